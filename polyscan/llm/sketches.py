"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut after every PIECE words; its digest is a 64-bit hash, and a document is the set of its digests.
A sketch has three sub-tables of CELLS cells; each digest is in one cell of each, and a cell keeps the number of its digests, their
XOR, and the XOR of their check hashes. Two sketches subtract cell by cell: what both documents have cancels. A cell left with
one digest (its check agrees) names it; peeling takes it out of its other cells, which frees more. If cells stay, the sketches
were too small for the difference, and the pair is retried larger: with as many sketches as hold PER digests each, chosen by
the digest's highest bits. Of these, any that stays stuck grows again, 2 ** SPLIT times at each step, until all is recovered.
No single sketch has to hold more than a few digests, so the work is in proportion to the digests, however long the text. The
digests recovered give the likeness of the two sets, the part of their union that they share.

The fingerprint as a string is the first sketch, in hexadecimal: the number of digests, and number, XOR and check of every
cell. It is what is subtracted first; `parse` reads it back.

Only DataFrame functions run. Documents are ordered by descending id in buckets at quantiles of the ids. That takes one shuffle of the texts;
the sketches of the retry are summed, and joined to their documents, by bucket, where they lie. Defined results: a null text is empty, an empty text has no digests, two empty ones are alike
(1.0); a text may be of any length that fits a task; repeated rows are documents of their own; equal ids are in the order of a text
hash, and a frequent id is spread over buckets by that hash; null ids come last; of a single document the next is itself; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyscan.llm.common import shared_table

PIECE = 16
#: Cells of a sub-table (a power of two), digests of two documents that a sketch of the first retry has at most on average,
#: bits that divide a stuck sketch, and how often: all bits but those of the cells.
CELLS, PER, SPLIT, LEVELS = 4, 2, 4, 14
#: Documents of one ordered bucket at least, and buckets for each shuffle partition at most.
BUCKET_ROWS, BUCKETS_PER_TASK = 1000, 8
LONGS = "array<bigint>"
CELL = "struct<n:int,key:bigint,check:bigint>"
PEELED = f"struct<cells:array<{CELL}>,a:{LONGS},b:{LONGS},done:boolean>"
OPEN = f"array<struct<a:{LONGS},b:{LONGS}>>"
STATE = f"struct<open:{OPEN},a:{LONGS},b:{LONGS}>"


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?:\S++[^\S\n]*+){{1,{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _bits(key: Column, shift, n: int) -> Column:
    return F.call_function("shiftrightunsigned", key, shift if isinstance(shift, Column) else F.lit(shift)).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _place(key: Column, t: int) -> Column:
    """The cell of a digest in sub-table t: other bits of the digest for each."""
    n = CELLS.bit_length() - 1
    return _bits(key, t * n, n)


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _xor(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(d))


def sketch(keys: Column) -> Column:
    """The 3 * CELLS cells of an array of distinct digests (a column or lambda variable, as it is read once a cell)."""

    def table(t: int) -> Column:
        def cell(pos: Column) -> Column:
            return _let(F.filter(keys, lambda d: _place(d, t) == pos), lambda own: F.struct(F.size(own).alias("n"), _xor(own).alias("key"), _xor(F.transform(own, _check)).alias("check")))

        return F.transform(F.array(*[F.lit(p).cast("long") for p in range(CELLS)]), cell)

    return F.concat(*[table(t) for t in range(3)]).cast(f"array<{CELL}>")


def _minus(x: Column, y: Column) -> Column:
    return F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check"))


def subtract(a: Column, b: Column) -> Column:
    """One sketch less another, cell by cell."""
    return F.zip_with(a, b, _minus)


def peel(cells: Column) -> Column:
    """struct(cells, a, b, done): what stays, and the digests recovered that only the first or only the second sketch has."""

    def step(s: Column, _: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"]))

        def without(found: Column) -> Column:
            def table(t: int) -> Column:
                def cell(c: Column, pos: Column) -> Column:
                    return F.aggregate(F.filter(found, lambda d: _place(d["key"], t) == pos.cast("long")), c, lambda x, d: _minus(x, d).cast(CELL))

                return F.transform(F.slice(s["cells"], t * CELLS + 1, CELLS), cell)

            of = lambda n: F.transform(F.filter(found, lambda d: d["n"] == n), lambda d: d["key"])
            some = F.struct(F.concat(*[table(t) for t in range(3)]).alias("cells"), F.concat(s["a"], of(1)).alias("a"), F.concat(s["b"], of(-1)).alias("b"), F.lit(False).alias("done"))
            none = F.struct(s["cells"].alias("cells"), s["a"].alias("a"), s["b"].alias("b"), F.lit(True).alias("done"))
            return F.when(F.size(found) > 0, some.cast(PEELED)).otherwise(none.cast(PEELED))

        return F.when(s["done"], s).otherwise(_let(F.array_distinct(pure), without))

    empty = F.array().cast(LONGS)
    start = F.struct(cells.alias("cells"), empty.alias("a"), empty.alias("b"), F.lit(False).alias("done")).cast(PEELED)
    return F.aggregate(F.sequence(F.lit(0), F.lit(3 * CELLS)), start, step)


def stuck(cells: Column) -> Column:
    return F.exists(cells, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))


def differences(a: Column, b: Column) -> Column:
    """struct(a, b): the digests that only the array a and only b has, by sketches of 2 ** SPLIT times as many cells at each step."""

    def grow(s: Column, level: Column) -> Column:
        def divide(x: Column) -> Column:
            low = 3 * (CELLS.bit_length() - 1)
            part = lambda keys, v: F.filter(keys, lambda d: _bits(d, (level * SPLIT + (low - SPLIT)).cast("int"), SPLIT) == v)
            return F.transform(F.array(*[F.lit(v).cast("long") for v in range(1 << SPLIT)]), lambda v: F.struct(part(x["a"], v).alias("a"), part(x["b"], v).alias("b")))

        def attempt(x: Column) -> Column:
            return _let(peel(subtract(sketch(x["a"]), sketch(x["b"]))), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.when(stuck(p["cells"]), x).alias("x")))

        def gather(tried: Column) -> Column:
            good = F.filter(tried, lambda r: r["x"].isNull())
            left = F.transform(F.filter(tried, lambda r: r["x"].isNotNull()), lambda r: r["x"])
            joined = lambda n: F.concat(s[n], F.flatten(F.transform(good, lambda r: r[n])))
            return F.struct(left.alias("open"), joined("a").alias("a"), joined("b").alias("b")).cast(STATE)

        parts = F.filter(F.flatten(F.transform(s["open"], divide)), lambda x: (F.size(x["a"]) > 0) | (F.size(x["b"]) > 0))
        return F.when(F.size(s["open"]) == 0, s).otherwise(_let(F.transform(parts, attempt), gather))

    def rest(s: Column) -> Column:  # digests alike in all bits that divide them: taken apart exactly
        only = lambda x, y: F.concat(s[x], F.flatten(F.transform(s["open"], lambda o: F.array_except(o[x], o[y]))))
        return F.struct(only("a", "b").alias("a"), only("b", "a").alias("b"))

    empty = F.array().cast(LONGS)
    start = F.struct(F.array(F.struct(a.alias("a"), b.alias("b"))).alias("open"), empty.alias("a"), empty.alias("b")).cast(STATE)
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, grow), rest)


def fingerprint(keys: Column, cells: Column) -> Column:
    """A sketch as text: the number of digests, and of each cell the number, the XOR and the check."""
    text = lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["check"]), 16, "0"))
    return F.lower(F.concat(F.lpad(F.hex(F.size(keys)), 8, "0"), F.concat_ws("", F.transform(cells, text))))


def parse(text: str) -> tuple[int, list[tuple[int, int, int]]]:
    """The number of digests and the cells (number, XOR, check) of a fingerprint."""
    cells = [text[i : i + 40] for i in range(8, len(text), 40)]
    return int(text[:8], 16), [(int(c[:8], 16), int(c[8:24], 16), int(c[24:], 16)) for c in cells]


def likeness(na: Column, nb: Column, differ: Column) -> Column:
    """Shared part of the union of two sets that differ in so many members."""
    return F.when(na + nb == 0, 1.0).otherwise((na + nb - differ) / (na + nb + differ)).cast("double")


def _bucket(id: Column, bounds: list[int]) -> Column:
    """The number of bounds above id, by binary search; null ids come after all."""
    array = F.from_json(F.lit(str(sorted(bounds))), LONGS)
    n = len(bounds)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))  # bounds[:lo] <= id < bounds[hi:]

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.get(array, mid) <= id
        return F.when(s["lo"] >= s["hi"], s).when(low, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, halve)["lo"]
    return F.when(id.isNull(), F.lit(n + 1)).otherwise(F.lit(n) - found)


def _spread(id: Column, h: Column, heavy: dict[int | None, int]) -> Column:
    """Of a frequent id the part, from 1, by descending hash; 0 for all others, which come before it in its bucket."""
    out = F.lit(0)
    for value, parts in heavy.items():
        part = F.lit(parts) - F.floor((h.cast("double") / 2.0**64 + 0.5) * parts).cast("int")
        out = F.when(id.isNull() if value is None else id == value, F.greatest(F.lit(1), part)).otherwise(out)
    return out


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (id, text) -> with bucket and rn, which name a row, a (digests), next and next_a: text and digests of the next document by descending id.

    The order is cut into buckets at quantiles of the ids, as many as the session's shuffle partitions call for, so no task
    orders all documents; the last of a bucket sees the first of the next bucket as an extra row.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    buckets = max(1, min(BUCKETS_PER_TASK * tasks, n // BUCKET_ROWS))
    found = [] if buckets == 1 else docs.agg(F.percentile_approx("id", [k / buckets for k in range(1, buckets)], max(10_000, 10 * buckets))).first()[0] or []
    heavy = {v: k for v, k in ((v, found.count(v)) for v in sorted({x for x, y in zip(found, found[1:]) if x == y})) if k > 1}
    if buckets > 1 and nulls * buckets > n:
        heavy[None] = -(-nulls * buckets // n)
    bounds = sorted(set(found))
    h = F.xxhash64("text")
    dealt = docs.select("id", "text", h.alias("h"), F.struct((_bucket(F.col("id"), bounds) if bounds else F.when(F.col("id").isNull(), 1).otherwise(0)).alias("b"), _spread(F.col("id"), h, heavy).alias("s")).alias("bucket"))
    # One row a bucket: who comes first in it, and which bucket is before it
    firsts = dealt.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("f"))
    order, all_ = Window.orderBy("bucket"), Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(all_)).alias("into"), F.col("f.id").alias("id"), F.col("f.h").alias("h"))
    firsts = shared_table(spark, firsts, "firsts")
    seen = dealt.select("id", "text", "h").alias("d").join(F.broadcast(firsts).alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.h") == F.col("f.h")))
    extra = seen.groupBy("into").agg(F.first("text").alias("text")).select(F.lit(None).cast("long").alias("id"), "text", F.lit(0).cast("long").alias("h"), F.col("into").alias("bucket"), F.lit(True).alias("extra"))
    both = dealt.withColumn("extra", F.lit(False)).unionByName(extra)
    both = both.repartition(tasks, "bucket").withColumn("a", digests(F.col("text")))  # digests are made behind the shuffle
    w = Window.partitionBy("bucket").orderBy("extra", F.col("id").desc_nulls_last(), F.col("h").desc())
    return both.select("bucket", F.row_number().over(w).alias("rn"), "id", "text", "a", "extra", F.lead("text").over(w).alias("next"), F.lead("a").over(w).alias("next_a")).where("NOT extra").drop("extra")


def _number(na: Column, nb: Column) -> Column:
    """The bits that choose one of a retry's sketches for documents of so many digests."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), na + nb) / PER))).cast("int")


def _which(key: Column, number: Column) -> Column:
    """The sketch of a digest, by its highest bits."""
    return F.when(number == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, F.lit(64) - number))


def larger(pairs: DataFrame) -> DataFrame:
    """pairs (bucket, rn, pair, a, b) -> (bucket, rn, pair, differ, stuck): digests recovered, and the sketches that stay stuck.

    Each digest counts in a's sketch less b's; the sums need no shuffle, as the rows lie by bucket.
    """
    sign = lambda n: lambda d: F.struct(F.lit(n).alias("s"), d.alias("d"))
    each = pairs.select("bucket", "rn", "pair", _number(F.size("a"), F.size("b")).alias("number"), F.explode(F.concat(F.transform("a", sign(1)), F.transform("b", sign(-1)))).alias("x"))
    each = each.select("bucket", "rn", "pair", _which(F.col("x.d"), F.col("number")).alias("sketch"), F.col("x.s").alias("s"), F.col("x.d").alias("d"), _check(F.col("x.d")).alias("c"), *[_place(F.col("x.d"), t).alias(f"p{t}") for t in range(3)])
    places = [(t, pos) for t in range(3) for pos in range(CELLS)]
    sums = []
    for t, pos in places:
        here = lambda c, t=t, pos=pos: F.when(F.col(f"p{t}") == pos, F.col(c)).otherwise(F.lit(0))
        sums += [F.sum(here("s")).cast("int").alias(f"n{t}_{pos}"), F.bit_xor(here("d")).alias(f"k{t}_{pos}"), F.bit_xor(here("c")).alias(f"c{t}_{pos}")]
    summed = each.groupBy("bucket", "rn", "pair", "sketch").agg(*sums)
    # Where each cell of a sub-table has one digest at most, peeling ends at once: they are all in it
    n, key, check = (lambda t, pos, k=k: F.col(f"{k}{t}_{pos}") for k in "nkc")
    read_off = F.lit(None).cast("int")
    for t in range(3):
        clean = F.lit(True)
        for pos in range(CELLS):
            clean = clean & (((n(t, pos) == 0) & (key(t, pos) == 0) & (check(t, pos) == 0)) | ((F.abs(n(t, pos)) == 1) & (_check(key(t, pos)) == check(t, pos))))
        read_off = F.when(clean, sum(F.abs(n(t, pos)) for pos in range(CELLS))).otherwise(read_off)
    cells = F.array(*[F.struct(n(t, pos).alias("n"), key(t, pos).alias("key"), check(t, pos).alias("check")) for t, pos in places]).cast(f"array<{CELL}>")
    peeled = _let(peel(F.col("cells")), lambda p: F.when(~stuck(p["cells"]), F.size(p["a"]) + F.size(p["b"])))
    done = summed.select("bucket", "rn", "pair", "sketch", read_off.alias("differ"), F.when(read_off.isNull(), cells).alias("cells"))
    done = done.select("bucket", "rn", "pair", "sketch", F.when(F.col("cells").isNull(), F.col("differ")).otherwise(peeled).alias("differ"))
    return done.groupBy("bucket", "rn", "pair").agg(F.coalesce(F.sum("differ"), F.lit(0)).alias("differ"), F.collect_list(F.when(F.col("differ").isNull(), F.col("sketch"))).alias("stuck"))


def _after(x: Column, b: str, found: Column) -> Column:
    """Digests that differ between the arrays x.a and x[b], what stayed stuck at the retry included."""

    def rest(number: Column) -> Column:
        own = lambda keys: F.filter(keys, lambda d: F.array_contains(found["stuck"], _which(d, number)))
        return _let(differences(own(x["a"]), own(x[b])), lambda d: F.size(d["a"]) + F.size(d["b"]))

    more = F.when(F.size(found["stuck"]) > 0, _let(_number(F.size(x["a"]), F.size(x[b])), rest)).otherwise(0)
    return F.when(found.isNotNull(), found["differ"] + more)


def fingerprints(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))

    # Each step binds what the next one reads, as one expression, so that Spark works it out once
    def of_texts(e: Column) -> Column:
        return F.struct(F.col("id"), n.cast("long").alias("n_chars"), F.sha2(e.cast("binary"), 256).alias("sha"), F.col("a"), digests(e).alias("e"), F.col("next_a").alias("x"))

    def of_digests(x: Column) -> Column:
        return F.struct(x.alias("x"), sketch(x["a"]).alias("a"), sketch(x["e"]).alias("e"), sketch(x["x"]).alias("next"))

    def of_sketches(s: Column) -> Column:
        differ = lambda o: _let(peel(subtract(s["a"], s[o])), lambda p: F.when(~stuck(p["cells"]), F.size(p["a"]) + F.size(p["b"])))
        return F.struct(s["x"].alias("x"), s["a"].alias("sa"), s["e"].alias("se"), differ("e").alias("d0"), differ("next").alias("d1"))

    ordered = with_next(spark, base).select("bucket", "rn", _let(_let(_let(edited, of_texts), of_digests), of_sketches).alias("h"))
    open_ = F.filter(
        F.array(F.struct(F.lit(0).alias("pair"), F.col("h.x.a").alias("a"), F.col("h.x.e").alias("b"), F.col("h.d0").alias("d")), F.struct(F.lit(1).alias("pair"), F.col("h.x.a").alias("a"), F.col("h.x.x").alias("b"), F.col("h.d1").alias("d"))),
        lambda p: p["d"].isNull(),
    )
    pairs = ordered.select("bucket", "rn", F.explode(open_).alias("p")).select("bucket", "rn", "p.pair", "p.a", "p.b")
    of_pair = lambda k: F.when(F.col("pair") == k, F.struct("differ", "stuck"))
    found = larger(pairs).select("bucket", "rn", F.lit(None).cast(ordered.schema["h"].dataType).alias("h"), of_pair(0).alias("f0"), of_pair(1).alias("f1"))
    none = F.lit(None).cast(found.schema["f0"].dataType)
    rows = ordered.select("bucket", "rn", "h", none.alias("f0"), none.alias("f1")).unionByName(found)
    whole = rows.groupBy("bucket", "rn").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("h", "f0", "f1")])

    def made(x: Column) -> Column:
        near = lambda b, d, f: _let(F.coalesce(F.col(d), _after(x, b, F.col(f))), lambda k: likeness(F.size(x["a"]), F.size(x[b]), k))
        return F.struct(
            x["id"].alias(id), x["n_chars"].alias("n_chars"), x["sha"].alias("edited_sha256"), fingerprint(x["a"], F.col("h.sa")).alias("fingerprint"),
            fingerprint(x["e"], F.col("h.se")).alias("edited_fingerprint"), near("e", "h.d0", "f0").alias("near_edited"), near("x", "h.d1", "f1").alias("near_next"),
        )

    done = whole.select(_let(F.col("h.x"), made).alias("made"))
    return done.select(*[F.col("made")[c].alias(c) for c in (id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
