"""Mixing sources to target weights, by Pivotal dependent rounding in a reduction tree.

Every document gets an expected number of copies, its source's target over its source's size. The whole part
is taken at once; the fractional parts are rounded by the Pivotal method: two documents at a time, mass (words)
moves from one to the other in a random direction until one of them is integral, which keeps both
expectations and the sum of words of the pair. What stays fractional meets again one level up: a level deals
the open documents of a source into buckets of about FAN documents, each bucket folds to at most one open
document, so a source of n documents takes log(n) / log(FAN) levels, and the sum of words taken differs from
the target by less than one document of the source. Only DataFrame functions run.

Defined results: a null text has size 0; documents of size 0 take 0 words; repeated rows are documents of their
own; a null source is a source of its own, the last in order; an empty table gives an empty result; other
columns of the input play no part in the plan and come back unchanged from `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyscan.llm.common import WORD, shared_table

#: Documents of a bucket, on average.
FAN = 48
#: What the sources weigh, in order of their names and over again.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target stops at so many times its source's size.
CAP = 3.0


def size_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, n, source_size) -> the same with `target`: one row a source, so windows over all of them are small.

    All sizes are shared by weight; a target stops at cap times its size and its excess goes to the others by
    weight. The shares end at a level L with target = min(L * weight, cap * size); in order of cap * size /
    weight the capped sources come first, so L follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", cap * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source in this order that the level does not fill to its cap sets the level for all after it
    s = s.withColumn("open", F.col("level") * F.col("w") < F.col("most"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("w")).alias("k"), F.col("level").alias("v")))).over(everything)["v"]
    s = s.withColumn("target", F.coalesce(F.least(level * F.col("w"), F.col("most")), F.col("most")))
    return s.select("source", "n", "source_size", F.col("target").cast("double").alias("target"))


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the given columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def _fold(docs: Column, seed: int) -> Column:
    """Folds an array of open documents (id, size, k, p) to `done` and, if one stays fractional, `rest`."""

    def step(acc, x):
        c = acc["rest"]
        up = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])  # words that may move to c
        down = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])  # words that may move to x
        to_c = _unit(c["id"], c["k"], c["size"], x["id"], x["k"], x["size"], F.lit(seed)) * (up + down) < down
        filled = (1 - c["p"]) * c["size"] <= x["p"] * x["size"]
        emptied = c["p"] * c["size"] <= (1 - x["p"]) * x["size"]
        # (who is done, as what, who stays, at what p)
        c_done = F.when(to_c, filled).otherwise(emptied)
        done_p = F.when(to_c, F.when(filled, 1.0).otherwise(0.0)).otherwise(F.when(emptied, 0.0).otherwise(1.0))
        left = F.when(
            to_c, F.when(filled, x["p"] - up / x["size"]).otherwise(c["p"] + up / c["size"])
        ).otherwise(F.when(emptied, x["p"] + down / x["size"]).otherwise(c["p"] - down / c["size"]))
        gone, stays = F.when(c_done, c).otherwise(x), F.when(c_done, x).otherwise(c)
        put = lambda d, p: F.struct(d["id"].alias("id"), d["size"].alias("size"), d["k"].alias("k"), p.cast("double").alias("p"))
        both = F.struct(F.concat(acc["done"], F.array(put(gone, done_p))).alias("done"), put(stays, F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))).alias("rest"))
        first = F.struct(acc["done"].alias("done"), put(x, x["p"]).alias("rest"))
        return F.when(c.isNull(), first).otherwise(both)

    kind = "array<struct<id:bigint,size:bigint,k:bigint,p:double>>"
    one = "struct<id:bigint,size:bigint,k:bigint,p:double>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast(one).alias("rest"))
    return F.aggregate(docs, start, lambda acc, x: step(acc, x).cast(f"struct<done:{kind},rest:{one}>"))


def plan(spark: SparkSession, rows: DataFrame, seed: int = 7, fan: int = FAN, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """rows (id long, source string, size long), one a document -> (id, k, source, size, source_size, target, copies).

    k tells equal rows apart. Reruns agree: the draws hash ids, sizes and the seed.
    """
    classes = shared_table(spark, rows.groupBy("source", "id", "size").agg(F.count("*").alias("m")), "mix")
    by_source = classes.groupBy("source").agg(F.sum("m").alias("n"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    goals = shared_table(spark, targets(by_source, weights, cap), "mix")
    # The join is on the source, of which one may hold most rows: Spark broadcasts `goals` if its size allows, else splits the join
    docs = classes.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).alias("d")
    docs = docs.join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("id", "k", "d.source", "size", "n", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    docs = docs.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)))
    docs = docs.withColumn("base", F.floor("rate")).withColumn("p", F.col("rate") - F.col("base")).drop("rate")
    keep = ["id", "k", "source", "size"]
    parts = [docs.where("p <= 0").select(*keep, F.lit(0.0).alias("p"))]
    open_ = docs.where("p > 0").select(*keep, "p")
    most = goals.agg(F.max("n")).first()[0] or 0
    level, made = 0, [classes, goals]
    while True:
        width = max(1, -(-most // fan)) if most > fan else 1
        bucket = F.pmod(F.xxhash64("id", "k", "size", F.lit(seed + level)), F.lit(width)) if width > 1 else F.lit(0)
        if level == 0 and width > 1:  # buckets by each source's own number of documents
            sized = docs.where("p > 0").select(*keep, "p", F.greatest(F.lit(1), F.ceil(F.col("n") / fan)).alias("width"))
            open_ = sized.withColumn("bucket", F.pmod(F.xxhash64("id", "k", "size", F.lit(seed)), F.col("width"))).drop("width")
        else:
            open_ = open_.withColumn("bucket", bucket)
        # Long documents first: what stays open at the end is then rather a short one
        order = F.struct((-F.col("size")).alias("by"), F.xxhash64("id", "k", F.lit(~seed)).alias("h"), *[F.col(c) for c in ("id", "size", "k", "p")])
        grouped = open_.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(order)).alias("docs"))
        folded = grouped.withColumn("f", _fold(F.transform("docs", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["k"].alias("k"), x["p"].alias("p"))), seed + 31 * level))
        both = folded.select("source", F.explode(F.concat(F.transform("f.done", lambda x: F.struct(x.alias("d"), F.lit(False).alias("open"))), F.array(F.struct(F.col("f.rest").alias("d"), ((F.col("f.rest.p") > 0) & (F.col("f.rest.p") < 1)).alias("open"))))).alias("x")).where("x.d IS NOT NULL")
        out = shared_table(spark, both.select("x.d.id", "x.d.k", "source", "x.d.size", "x.d.p", "x.open"), "mix")
        made.append(out)
        parts.append(out.where("NOT open").select(*keep, "p"))
        open_ = out.where("open").select(*keep, "p")
        if width == 1:
            break
        most, level = width, level + 1
    # One document of a source may stay open: it goes to the nearer side
    parts.append(open_.select(*keep, F.when(F.col("p") > 0.5, 1.0).otherwise(0.0).alias("p")))
    done = parts[0]
    for x in parts[1:]:
        done = done.unionByName(x)
    done = done.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    base = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return done.select("id", "k", "d.source", "size", "source_size", "target", (base + F.round("p")).cast("long").alias("copies"))


def mix(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the plan takes it; the columns of docs."""
    key = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(docs.columns)])
    keyed = docs.withColumns({"__key": key, "__size": size_of(F.col(text))})
    rows = keyed.select(F.col("__key").alias("id"), F.col(source).alias("source"), F.col("__size").alias("size"))
    taken = plan(spark, rows, seed).groupBy("id", "size").agg(F.count("*").alias("__m"), F.sum("copies").alias("__copies"))
    taken = taken.where("__copies > 0").select(F.col("id").alias("__key"), F.col("size").alias("__size"), "__m", "__copies")
    joined = keyed.join(taken, ["__key", "__size"])
    # Equal rows share a key: one of them stands for all
    once = joined.where("__m = 1")
    many = joined.where("__m > 1").groupBy("__key", "__size").agg(*[F.first(f"`{c}`").alias(c) for c in docs.columns], F.first("__copies").alias("__copies"))
    out = once.select(*[f"`{c}`" for c in docs.columns], "__copies").unionByName(many.select(*[f"`{c}`" for c in docs.columns], "__copies"))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*[f"`{c}`" for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), "source", size_of(F.col("text")).alias("size"))
    taken = plan(spark, rows)
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
