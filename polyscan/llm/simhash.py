"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two link if at most RADIUS = 4 bits differ, and the classes are the connected
components of the links. Two fingerprints within 4 bits share a variant within half the radius, 2 bits, of
each; all fingerprints that share such a variant are within 4 bits of one another, so a bucket needs no pairs:
a star to its smallest member has the same components.

Emitting all 2,081 variants of every fingerprint would move 33 KB a document, so the ball is first hashed in
projection: of three bit blocks, two differ in at most floor(2 * 4 / 3) = 2 bits between linked fingerprints,
hence the projections on these two blocks share a variant within 1 bit. Each fingerprint emits its 131 variants
of the three projections; colliding pairs are verified over all 64 bits within buckets of up to BUCKET
fingerprints. The members of any larger bucket go through the full 2-bit ball, which is exact and linear in a
bucket's size. No link is lost either way, and equal fingerprints are merged before, so thousands of exact
copies are one fingerprint here.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links like any other;
a null doc_id links too, and a component of null ids alone has a null component_id; repeated rows stay rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyscan.llm.common import BLOCKS, blocks, components, local_roots, shared_table, unblock

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Up to so many fingerprints of a projected bucket are compared with each other; larger buckets go through the full ball.
BUCKET = 64
#: Records of a shuffled block group, on average.
GROUP = 250_000
PAIR = np.dtype([("key", "<u8"), ("fp", "<u8")])


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of the words' shingles; bytes.split() and bytes.lower() know ASCII only."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The kept columns with `fp`, the fingerprint as a signed long."""
    keep = list(keep)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(fps)], [*keep, "fp"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{kinds}, fp long")


def flips(bits: list[int], most: int) -> np.ndarray:
    """All masks of up to `most` of the given bit positions."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], np.uint64)


def _emit(keyed, parts: int):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2000):
                out = np.concatenate([x for x in keyed(fps[at : at + 2000])])
                yield blocks(out["key"], out, parts)

    return run


def projected_keys(radius: int):
    """fps -> records of every variant of each projection on two of three blocks."""
    cuts = [list(range(0, 21)), list(range(21, 42)), list(range(42, 64))]
    most = -(-(2 * radius // 3) // 2)
    plans = [(np.uint64(sum(1 << b for b in a + b_)), flips(a + b_, most)) for a, b_ in combinations(cuts, 2)]

    def keyed(fps):
        for n, (mask, masks) in enumerate(plans):
            out = np.empty((len(fps), len(masks)), PAIR)
            # the block left out is zero in a key: the number of the projection goes to its lowest and highest bits
            tag = np.uint64([3 << 62, 2 << 30, 1][n])
            out["key"] = ((fps & mask)[:, None] ^ masks[None, :]) ^ tag
            out["fp"] = fps[:, None]
            yield out.ravel()

    return keyed


def full_keys(radius: int):
    masks = flips(list(range(64)), radius // 2)

    def keyed(fps):
        for at in range(0, len(fps), 200):
            f = fps[at : at + 200]
            out = np.empty((len(f), len(masks)), PAIR)
            out["key"] = f[:, None] ^ masks[None, :]
            out["fp"] = f[:, None]
            yield out.ravel()

    return keyed


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of fps[i] and fps[j] as stars: every linked fingerprint with the root of its component in this task."""
    names, inverse = np.unique(fps, return_inverse=True)
    root = local_roots(len(names), inverse[i], inverse[j])
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _verify(radius: int, bucket: int):
    """Verified links of small buckets as a-b; a member of a larger bucket as a-a."""

    def run(table: pa.Table) -> pa.Table:
        x = unblock(table, PAIR)
        x = x[np.argsort(x["key"], kind="stable")]
        key, fp = x["key"], x["fp"]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        size = np.repeat(sizes, sizes)
        big = np.unique(fp[size > bucket])
        some = (size > 1) & (size <= bucket)
        key, fp = key[some], fp[some]
        ii, jj = [], []
        at = np.arange(len(key))
        for d in range(1, bucket):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            near = at[(np.bitwise_count(fp[at] ^ fp[at + d]) <= radius) & (fp[at] != fp[at + d])]
            ii.append(near)
            jj.append(near + d)
        a, b = _links(fp, np.concatenate(ii), np.concatenate(jj)) if ii else (fp[:0], fp[:0])
        return pa.table([pa.array(np.r_[a, big].view(np.int64)), pa.array(np.r_[b, big].view(np.int64))], schema=LINKS)

    return run


def _stars(table: pa.Table) -> pa.Table:
    """Links of full-ball buckets: members within half the radius of one variant are within the radius of each other."""
    x = unblock(table, PAIR)
    x = x[np.argsort(x["key"], kind="stable")]
    same = np.flatnonzero(x["key"][1:] == x["key"][:-1])
    a, b = _links(x["fp"], same, same + 1)
    return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=LINKS)


def links(spark: SparkSession, fps: DataFrame, n: int, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """fps: n distinct fingerprints (fp) -> (a, b) whose connected components are those of all links."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is the radius of the balls")
    parts = max(48, n * 131 // GROUP)
    first = fps.select("fp").mapInArrow(_emit(projected_keys(radius), parts), BLOCKS).groupBy("part").applyInArrow(_verify(radius, bucket), "a long, b long")
    first = shared_table(spark, first, "links")
    big = shared_table(spark, first.where("a = b").select(F.col("a").alias("fp")).distinct(), "big", n)
    many = big.count()
    out = first.where("a <> b")
    if many:
        parts = max(48, many * 2081 // GROUP)
        second = big.repartition(max(1, many // 500), "fp").mapInArrow(_emit(full_keys(radius), parts), BLOCKS).groupBy("part").applyInArrow(_stars, "a long, b long")
        out = out.unionByName(second)
    return out


def classes(spark: SparkSession, fps: DataFrame, radius: int = RADIUS, id: str = "doc_id") -> DataFrame:
    """fps (id, fp) -> one row a distinct fingerprint: fp, component_id (the smallest id of its component)."""
    reps = shared_table(spark, fps.groupBy("fp").agg(F.min(id).alias("low")), "fps")
    n = reps.count()
    joined = components(spark, links(spark, reps, n, radius))
    rooted = reps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = shared_table(spark, rooted, "rooted", n)
    low = shared_table(spark, rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows", n)
    return rooted.select("fp", "root").join(low, "root").select("fp", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id."""
    fps = shared_table(spark, fingerprints(docs, text, (id,)), "docfps")
    found = shared_table(spark, classes(spark, fps, radius, id), "classes")
    return fps.join(found, "fp").select(id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component: that of the smallest id, among equal ids of the smallest row hash; columns of docs."""
    key = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(docs.columns)])
    keyed = docs.withColumn("__key", key)
    fps = shared_table(spark, fingerprints(keyed, text, (id, "__key")), "docfps")
    best = F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("__key").alias("key")))
    reps = shared_table(spark, fps.groupBy("fp").agg(best.alias("best"), F.count("*").alias("m")), "fps")
    n = reps.count()
    joined = components(spark, links(spark, reps, n, radius))
    rooted = reps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = shared_table(spark, rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias("__key")), "kept", n)
    out = keyed.join(kept, "__key", "left_semi")
    # Equal rows share a key; one of them stays
    twice = shared_table(spark, fps.groupBy("__key").agg(F.count("*").alias("m")).where("m > 1").select("__key"), "twice")
    once = out.join(twice, "__key", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return out.select(docs.columns)
    many = out.join(twice, "__key", "left_semi").groupBy("__key").agg(*[F.first(f"`{c}`").alias(c) for c in docs.columns])
    return once.unionByName(many.select(docs.columns))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
