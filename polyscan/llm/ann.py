"""Approximate nearest neighbours by inverted file and product quantisation.

Coarse centroids and the codebooks of the residuals are fit on a sample (the smallest hashes of id): SAMPLE vectors, or
TRAIN for each list where that is more, so at most MOST_LISTS * TRAIN. Every distinct vector is indexed: its list, the codes of its residual, its
ids. A query ranks the centroids by inner product and probes the first lists; in each block of a list it
scores all vectors by asymmetric distance tables (the inner product with the centroid plus one table entry per
code), and the best RERANK of a block, with all that come within the tables' usual error of the (k + 1)st, are scored
exactly in double precision. The best of all blocks are the answer.

How many lists to probe depends on how well the vectors fall into lists, so it is measured: TUNE of the sample's vectors are
searched by brute force in the sample, and the probes are as many as hold COVER of their true neighbours.

Equal vectors are one index entry with its COPIES smallest ids, which is all an answer can hold, so a vector of a third of all
rows costs one entry; equal queries are searched once. A long list is cut into blocks of BLOCK entries, each a
task's group of its own; where more than SLOT queries probe a block, they are dealt to slots, and the block goes to each slot.

Defined results: null, zero or differently long vectors, and those with null or non-finite components, take no part;
the length is that of most of the sampled vectors. Fewer candidates than k are all returned. Repeated rows count once as a
candidate. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyscan.llm.common import shared_table

K = 20
SAMPLE = 20_000
#: Lists grow as the root of the entries up to this bound, and sampled vectors of a list.
MOST_LISTS, TRAIN = 65_536, 8
#: Vectors of a list, on average, and of a block at most; a block's vectors scored exactly for a query.
LIST, BLOCK, RERANK = 800, 2048, 60
#: A query's probes hold at least so many entries, so small tables are searched whole.
REACH = 4000
#: Sampled queries that fix the number of probes, and the part of their neighbours that the probes must hold.
TUNE, COVER = 400, 0.97
#: Queries of a block that one task answers, on average, and rows of queries by lists ranked at once.
SLOT, RANKED = 4096, 256
COPIES = K + 1
SUB, WORDS = 4, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Up to k centroids of the rows of x (Lloyd); empty ones move to random rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        count = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, weights=x[:, d], minlength=k) for d in range(x.shape[1])], 1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of every row."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    """Centroids and codebooks of vectors of `dim` components."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.parts = -(-self.dim // SUB)
        self.centroids = kmeans(sample, lists)
        rest = self.padded(sample - self.centroids[nearest(sample, self.centroids)])
        self.books = [kmeans(rest[:, m * SUB : (m + 1) * SUB], WORDS, 6) for m in range(self.parts)]
        few = sample[np.random.default_rng(3).choice(len(sample), min(1000, len(sample)), replace=False)]
        own, codes = self.encode(few)
        q = few[:100]
        coded = self.centroids[own] + np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)[:, : self.dim]
        self.error = float(np.std(q @ (few - coded).T))  # of an approximate inner product

    def probes(self, sample: np.ndarray, k: int) -> int:
        """Lists to probe so that COVER of the k nearest within the sample are in them."""
        q = sample[np.random.default_rng(2).choice(len(sample), min(TUNE, len(sample)), replace=False)]
        own = nearest(sample, self.centroids)
        rank = np.argsort(np.argsort(-(q @ self.centroids.T), axis=1, kind="stable"), axis=1)
        k = min(k + 1, len(sample))
        depth = [rank[i][own[np.argpartition(-(sample @ v), k - 1)[:k]]] for i, v in enumerate(q)]
        return int(np.quantile(np.concatenate(depth), COVER)) + 1

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * SUB - self.dim)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centroids)
        rest = self.padded(x - self.centroids[own])
        codes = [nearest(rest[:, m * SUB : (m + 1) * SUB], b) for m, b in enumerate(self.books)]
        return own, np.stack(codes, 1).astype(np.uint8) if len(x) else np.zeros((0, self.parts), np.uint8)

    def approximate(self, q: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of the queries with a list's vectors by their codes."""
        out = np.repeat((q @ self.centroids[list_])[:, None], len(codes), axis=1)
        padded = self.padded(q)
        for m, book in enumerate(self.books):
            out += (padded[:, m * SUB : (m + 1) * SUB] @ book.T)[:, codes[:, m]]
        return out


def valid(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): the vectors that take part, as float64 bytes; ids may be null only to be left out."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not x or None in x:
                    continue
                x = np.array(x, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])

    return vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, v binary")


def _smallest(rows) -> dict[bytes, list[int]]:
    """v -> its COPIES smallest distinct ids."""
    out: dict[bytes, set[int]] = {}
    for v, i in rows:
        s = out.setdefault(v, set())
        s.add(i)
        if len(s) > 4 * COPIES:
            out[v] = set(sorted(s)[:COPIES])
    return {v: sorted(s)[:COPIES] for v, s in out.items()}


def distinct(rows: DataFrame) -> DataFrame:
    """(id, v) -> (v, ids): combined in each task before the shuffle, so a common vector arrives as a few rows."""

    def first(batches):
        for batch in batches:
            found = _smallest(zip(batch.column("v").to_pylist(), batch.column("id").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["v", "ids"])

    part = rows.mapInArrow(first, "v binary, ids array<long>")
    return part.groupBy("v").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, COPIES).alias("ids"))


def _vectors(column) -> np.ndarray:
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), np.float64).reshape(len(found), -1) if found else np.zeros((0, 0))


def search(spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = K, id: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """Queries: rows whose id is divisible by `every`. -> query_id, rank, vec_id, score."""
    if k + 1 > COPIES:
        raise ValueError(f"k is at most {COPIES - 1}")
    rows = shared_table(spark, valid(vectors, id, vector), "vectors")
    size = F.octet_length("v")
    lists_of = lambda n: max(1, min(MOST_LISTS, max(16, n // LIST), math.isqrt(n)))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, TRAIN * lists_of(rows.count())))
    sample = [(r.id, bytes(r.v)) for r in some.collect()]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    lengths = [len(v) for _, v in sample]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if len(set(lengths)) > 1 else lengths[0]
    rows = rows.where(size == width)
    entries = shared_table(spark, distinct(rows), "distinct")
    n = entries.count()
    x = np.stack([np.frombuffer(v) for _, v in sample if len(v) == width])
    x = np.unique(x, axis=0)
    index = Index(x, lists_of(n))
    probes = index.probes(x, k) if probes is None else probes

    def encode(batches):
        for batch in batches:
            own, codes = index.encode(_vectors(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["v", "ids", "list", "codes"])

    coded = shared_table(spark, entries.mapInArrow(encode, "v binary, ids array<long>, list int, codes binary"), "coded")
    counts = np.zeros(len(index.centroids), np.int64)
    for r in coded.groupBy("list").count().collect():  # one row a list
        counts[r["list"]] = r["count"]
    cut = np.maximum(1, -(-counts // BLOCK))

    def deal(batches):  # entries of a list to its blocks in turn
        seen: dict[int, int] = {}
        for batch in batches:
            out = []
            for l in batch.column("list").to_pylist():
                seen[l] = seen.get(l, -1) + 1
                out.append(seen[l] % int(cut[l]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "block"])

    def probe(batches):
        for batch in batches:
            q = _vectors(batch.column(0))
            lists, blocks, at = [], [], []
            if len(q):
                for first in range(0, len(q), RANKED):
                    order = np.argsort(-(q[first : first + RANKED] @ index.centroids.T), axis=1, kind="stable")
                    reach = np.cumsum(counts[order], axis=1)
                    enough = np.maximum(np.argmax(reach >= min(REACH, n), axis=1) + 1, min(probes, len(counts)))
                    for i, e in enumerate(enough, first):
                        for l in order[i - first, :e]:
                            if counts[l]:
                                lists += [int(l)] * int(cut[l])
                                blocks += range(int(cut[l]))
                                at += [i] * int(cut[l])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(lists, pa.int32()), pa.array(blocks, pa.int32())], ["q", "list", "block"])

    asked = rows.where(F.col("id") % every == 0)
    wanted = shared_table(spark, asked.select("v").distinct(), "queries")
    slots = max(1, -(-wanted.count() // SLOT))  # at least what any block needs, as every query may probe it
    queries = wanted.mapInArrow(probe, "q binary, list int, block int").withColumn("slot", F.pmod(F.xxhash64("q"), F.lit(slots)))
    dealt = coded.mapInArrow(deal, "v binary, ids array<long>, list int, codes binary, block int").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, scores, ids = [], [], []
        if left.num_rows and right.num_rows:
            names, q = left.column("q").to_pylist(), _vectors(left.column("q"))
            x, owned = _vectors(right.column("v")), right.column("ids").to_pylist()
            low = np.array([o[0] for o in owned])
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            for start in range(0, len(q), 256):
                near = index.approximate(q[start : start + 256], left.column("list")[0].as_py(), codes)
                for i, approx in enumerate(near):
                    if len(x) <= RERANK:
                        few = np.arange(len(x))
                    else:  # the best by the tables, and all that these can't tell from the (k + 1)st
                        best = np.partition(approx, (-RERANK, -k - 1))
                        few = np.flatnonzero(approx >= min(best[-RERANK], best[-k - 1] - index.error))
                    exact = (x[few] * q[start + i]).sum(axis=1)
                    best = np.lexsort((low[few], -exact))[: k + 1]
                    qs.append(names[start + i])
                    pairs = [(float(exact[b]), j) for b in best for j in owned[few[b]]]
                    scores.append([p[0] for p in pairs])
                    ids.append([p[1] for p in pairs])
        return pa.table([pa.array(qs, pa.binary()), pa.array(scores, pa.list_(pa.float64())), pa.array(ids, pa.list_(pa.int64()))], names=["q", "scores", "ids"])

    found = queries.groupBy("list", "block", "slot").cogroup(dealt.groupBy("list", "block", "slot")).applyInArrow(score, "q binary, scores array<double>, ids array<long>")
    best = found.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.transform(F.arrays_zip("scores", "ids"), lambda z: F.struct((-z["scores"]).alias("s"), z["ids"].alias("i")))))), 1, k + 1).alias("best"))
    joined = asked.select("id", F.col("v").alias("q")).distinct().join(shared_table(spark, best, "best"), "q")
    own = F.slice(F.filter("best", lambda z: z["i"] != F.col("id")), 1, k)
    out = joined.select(F.col("id").alias("query_id"), F.posexplode(own).alias("at", "z"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("z.i").alias("vec_id"), (-F.col("z.s")).alias("score"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
