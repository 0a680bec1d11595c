"""What the training-data operators share: word rules, shared tables, components, blocked shuffles."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. The same pattern serves Java and Python.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one only where it is unset and all run in one process."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        set_dir = tempfile.mkdtemp(prefix="polyscan-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/polyscan/{name}-{uuid.uuid4().hex}"


#: Rows of a file of a shared table whose number of rows is known.
FILE_ROWS = 250_000


def shared_table(spark: SparkSession, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and lost executors cost nothing.

    rows: how many narrow rows it has at most, if known. They are written by a task for FILE_ROWS of them, and by as many as run at
    once at least: for every file on a local disk Hadoop has the executor spawn processes that set its mode, which share
    the executor's memory until they have begun and are counted with it a second time.
    """
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the folder of a table that shared_table() made."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/polyscan/" in folder:
            drop_path(spark, folder)


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps. Nodes without an edge to another node do not appear; null
    ends and loops are left out. A hub's neighbours are never gathered in one row: the steps need only minima,
    which combine before the shuffle, and joins of two plain shuffles, whose skewed partitions Spark splits.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = shared_table(spark, e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rows = 2 * e.count()  # a step makes no more edges than there were, and at most as many nodes as two ends an edge
    seen = None
    for _ in range(rounds):
        made = [e]
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = shared_table(spark, both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "low", rows)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = shared_table(spark, large.distinct(), "large", rows)
        low2 = shared_table(spark, large.groupBy("a").agg(F.min("b").alias("m")), "low", rows)
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = shared_table(spark, small.unionByName(low2.select("a", F.col("m").alias("b"))).distinct(), "edges", rows)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for t in [*made, low, large, low2]:
            drop_table(spark, t)
        e = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    own = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels 0..n-1 (the smallest member) of the graph of edges i-j, in one task."""
    root = np.arange(n)
    while True:
        ri, rj = root[i], root[j]
        differ = ri != rj
        if not differ.any():
            return root
        i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
        np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(keys: np.ndarray, records: np.ndarray, parts: int) -> pa.RecordBatch:
    """Records dealt to `parts` by key, one row (part, block) for each part: a shuffle of few large rows, not many small."""
    part = (mix64(keys) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint32), kind="stable")
    part, records = part[order], records[order]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.array([], int)
    ends = np.r_[at[1:], len(part)]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[at].astype(np.int32)), pa.array([records[s:e].tobytes() for s, e in zip(at, ends)], pa.binary())], ["part", "block"]
    )


def unblock(table: pa.Table, dtype) -> np.ndarray:
    found = [np.frombuffer(x, dtype) for x in table.column("block").to_pylist()]
    return np.concatenate(found) if found else np.empty(0, dtype)


BLOCKS = "part int, block binary"
