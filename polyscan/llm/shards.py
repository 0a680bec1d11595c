"""Sharding by size-tiered compaction.

A store is a folder with immutable Parquet shards and a chain of versioned manifests. Arrivals are appended as
small shards. Compaction puts the shards below the target size into tiers by the logarithm of their size; a tier with
TIER_RUN or more shards is merged: its files are read as they lie and coalesced, without a shuffle, into
files of about the target size. Each step ends in a new manifest, written aside and renamed to the next version's
name, which must not exist yet: of two writers one gets the version and the other an error, and a reader sees the
shards of one version, all of them. Files that the newest manifest no longer names are removed by vacuum().

Only DataFrame operations and the file system's own calls run, in tasks no Python at all. Defined results: an
empty table makes a version without shards; nulls, repeated rows, very long texts and any further columns are stored as they are.
A rename must be atomic, as in HDFS and local file systems.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polyscan.llm.common import new_path

#: Bytes of a merged shard, rows of an arriving one, shards of a tier that make a merge, and the ratio of the tiers.
TARGET = 64 << 20
ARRIVAL_ROWS = 2_000
TIER_RUN = 4
TIER_BASE = 4


class CommitConflict(RuntimeError):
    """Another writer has committed the same version."""


class ShardStore:
    """Manifest: {"version", "schema", "shards": [{"path", "bytes", "tier"}]}; paths are relative to the root."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, arrival_rows: int = ARRIVAL_ROWS):
        self.spark, self.root, self.target, self.arrival_rows = spark, root.rstrip("/"), target, arrival_rows
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[tuple[str, int]]:
        p = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(p):
            return []
        return sorted((f"{folder}/{s.getPath().getName()}", s.getLen()) for s in self._fs.listStatus(p))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max([0, *(int(p[-13:-5]) for p, _ in self._list("manifest") if p.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, shards: list[dict], schema: str, base: int) -> int:
        """Makes version base + 1, or raises CommitConflict if it exists."""
        body = {"version": base + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        aside, final = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/v{base + 1:08d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise CommitConflict(f"version {base + 1} is there already")
        return base + 1

    def tier(self, size: int) -> int:
        """0 for the smallest; shards of a tier differ in size by less than TIER_BASE times."""
        return max(0, int(math.log(max(size, 1) / 4096, TIER_BASE)))

    def _write(self, df: DataFrame, rows: int | None) -> list[dict]:
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows) if rows else writer).parquet(f"{self.root}/{folder}")
        files = [(p, n) for p, n in self._list(folder) if p.endswith(".parquet")]
        return [{"path": p, "bytes": n, "tier": self.tier(n)} for p, n in files]

    def append(self, df: DataFrame) -> int:
        """Adds df as small shards; the new version."""
        now = self.manifest()
        shards = self._write(df, self.arrival_rows)
        return self.commit([*now["shards"], *shards], df.schema.json(), now["version"])

    def due(self, shards: list[dict]) -> list[list[dict]]:
        """The tiers to be merged, below the target and with enough shards."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(s["tier"], []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= TIER_RUN]

    def compact(self) -> int:
        """Merges the lowest tier that is due until none is; the version reached. Each merge commits, so a lost driver loses one."""
        while True:
            now = self.manifest()
            runs = [r for r in self.due(now["shards"]) if math.ceil(sum(s["bytes"] for s in r) / self.target) < len(r)]
            if not runs:
                return now["version"]
            # One tier a round: its shards are of similar size, so the coalesced files are too
            old = runs[0]
            files = max(1, math.ceil(sum(s["bytes"] for s in old) / self.target))
            merged = self._write(self._read(old, now["schema"]).coalesce(files), None)
            gone = {s["path"] for s in old}
            self.commit([*(s for s in now["shards"] if s["path"] not in gone), *merged], now["schema"], now["version"])

    def _read(self, shards: list[dict], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{s['path']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m["shards"], m["schema"] or StructType().json())

    def vacuum(self) -> int:
        """Removes shards that the newest manifest does not name; how many. No reader of an older version may run."""
        kept = {s["path"] for s in self.manifest()["shards"]}
        gone = [p for folder, _ in self._list("data") for p, _ in self._list(folder) if p.endswith(".parquet") and p not in kept]
        for p in gone:
            self._fs.delete(self._path(f"{self.root}/{p}"), False)
        return len(gone)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document as the compacted store gives it back, with its shard's number and tier and the version."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append(docs)
    version = store.compact()
    store.vacuum()
    m = store.manifest(version)
    rows = [(s["path"].rsplit("/", 1)[1], i, s["tier"]) for i, s in enumerate(m["shards"])]
    names = spark.createDataFrame(rows, "file string, shard int, tier int")
    stored = store.read(version)
    own = stored.select("doc_id", F.octet_length("text").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return own.join(names, "file").select("doc_id", "n_bytes", "text_sha256", "shard", "tier", F.lit(version).alias("version"))
