"""Append-only line files as a stream: offsets are byte positions of whole lines, by file."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamReader

from polyscan.sources.base import BATCH, Part
from polyscan.sources.index import parser_for

#: Bytes of one task's range.
RANGE = 32 << 20


def whole_lines(path: str, start: int) -> int:
    """The end of the last whole line behind start."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at = size
        while at > start:
            back = max(start, at - 65536)
            f.seek(back)
            k = f.read(at - back).rfind(b"\n")
            if k >= 0:
                return back + k + 1
            at = back
    return start


class TailReader(DataSourceStreamReader):
    """Each trigger reads what was appended since the last, in ranges that end behind a line.

    A file is known by path and inode: one that was replaced starts anew. A line that is not ended yet waits.
    """

    def __init__(self, scan):
        self.scan = scan

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in self.scan.files():
            out[f"{path}#{os.stat(path).st_ino}"] = whole_lines(path, 0)
        return out

    def partitions(self, start: dict, end: dict):
        out = []
        for key, stop in sorted(end.items()):
            path, at = key.rpartition("#")[0], start.get(key, 0)
            while at < stop:
                to = stop if stop - at <= RANGE else self._cut(path, at, stop)
                out.append(Part((path, at, to)))
                at = to
        return out or [Part(None)]

    @staticmethod
    def _cut(path: str, start: int, stop: int) -> int:
        with open(path, "rb") as f:
            f.seek(start + RANGE)
            f.readline()
            return min(stop, f.tell())

    def read(self, partition):
        if partition.value is None:
            return
        path, start, end = partition.value
        with open(path, "rb") as f:
            f.seek(start)
            data = f.read(end - start)
        b = parser_for(self.scan.table, path).batch(data, start, self.scan.schema)
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)

    def commit(self, end: dict) -> None:
        pass


def read_stream(spark: SparkSession, scan) -> DataFrame:
    """A streaming DataFrame over a rows_file scan."""
    from polyscan.sources.base import source_class

    name = "tail_" + "".join(c if c.isalnum() else "_" for c in scan.name) + f"_{id(scan)}"
    spark.dataSource.register(source_class(name, scan))
    return spark.readStream.format(name).load()


def tumbling_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; rows later than the watermark are left out of closed windows."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def session_counts(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """One row a session of a key: a run of events with no gap of that length."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
