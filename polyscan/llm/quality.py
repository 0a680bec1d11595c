"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

One pass over the texts gives each document a short vector of statistics of the whole text. Standardised, the
vector goes through FEATURES random Fourier features, which approximate a Gaussian kernel; each partition of
the labelled rows sums its normal equations, the sums are added up in a tree, and the driver solves one ridge
system of fixed size. The rows are summed by fold, so a model without a fold costs one more solution: such
out-of-fold scores are counted in BINS bins, on which isotonic regression turns scores into probabilities.

Defined results: a null text counts as empty and is scored; a document without an id takes no part in learning
and is not held out; several labels of one document are averaged and null labels left out; without labels, or
with labels of one kind only, every score is the mean label (0.5 without any). Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyscan.llm.common import shared_table

FEATURES = 192
RIDGE = 3.0
BINS = 4096
#: Rows of labels for each partial sum of the normal equations.
ROWS = 20_000
HELD_OUT_OF = 5
THRESHOLD = 0.3

_CLASS = np.full(256, 9, np.int64)  # of bytes: 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 end, 6 comma, 7 odd, 8 quote or bracket, 9 other
for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\x0b\x0c\r", 3), (b"\n", 4), (b".?", 5), (b",;:-", 6), (b"#$%&*+/<=>@\\^_`|~!", 7), (b"\"'()[]{}", 8)):
    _CLASS[list(chars)] = k
for c in range(128, 256):
    _CLASS[c] = 10


def statistics(text: bytes | None) -> np.ndarray:
    """Statistics of a whole text, each of a bounded or slowly growing range."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=11)
    words = text.split()
    lines = text.split(b"\n")
    n, w = max(1, len(text)), max(1, len(words))
    letters = max(1.0, kinds[0] + kinds[1] + kinds[10])
    distinct = set(words)
    filled = [x for x in lines if x.strip()]
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    shouted = sum(map(bytes.isupper, words))
    share = counts / n
    top = np.sort(share[33:48])[::-1]
    return np.array(
        [
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(filled)),
            *(kinds / n), kinds[1] / letters, np.sqrt(kinds[7] / w), kinds[5] / w, kinds[6] / w,
            shouted / w, len(distinct) / w, np.log1p(w / max(1, len(distinct))), len(set(filled)) / max(1, len(filled)),
            sizes.mean() / 10, sizes.std() / 10, np.log1p(sizes.max()), (sizes <= 2).mean(),
            np.log1p(len(text) / max(1, len(filled))), sum(x.rstrip()[-1:] in (b".", b"?", b"!", b'"') for x in filled) / max(1, len(filled)),
            float(top[0]) * 10, float(top[1]) * 10, counts[124] / w, counts[33] / w, counts[35:39].sum() / w,
        ],
        np.float32,
    )


SIZE = len(statistics(b""))


def features(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, stats): the statistics as float32 bytes."""

    def run(batches):
        for batch in batches:
            stats = [statistics(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.binary())], ["id", "stats"])

    chosen = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, stats binary")


def remainder(id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(of))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, SIZE).astype(np.float64)


class Basis:
    """Standardisation and random Fourier features, with the statistics themselves and a one beside them."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-6, std, 1.0)
        self.w = rng.normal(size=(SIZE, FEATURES)) / np.sqrt(SIZE)  # a bandwidth of the vectors' usual distance
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b) * 4, z / 4, np.ones((len(x), 1))], axis=1)


def _sums(rows: DataFrame, one, size: int) -> dict[int, np.ndarray]:
    """rows (fold int, ...) -> by fold the sum of the vectors of `size` that `one(batch)` gives by fold, added up in a tree."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, vector in one(batch).items():
                total[fold] = total.get(fold, 0) + vector
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["fold", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in table.column("v"):
            total += np.frombuffer(x.as_py())
        return pa.table({"fold": pa.array([table.column("fold")[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "fold int, v binary").withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = parts.groupBy("fold", "slot").applyInArrow(lambda t: add(t.select(["fold", "v"])), "fold int, v binary")
    return {r.fold: np.frombuffer(bytes(r.v)) for r in some.groupBy("fold").applyInArrow(add, "fold int, v binary").collect()}


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to y, weighted (pool adjacent violators)."""
    values, weights, sizes = [], [], []
    for a, b in zip(y.tolist(), w.tolist()):
        values.append(a)
        weights.append(b)
        sizes.append(1)
        while len(values) > 1 and values[-2] >= values[-1]:
            v, u, s = values.pop(), weights.pop(), sizes.pop()
            values[-1] = (values[-1] * weights[-1] + v * u) / (weights[-1] + u)
            weights[-1] += u
            sizes[-1] += s
    return np.repeat(values, sizes)


LOW, HIGH = -1.0, 2.0


class Model:
    """basis, weights of the ridge scores, and the calibration as points (score, probability)."""

    def __init__(self, basis, weights, xs, ps):
        self.basis, self.weights, self.xs, self.ps = basis, weights, xs, ps

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.basis is None or not len(stats):
            return np.full(len(stats), self.ps[0])
        return np.interp(self.basis(stats) @ self.weights, self.xs, self.ps)


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", of: int = HELD_OUT_OF, held_out: int = 0) -> Model:
    """stats (id, stats), labels (id, label 0 or 1); rows whose remainder is held_out are not learned from."""
    marks = labels.select(F.col(id).alias("id"), F.col(label).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marks = marks.groupBy("id").agg(F.avg("y").alias("y")).withColumn("fold", remainder(F.col("id"), of).cast("int")).where(F.col("fold") != held_out)
    rows = shared_table(spark, stats.join(marks, "id").select("fold", "y", "stats"), "labelled")
    n, mean = rows.agg(F.count("*"), F.avg("y")).first()
    if not n or mean in (0.0, 1.0):
        return Model(None, None, None, [0.5 if not n else mean])
    rows = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), -(-n // ROWS))))

    def moments(batch):
        x = _matrix(batch.column(2))
        return {0: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])}

    m = _sums(rows, moments, 1 + 2 * SIZE)[0]
    centre = m[1 : 1 + SIZE] / m[0]
    basis = Basis(centre, np.sqrt(np.maximum(m[1 + SIZE :] / m[0] - centre**2, 0)))
    width = FEATURES + SIZE + 1

    def equations(batch):
        folds, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
        out = {}
        for f in np.unique(folds):
            z = basis(x[folds == f])
            out[int(f)] = np.concatenate([(z.T @ z).ravel(), z.T @ y[folds == f]])
        return out

    by_fold = _sums(rows, equations, width * width + width)
    total = sum(by_fold.values())
    penalty = RIDGE * np.eye(width)
    penalty[-1, -1] = 1e-9
    solve = lambda s: np.linalg.solve(s[: width * width].reshape(width, width) + penalty, s[width * width :])
    weights = solve(total)
    others = {f: solve(total - s) if len(by_fold) > 1 else weights for f, s in by_fold.items()}

    def counted(batch):
        folds, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
        z, out = basis(x), np.zeros(3 * BINS)
        for f in np.unique(folds):
            own = folds == f
            s = z[own] @ others[int(f)]
            k = np.clip((s - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            for at, v in enumerate((np.ones(len(s)), y[own], np.clip(s, LOW, HIGH))):
                out[at * BINS : (at + 1) * BINS] += np.bincount(k, weights=v, minlength=BINS)
        return {0: out}

    count, positive, score = _sums(rows, counted, 3 * BINS)[0].reshape(3, BINS)
    some = count > 0
    xs = score[some] / count[some]
    ps = isotonic(positive[some] / count[some], count[some])
    # A little towards the mean, so that no probability is 0 or 1; between the bins the calibration is linear
    return Model(basis, weights, xs, (ps * n + mean) / (n + 1))


def scores(stats: DataFrame, model: Model, of: int = HELD_OUT_OF, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(id, stats) -> id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            s = model(_matrix(batch.column(1))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(s, 0, 1), pa.float64())], ["id", "score"])

    kind = stats.schema["id"].dataType.simpleString()
    out = stats.select("id", "stats").mapInArrow(run, f"id {kind}, score double")
    return out.select("id", F.coalesce(remainder(F.col("id"), of) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier does not reject; learned from the labels of their ids."""
    stats = shared_table(spark, features(docs, id, text), "stats")
    model = fit(spark, stats, labels, id)

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(text)
            s = model(np.array([statistics(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, SIZE))
            yield batch.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = shared_table(spark, features(docs), "stats")
    model = fit(spark, stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(stats, model).withColumnRenamed("id", "doc_id")
