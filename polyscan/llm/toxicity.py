"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Known are confirmed toxic documents (P) and unlabelled ones (U), a mixture in which a share pi, the class
prior, is toxic. The classifier is linear in the presence of words and word beginnings that toxic documents
have more often than unlabelled ones, with weights of zero or more, and minimises

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))

with the logistic loss: the class-prior-corrected risk, kept from going negative; where the corrected
part falls below zero, the step goes back up it. Fit on a bounded sample of the labelled rows (MOST_TOXIC and
MOST_UNLABELLED, those of the smallest hash); of a labelled row in U only the text is used. The prior is the mean
label over all labelled rows to learn from. Then one pass scores every whole text.

Defined results: a null text counts as empty and is scored; null ids are never learned from nor held out; the
highest of several labels of a document holds, null labels are left out; without a toxic example every score is 0.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyscan.llm.quality import remainder

#: Bounds of the sample to learn from.
MOST_TOXIC = 6_000
MOST_UNLABELLED = 12_000
SPACE = 1 << 18
#: A feature counts if the confirmed toxic documents that have it exceed what the unlabelled ones lead to expect
#: by so many standard deviations and by this factor (or half of what the prior allows).
DEVIATIONS, FACTOR = 4.0, 2.5
HELD_OUT_OF, HELD_OUT = 3, 1
THRESHOLD = 0.7
STEPS, RATE, SHRINK = 1500, 0.05, 1e-4
BEGINNINGS = (4, 5, 6)
_WORDS = re.compile(r"[^\W_]+")


class Features:
    """Text -> sorted distinct feature numbers below SPACE; remembers the features of words."""

    def __init__(self, kept: np.ndarray | None = None):
        self.seen: dict[str, tuple[int, ...]] = {}
        self.kept = kept  # if given, a mask of the features that count

    def of_word(self, word: str) -> tuple[int, ...]:
        names = [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]
        found = {zlib.crc32(x.encode("utf-8", "surrogatepass")) % SPACE for x in names}
        return tuple(x for x in found if self.kept is None or self.kept[x])

    def __call__(self, text: str | None) -> np.ndarray:
        out: set[int] = set()
        if len(self.seen) > 400_000:
            self.seen.clear()
        for word in set(_WORDS.findall((text or "").lower())):
            f = self.seen.get(word)
            if f is None:
                f = self.seen[word] = self.of_word(word)
            out.update(f)
        return np.array(sorted(out), np.int32)


class Model:
    """A sparse linear classifier: weights by feature, and a bias; bias None: there was nothing to learn from."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float | None):
        self.kept, self.weights, self.bias = kept, weights, bias

    def scorer(self):
        if self.bias is None:
            return lambda text: 0.0
        mask = np.zeros(SPACE, bool)
        mask[self.kept] = self.weights != 0
        weight = np.zeros(SPACE)
        weight[self.kept] = self.weights
        features = Features(mask)
        return lambda text: float(1 / (1 + np.exp(-np.clip(weight[features(text)].sum() + self.bias, -40, 40))))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row number, feature) of every entry."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights of `width` features and the bias: Adam on the non-negative risk over all rows."""
    (pr, pf), (ur, uf) = _flat(positive), _flat(unlabelled)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, STEPS + 1):
        zp = np.bincount(pr, weights=w[pf], minlength=len(positive)) + w[-1]
        zu = np.bincount(ur, weights=w[uf], minlength=len(unlabelled)) + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        plus, minus, gu = -sigmoid(-zp) * prior / len(zp), -sigmoid(zp) * prior / len(zp), sigmoid(zu) / len(zu)
        gp, gu = (plus + minus, gu) if negative >= 0 else (-minus, -gu)
        g = np.bincount(pf, weights=gp[pr], minlength=width + 1) + np.bincount(uf, weights=gu[ur], minlength=width + 1)
        g[-1] = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        # Only evidence for toxicity has a weight: the length of a clean document then says nothing
        w[:-1] = np.maximum(w[:-1] - SHRINK, 0)
    return w[:-1], float(w[-1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", of: int = HELD_OUT_OF, held_out: int = HELD_OUT) -> Model:
    marks = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("y").alias("y")).where(remainder(F.col("id"), of) != held_out)
    prior = marks.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0] or 0.0
    nothing = Model(np.zeros(0, int), np.zeros(0), None)
    if prior == 0.0:
        return nothing
    order = F.xxhash64("id")
    toxic = marks.where("y > 0").orderBy(order, "id").limit(MOST_TOXIC).select("id", F.lit(True).alias("p"))
    other = marks.orderBy(order, "id").limit(MOST_UNLABELLED).select("id", F.lit(False).alias("p"))
    # Both samples are bounded by a parameter: at most MOST_TOXIC + MOST_UNLABELLED numbers are broadcast
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def rows(sample: DataFrame) -> list[np.ndarray]:
        def run(batches):
            features = Features()
            for batch in batches:
                found = [features(t).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "f"])

        chosen = texts.join(F.broadcast(sample.select("id")), "id").select(F.col("id").cast("string").alias("id"), "text")
        found = sorted((r.id, bytes(r.f)) for r in chosen.mapInArrow(run, "id string, f binary").collect())
        return [np.frombuffer(f, np.int32) for _, f in found]

    positive = rows(toxic)
    if not positive:
        return nothing
    unlabelled = rows(other)
    often = np.bincount(np.concatenate(positive), minlength=SPACE)
    usual = np.bincount(np.concatenate(unlabelled), minlength=SPACE) / len(unlabelled) * len(positive)
    kept = np.flatnonzero((often - usual >= DEVIATIONS * np.sqrt(usual + 0.5)) & (often >= min(FACTOR, 0.5 + 0.5 / prior) * usual))  # a word of toxic texts alone has 1 / prior
    if not len(kept):
        return nothing
    number = np.full(SPACE, -1, np.int32)
    number[kept] = np.arange(len(kept))
    positive, unlabelled = ([x[x >= 0] for x in (number[r] for r in side)] for side in (positive, unlabelled))
    return Model(kept, *learn(positive, unlabelled, len(kept), min(max(prior, 1e-4), 0.9)))


def scores(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", of: int = HELD_OUT_OF, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches):
        score = model.scorer()
        for batch in batches:
            s = [score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    chosen = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    out = chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id), F.coalesce(remainder(F.col("id"), of) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
