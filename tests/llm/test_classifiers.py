import zlib

import numpy as np
import pytest

from polyscan.llm import quality, toxicity


def corpus(spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "re", "tu") for b in ("la", "ne", "so", "vi", "za")]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(words, rng.integers(20, 90)))
        junk, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for k in rng.choice(len(w), 3, replace=False):
                w[k] = str(rng.choice(["vileword", "foulterm"]))
        text = " ".join(w).capitalize() + "."
        rows.append((i, text.upper().replace(" ", "!! ") if junk else text, "en", "s", 7.0))
        if i % 2 or i % 10 == 0:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 1.0), (1002, "Word " * 30000, "en", "s", 1.0), (None, "A text without a number.", "en", "s", 1.0), (1001, "", "en", "s", 1.0)]
    labels += [(None, 1, 1), (3, None, None), (5, 1, 1), (5, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_and_scores_every_row(spark):
    docs, labels = corpus(spark)
    stats = quality.features(docs)
    out = quality.scores(stats, quality.fit(spark, stats, labels)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.id < 600]
    assert sum(r.predicted == int(r.id % 5 != 0) for r in held) >= 0.95 * len(held)
    kept = quality.accepted(spark, docs, labels)
    assert kept.columns == docs.columns
    ids = {r.id for r in out if r.predicted}
    assert {r.doc_id for r in kept.collect()} == ids


def test_quality_without_labels_or_rows(spark):
    docs, labels = corpus(spark)
    stats = quality.features(docs)
    assert {r.score for r in quality.scores(stats, quality.fit(spark, stats, labels.limit(0))).collect()} == {0.5}
    empty = quality.features(docs.limit(0))
    assert quality.scores(empty, quality.fit(spark, empty, labels)).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    stats = quality.features(docs)
    a, b = ({r.id: r.score for r in quality.scores(stats, quality.fit(spark, stats, x)).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)
    a, b = ({r.doc_id: r.score for r in toxicity.scores(docs, toxicity.fit(spark, docs, x)).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_isotonic_is_the_nearest_monotone_sequence():
    y, w = np.array([1.0, 3, 2, 2, 5, 4]), np.array([1.0, 1, 1, 2, 1, 3])
    assert np.allclose(quality.isotonic(y, w), [1, 2.25, 2.25, 2.25, 4.25, 4.25])


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    docs, labels = corpus(spark)
    out = toxicity.scores(docs, toxicity.fit(spark, docs, labels)).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held_out and r.doc_id < 600]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.predicted == int(r.doc_id % 4 == 1) for r in held) >= 0.95 * len(held)
    assert all(r.predicted == 0 for r in out if r.doc_id is None or r.doc_id >= 600)
    none = toxicity.scores(docs, toxicity.fit(spark, docs, labels.where("toxic = 0"))).collect()
    assert {r.score for r in none} == {0.0}
