import re

import pandas as pd

from polyscan.llm import mixing
from polyscan.llm.mixing import WEIGHTS


def brute_targets(sizes: dict) -> dict:
    """Shares by weight; the excess over three times a size goes to the others, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 3 * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_plan_matches_brute_force_targets_and_comes_near(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), ["a", "b", "é", "Z", None][i * i % 5]) for i in range(400)]
    rows += [(1000 + i, "x y", "tiny") for i in range(2)] + [(None, None, "a"), (7, "", "a"), (5, "q r s", "b"), (5, "q r s", "b")]
    docs = frame(spark, rows)
    keyed = docs.withColumn("size", mixing.size_of(docs["text"])).selectExpr("doc_id AS id", "source", "size")
    got = mixing.plan(spark, keyed, fan=8).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    for s, g in got.groupby(got.source.fillna("<null>")):
        key = None if s == "<null>" else s
        assert g.source_size.iloc[0] == sizes[key]
        assert abs(g.target.iloc[0] - want[key]) < 1e-6
        assert abs((g.copies * g["size"]).sum() - want[key]) <= g["size"].max()
    assert (got.copies <= 3).all()
    again = mixing.plan(spark, keyed.repartition(3), fan=8).toPandas()
    cols = ["id", "k", "source", "size", "copies"]
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, again[cols].values.tolist()))


def test_expectation_holds_over_seeds(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "ab"[i % 2]) for i in range(60)]
    keyed = frame(spark, rows).selectExpr("doc_id AS id", "source", "length(text) div 2 + 1 AS size")
    draws = pd.concat(mixing.plan(spark, keyed, seed=s, fan=16).toPandas() for s in range(12))
    by = draws.groupby("source").agg(mean=("copies", "mean"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by["mean"] - by.target / by["size"]) < 0.1).all()


def test_empty_and_mix_repeats_whole_rows(spark):
    assert mixing.plan(spark, frame(spark, []).selectExpr("doc_id AS id", "source", "0L AS size")).count() == 0
    rows = [(i, "a b c", "s") for i in range(6)] + [(9, "d e", "t")] * 3
    docs = frame(spark, rows).selectExpr("*", "1 AS size", "2 AS target", "3 AS copies")
    out = mixing.mix(spark, docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {(*r, 1, 2, 3) for r in rows}
