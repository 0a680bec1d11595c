import numpy as np

from polyscan.llm import ann


def brute(rows, every=20, k=20):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = (x * np.array(v)).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_small_tables_are_exact_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(120)]
    good = [(i, v) for i, v in good if any(v)] + [(1000 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(60)]
    bad = [(20, None), (2000, [0.0] * 6), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (2080, [1.0, 2.0]), (None, [1.0] * 6)]
    good = [g for g in good if g[0] != 20]
    df = spark.createDataFrame([*good, *bad, good[0]], "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS q")
    got, want = results(ann.search(spark, df)), brute(good)
    assert got == want


def test_fewer_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (40, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert results(ann.search(spark, df)) == {0: [(40, 1.0), (1, 0.5)], 40: [(0, 1.0), (1, 0.5)]}
    assert ann.search(spark, df.limit(0)).count() == 0
    assert ann.search(spark, df.where("vec_id = 0")).count() == 0


def test_recall(spark):
    d = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    want = brute([(r.vec_id, np.array(r.embedding, np.float64)) for r in t])
    got = results(ann.op5(spark, d))
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in found if i in exact)


def test_queries_of_a_block_are_dealt_to_slots(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)]
    monkeypatch.setattr(ann, "SLOT", 3)
    monkeypatch.setattr(ann, "RANKED", 7)
    monkeypatch.setattr(ann, "BLOCK", 10)
    assert results(ann.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows)
