import hashlib
import re

import pytest
from pyspark.sql import functions as F

from polyscan.llm import sketches


def pieces(text):
    return set(re.findall(r"(?:[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*){1,16}", text))


def brute(rows):
    """rows (id, text), in descending order of id -> [(id, n, sha, likeness to edited, to next)]."""
    out = []
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(pieces(t), pieces(edited)), like(pieces(t), pieces(nxt))))
    return out


def check(got, want):
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got)
    want = sorted(want)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3:] for g in got] == [pytest.approx(w[3:]) for w in want]


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.desc("doc_id")).collect()]
    got = sketches.op7(spark, sf_dir).collect()
    check(got, brute(rows))
    by_text = {}
    text = dict(rows)
    for r in got:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def test_order_across_buckets_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", 3)
    texts = [None, "", "é" * 31, " \n\t", "one", "line\n" * 40, " ".join(f"w{k}" for k in range(3000)), "tail \U0001f389 end"]
    rows = [(i * 37 % 101 - 50, texts[i % len(texts)]) for i in range(26)]
    rows.sort(key=lambda r: -r[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS a", "2 AS next", "3 AS bucket").repartition(4)
    check(sketches.fingerprints(spark, docs).collect(), brute(rows))


def test_single_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    check(sketches.fingerprints(spark, docs).collect(), brute([(1, "a b c d")]))
    assert sketches.fingerprints(spark, docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)], "doc_id long, text string")
    assert sketches.fingerprints(spark, same).count() == 4


def test_frequent_and_null_ids_are_spread_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", 3)
    rows = [(7 if i % 3 else i, f"text {i} of many") for i in range(60)]
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows.sort(key=lambda r: (-r[0], -hashes[r[1]]))
    assert sketches.with_next(spark, docs.withColumnRenamed("doc_id", "id")).select("bucket").distinct().where("bucket.s > 1").count() > 2
    check(sketches.fingerprints(spark, docs).collect(), brute(rows))
    nulls = docs.select(F.when(F.col("doc_id") != 7, F.col("doc_id")).alias("doc_id"), "text")
    assert sketches.fingerprints(spark, nulls).count() == 60


def peeled(cells):
    """Plain peeling of cells [n, key, check] -> (digests of the first, of the second, whether all came out)."""
    bits = sketches.CELLS.bit_length() - 1
    cells = [list(c) for c in cells]
    out = {1: set(), -1: set()}
    done = False
    while not done:
        done = True
        for n, key, chk in [tuple(c) for c in cells]:
            if abs(n) == 1 and chk == CHECKS.get(key, chk) and key not in out[n] and key in CHECKS:
                out[n].add(key)
                for t in range(3):
                    c = cells[t * sketches.CELLS + (key >> t * bits & sketches.CELLS - 1)]
                    c[0], c[1], c[2] = c[0] - n, c[1] ^ key, c[2] ^ chk
                done = False
    return out[1], out[-1], not any(any(c) for c in cells)


CHECKS: dict[int, int] = {}


def test_returned_fingerprints_subtract_and_peel_to_the_likeness(spark):
    lines = [f"paragraph number {k}" for k in range(40)]
    texts = ["\n".join([*lines[:k], *lines[k + k % 3 :], f"end {k // 2}"]) for k in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in docs.select(F.explode(sketches.digests(F.col("text"))).alias("d")).select("d", sketches._check(F.col("d")).alias("c")).collect():
        CHECKS[r.d & (1 << 64) - 1] = r.c & (1 << 64) - 1
    got = sorted(sketches.fingerprints(spark, docs).collect(), key=lambda r: -r.doc_id)
    read = 0
    for r, nxt in zip(got, got[1:] + got[:1]):
        (na, a), (nb, b) = sketches.parse(r.fingerprint), sketches.parse(nxt.fingerprint)
        only_a, only_b, whole = peeled([(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]) for x, y in zip(a, b)])
        if not whole:  # too small for this pair: retried larger
            continue
        read += 1
        assert len(only_a) - len(only_b) == na - nb
        shared = na - len(only_a)
        assert r.near_next == pytest.approx(shared / (shared + len(only_a) + len(only_b)))
    assert read > 16


def test_stuck_sketches_grow_until_all_is_recovered(spark):
    rows = [(i, list(range(i, i + 4 * i)), list(range(i + 30, i + 90))) for i in range(1, 16)]
    df = spark.createDataFrame(rows, "rid long, x array<long>, y array<long>")
    df = df.select("rid", *[F.transform(c, lambda v: F.xxhash64(v)).alias(n) for c, n in (("x", "a"), ("y", "b"))])
    tight = df.select(sketches.peel(sketches.subtract(sketches.sketch(F.col("a")), sketches.sketch(F.col("b")))).alias("p")).select(sketches.stuck(F.col("p.cells")).alias("s"))
    assert tight.where("s").count() > 10
    for r in df.withColumn("d", sketches.differences(F.col("a"), F.col("b"))).collect():
        assert (set(r.d.a), set(r.d.b)) == (set(r.a) - set(r.b), set(r.b) - set(r.a)) and len(r.d.a) + len(r.d.b) == len(set(r.a) ^ set(r.b))


def test_very_long_texts(spark):
    texts = [" ".join(f"w{k * m % 999983}" for k in range(300_000)) for m in (1, 7)]
    rows = [(2 - i, t) for i, t in enumerate(texts)]
    check(sketches.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))
