import re

import numpy as np
import xxhash

from polyscan.llm import simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs):
    """pairs: (id, fp) -> the smallest id reachable for each."""
    n = len(pairs)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        ids = [x for x in (low.get(find(i)), pairs[i][0]) if x is not None]
        low[find(i)] = min(ids) if ids else None
    return [low[find(i)] for i in range(n)]


def test_fingerprint_matches_brute_force():
    for t in (None, "", " \t\n", "One", "a b c", "a b c d", "A B c D e a b c d e", "é x y Ä z \x1c w\x0bq " * 5):
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_documents_of_the_smallest_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2(spark, sf_dir).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(fps)
    assert got == {i: (f"{fp:016x}", c) for (i, fp), c in zip(fps, want)}


def test_balls_find_every_link_in_small_and_large_buckets(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = set(map(int, centres))
    for k, c in enumerate(centres):
        for _ in range(200 if k < 2 else 12):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(spark, df).collect()}
    want = brute_components(list(enumerate(fps)))
    assert [got[int(np.uint64(f).view(np.int64))] for f in fps] == want


def test_dedup_keeps_one_row_of_each_class(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text, "x", 1), (3, text + " tail", "y", 2), (9, "quite another text with words of its own here", "z", 3), (9, "quite another text with words of its own here", "z", 3), (None, None, None, 4), (None, "", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, fp int")
    out = simhash.dedup(spark, docs)
    assert out.columns == docs.columns
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    near = (fps[0][1] ^ fps[1][1]).bit_count() <= 4
    ids = sorted([r.doc_id for r in out.collect()], key=str)
    assert ids == sorted([3, 9, None] + ([] if near else [5]), key=str)
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0
