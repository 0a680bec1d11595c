import random
import sys

import numpy as np

from polyscan.llm import passages


def prose(rng, n):
    return [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(n)]


def toks(words):
    return passages.tokens(passages.Words()(" ".join(words).encode()))


def test_minima_match_brute_force():
    h = np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64)
    assert (passages.minima(h) == [h[i : i + passages.LENGTH].min() for i in range(len(h) - passages.LENGTH + 1)]).all()


def test_tree_nodes_group_all_subsequences_by_their_minimum():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 90, n).tolist() for n in (60, 75)]  # many ties
    value, place, first, last, at = [], [], [], [], 0
    for x in texts:
        nodes = sorted({min(range(i, i + 20), key=lambda k: (x[k], k)) for i in range(len(x) - 19)})
        value += [x[k] for k in nodes]
        place += [at + k for k in nodes]
        first += [at] * len(nodes)
        last += [at + len(x) - 1] * len(nodes)
        at += len(x)
    left, right = passages.tree(value, place, first, last)
    windows = {c: (l, r) for c, l, r in zip(place, left, right)}
    at = 0
    for x in texts:
        for i in range(len(x)):
            for j in range(i + 19, len(x)):
                c = at + min(range(i, j + 1), key=lambda k: (x[k], k))
                assert windows[c][0] <= at + i and at + j <= windows[c][1]
        at += len(x)


def test_joint_windows_are_the_pairs_of_minima_of_all_subsequences():
    rng = random.Random(1)
    words = [prose(rng, n) for n in (200, 90, 30, 51, 0, 140)]
    words[1][10:40] = words[1][50:80]
    t, begin = passages.all_tokens([passages.Words()(" ".join(w).encode()) for w in words])
    assert all((t[s:e] == toks(w)).all() for s, e, w in zip(begin, begin[1:], words))
    found, low, high = passages.joined(t, begin, np.arange(len(words)))
    n = passages.LENGTH
    want = set()
    for d, w in enumerate(words):
        x = toks(w)
        for i in range(len(x) - n + 1):
            one, lo, hi = passages.joined(x[i : i + n], np.array([0, n]), np.array([d]))
            assert len(one) == passages.BANDS and (lo == 0).all() and (hi == 0).all()
            want |= {(d, int(r["key"]), int(begin[d]) + i) for r in one}
    assert {(int(r["doc"]), int(r["key"]), i) for r, s, e in zip(found, low.tolist(), high.tolist()) for i in range(s, e + 1)} == want


def test_passages_are_compared_with_passages():
    rng = random.Random(2)
    p = prose(rng, 60)
    spread = [w for k in range(0, 60, 10) for w in p[k : k + 14] + prose(rng, 60)]  # all shingles, far apart
    assert passages.shared_spans(toks(p), toks(spread)) == []
    near = p[:20] + ["x"] + p[21:]
    assert passages.shared_spans(toks(prose(rng, 9) + p), toks(near + prose(rng, 300)))[0][0] in range(9, 20)
    edited = [w if k % 9 else "y" for k, w in enumerate(p)]
    twice = edited[:30] + prose(rng, 5) + p[20:] + prose(rng, 80) + p  # first and last places do not make one passage
    twice += prose(rng, 80) + p[:30] + prose(rng, 9) + p[30:45]
    assert passages.shared_spans(toks(p), toks(twice)) == [(0, 60)]
    line = ["one", "line"] * 60
    assert passages.shared_spans(toks(line), toks(line)) == [(0, 120)]


def test_shared_starts_match_brute_force():
    n, share = passages.LENGTH, passages.SHARE
    for seed in range(12):
        rng = random.Random(seed)
        some = [rng.randrange(1, 60 + 40 * seed) for _ in range(70)]
        change = lambda x, p: [y for t in x for y in ([t] if rng.random() > p else [] if rng.random() < 0.3 else [rng.randrange(10**6)] * rng.randrange(1, 3))]
        a = np.array(change(some, 0.02) + [rng.randrange(9) for _ in range(30)] + change(some, 0.05), np.uint64)
        b = np.array(change(some, 0.12) + some[:35] + change(some, 0.08) + [rng.randrange(9) for _ in range(60)] + some[30:], np.uint64)
        want = [i for i in range(len(a) - n + 1) if max(np.isin(a[i : i + n], b[j : j + n]).sum() for j in range(max(1, len(b) - n + 1))) >= share]
        assert passages.shared_starts(a, b)[0].tolist() == want


def test_hot_keys_combine_within_a_task():
    x = np.zeros(1000, passages.RECORD)
    x["key"], x["apart"], x["doc"] = 7, np.arange(1000) % 3, np.arange(1000)[::-1]
    found, least = passages.star(x)
    assert len(least) == 3 and len(found) <= 1002
    assert {int(d) for d in found["a"]} | {int(d) for d in found["b"]} == set(range(1000))


def corpus(rng):
    shared, near, line = prose(rng, 70), prose(rng, 80), prose(rng, 14)
    changed = near[:40] + ["other"] + near[41:]
    docs = {}
    for i in range(60):
        docs[i] = line + prose(rng, 120)
    for i in range(60, 70):
        docs[i] = prose(rng, 30 + i) + shared + prose(rng, 40)
    docs[80] = prose(rng, 50) + near
    docs[81] = changed + prose(rng, 33)
    docs[90] = docs[91] = prose(rng, 100)
    docs[92], docs[93] = prose(rng, 49), None
    return docs


def test_finds_planted_passages_only(spark):
    rng = random.Random(7)
    docs = corpus(rng)
    rows = [(i, None if w is None else " ".join(w), 1) for i, w in docs.items()] + [(None, "", 1), (90, " ".join(docs[90]), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int")
    got = {r.doc_id: r for r in passages.repeated_passages(spark, df).collect()}
    assert set(got) == {*range(60, 70), 80, 81, 90, 91}
    for i in range(60, 70):
        assert got[i].class_id == 60
        ((s, e),) = [(x.s, x.e) for x in got[i].spans]
        assert (s, e) == (30 + i, 100 + i)
    assert got[81].class_id == 80 and got[91].class_id == 90 and got[91].n_words == 100
    cut = {r.doc_id: r.text for r in passages.remove_repeats(spark, df).collect()}
    whole = [i for i in range(60, 70) if cut[i] == " ".join(docs[i])]
    assert len(whole) == 1
    for i in {*range(60, 70)} - {*whole}:
        assert cut[i].split() == docs[i][: 30 + i] + docs[i][100 + i :]
    assert sorted(cut.keys() & {90, 91}) in ([90], [91])
    assert sum(cut[i] == " ".join(docs[i]) for i in (80, 81)) == 1
    for i in (*range(60), 92):
        assert cut[i] == " ".join(docs[i])
    assert cut[93] is None and cut[None] == ""
    assert passages.repeated_passages(spark, df.limit(0)).count() == 0


def test_without_cuts_words_and_the_space_behind_them():
    assert passages.without("  é one\ttwo  three\n", [(1, 2)]) == "  é two  three\n"
    assert passages.without("a b c", [(0, 1), (2, 3)]) == "b "


def edited_groups(rng, groups, copies, n):
    """Copies of passages, each with an edit of its own, between words of their own."""
    docs = []
    for _ in range(groups):
        passage = prose(rng, n)
        for _ in range(copies):
            k = rng.randrange(n)
            docs.append(prose(rng, 30) + passage[:k] + [f"edit{rng.random()}"] + passage[k + 1 :] + prose(rng, 30))
    return docs


def brute_force(docs):
    """{document: (words in passages that another has, least of its class)} of all pairs."""
    toks = [passages.tokens(passages.Words()(" ".join(d).encode())) for d in docs]
    spans, root = {}, list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = passages.shared_spans(toks[i], toks[j]), passages.shared_spans(toks[j], toks[i])
            if a and b:
                spans.setdefault(i, []).extend(a)
                spans.setdefault(j, []).extend(b)
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return {i: ({w for s, e in x for w in range(s, e)}, root[i]) for i, x in spans.items()}


def test_edited_copies_as_by_brute_force(spark):
    docs = edited_groups(random.Random(3), 4, 60, 55)
    want = brute_force(docs)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: ({w for x in r.spans for w in range(x.s, x.e)}, r.class_id) for r in passages.repeated_passages(spark, df).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert sum(len(got[i][0]) for i in got) >= 0.98 * sum(len(w) for w, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.98 * len(want)


def test_in_key_covers_and_connects_like_all_pairs():
    for seed in range(6):
        rng = random.Random(seed)
        toks = [passages.tokens(passages.Words()(" ".join(d).encode())) for d in edited_groups(rng, 2, 14, 56) + [prose(rng, 90)]]
        toks += [toks[0], toks[3]]
        regions = [(t >> np.uint64(32)).astype(np.uint32) for t in toks]
        n = len(toks)

        def covered(pairs):
            good, root = set(), list(range(n))
            for i, j in pairs:
                a, b = passages.shared_spans(regions[i], regions[j]), passages.shared_spans(regions[j], regions[i])
                if a and b:
                    for k, x, y in ((i, i, j), (j, j, i)):
                        hit = np.r_[0, np.cumsum(np.isin(regions[x], regions[y]))]
                        good |= {(k, int(w)) for w in np.flatnonzero(hit[passages.LENGTH :] - hit[: -passages.LENGTH] >= passages.SHARE)}
                    u, v = sorted((root[i], root[j]))
                    root = [u if r == v else r for r in root]
            return good, root

        assert covered(passages.in_key(list(range(n)), regions)) == covered([(i, j) for i in range(n) for j in range(i)])


def test_joined_windows_are_those_of_the_tree_within_a_subsequence():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 400, 500)  # ties
    n = passages.LENGTH
    least = [min(range(i, i + n), key=lambda k: (h[k], k)) for i in range(len(h) - n + 1)]
    nodes = sorted(set(least))
    left, right = passages.tree([int(h[c]) for c in nodes], nodes, [0] * len(nodes), [len(h) - 1] * len(nodes))
    for c, l, r in zip(nodes, left, right):
        runs = [i for i, k in enumerate(least) if k == c]
        assert runs == list(range(max(l, c - n + 1), min(c, r - n + 1) + 1))


def test_words_of_texts_hashed_together():
    texts = [b"A bb\tAa-c\x0bd", None, b"", b" \n ", b"aa-C  a", "Été é x\x00 \x00x a".encode(), b"z" * 700_000 + b" a " + b"a a " * 200_000, b"a"]
    got = passages.word_hashes(texts)
    words = [(t or b"").lower().split() for t in texts]
    assert [len(h) for h in got] == [len(w) for w in words]
    flat = [(w, int(v)) for ws, hs in zip(words, got) for w, v in zip(ws, hs)]
    assert len({w for w, _ in flat}) == len({v for _, v in flat}) == len(set(flat))
    assert all((passages.Words()(t) == h).all() for t, h in zip(texts, got))


def test_no_call_for_each_word_or_window():
    rng = random.Random(8)
    some = prose(rng, 3000)
    texts = [" ".join(rng.choices(some, k=600)).encode() for _ in range(100)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        t, begin = passages.all_tokens(passages.word_hashes(texts))
        passages.star(passages.joined(t, begin, np.arange(len(texts)))[0])
    finally:
        sys.setprofile(None)
    assert calls < 60_000 / 20


def test_equal_regions_of_a_document_are_compared_once():
    rng = random.Random(6)
    line = prose(rng, 61)
    words = [passages.word_hashes([" ".join(line * n + prose(rng, 80)).encode()])[0] for n in (9, 1)]
    t, begin = passages.all_tokens(words)
    keys = np.unique(passages.joined(t, begin, np.arange(2))[0]["key"]).view(np.int64).tolist()
    blobs = [passages.zstandard.ZstdCompressor().compress(w.tobytes()) for w in words]
    batch = passages.pa.RecordBatch.from_arrays([passages.pa.array([4, 5]), passages.pa.array(blobs), passages.pa.array([keys, keys])], ["rid", "words", "keys"])
    rows = [(r["key"], r["rid"], r["region"]) for b in passages._regions(7)(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == len(set(rows))
    assert {k for k, rid, _ in rows if rid == 4} | {k for k, rid, _ in rows if rid == 5} == set(keys)
