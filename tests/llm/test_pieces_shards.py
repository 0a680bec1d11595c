import random

import pytest

from polyscan.llm import pieces, shards


def brute(p, text):
    """All segmentations of a short text: (score, ids)."""
    ends = p.lattice(text)

    def back(j):
        if j == 0:
            yield 0.0, []
            return
        for i, ids, s in ends[j]:
            for score, before in back(i):
                yield score + s, [*before, *ids]

    return sorted(back(len(text)), key=lambda x: -x[0])


TEXTS = ["", "Hello world", "  a  b\n\nc ", "▁x▁ y", "漢字\U0001f389 ﬁ", "    indent\tq\r\n", "x" * 90, "naïve café, déjà vu!!", "a" * 41 + " b"]


def test_nbest_matches_brute_force():
    p = pieces.Pieces(pieces.load())
    for t in (" the cat", " aé b", " Ox 12", "  q"):
        every = brute(p, t)
        got = p.nbest(t, 6)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in every[:6]])
        lengths = lambda ids: [len(p.bytes[i].decode()) for i in reversed(ids)]
        assert all(a[0] > b[0] + 1e-9 or lengths(a[1]) < lengths(b[1]) for a, b in zip(got, got[1:]) if b"\xc3" not in b"".join(p.bytes[i] for i in a[1] if len(p.bytes[i]) == 1))
        assert len({tuple(i) for _, i in got}) == len(got)


def test_texts_agree_with_the_whole_lattice_and_round_trip():
    p = pieces.Pieces(pieces.load())
    rng = random.Random(4)
    texts = TEXTS + [" ".join("".join(rng.choice("aeinrst!é") for _ in range(rng.randrange(1, 9))) for _ in range(8)) for _ in range(20)]
    for t, found in zip(texts, p.encode_all(texts)):
        whole = p.nbest(" " + t, 4) if t else [(0.0, [])]
        assert [s for s, _ in found] == pytest.approx([s for s, _ in whole])
        assert found[0][1] == whole[0][1]
        for _, ids in found:
            assert p.decode(ids) == t
    flat, at, scores, same = p.best_all(texts)
    assert same.all() and [flat[s:e].tolist() for s, e in zip(at, at[1:])] == [p.encode(t)[0][1] for t in texts]
    assert scores == [pytest.approx([s for s, _ in p.encode(t)]) for t in texts]


def test_the_table_of_words_may_be_emptied_at_any_time(monkeypatch):
    texts = [" ".join(f"w{k % 13}x{k * 7}" for k in range(j, j + 30)) for j in range(20)]
    p = pieces.Pieces(pieces.load())
    want = [p.nbest(" " + t)[0] for t in texts]
    monkeypatch.setattr(pieces, "KNOWN", 40)
    got = [p.encode_all(texts[k : k + 2]) for k in range(0, 20, 2)]
    assert [f[0] for g in got for f in g] == want


def test_columns_of_the_same_name_give_way(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "q"), (2, None, 8, "r")], "doc_id long, text string, N_pieces int, decoded string")
    out = pieces.decode(pieces.encode(docs))
    assert out.columns == ["doc_id", "text", "piece_ids", "n_pieces", "piece_score", "nbest_scores", "round_trip", "decoded"]
    rows = out.orderBy("doc_id").collect()
    assert rows[0].decoded == "a b" and rows[0].n_pieces == len(rows[0].piece_ids) and rows[1].decoded is None and rows[1].nbest_scores is None
    odd = spark.createDataFrame([("a b", 9)], "piece_ids string, n int")
    assert pieces.encode(odd, "piece_ids").first().round_trip


def test_encode_and_decode_frames(spark):
    rows = [(i, t, "k") for i, t in enumerate([*TEXTS, None, "long " * 40000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd name` string")
    out = pieces.decode(pieces.encode(docs)).collect()
    assert all(r.decoded == r.text and r.round_trip in (True, None) for r in out) and len(out) == len(rows)
    assert [r.n_pieces for r in out if r.text is None] == [None]
    assert pieces.encode(docs.limit(0)).count() == 0


def test_shards_keep_every_row_and_versions(spark, tmp_path):
    rows = [(i, None if i % 17 == 0 else f"text {i} " * (i % 50)) for i in range(3000)] + [(5, "twice"), (5, "twice"), (None, "x" * 400000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "'t' AS tier").repartition(4)
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target=60_000, arrival_rows=100)
    assert store.append(docs) == 1
    small = len(store.manifest()["shards"])
    version = store.compact()
    m = store.manifest()
    assert version > 1 and len(m["shards"]) < small / 3
    assert not store.due(m["shards"]) or len(m["shards"]) * 60_000 < 4 * sum(s["bytes"] for s in m["shards"])
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, store.read().collect())) == want
    assert sorted(map(str, store.read(1).collect())) == want
    other = shards.ShardStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(shards.CommitConflict):
        other.commit([], docs.schema.json(), version - 1)
    store.append(docs.limit(10))
    assert store.read().count() == len(rows) + 10
    assert store.vacuum() >= small and sorted(map(str, store.read(version).collect())) == want


def test_empty_store(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    store = shards.ShardStore(spark, f"file://{tmp_path}/e")
    store.append(docs)
    store.compact()
    assert store.read().count() == 0 and store.read().columns == docs.columns


def test_arrivals_merge_tier_by_tier_and_old_versions_stay_readable(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 90)) for i in range(900)], "doc_id long, text string")
    store = shards.ShardStore(spark, f"file://{tmp_path}/t", target=200_000, arrival_rows=40)
    parts, seen = docs.randomSplit([1.0] * 4, seed=3), []
    for k, part in enumerate(parts):
        store.append(part)
        seen = sorted(seen + [r.doc_id for r in part.collect()])
        before, version = store.version(), store.compact()
        for v in range(before, version):
            old, new = store.manifest(v)["shards"], {s["path"] for s in store.manifest(v + 1)["shards"]}
            assert len({s["tier"] for s in old if s["path"] not in new}) == 1 and len(new) < len(old)
        for v in {before, version}:
            assert sorted(r.doc_id for r in store.read(v).select("doc_id").collect()) == seen
    assert not store.due(store.manifest()["shards"]) and sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
