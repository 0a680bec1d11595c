"""Substring dedup by compact windows.

A text is a sequence of tokens, its shingles of SHINGLE = 5 words. Passages have LENGTH tokens or more (50 words). For each hash function, the
Cartesian tree of the token hashes groups the subsequences by their least hash: a node at token c with the smaller tokens l - 1
and r + 1 nearest to it on both sides is the compact window (l, c, r), of all subsequences that begin in l..c and end in
c..r (`tree`). Only nodes whose window holds LENGTH tokens count. They are the top of the tree, and just the minima of the
subsequences of LENGTH tokens, so running minima find them. Of a window only the subsequences of LENGTH tokens are asked for:
it is held as the run of their starts, which ends where the running minimum changes.

Two functions' windows of a text are joined by interval: where they overlap in a subsequence of LENGTH tokens around both minima, all
its subsequences there share both least hashes. That is one record, keyed by the two hashes. Documents that meet under one
key in one of BANDS pairs of functions are candidates: an exact repetition meets in all of them, two passages of similarity
0.8 with probability 0.95. Longer subsequences need no records, as they hold one of LENGTH tokens.

Records of a key are sorted by the distance of the two minima and the document; each is linked to the least document of the same
distance, and that one to the least of all, so a passage of a third of all documents costs one link a record and
no pairs within the group. A task does so with its own records first, so a key has a few records of each task behind the
shuffle. Where one of these links fails, all members of the key are compared on the tokens of their windows:
each against all others, unless all its subsequences already repeat and the whole group hangs together (`in_key`).

Candidate documents are verified passage against passage: a subsequence of LENGTH tokens counts if SHARE of its tokens (similarity
0.8) stand within LENGTH tokens of the other document; the words of all that count are the repeated passages.

Words are ASCII-lower-cased and divided by ASCII white space. Defined results: texts of fewer than 50 words, empty and null texts
have no passages; texts of any length that fits a task are compared whole; equal hashes within a window go to the token that
comes first; rows of equal id and text count as one document; a null id has passages like any; repetition within one
document does not count; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyscan.llm.common import blocks, components, mix64, shared_table

SHINGLE = 5
#: Tokens of a subsequence: with 5 words a token, passages of 50 words.
LENGTH = 46
BANDS = 3
#: Of a subsequence's tokens, so many must be in the other document: Jaccard similarity 0.8 is 2 * 0.8 / 1.8 of each side.
SHARE = -(-LENGTH * 16 // 18)
#: Records of a shuffled block group, on average.
GROUP = 400_000
RECORD = np.dtype([("key", "<u8"), ("apart", "<u2"), ("doc", "<i8")])
LINKED = np.dtype([("key", "<u8"), ("a", "<i8"), ("b", "<i8")])
#: The lowest bits of a token's hash carry its place, so a minimum tells both.
PLACE = np.uint64(0xFFFF)


#: Words are hashed as polynomials in PRIME, those of so many bytes of text together.
PRIME = 0x9E3779B97F4A7C15
TEXTS = 1 << 18
_FOLDED = np.array([x + 33 if 65 <= x <= 90 else x + 1 for x in range(256)], np.uint64)
_BLANK = np.array([x == 32 or 9 <= x <= 13 for x in range(256)])


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of PRIME and of its inverse modulo 2**64, from 0 to size - 1."""
    out = []
    for x in (PRIME, pow(PRIME, -1, 1 << 64)):
        steps = np.full(size, x, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _hashed(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes whose last is blank the words' beginnings and hashes."""
    power, inverse = _powers(1 << (len(data) - 1).bit_length())
    edges = np.flatnonzero(blank != np.r_[True, blank[:-1]])
    begin, end = edges[::2], edges[1::2]
    terms = _FOLDED[data] * power[: len(data)]
    total = np.cumsum(terms)
    h = mix64((total[end - 1] - total[begin] + terms[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return begin, (h >> np.uint64(32)).astype(np.uint32)


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """Texts -> arrays of 32-bit hashes of their words."""
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    blank = _BLANK[data]
    begins, found, at = [], [], 0
    while at < len(data):
        stop = min(at + TEXTS, len(data))
        last = np.flatnonzero(blank[at:stop])[-1:]
        # no word is cut: one longer than TEXTS makes the piece longer
        stop = at + int(last[0]) + 1 if len(last) else stop + int(blank[stop:].argmax()) + 1
        begin, h = _hashed(data[at:stop], blank[at:stop])
        begins.append(begin + at)
        found.append(h)
        at = stop
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return np.split(np.concatenate(found), np.searchsorted(np.concatenate(begins), ends[:-1]))


class Words:
    """A text -> the array of its words' hashes."""

    def __call__(self, text: bytes | None) -> np.ndarray:
        return word_hashes([text])[0]


def tokens(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = words.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (w[k : k + n] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return mix64(out)


def minima(h: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The least hash of every subsequence of `length` tokens, by doubled lengths."""
    n = len(h) - length + 1
    if n <= 0:
        return h[:0]
    width = 1
    while 2 * width <= length:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:n], h[length - width : length - width + n])


def tree(value: list[int], place: list[int], first: list[int], last: list[int]) -> tuple[list[int], list[int]]:
    """The windows [l, r] of the nodes at `place`, in order, of the Cartesian trees of several texts; first, last: of the node's text."""
    left, right, stack = [0] * len(value), list(last), []
    begin = -1
    for k, v in enumerate(value):
        if first[k] != begin:
            begin, stack = first[k], []
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[k] - 1
        left[k] = place[stack[-1]] + 1 if stack else begin
        stack.append(k)
    return left, right


def joined(t: np.ndarray, begin: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joint windows of all bands of texts with tokens t[begin[k] : begin[k + 1]]: records, first and last start of LENGTH tokens."""
    if len(t) < LENGTH:
        return np.empty(0, RECORD), np.empty(0, np.int64), np.empty(0, np.int64)
    of = np.repeat(np.arange(len(docs)), np.diff(begin))
    starts = np.arange(len(t) - LENGTH + 1)
    starts = starts[of[starts] == of[starts + LENGTH - 1]]
    if not len(starts):
        return np.empty(0, RECORD), np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.arange(len(t), dtype=np.uint64) & PLACE

    fresh = np.ones(len(starts), bool)  # starts of another text than the one before
    fresh[1:] = np.diff(starts) > 1

    def windows(k: int):
        """Of each start its node's hash and place."""
        h = mix64(t ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & (2**64 - 1))) & ~PLACE | place
        least = minima(h)[starts]
        # equal hashes: the earlier token is the less
        return least & ~PLACE, starts + ((least - starts.astype(np.uint64)) & PLACE).astype(np.int64)

    out, lows, highs = [], [], []
    for band in range(BANDS):
        (a, ca), (b, cb) = windows(2 * band), windows(2 * band + 1)
        # Two windows overlap in the starts from where either begins to where either ends
        begins = fresh.copy()
        begins[1:] |= (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])
        low = np.flatnonzero(begins)
        r = np.empty(len(low), RECORD)
        r["key"] = mix64(a[low] ^ (b[low] * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(band))
        r["apart"] = (cb[low] - ca[low]).astype(np.int16).view(np.uint16)
        r["doc"] = docs[of[starts[low]]]
        out.append(r)
        lows.append(starts[low])
        highs.append(starts[np.r_[low[1:], len(starts)] - 1])
    return np.concatenate(out), np.concatenate(lows), np.concatenate(highs)


def all_tokens(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of several texts one after another, and where each text's begin."""
    size = np.array([len(w) for w in words], np.int64)
    t = tokens(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    end = np.cumsum(size)
    inside = np.ones(len(t), bool)
    for k in range(1, SHINGLE):  # shingles across two texts
        over = end - k
        inside[over[(over >= 0) & (over < len(t))]] = False
    of = np.repeat(np.arange(len(words)), size)[: len(t)]
    return t[inside], np.searchsorted(of[inside], np.arange(len(words) + 1))


def _tokenise(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        found, held, size = [], [], 0
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for n, t in enumerate(texts):
            held.append(t)
            size += len(t or b"")
            if size > TEXTS or n == len(texts) - 1:
                found += [squeeze.compress(w.tobytes()) for w in word_hashes(held)]
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["rid", "id", "words"])


def _loose(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32)


def _dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix64(keys) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _emit(parts: int):
    """(rid, words) -> rows (part, block, links): records dealt by key; those that meet within the task as links, but for the least."""

    def made(held: list, docs: list) -> list[pa.RecordBatch]:
        t, begin = all_tokens(held)
        return joined(t, begin, np.array(docs, np.int64))[0]

    def batch_of(records: list):
        found, least = star(np.concatenate(records))
        block, near = blocks(least["key"], least, parts), blocks(found["key"], found, parts)
        none = lambda n: pa.nulls(n, pa.binary())
        names = ["part", "block", "links"]
        yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), none(block.num_rows)], names)
        yield pa.RecordBatch.from_arrays([near.column(0), none(near.num_rows), near.column(1)], names)

    def run(batches):
        records, count = [], 0
        for batch in batches:
            held, docs, size = [], [], 0
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for k, (rid, blob) in enumerate(rows):
                held.append(_loose(blob))
                docs.append(rid)
                size += len(held[-1])
                if size > 200_000 or k == len(rows) - 1:
                    records.append(made(held, docs))
                    count += len(records[-1])
                    held, docs, size = [], [], 0
                    if count > 1_500_000:
                        yield from batch_of(records)
                        records, count = [], 0
        if count:
            yield from batch_of(records)

    return run


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique of records, sorted field by field."""
    x = x[np.lexsort([x[name] for name in reversed(x.dtype.names)])]
    new = np.zeros(len(x), bool)
    new[:1] = True
    for name in x.dtype.names:
        new[1:] |= x[name][1:] != x[name][:-1]
    return x[new]


def star(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records -> links (a > b as numbers) of documents that meet under a key, and the least record of each key and distance.

    One link a record, to the least document of the same distance, and one a distance, to the least of all.
    """
    order = np.argsort(x["key"].copy())
    key = x["key"][order]
    new = np.r_[True, key[1:] != key[:-1]]
    alone = (new & np.r_[new[1:], True])[: len(x)]
    lone, x = x[order[alone]], x[order[~alone]]
    if not len(x):
        return np.empty(0, LINKED), lone
    x = x[np.lexsort((x["doc"], x["apart"], x["key"]))]
    key, doc = x["key"], x["doc"]
    group = np.r_[True, key[1:] != key[:-1]]
    sub = group | np.r_[True, x["apart"][1:] != x["apart"][:-1]]
    first_sub = np.maximum.accumulate(np.where(sub, np.arange(len(x)), 0))
    least = np.minimum.reduceat(doc, np.flatnonzero(group))[np.cumsum(group) - 1]
    a, b = np.concatenate([doc, doc[sub]]), np.concatenate([doc[first_sub], least[sub]])
    differ = a != b
    a, b, keys = a[differ], b[differ], np.concatenate([key, key[sub]])[differ]
    found = np.empty(len(a), LINKED)
    found["key"], found["a"], found["b"] = keys, np.maximum(a, b), np.minimum(a, b)
    return _distinct(found), np.concatenate([x[sub], lone])


def _candidates(table: pa.Table) -> pa.Table:
    """Pairs of documents (a > b as numbers) that meet under a key.

    key is 0 where a key has two documents only: their one pair leaves nothing to compare.
    """
    records = [np.frombuffer(x, RECORD) for x in table.column("block").to_pylist() if x]
    known = [np.frombuffer(x, LINKED) for x in table.column("links").to_pylist() if x]
    found = _distinct(np.concatenate([star(np.concatenate(records))[0] if records else np.empty(0, LINKED), *known]))
    both = np.empty(2 * len(found), np.dtype([("key", "<u8"), ("doc", "<i8")]))
    both["key"], both["doc"] = np.tile(found["key"], 2), np.concatenate([found["a"], found["b"]])
    keys, count = np.unique(_distinct(both)["key"], return_counts=True)
    if len(found):
        found["key"] = np.where(count[np.searchsorted(keys, found["key"])] > 2, found["key"], np.uint64(0))
    return pa.table({"key": pa.array(found["key"].view(np.int64)), "a": pa.array(found["a"]), "b": pa.array(found["b"])})


def _regions(parts: int):
    """(rid, words, keys) -> the tokens of the document's windows under these keys, dealt by key."""

    def made(held: list, rids: list, keys: list):
        t, begin = all_tokens(held)
        found, starts, ends = joined(t, begin, np.arange(len(held)))
        names, key = np.unique(np.concatenate(keys).view(np.uint64), return_inverse=True)
        wanted = np.repeat(np.arange(len(keys)), [len(k) for k in keys]) * len(names) + key
        rank = np.minimum(np.searchsorted(names, found["key"]), len(names) - 1)
        at = np.flatnonzero((names[rank] == found["key"]) & np.isin(found["doc"] * len(names) + rank, wanted))
        places = np.stack([found["doc"][at], found["key"][at].view(np.int64), starts[at], ends[at]], 1)
        places = places[np.lexsort(places.T[::-1])]
        places = places[np.r_[True, (places[1:] != places[:-1]).any(axis=1)][: len(places)]]
        low = (t >> np.uint64(32)).astype(np.uint32)
        once = {}  # equal regions of one document and key need comparing once
        for k, (doc, key, s, e) in enumerate(places.tolist()):
            once.setdefault((doc, key, low[s : e + LENGTH].tobytes()), k)
        places = places[list(once.values())]
        key, blob = np.ascontiguousarray(places[:, 1]), [x[2] for x in once]
        rid = np.array(rids, np.int64)[places[:, 0]]
        return pa.RecordBatch.from_arrays([pa.array(_dealt(key.view(np.uint64), parts)), pa.array(key), pa.array(rid), pa.array(blob, pa.binary())], ["part", "key", "rid", "region"])

    def run(batches):
        for batch in batches:
            held, rids, keys, size = [], [], [], 0
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for n, (rid, blob, some) in enumerate(rows):
                held.append(_loose(blob))
                rids.append(rid)
                keys.append(np.array(some, np.int64))
                size += len(held[-1])
                if size > 200_000 or n == len(rows) - 1:
                    yield made(held, rids, keys)
                    held, rids, keys, size = [], [], [], 0

    return run


def in_key(docs: list[int], regions: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of documents, of those that meet under a key, which share subsequences there.

    Not all pairs: enough that every subsequence that any other document of the key shares is in a pair with one that does, and that
    documents hang together by these pairs as they do by all. A token that one document alone has can't be shared, and documents
    alike in all others are compared as one.
    """
    flat, size = np.concatenate(regions), np.array([len(r) for r in regions])
    of = np.repeat(np.arange(len(docs)), size)
    names, flat = np.unique(flat, return_inverse=True)
    who = np.unique(np.array(docs), return_inverse=True)[1].astype(np.int64)
    pairs = np.unique(flat.astype(np.int64) * len(docs) + who[of])
    lone = np.bincount(pairs // len(docs), minlength=len(names)) < 2
    flat = np.where(lone[flat], -1, flat)
    begin = np.r_[0, np.cumsum(size)]
    window = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begin.tolist(), size.tolist())])
    hits = np.r_[0, np.cumsum(flat >= 0)]
    window = window[hits[window + LENGTH] - hits[window] >= SHARE]
    out, reps, alike, twins = [], [], {}, set()
    live = np.unique(of[window])
    for k in live.tolist():
        own = window[np.searchsorted(window, begin[k]) : np.searchsorted(window, begin[k + 1])]
        part = flat[own[0] : own[-1] + LENGTH]
        first = alike.setdefault((tuple((own - own[0]).tolist()), part.tobytes()), k)
        if first == k:
            reps.append(part)
        elif docs[first] != docs[k]:
            out.append((docs[k], docs[first]))
            twins.add(first)
    at = sorted(set(alike.values()))
    if len(at) < 2:
        return out
    size = np.array([len(r) for r in reps])
    begin, flat = np.r_[0, np.cumsum(size)], np.concatenate(reps)
    window = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begin.tolist(), size.tolist())])
    of = np.repeat(np.arange(len(at)), size)[window]
    hits = np.r_[0, np.cumsum(flat >= 0)]
    covered = hits[window + LENGTH] - hits[window] < SHARE  # nothing to look for
    first_of = np.searchsorted(of, np.arange(len(at) + 1))
    for i, k in enumerate(at):
        if k in twins:
            covered[first_of[i] : first_of[i + 1]] = True
    who = np.array([docs[k] for k in at])
    root = np.arange(len(at))
    for one in np.unique(who):  # a document's own runs hang together
        root[who == one] = np.flatnonzero(who == one)[0]
    has = np.zeros(len(names) + 1, bool)  # the last for -1
    for i in range(len(at)):
        if covered[first_of[i] : first_of[i + 1]].all() and (root == root[i]).all():
            continue
        has[reps[i]] = True
        has[-1] = False
        hits = np.r_[0, np.cumsum(has[flat])]
        has[reps[i]] = False
        good = hits[window + LENGTH] - hits[window] >= SHARE
        good &= who[of] != who[i]
        mine = slice(first_of[i], first_of[i + 1])
        here = window[mine] - begin[i]
        for j in np.unique(of[good]).tolist():
            its = slice(first_of[j], first_of[j + 1])
            if covered[mine].all() and root[j] == root[i] and not (good[its] & ~covered[its]).any():
                continue
            has[reps[j]] = True
            has[-1] = False
            hits = np.r_[0, np.cumsum(has[reps[i]])]
            has[reps[j]] = False
            back = hits[here + LENGTH] - hits[here] >= SHARE
            if not back.any():
                continue
            if root[j] != root[i] or (good[its] & ~covered[its]).any() or (back & ~covered[mine]).any():
                out.append((int(who[j]), int(who[i])))
                covered[its] |= good[its]
                covered[mine] |= back
                root[root == root[j]] = root[i]
    return out


def _in_keys(table: pa.Table) -> pa.Table:
    """Pairs of documents (a > b) to verify, from the regions of whole keys."""
    table = table.sort_by([("key", "ascending"), ("rid", "ascending")])
    key, rid = table.column("key").to_numpy(), table.column("rid").to_pylist()
    regions = [np.frombuffer(b, np.uint32) for b in table.column("region").to_pylist()]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
    found = sorted({(max(p), min(p)) for s, e in zip(at, at[1:]) for p in in_key(rid[s:e], regions[s:e])})
    return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})


def _within(q: list[np.ndarray]) -> bool:
    """Whether SHARE of a subsequence's tokens, with the places q of each, stand within LENGTH tokens."""
    places = sorted((p, k) for k, own in enumerate(q) for p in own.tolist())
    held: dict[int, int] = {}
    low = 0
    for p, k in places:
        held[k] = held.get(k, 0) + 1
        while places[low][0] <= p - LENGTH:
            k0 = places[low][1]
            held[k0] -= 1
            if not held[k0]:
                del held[k0]
            low += 1
        if len(held) >= SHARE:
            return True
    return False


def shared_starts(a: np.ndarray, b: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of LENGTH tokens of a of which SHARE stand within LENGTH tokens of b, and which tokens of a are in b.

    order: np.argsort(b), where it is known.
    """
    order = np.argsort(b) if order is None else order
    sorted_b = b[order]
    lo = np.minimum(np.searchsorted(sorted_b, a), len(b) - 1)
    hit = sorted_b[lo] == a
    total = np.r_[0, np.cumsum(hit)]
    good = np.flatnonzero(total[LENGTH:] - total[:-LENGTH] >= SHARE)
    if not len(good):
        return good, hit
    # Mostly SHARE tokens stand as far from each other as in a
    ahead = np.where(hit, order[lo] - np.arange(len(a)), 1 << 40)
    values, count = np.unique(ahead[good[0] : good[-1] + LENGTH], return_counts=True)
    sure = np.zeros(len(good), bool)
    for v in values[(count >= SHARE) & (values < 1 << 40)].tolist():
        total = np.r_[0, np.cumsum(ahead == v)]
        sure |= total[good + LENGTH] - total[good] >= SHARE
    if sure.all():
        return good, hit
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(sorted_b, a, "left"), np.searchsorted(sorted_b, a, "right")
    several = np.r_[0, np.cumsum(hi - lo > 1)]
    here = np.arange(len(a))
    # Token by token its places in b, ascending
    width = len(b) + 2 * LENGTH
    places = np.searchsorted(sorted_b, sorted_b) * width + order

    def test(q: np.ndarray) -> None:
        """Marks the subsequences of which SHARE stand together at the places q."""
        views = np.lib.stride_tricks.sliding_window_view(np.where(hit, q, 1 << 40), LENGTH)
        left = np.flatnonzero(~sure)
        for at in range(0, len(left), 4096):
            some = left[at : at + 4096]
            rows = np.sort(views[good[some]], axis=1)
            top = rows[:, SHARE - 1 :]
            sure[some] = ((top - rows[:, : LENGTH - SHARE + 1] < LENGTH) & (top < 1 << 40)).any(axis=1)

    first, last = order[np.minimum(lo, len(b) - 1)], order[np.maximum(hi - 1, 0)]
    test(first)
    left = np.flatnonzero(~sure & (several[good + LENGTH] > several[good]))
    if len(left):
        test(last)
        # By the places nearest to where the passage would be if it stood as far ahead as most tokens do
        values, count = np.unique(np.concatenate([(first - here)[hit], (last - here)[hit]]), return_counts=True)
        for v in [0, len(b) - len(a), *values[np.argsort(-count, kind="stable")[:6]].tolist()]:
            want = np.clip(here + v, 0, len(b))
            up = np.searchsorted(places, lo * width + want)
            high, low = order[np.clip(up, lo, np.maximum(hi - 1, lo)).clip(max=len(b) - 1)], order[np.clip(up - 1, lo, np.maximum(hi - 1, lo)).clip(max=len(b) - 1)]
            test(np.where(np.abs(high - want) <= np.abs(low - want), high, low))
            if sure.all():
                break
        # Exactly: a stretch of b misses so few tokens that it has one of the rarest
        left = np.flatnonzero(~sure & (several[good + LENGTH] > several[good])).tolist()
        for k in left:
            own = np.arange(good[k], good[k] + LENGTH)
            own = own[hit[own]]
            rare = own[np.argsort(hi[own] - lo[own], kind="stable")[: len(own) - SHARE + 1]]
            x = np.unique(np.concatenate([order[lo[p] : hi[p]] for p in rare.tolist()]))
            cut = np.flatnonzero(np.diff(x) >= LENGTH)
            for s, e in zip(x[np.r_[0, cut + 1]].tolist(), x[np.r_[cut, len(x) - 1]].tolist()):
                begin = np.searchsorted(places, lo[own] * width + max(0, s - LENGTH + 1))
                end = np.searchsorted(places, lo[own] * width + e + LENGTH)
                if np.count_nonzero(end > begin) >= SHARE and _within([order[f:t] for f, t in zip(begin.tolist(), end.tolist())]):
                    sure[k] = True
                    break
    return good[sure], hit


def shared_spans(a: np.ndarray, b: np.ndarray, order: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Stretches of words [start, end) of a of which b has a passage of similarity 0.8."""
    if len(a) < LENGTH or len(b) < LENGTH:
        return []
    good, hit = shared_starts(a, b, order)
    out: list[list[int]] = []
    for i in good.tolist():
        if out and i <= out[-1][1]:
            out[-1][1] = i + LENGTH
        else:
            out.append([i, i + LENGTH])
    spans = []
    for s, e in out:  # from token to token that both have; in words
        inside = np.flatnonzero(hit[s:e])
        spans.append((s + int(inside[0]), s + int(inside[-1]) + SHINGLE))
    return spans


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


LINK = "a long, b long, a_spans array<struct<s:int,e:int>>, b_spans array<struct<s:int,e:int>>"
_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _verify(batches):
    last = tb = order = None
    for batch in batches:
        rows = []
        for a, b, wa, wb in zip(*(c.to_pylist() for c in batch.columns)):
            if wa == wb:  # copies: all that has LENGTH tokens
                n = len(_loose(wa))
                if n >= LENGTH + SHINGLE - 1:
                    rows.append((a, b, [{"s": 0, "e": n}], [{"s": 0, "e": n}]))
                continue
            ta = tokens(_loose(wa))
            if wb != last:  # pairs come sorted by b
                last, tb = wb, tokens(_loose(wb))
                order = np.argsort(tb)
            sa = shared_spans(ta, tb, order)
            if sa:
                sb = shared_spans(tb, ta)
                if sb:
                    rows.append((a, b, [{"s": s, "e": e} for s, e in sa], [{"s": s, "e": e} for s, e in sb]))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], _SPANS), pa.array(cols[3], _SPANS)], ["a", "b", "a_spans", "b_spans"])


def links(spark: SparkSession, docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents (rid, id), verified links (a, b, a_spans, b_spans) between rids)."""
    rid = F.xxhash64(F.col(id), F.col(text))
    chosen = docs.select(rid.alias("rid"), F.col(id).alias("id"), F.col(text).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    table = shared_table(spark, chosen.mapInArrow(_tokenise, f"rid long, id {kind}, words binary"), "tokens")
    if not table.groupBy("rid").count().where("count > 1").isEmpty():
        table = shared_table(spark, table.groupBy("rid").agg(F.first("id").alias("id"), F.first("words").alias("words")), "tokens")
    size = table.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(48, int(size * 0.15) // GROUP)
    own = table.select("rid", "words")
    met = own.mapInArrow(_emit(parts), "part int, block binary, links binary").groupBy("part").applyInArrow(_candidates, "key long, a long, b long")
    met = shared_table(spark, met, "candidates")
    pairs = met.select("a", "b").distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        joined = pairs.join(own.select(F.col("rid").alias("a"), F.col("words").alias("wa")), "a")
        joined = joined.join(own.select(F.col("rid").alias("b"), F.col("words").alias("wb")), "b")
        return shared_table(spark, joined.select("a", "b", "wa", "wb").mapInArrow(_verify, LINK), name)

    found = verified(pairs, "links")
    # The keys of which a link failed, whole
    several = met.where("key <> 0")
    failed = several.join(found.select("a", "b"), ["a", "b"], "left_anti").select("key").distinct()
    members = several.join(failed, "key", "left_semi")
    members = members.select("key", F.explode(F.array("a", "b")).alias("rid")).distinct().groupBy("rid").agg(F.collect_list("key").alias("keys"))
    regions = own.join(members, "rid").select("rid", "words", "keys").mapInArrow(_regions(parts), "part int, key long, rid long, region binary")
    more = regions.groupBy("part").applyInArrow(_in_keys, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    more = verified(shared_table(spark, more, "candidates"), "links")
    return table.select("rid", "id"), found.unionByName(more)


def _merge(batches):
    for batch in batches:
        spans = [[{"s": s, "e": e} for s, e in merged((x["s"], x["e"]) for x in row)] for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["rid", "spans"])


def _of_documents(rows: DataFrame) -> DataFrame:
    """(rid, spans) with repetitions -> one row a rid with its merged spans; equal spans meet before they are gathered."""
    single = rows.select("rid", F.explode("spans").alias("x")).distinct()
    gathered = single.groupBy("rid").agg(F.collect_list("x").alias("spans"))
    return gathered.mapInArrow(_merge, "rid long, spans array<struct<s:int,e:int>>")


def repeated_passages(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document with a passage that another has too: id, class_id, n_words, spans.

    spans are words [s, e) of the text; class_id is the smallest id of the documents linked to it, directly or not.
    """
    known, found = links(spark, docs, id, text)
    both = found.select(F.col("a").alias("rid"), F.col("a_spans").alias("spans")).unionByName(found.select(F.col("b").alias("rid"), F.col("b_spans").alias("spans")))
    spans = _of_documents(both)
    named = shared_table(spark, components(spark, found).withColumnRenamed("node", "rid").join(known, "rid"), "named")
    low = shared_table(spark, named.groupBy("root").agg(F.min("id").alias("class_id")), "lows")
    words = F.aggregate("spans", F.lit(0), lambda n, x: n + x["e"] - x["s"])
    out = named.join(low, "root").join(spans, "rid")
    return out.select(F.col("id").alias(id), "class_id", words.alias("n_words"), "spans")


def remove_repeats(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the passages that another keeps; documents left without a word go. Columns of docs.

    Of two linked documents the one of the smaller hash of id and text keeps the passage, so one document keeps each,
    and reruns agree.
    """
    _, found = links(spark, docs, id, text)
    cut = found.select(F.greatest("a", "b").alias("rid"), F.when(F.col("a") > F.col("b"), F.col("a_spans")).otherwise(F.col("b_spans")).alias("spans"))
    spans = _of_documents(cut).select(F.col("rid").alias("__rid"), F.col("spans").alias("__spans"))
    joined = docs.withColumn("__rid", F.xxhash64(F.col(id), F.col(text))).join(spans, "__rid", "left").select(*[f"`{c}`" for c in docs.columns], "__spans")
    at, names = docs.columns.index(text), docs.columns
    width = len(names)

    def run(batches):
        for batch in batches:
            texts, kept = [], []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist()):
                t = t if not spans else without(t, [(x["s"], x["e"]) for x in spans])
                texts.append(t)
                kept.append(not spans or bool(t.strip(" \t\n\x0b\x0c\r")))
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : width]]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(kept, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words [s, e) of each span and the white space behind them."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : starts[s]])
        at = int(starts[e]) if e < len(starts) else len(data)
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
