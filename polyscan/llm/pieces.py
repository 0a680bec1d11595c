"""SentencePiece encoding and decoding: N-best segmentation by A* over the piece lattice.

The lattice has an edge for every piece of the vocabulary that matches, weighted by the piece's score; a character
that no piece covers is one edge of byte pieces. A forward Viterbi pass gives every node the best score from
the start; a backward A-star search from the end uses these scores as its heuristic. They are exact, so paths
come out in order of score and the first N are the N best. The vocabulary's file stores merge ranks as scores: this
is the best-scoring segmentation of the lattice, which may differ from what merging in rank order gives.

No piece has a blank after another character, a letter beside another sign, or a character that only bytes spell, so the lattice of a
text falls apart into one of each word or run of signs with the blanks before it (coarser ones if a vocabulary has such pieces). Their N best are kept by word, and the N best of the text
combine those of the N - 1 words with the smallest loss from best to second best: any other choice loses at
least as much as N - 1 better ones. Decoding joins the pieces' bytes and gives back every text exactly; a
literal U+2581, which stands for the blank in pieces, is spelled in bytes. The best and the loss come
from the forward pass, run over all new words of a length at once in numpy; the search runs for the few words whose
alternatives count.

Defined results: a null text has null ids and no score; an empty text has no pieces and score 0; a text of any length that fits
a task is solved whole; repeated rows and other columns pass unchanged, but a column that is named like one of the new ones gives
way; an empty table gives an empty one. Of segmentations of equal score the one with the shorter last piece comes first, then that with
the shorter last but one, and so on; of changes to words that cost a text the same, that to the earlier word. The vocabulary's path is a parameter; the driver reads it, and the table of fixed
size goes to the executors with the function.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
N_BEST = 4
#: Entries of a worker's table of known words, emptied when full; words longer than LONGEST are solved one at a time;
#: characters of the texts that a task solves together.
KNOWN, LONGEST, TOGETHER = 250_000, 40, 1_000_000


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores, and kinds: 0 for text, 1 for a byte, 2 for neither."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    kinds = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in ids]
    return [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], kinds


class Pieces:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, vocabulary: tuple[list[str], list[float], list[int]], n: int = N_BEST):
        names, scores, kinds = vocabulary
        self.n = n
        self.text = {p: (i, s) for i, (p, s, k) in enumerate(zip(names, scores, kinds)) if k == 0}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(names, kinds)) if k == 1}
        self.longest = max(map(len, self.text), default=1)
        self.missing = min((s for _, s in self.text.values() if s > -1e6), default=0.0) - 10.0
        self.bytes = [bytes([int(p[3:5], 16)]) if k == 1 else p.replace(BLANK, " ").encode() if k == 0 else b"" for p, k in zip(names, kinds)]
        letters = set("".join(self.text))
        self.alone = [c for c in "\n\t\r" if c not in letters]
        inside = any(BLANK in p.lstrip(BLANK) for p in self.text)
        stop = re.escape("".join(self.alone))
        coarse = rf" *[^ {stop}]+|[{stop}]| +" if stop else r" *[^ ]+| +"
        odd = re.escape("".join(sorted(c for c in letters if c.isalnum() and not c.isalpha())))
        fine = rf" *[^\W\d_{odd}]+| *(?:[\d_{odd}]|[^\w {stop}])+|{coarse}"
        # Letters part from other characters too, where no piece has both
        whole = [re.compile(r).findall for r in (fine, coarse) if all(len(re.findall(r, x.replace(BLANK, " "))) == 1 for x in self.text)]
        self.split = whole[0] if whole and not inside else lambda t: [t]
        self.letters = np.array(sorted(map(ord, letters - {BLANK} | {" "})), np.uint32)
        self.spelled = [p.replace(BLANK, " ") if k == 0 else None for p, k in zip(names, kinds)]
        self._forget()
        self.ranked: dict[str, list] = {}
        # Pieces by a polynomial hash: a small table says which hashes can be pieces, a sorted list which are
        names_ = sorted(self.text)
        hashes = np.array([self._hash(x) for x in names_], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.hash_id = np.array([self.text[names_[k]][0] for k in order], np.int32)
        self.hash_score = np.array([self.text[names_[k]][1] for k in order])
        self.may = np.zeros(1 << 20, bool)
        self.may[self._slot(self.hashes)] = True

    def _forget(self) -> None:
        """Empties the table of known words: slot by word, and by slot score, loss, length, round trip, first and number of its ids."""
        self.slot: dict[str, int] = {}
        self.score, self.loss, self.size, self.same = (np.zeros(0, t) for t in (np.float64, np.float64, np.int64, bool))
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def lattice(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For every end the edges (start, ids, score) into it. A word has blanks as ' '."""
        size, ends = len(word), [[]]
        marked = word.replace(BLANK, "\0").replace(" ", BLANK)
        get = self.text.get
        for j in range(1, size + 1):
            edges = []
            for i in range(max(0, j - self.longest), j):
                hit = get(marked[i:j])
                if hit is not None:
                    edges.append((i, (hit[0],), hit[1]))
            if not edges or edges[-1][0] != j - 1:  # no piece for this character: its bytes
                edges.append((j - 1, tuple(self.byte[b] for b in word[j - 1].encode("utf-8", "surrogatepass")), self.missing))
            ends.append(edges)
        return ends

    def nbest(self, word: str, n: int | None = None) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a stretch of text, best first."""
        n = self.n if n is None else n
        ends = self.lattice(word)
        best = [0.0]
        for edges in ends[1:]:
            best.append(max(best[i] + s for i, _, s in edges))
        out, count = [], 0
        heap = [(-best[-1], (), 0, len(word), 0.0, None)]
        while heap and len(out) < n:
            _, lengths, _, j, g, path = heapq.heappop(heap)
            if j == 0:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((g, ids))
                continue
            for i, ids, s in ends[j]:
                count += 1
                heapq.heappush(heap, (-(best[i] + g + s), (*lengths, j - i), count, i, g + s, (ids, path)))
        return out

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) % 2**64
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(44)).astype(np.int64)

    def _together(self, words: list[str]) -> None:
        """Viterbi, best and second best, over many words of one length at once; those with characters without a piece go alone."""
        size = len(words[0])
        c = np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size)
        plain = np.isin(c, self.letters).all(axis=1)
        if not plain.all():
            self._alone([words[k] for k in np.flatnonzero(~plain).tolist()])
            words, c = [words[k] for k in np.flatnonzero(plain).tolist()], c[plain]
        n, c = len(words), c.astype(np.uint64)
        if not n:
            return
        c[c == 32] = ord(BLANK)
        h = np.zeros((n, size), np.uint64)
        edges = []
        for length in range(1, min(size, self.longest) + 1):
            h = h[:, : size - length + 1] * self.BASE + c[:, length - 1 :] + np.uint64(1)
            row, col = np.nonzero(self.may[self._slot(h)])
            k = np.minimum(np.searchsorted(self.hashes, h[row, col]), len(self.hashes) - 1)
            real = self.hashes[k] == h[row, col]
            score, id_ = np.full(h.shape, -np.inf), np.zeros(h.shape, np.int32)
            score[row[real], col[real]] = self.hash_score[k[real]]
            id_[row[real], col[real]] = self.hash_id[k[real]]
            edges.append((score, id_))
        first, second = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        came, by = np.zeros((size + 1, n), np.int64), np.zeros((size + 1, n), np.int32)
        first[0] = 0.0
        for j in range(1, size + 1):
            for length in range(1, min(j, self.longest) + 1):
                score, id_ = edges[length - 1][0][:, j - length], edges[length - 1][1][:, j - length]
                one = first[j - length] + score
                better = one > first[j]
                second[j] = np.maximum(np.maximum(second[j], np.minimum(first[j], one)), second[j - length] + score)
                first[j] = np.where(better, one, first[j])
                came[j] = np.where(better, length, came[j])
                by[j] = np.where(better, id_, by[j])
        ids, count, at, rows = np.zeros((n, size), np.int32), np.zeros(n, int), np.full(n, size), np.arange(n)
        for step in range(size - 1, -1, -1):  # back from the end, ids filled in from the right
            open_ = at > 0
            if not open_.any():
                break
            ids[open_, step] = by[at[open_], rows[open_]]
            count[open_] += 1
            at = at - np.where(open_, came[at, rows], 0)
        used = np.arange(size)[None, :] >= size - count[:, None]
        self._learn(words, first[size], first[size] - second[size], count, ids[used], self.spelled, words)

    def _alone(self, words: list[str]) -> None:
        found = [self.nbest(w, 2) for w in words]
        loss = [f[0][0] - f[1][0] if len(f) > 1 else np.inf for f in found]
        texts = [w.encode("utf-8", "surrogatepass") for w in words]
        self._learn(words, [f[0][0] for f in found], loss, [len(f[0][1]) for f in found], [i for f in found for i in f[0][1]], self.bytes, texts)

    def _learn(self, words: list[str], score, loss, count, ids, table, texts) -> None:
        """Enters words, of which `ids` has all pieces one after another; table: what an id spells, as texts has the words."""
        at, base, flat = len(self.score), len(self.ids), np.asarray(ids, np.int32)
        count = np.asarray(count, np.int64)
        first = np.cumsum(count) - count
        pieces, empty = [table[i] for i in flat.tolist()], texts[0][:0]
        same = [empty.join(pieces[f:e]) == t for t, f, e in zip(texts, first.tolist(), (first + count).tolist())]
        self.slot.update(zip(words, range(at, at + len(words))))
        for name, more in (("score", score), ("loss", loss), ("size", [len(w) for w in words]), ("same", same), ("first", first + base), ("count", count), ("ids", flat)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.asarray(more, old.dtype)]))

    def prepare(self, words) -> None:
        """Enters the best segmentation of every word that is not known."""
        if len(self.slot) >= KNOWN:
            self._forget()
        by_size: dict[int, list[str]] = {}
        slot = self.slot
        for w in words:
            if w not in slot:
                by_size.setdefault(len(w), []).append(w)
        for size, some in by_size.items():
            if size > LONGEST:
                self._alone(some)
                continue
            step = max(1, 3_000_000 // (size * min(size, self.longest)))
            for at in range(0, len(some), step):
                self._together(some[at : at + step])

    def _ranked(self, word: str) -> list[tuple[float, list[int]]]:
        found = self.ranked.get(word)
        if found is None:
            if len(self.ranked) > KNOWN // 8:
                self.ranked.clear()
            found = self.ranked[word] = self.nbest(word)
        return found

    def _solve(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words of all texts, their slots, and where the words of each text begin and the last one's end."""
        words, begin = [], [0]
        for t in texts:
            if t:
                words += self.split(" " + t)
            begin.append(len(words))
        self.prepare(set(words))
        return words, np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words)), np.array(begin)

    def _choices(self, words: list[str], loss: np.ndarray) -> list[tuple[float, tuple]]:
        """The n best (loss, ((place, ids), ...)) of a text: changes to the words of least loss."""
        few = np.arange(len(loss))
        if len(loss) >= self.n > 1:
            few = np.flatnonzero(loss <= np.partition(loss, self.n - 2)[self.n - 2])
        few = few[np.argsort(loss[few], kind="stable")][: self.n - 1]
        choices = [(0.0, ())]
        for k in few.tolist():
            if loss[k] == np.inf:
                break
            ranked = self._ranked(words[k])
            choices = heapq.nsmallest(self.n, [(lost + ranked[0][0] - s, (*picked, (k, i)) if a else picked) for lost, picked in choices for a, (s, i) in enumerate(ranked)])
        return choices

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        count = self.count[slots]
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.first[slots] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)], count

    def best_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[float]], np.ndarray]:
        """For texts solved together: all ids, where each text's begin, the n best scores, whether the pieces spell the text."""
        words, slots, begin = self._solve(texts)
        ids, count = self._gather(slots)
        at = np.r_[0, np.cumsum(count)][begin]
        score, size, same = (np.zeros(len(texts), t) for t in (np.float64, np.int64, bool))
        full = np.flatnonzero(begin[1:] > begin[:-1])
        same[:] = True
        if len(full):
            score[full] = np.add.reduceat(self.score[slots], begin[:-1][full])
            size[full] = np.add.reduceat(self.size[slots], begin[:-1][full]) - 1
            same[full] = np.logical_and.reduceat(self.same[slots], begin[:-1][full])
        same &= size == np.array([len(t) for t in texts], np.int64)  # the words are stretches of the text, in order: alike if none is missing
        loss = self.loss[slots]
        scores = [[top - lost for lost, _ in self._choices(words[s:e], loss[s:e])] for top, s, e in zip(score.tolist(), begin.tolist(), begin[1:].tolist())]
        return ids, at, scores, same

    def encode_all(self, texts: list[str | None]) -> list[list[tuple[float, list[int]]] | None]:
        """encode() of each text, the words of all solved together."""
        words, slots, begin = self._solve(texts)
        out = []
        for t, s, e in zip(texts, begin.tolist(), begin[1:].tolist()):
            own, score = slots[s:e], float(self.score[slots[s:e]].sum())
            found = []
            for lost, picked in self._choices(words[s:e], self.loss[own]):
                change = dict(picked)
                found.append((score - lost, [i for k, x in enumerate(own.tolist()) for i in change.get(k, self.ids[self.first[x] : self.first[x] + self.count[x]].tolist())]))
            out.append(None if t is None else found)
        return out

    def encode(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text as (score, ids), best first."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


_SOLVERS: dict = {}


def _solver(vocabulary, n: int) -> Pieces:
    """The worker's encoder: one for all its tasks, as long as they have the same vocabulary."""
    key = hash((n, *vocabulary[0])), hash(tuple(vocabulary[1]))
    if key not in _SOLVERS:
        _SOLVERS.clear()
        _SOLVERS[key] = Pieces(vocabulary, n)
    return _SOLVERS[key]


def _parts(batch: pa.RecordBatch, at: int):
    """A batch in slices of about TOGETHER characters of text, each with its texts."""
    texts, start, size = batch.column(at).to_pylist(), 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= TOGETHER or k == len(texts) - 1:
            yield batch.slice(start, k + 1 - start), texts[start : k + 1]
            start, size = k + 1, 0


def _kept(df: DataFrame, text: str, names: list[str]) -> tuple[DataFrame, int, int]:
    """df without columns named like the new ones, the place of `text` in it, and how many columns to return."""
    new = {n.lower() for n in names}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    if text.lower() in new:
        return df.select(*kept, F.col(f"`{text}`").alias(f"__{text}")), len(kept), len(kept)
    out = df.select(*kept)
    return out, out.columns.index(text), len(kept)


def _schema(df: DataFrame, n: int) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[:n])


def encode(docs: DataFrame, text: str = "text", path: str = MODEL, n: int = N_BEST) -> DataFrame:
    """The columns of docs and piece_ids array<int> (best), n_pieces, piece_score, nbest_scores array<double>, round_trip."""
    vocabulary = load(path)
    names = ["piece_ids", "n_pieces", "piece_score", "nbest_scores", "round_trip"]
    frame, at, width = _kept(docs, text, names)

    def run(batches):
        pieces = _solver(vocabulary, n)
        for batch in batches:
            for part, texts in _parts(batch, at):
                null = np.array([t is None for t in texts], bool)
                ids, begin, scores, same = pieces.best_all([t or "" for t in texts])
                rows = pa.ListArray.from_arrays(pa.array(begin, pa.int32(), mask=np.r_[null, False]), pa.array(ids))
                best = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in scores])], pa.int32(), mask=np.r_[null, False]), pa.array([x for s in scores for x in s], pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], rows, pa.array(np.diff(begin), pa.int64(), mask=null), pa.array([s[0] for s in scores], pa.float64(), mask=null), best, pa.array(same, mask=null)],
                    [*part.schema.names[:width], *names],
                )

    return frame.mapInArrow(run, f"{_schema(frame, width)}piece_ids array<int>, n_pieces long, piece_score double, nbest_scores array<double>, round_trip boolean")


def decode(df: DataFrame, ids: str = "piece_ids", out: str = "decoded", path: str = MODEL) -> DataFrame:
    """df with `out`, the text that the ids spell; null for null ids. A column that is named like it gives way."""
    vocabulary = load(path)
    frame, at, width = _kept(df, ids, [out])

    def run(batches):
        pieces = Pieces(vocabulary, 1)
        for batch in batches:
            texts = [None if i is None else pieces.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], [*batch.schema.names[:width], out])

    return frame.mapInArrow(run, f"{_schema(frame, width)}`{out}` string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs)
    digest = F.sha2(F.concat_ws(",", F.col("piece_ids").cast("array<string>")), 256)
    return out.select("doc_id", "n_pieces", "piece_score", "nbest_scores", "round_trip", digest.alias("ids_sha256"))
