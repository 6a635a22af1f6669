"""SentencePiece encoding and decoding: exact N-best segmentations of whole texts."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from plumbline.llm.common import fresh, map_texts, small_batches, slices

SPACE = "▁"
#: Stands for a literal U+2581, which spaces would otherwise swallow: no text holds a lone surrogate.
LITERAL = "\ud800"
#: A word, or a newline: no piece has the space sign after another character or a newline beside one, so none crosses.
WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def load_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, with the model's own scores; read on the driver, about 32,000 entries."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class Segmenter:
    """The lattice of all segmentations of a text into pieces, and its best paths.

    A path's score is the sum of its pieces' scores. A character that is no piece is spelled with byte pieces, at the
    lowest score less 10. The lattice falls apart wherever no piece crosses, so words are searched on their own: a
    forward Viterbi pass gives the best score of every prefix, which is the exact remaining cost for an A* search
    that runs backward from the end; as every entry's priority is then the score of its best completion, only the n
    best entries of the agenda can matter, which bounds it. Words join by the same search over their alternatives.
    """

    def __init__(self, pieces: list[tuple[str, float, str]], hold: int = 150_000):
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "piece" else b"" for p, _, k in pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        normal = [(p, i, s) for i, (p, s, k) in enumerate(pieces) if k == "piece"]
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p, _, _ in normal):
            raise ValueError("a piece crosses from one word to the next")
        self.unknown = min((s for _, _, s in normal), default=0.0) - 10
        #: Every beginning of a piece, with its id and score where it is a piece itself; every end of a piece.
        self.prefixes: dict[str, tuple[int, float] | None] = {}
        self.suffixes: set[str] = set()
        for p, i, s in normal:
            for k in range(1, len(p)):
                self.prefixes.setdefault(p[:k], None)
            self.prefixes[p] = (i, s)
            self.suffixes.update(p[k:] for k in range(len(p)))
        self.pairs = {p[k : k + 2] for p, _, _ in normal for k in range(len(p) - 1)}
        self._build_trie([(p, i, s) for p, i, s in normal])
        self.hold = hold
        self.alternatives: dict[tuple[str, int], list] = {}
        self._forget()
        self.byte_at = np.concatenate([[0], np.cumsum([len(x) for x in self.bytes_of])])
        self.byte_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _forget(self) -> None:
        """Empties what is held of words: their ids one after another, where each begins, best scores and gaps."""
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.best, self.gaps = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.float64, np.float64))

    def _build_trie(self, normal: list[tuple[str, int, float]], classes: int = 160) -> None:
        """Dense moves of a trie over the commonest characters, Latin ones first, for the search of many words at once."""
        common: dict[str, int] = {}
        for p, _, _ in normal:
            for c in p:
                common[c] = common.get(c, 0) + 1
        chosen = sorted(common, key=lambda c: (ord(c) >= 0x180 and c != SPACE, -common[c], c))[: classes - 1]
        self.classes = np.zeros(0x110000, np.uint8)
        for k, c in enumerate(chosen):
            self.classes[ord(c)] = k + 1
        moves: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for p, i, s in normal:
            at = 0
            for c in p:
                k = int(self.classes[ord(c)])
                if not k:
                    break
                at = moves.setdefault((at, k), len(moves) + 1)
            else:
                ends[at] = (i, s)
        self.width, n = classes, len(moves) + 1
        self.moves = np.zeros(n * classes, np.int32)
        for (at, k), to in moves.items():
            self.moves[at * classes + k] = to
        self.end_id, self.end_score = np.full(n, -1, np.int32), np.zeros(n)
        for at, (i, s) in ends.items():
            self.end_id[at], self.end_score[at] = i, s

    def _forward(self, w: str) -> tuple[list[float], list]:
        """Viterbi: the best score of every prefix, and its last piece as (begin, id); id -1: spelled with bytes."""
        n, get = len(w), self.prefixes.get
        best, back = [float("-inf")] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b, single = best[i], False
            for j in range(i + 1, n + 1):
                found = get(w[i:j], 0)
                if found == 0:
                    break
                if found:
                    single = single or j == i + 1
                    if b + found[1] > best[j]:
                        best[j], back[j] = b + found[1], (i, found[0])
            if not single and b + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = b + self.unknown, (i, -1)
        return best, back

    def _into(self, w: str, j: int) -> list[tuple[int, int, float]]:
        """The lattice's edges that end at ``j``: (begin, id, score)."""
        out, get = [], self.prefixes.get
        for i in range(j - 1, -1, -1):
            part = w[i:j]
            if part not in self.suffixes:
                break
            found = get(part)
            if found:
                out.append((i, found[0], found[1]))
        if not out or out[0][0] != j - 1:
            out.append((j - 1, -1, self.unknown))
        return out

    def _spell(self, w: str, path: list[tuple[int, int]]) -> list[int]:
        """Ids of a path of (begin, id) in order."""
        out: list[int] = []
        for i, piece in path:
            if piece >= 0:
                out.append(piece)
            else:
                c = SPACE if w[i] == LITERAL else w[i]
                out += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        return out

    def nbest(self, w: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of ``w``, best first; equal scores by the pieces from the end, earliest begin first."""
        if not w:
            return [(0.0, [])]
        best, _ = self._forward(w)
        agenda = [(-best[len(w)], 0, None, 0.0, len(w))]  # minus the best total, serial, the path from the end, its score, where it begins
        out, serial = [], 0
        while agenda and len(out) < n:
            total, _, path, score, at = heapq.heappop(agenda)
            if at == 0:
                steps = []
                while path is not None:
                    step, path = path
                    steps.append(step)
                out.append((-total, self._spell(w, steps)))
                continue
            for i, piece, s in self._into(w, at):
                serial += 1
                heapq.heappush(agenda, (-(best[i] + s + score), serial, ((i, piece), path), s + score, i))
            if len(agenda) > 2 * n + 16:
                agenda = heapq.nsmallest(n - len(out), agenda)
        return out

    def _one(self, w: str) -> tuple[np.ndarray, float, float]:
        """The best path of a word, its score, and how far the second best is behind it."""
        ids: list[int] = []
        gap, score = float("inf"), 0.0
        for part in self.cut(w):
            best, back = self._forward(part)
            path, j = [], len(part)
            score += best[j]
            while j:  # the second best leaves the best path, seen from the end, at one of its ends
                for i, piece, s in self._into(part, j):
                    if (i, piece) != back[j]:
                        gap = min(gap, best[j] - best[i] - s)
                path.append(back[j])
                j = back[j][0]
            ids += self._spell(part, path[::-1])
        return np.array(ids, np.int32), score, gap

    def _many(self, words: list[str], n: int):
        """The same for many words of one length: Viterbi with the two best scores of every prefix, a position at a
        time for all words. Words with a character outside the trie's, or that is no piece, come back as odd."""
        m = len(words)
        kind = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(m, n).T.copy()
        odd = (kind == 0).any(axis=0)
        top, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        last, size = np.zeros((n + 1, m), np.int32), np.ones((n + 1, m), np.int16)
        top[0] = 0
        for i in range(n):
            who, node = np.flatnonzero(~odd), 0
            for j in range(i + 1, n + 1):
                node = self.moves[node * self.width + kind[j - 1, who].astype(np.int64)]
                piece = self.end_id[node]
                if j == i + 1:
                    odd[who[piece < 0]] = True
                live = np.flatnonzero(node)
                if len(live) < len(who):
                    who, node, piece = who[live], node[live], piece[live]
                if not len(who):
                    break
                have = np.flatnonzero(piece >= 0)
                if len(have):
                    w, p = who[have], piece[have]
                    s = self.end_score[node[have]]
                    c1, c2, t1, t2 = top[i, w] + s, second[i, w] + s, top[j, w], second[j, w]
                    better = c1 > t1
                    second[j, w] = np.maximum(np.maximum(np.minimum(t1, c1), t2), c2)
                    w, p = w[better], p[better]
                    top[j, w], last[j, w], size[j, w] = c1[better], p, j - i
        at, every, steps = np.full(m, n), np.arange(m), []
        at[odd] = 0
        while at.any():
            steps.append(np.where(at > 0, last[at, every], -1))
            at = at - np.where(at > 0, size[at, every], 0)
        path = np.array(steps[::-1] or np.zeros((0, m)), np.int32).T
        with np.errstate(invalid="ignore"):
            return odd, path[path >= 0], (path >= 0).sum(axis=1), top[n], top[n] - second[n]

    def learn(self, words: set[str]) -> None:
        """Holds the best path of every word, with its score and the gap to the second best."""
        if len(self.index) + len(words) > self.hold:
            self._forget()
            self.alternatives.clear()
        by_length: dict[int, list[str]] = {}
        for w in words:
            if w not in self.index:
                by_length.setdefault(len(w), []).append(w)
        names, flat, sizes, best, gaps = [], [self.flat], [self.sizes], [self.best], [self.gaps]
        odd = [w for n, group in by_length.items() if n > 48 or len(group) < 8 for w in group]
        for n, group in ((n, g[k : k + 20_000]) for n, g in by_length.items() if n <= 48 and len(g) >= 8 for k in range(0, len(g), 20_000)):
            strange, ids, size, score, gap = self._many(group, n)
            odd += [group[k] for k in np.flatnonzero(strange)]
            names += [w for w, x in zip(group, strange.tolist(), strict=True) if not x]
            flat.append(ids)
            for all_, x in ((sizes, size), (best, score), (gaps, gap)):
                all_.append(x[~strange])
        for w in odd:
            ids, score, gap = self._one(w)
            names.append(w)
            flat.append(ids)
            for all_, x in ((sizes, len(ids)), (best, score), (gaps, gap)):
                all_.append([x])
        first = len(self.index)
        self.index.update(zip(names, range(first, first + len(names)), strict=True))
        self.flat, self.best, self.gaps = np.concatenate(flat), np.concatenate(best), np.concatenate(gaps)
        self.sizes = np.concatenate(sizes).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def cut(self, w: str) -> list[str]:
        """``w`` cut wherever no piece crosses."""
        out, begin = [], 0
        for k in range(1, len(w)):
            if w[k - 1 : k + 1] not in self.pairs:
                out.append(w[begin:k])
                begin = k
        out.append(w[begin:])
        return out

    def _alternatives(self, w: str, n: int) -> list[tuple[float, list[int]]]:
        if (w, n) not in self.alternatives:
            if len(self.alternatives) > 10_000:
                self.alternatives.clear()
            self.alternatives[w, n] = combine([self.nbest(p, n) for p in self.cut(w)], n)
        return self.alternatives[w, n]

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else []

    def encode(self, text: str | None, n: int = 3):
        words = self.words(text)
        self.learn(set(words))
        return self.encode_words(words, n)

    def encode_words(self, words: list[str], n: int):
        """(ids of the best, its score, alternatives): an alternative has its score and what it changes in the best,
        as (first position, number of ids that go, ids that come). The words must have been learnt."""
        if not words:
            return np.zeros(0, np.int32), 0.0, []
        k = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        size = self.sizes[k]
        begin = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.starts[k] - begin, size) + np.arange(size.sum())]
        score = float(self.best[k].sum())
        if n < 2:
            return ids, score, []
        # Only the n - 1 words that cost least to change can differ in the n best: each of them alone gives a
        # segmentation at least as good as any that changes a further word.
        cost = self.gaps[k]
        near = np.arange(len(cost))
        if len(cost) >= n:
            near = np.flatnonzero(cost <= np.partition(cost, n - 2)[n - 2])
            near = near[np.argsort(cost[near], kind="stable")[: n - 1]]
        near = np.sort(near[np.isfinite(cost[near])])
        if not len(near):
            return ids, score, []
        lists = [self._alternatives(words[x], n) for x in near]
        found = combine([[(s, [(p, r)]) for r, (s, _) in enumerate(a)] for p, a in enumerate(lists)], n)
        out, top = [], found[0][0]
        for total, picks in found[1:]:
            out.append((score + (total - top), [(int(begin[near[p]]), int(size[near[p]]), lists[p][r][1]) for p, r in picks if r]))
        return ids, score, out

    def decode(self, ids) -> str:
        """The text of a sequence of ids; the space before the first word isn't part of it."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        size = self.byte_at[ids + 1] - self.byte_at[ids]
        data = self.byte_flat[np.repeat(self.byte_at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
        return (data[1:] if data.startswith(b" ") else data).decode("utf-8", "replace")


def combine(lists: list[list[tuple[float, list]]], n: int) -> list[tuple[float, list]]:
    """The n best sums of one entry from each list (each best first), with the entries' lists joined."""
    found = [(0.0, [])]
    for options in lists:
        found = [(s + t, a + b) for s, a in found for t, b in options]
        if len(found) > n:
            found = [x for _, x in sorted(enumerate(found), key=lambda e: (-e[1][0], e[0]))[:n]]
    return found


def encode_texts(docs: DataFrame, pieces: list[tuple[str, float, str]], keep: list[str], n: int = 3, text_col: str = "text") -> DataFrame:
    """``keep`` plus ids (of the best segmentation), score, alternatives (the next n - 1) and round_trip.

    alternatives: array of (score, edits), best first; an edit says at which position how many of the best's ids go
    and which come, so that long texts are not written n times. round_trip: whether decoding ids gives the text.

    Defined cases: null and empty texts have no ids, score 0, no alternatives, and round_trip true for an empty,
    null for a null text; a literal U+2581 is spelled with byte pieces and survives; a text with fewer segmentations
    than n has all it has; equal scores keep the order of the search, which is fixed; an empty table gives an empty
    table; rows that repeat are answered each; columns not in ``keep`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # bounded by the vocabulary
    small_batches(docs.sparkSession)
    names = [fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), x) for x in ("ids", "score", "alternatives", "round_trip")]
    edit = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    more = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))]))

    def run(batches):
        s = _segmenter(shared.value)
        for batch in slices(batches, len(keep)):
            texts = batch.column(len(keep)).to_pylist()
            words = [s.words(t) for t in texts]
            s.learn(set().union(*words))
            found = [s.encode_words(w, n) for w in words]
            ids = pa.ListArray.from_arrays(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32), np.concatenate([f[0] for f in found] or [np.zeros(0, np.int32)]))
            others = [[{"score": t, "edits": [{"at": a, "drop": d, "ids": i} for a, d, i in e]} for t, e in f[2]] for f in found]
            again = [None if t is None else s.decode(f[0]) == t for t, f in zip(texts, found, strict=True)]
            made = [ids, pa.array([f[1] for f in found], pa.float64()), pa.array(others, more), pa.array(again, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *names])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`"))
    kinds = _parse_datatype_string("ids array<int>, score double, alternatives array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>, round_trip boolean").fields
    return source.mapInArrow(run, StructType([*source.schema.fields[: len(keep)], *(StructField(c, f.dataType) for c, f in zip(names, kinds, strict=True))]))


def decode_ids(rows: DataFrame, pieces: list[tuple[str, float, str]], keep: list[str], ids_col: str = "ids") -> DataFrame:
    """``keep`` plus the decoded text; null ids stay null, unknown numbers are refused."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def start():
        s = _segmenter(shared.value)
        return lambda ids: (None if ids is None else s.decode(ids),)

    return map_texts(rows, start, "decoded string", keep, ids_col)


_held: dict = {}


def _segmenter(pieces) -> Segmenter:
    key = (len(pieces), hash(tuple(pieces)))
    if key not in _held:
        _held.clear()
        _held[key] = Segmenter(pieces)
    return _held[key]

