"""SentencePiece encoding with N-best segmentation, and decoding, over the piece lattice of a .model file.

Forward Viterbi scores of the lattice are exact heuristics of a backward A* search: hypotheses grow from the end of the
text, are ordered by (score of what they hold) + (best score of what is left), and leave the queue in order of their
whole score. Scores are those stored in the model; a character that no piece covers becomes its bytes, with one penalty.

Whole texts factor exactly: where no piece of the model holds two neighbouring kinds of characters (letters and
punctuation, a word and the mark after it, line ends), the lattice has a cut; the model's own pieces decide which rules hold. Words are searched once and kept in a bounded memo. The N best of a text differ from its best
only in the N - 1 words whose second-best segmentation costs least, so A* runs for those words alone.

Defined results: a null or empty text has no pieces, score 0 and decodes to itself; texts with the mark U+2581 decode to
spaces in its place (round_trip false), as in the format itself; of equal scores the best segmentation has the longest last
piece, then the longest before it, on every path of this module, and further ones follow by the words they change, from the
left; repeated rows are encoded alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import tokens

MARK = "▁"
N_BEST = 4
#: The model's penalty for an uncovered character, below its least usable score; scores below UNUSABLE mark reserved pieces.
PENALTY, UNUSABLE = 10.0, -1e8
#: Words kept by the memo of one Python worker.
MEMO = 900_000
#: Words of one vectorised block, and the longest word in one.
BLOCK_WORDS, BLOCK_LENGTH = 4096, 40
#: Slots of each side of the hash table of pieces.
SLOTS = 1 << 20
#: Ways to cut texts, finest first; one is used if no piece of the model spans two of its matches.
_CUTS = (
    re.compile(f"{MARK}*[^{MARK}\\W\\d_²]+|{MARK}*(?:[^{MARK}\n\\w]|[_²])+|{MARK}*\\d+|{MARK}+|\n"),
    re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"),
)


def _span_hash(polynomial: np.ndarray, size: int) -> np.ndarray:
    return tokens.mix(polynomial + np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _slot(keys: np.ndarray, side: int) -> np.ndarray:
    return (keys >> np.uint64(20 * side) & np.uint64(SLOTS - 1)).astype(np.int64)


class Model:
    """Pieces, scores and ids of a .model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.pieces = {self.text[i]: (i, sp.get_score(i)) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.bytes_ids = [0] * 256
        for i in range(size):
            if sp.is_byte(i):
                self.bytes_ids[int(self.text[i][3:5], 16)] = i
        usable = [s for _, s in self.pieces.values() if s > UNUSABLE]
        self.unknown = min(usable, default=0.0) - PENALTY
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        self.raw = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.single = {p for p in self.pieces if len(p) == 1}
        self.longest = max(map(len, self.pieces))
        keys = np.array([self._key(p) for p in self.pieces], np.uint64)
        order = np.argsort(keys)
        self.span_keys = keys[order]
        self.span_ids, self.span_scores = (np.array([v[k] for v in self.pieces.values()])[order] for k in (0, 1))
        # Two-choice hash table of the keys; if a key finds both its places taken, bisection serves instead.
        self.slots, crowded = np.zeros((2, SLOTS), np.int32), []
        taken = np.zeros((2, SLOTS), bool)
        for place, (a, b) in enumerate(zip(*[_slot(self.span_keys, k).tolist() for k in (0, 1)], strict=True)):
            side, slot = (0, a) if not taken[0, a] else (1, b)
            if taken[side, slot]:
                crowded.append(place)
                continue
            taken[side, slot], self.slots[side, slot] = True, place
        self.crowded = bool(crowded)
        self.cut = next((c for c in _CUTS if all(len(c.findall(p)) == 1 for p in self.pieces)), None)

    @staticmethod
    def _key(piece: str) -> np.uint64:
        power, _ = tokens.powers(len(piece))
        codes = np.array([ord(c) + 1 for c in piece], np.uint64)
        return _span_hash((codes * power[: len(piece)]).sum(dtype=np.uint64)[None], len(piece))[0]

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys among the pieces, and whether they are pieces."""
        if self.crowded:
            at = np.minimum(np.searchsorted(self.span_keys, key), len(self.span_keys) - 1)
            return at, self.span_keys[at] == key
        at, other = self.slots[0][_slot(key, 0)], self.slots[1][_slot(key, 1)]
        at = np.where(self.span_keys[at] == key, at, other)
        return at, self.span_keys[at] == key

    def lattice(self, word: str) -> list[list[tuple[int, float, int]]]:
        """For each end: (start, score, id) of the nodes that end there; id -1 is an uncovered character."""
        n, pieces, prefixes = len(word), self.pieces, self.prefixes
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                part = word[i:j]
                if part not in prefixes:
                    break
                if part in pieces:
                    k, score = pieces[part]
                    ends[j].append((i, score, k))
                    single = single or j == i + 1
            if not single:
                ends[i + 1].append((i, self.unknown, -1))
        return ends

    def ids_of(self, word: str, path: list[tuple[int, int, int]]) -> tuple[int, ...]:
        """Ids along a path of (start, end, id), uncovered characters as bytes."""
        return tuple(chain.from_iterable((k,) if k >= 0 else (self.bytes_ids[b] for b in word[i:j].encode()) for i, j, k in path))

    def best(self, word: str) -> tuple[float, tuple[int, ...], float]:
        """Viterbi score and ids, and what the second-best segmentation costs (inf: there is none)."""
        if word in self.pieces and len(word) == 1:
            k, score = self.pieces[word]
            return score, (k,), float("inf")
        ends, n = self.lattice(word), len(word)
        ahead: list[float] = [0.0] + [float("-inf")] * n
        back: list[tuple[int, float, int] | None] = [None] * (n + 1)
        for j in range(1, n + 1):
            for node in ends[j]:
                x = ahead[node[0]] + node[1]
                if x > ahead[j] or back[j] is None:
                    ahead[j], back[j] = x, node
        behind = [float("-inf")] * n + [0.0]
        path, used, j = [], set(), n
        while j:
            i, _, k = back[j]
            path.append((i, j, k))
            used.add((i, j))
            j = i
        second = float("-inf")
        for j in range(n, 0, -1):
            b = behind[j]
            for i, score, _ in ends[j]:
                x = score + b
                if x > behind[i]:
                    behind[i] = x
                if (i, j) not in used and x + ahead[i] > second:
                    second = x + ahead[i]
        return ahead[n], self.ids_of(word, path[::-1]), ahead[n] - second

    def best_many(self, words: list[str]) -> list[tuple[float, tuple[int, ...], float]]:
        """best() of many words: like lengths together, all words of a block at once."""
        out: list = [None] * len(words)
        plain = []
        for i, w in enumerate(words):
            if len(w) <= BLOCK_LENGTH and self.single.issuperset(w):
                plain.append(i)
            else:
                out[i] = self.best(w)
        plain.sort(key=lambda i: len(words[i]))
        for k in range(0, len(plain), BLOCK_WORDS):
            block = plain[k : k + BLOCK_WORDS]
            for i, found in zip(block, self._block([words[i] for i in block]), strict=True):
                out[i] = found
        return out

    def _block(self, words: list[str]) -> Iterator[tuple[float, tuple[int, ...], float]]:
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        wide, deep = int(lengths.max()), int(min(lengths.max(), self.longest))
        chars = np.array(words, f"U{wide}").view(np.uint32).reshape(n, wide)
        power, inverse = tokens.powers(wide)
        total = np.zeros((n, wide + 1), np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[:wide], axis=1, out=total[:, 1:])
        none, every = -np.inf, np.arange(n)
        scores = np.full((wide, deep, n), none)  # by start, length - 1, word
        ids = np.zeros((wide, deep, n), np.int32)
        for i in range(wide):
            for size in range(1, min(deep, wide - i) + 1):
                live = np.flatnonzero(lengths >= i + size)
                key = _span_hash((total[live, i + size] - total[live, i]) * inverse[i], size)
                at, hit = self._find(key)
                scores[i, size - 1, live[hit]] = self.span_scores[at[hit]]
                ids[i, size - 1, live[hit]] = self.span_ids[at[hit]]
        ahead, behind, back = np.full((wide + 1, n), none), np.full((wide + 1, n), none), np.zeros((wide + 1, n), np.int64)
        ahead[0], behind[lengths, every] = 0, 0
        for j in range(1, wide + 1):
            most = min(j, deep)
            reach = np.stack([ahead[j - size] + scores[j - size, size - 1] for size in range(most, 0, -1)])
            place = reach.argmax(0)
            back[j], ahead[j] = most - place, reach[place, every]
        second = np.full(n, none)
        places, steps = lengths.copy(), []
        used = np.zeros((wide, deep, n), bool)
        while places.any():
            size = np.where(places > 0, back[places, every], 1)
            start = np.maximum(places - size, 0)
            steps.append(np.where(places > 0, ids[start, size - 1, every], -1))
            live = np.flatnonzero(places > 0)
            used[start[live], size[live] - 1, live] = True
            places = np.where(places > 0, start, 0)
        for i in range(wide - 1, -1, -1):
            for size in range(1, min(deep, wide - i) + 1):
                left = scores[i, size - 1] + behind[i + size]
                np.maximum(behind[i], left, out=behind[i])
                np.maximum(second, np.where(used[i, size - 1], none, left + ahead[i]), out=second)
        score = ahead[lengths, every]
        paths = np.stack(steps[::-1]).T if steps else np.zeros((n, 0), int)
        with np.errstate(invalid="ignore"):
            costs = (score - second).tolist()
        for s, path, cost in zip(score.tolist(), paths.tolist(), costs, strict=True):
            yield s, tuple([k for k in path if k >= 0]), cost

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first: backward A* with forward Viterbi scores."""
        ends, size = self.lattice(word), len(word)
        ahead = [0.0] + [float("-inf")] * size
        for j in range(1, size + 1):
            ahead[j] = max(ahead[i] + s for i, s, _ in ends[j])
        # Of equal scores the newest comes first, and nodes are pushed shortest first: straight to the start by longest pieces.
        queue: list = [(-ahead[size], 0, size, 0.0, None)]
        out, pushed = [], 0
        while queue and len(out) < n:
            _, _, j, held, path = heapq.heappop(queue)
            if not j:
                whole = []
                while path:
                    whole.append(path[0])
                    path = path[1]
                out.append((held, self.ids_of(word, whole)))
                continue
            for i, s, k in reversed(ends[j]):
                pushed -= 1
                heapq.heappush(queue, (-(held + s + ahead[i]), pushed, i, held + s, ((i, j, k), path)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Text of ids, without the first space that encoding adds."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return data[1:] if data.startswith(b" ") else data


class Memo:
    """Words already searched: their ids, scores and second-best costs in flat arrays. Full, it keeps the words met twice."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.firsts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.scores, self.costs, self.met = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)

    def add(self, words: list[str], found: list[tuple[float, tuple[int, ...], float]]) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable([f[1] for f in found]), np.int32)])
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum([len(f[1]) for f in found], dtype=np.int64)])
        self.scores = np.concatenate([self.scores, [f[0] for f in found]])
        self.costs = np.concatenate([self.costs, [f[2] for f in found]])
        self.met = np.concatenate([self.met, np.zeros(len(found), np.int64)])

    def shrink(self) -> None:
        keep = self.met > 1
        words = [w for w, k in zip(self.place, keep.tolist(), strict=True) if k]
        sizes = np.diff(self.firsts)
        self.ids, self.firsts = self.ids[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])])
        self.scores, self.costs, self.met = self.scores[keep], self.costs[keep], self.met[keep] // 2
        self.place = dict(zip(words, range(len(words)), strict=True))


@dataclass(frozen=True)
class Edit:
    """`size` ids from place `first` of the best segmentation are replaced by `ids`; whether the text stays the same."""

    first: int
    size: int
    ids: tuple[int, ...]
    same: bool

    @staticmethod
    def apply(edits: list[Edit], best: np.ndarray) -> np.ndarray:
        """Ids of a segmentation from those of the best; edits come in order of their places."""
        parts, at = [], 0
        for e in edits:
            parts += [best[at : e.first], np.array(e.ids, best.dtype)]
            at = e.first + e.size
        return np.concatenate([*parts, best[at:]])


class Encoder:
    def __init__(self, path: str, n: int = N_BEST):
        self.model, self.n = Model(path), n
        self.memo = Memo()
        self.others: dict[str, list[tuple[float, tuple[int, ...], bool]]] = {}

    def words(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return self.model.cut.findall(marked) if self.model.cut else [marked]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, float, list[tuple[float, list[Edit]]]]]:
        """For each text: ids and score of the best segmentation, and the n best as scores and edits of the best one's ids."""
        memo = self.memo
        if len(memo.place) > MEMO:
            memo.shrink()
            if len(memo.place) > MEMO // 2:
                memo.__init__()
            self.others.clear()
        cut = [self.words(t) if t else [] for t in texts]
        every = list(chain.from_iterable(cut))
        at = np.fromiter(map(memo.place.get, every, repeat(-1)), np.int64, len(every))
        lacking = np.flatnonzero(at < 0).tolist()
        if lacking:
            missing = list({every[i] for i in lacking})
            memo.add(missing, self.model.best_many(missing))
            at[lacking] = [memo.place[every[i]] for i in lacking]
        memo.met += np.bincount(at, minlength=len(memo.met))
        sizes = np.diff(memo.firsts)[at]
        ends = np.cumsum(sizes)
        ids = memo.ids[np.repeat(memo.firsts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        scores, costs = memo.scores[at], memo.costs[at]
        stops, done = np.concatenate([[0], ends]), 0
        for words in cut:
            here = slice(done, done + len(words))
            score = float(scores[here].sum())
            firsts = stops[done : done + len(words) + 1] - stops[done]
            yield ids[stops[done] : stops[done + len(words)]], score, self.tops(words, costs[here], score, firsts)
            done += len(words)

    def alternatives(self, word: str) -> list[tuple[float, tuple[int, ...], bool]]:
        """What a word's n best segmentations cost, their ids, and whether they decode to the same text as the best."""
        found = self.others.get(word)
        if found is None:
            own = self.model.nbest(word, self.n)
            text = [b"".join(map(self.model.raw.__getitem__, i)) for _, i in own]
            found = self.others[word] = [(s - own[0][0], i, t == text[0]) for (s, i), t in zip(own, text, strict=True)]
        return found

    def tops(self, words: list[str], costs: np.ndarray, score: float, firsts: np.ndarray) -> list[tuple[float, list[Edit]]]:
        """Scores and edits of the n best: only the n - 1 words with the least costs of a second-best segmentation can differ."""
        some = np.flatnonzero(np.isfinite(costs))
        if len(some) >= self.n > 1:
            some = some[costs[some] <= np.partition(costs[some], self.n - 2)[self.n - 2]]
        near = np.sort(some[np.argsort(costs[some], kind="stable")[: self.n - 1]]).tolist()
        tops: list[tuple[float, list[Edit]]] = [(0.0, [])]
        for w in near:
            edits = [(gap, [Edit(int(firsts[w]), int(firsts[w + 1] - firsts[w]), ids, same)] if k else []) for k, (gap, ids, same) in enumerate(self.alternatives(words[w]))]
            tops = sorted(((a + gap, x + e) for a, x in tops for gap, e in edits), key=lambda t: -t[0])[: self.n]
        return [(score + t, e) for t, e in tops]

    def nbest(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text, by A* over its words' own n best."""
        lists = [self.model.nbest(w, self.n) for w in self.words(text)] if text else []
        tops: list[tuple[float, list[int]]] = [(0.0, [])]
        for own in lists:
            tops = sorted(((a + s, x + list(i)) for a, x in tops for s, i in own), key=lambda t: -t[0])[: self.n]
        return tops


_SCHEMA = (
    "n_bytes bigint, n_pieces bigint, piece_ids array<int>, ids_sha256 string, best_score double, nbest_scores array<double>, nbest_sha256 array<string>, "
    "nbest_edits array<array<struct<first:int,size:int,ids:array<int>>>>, decoded_sha256 string, round_trip boolean"
)
_EDITS = pa.list_(pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))
_NAMES = ("n_bytes", "n_pieces", "piece_ids", "ids_sha256", "best_score", "nbest_scores", "nbest_sha256", "nbest_edits", "decoded_sha256", "round_trip")
_workers: dict[tuple[str, int], Encoder] = {}


def _encode_rows(path: str, n: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _workers.get((path, n)) or _workers.setdefault((path, n), Encoder(path, n))
        for batch, texts in tokens.text_batches(batches):
            ids, rows = [], []
            decoded_texts = [x.decode("utf-8", "replace") for x in texts]
            for text, (array, score, tops) in zip(texts, coder.encode(decoded_texts), strict=True):
                back = coder.model.decode(array.tolist())
                digest = hashlib.sha256(array.tobytes()).hexdigest()
                digests = [hashlib.sha256(Edit.apply(e, array).tobytes()).hexdigest() if e else digest for _, e in tops]
                edits = [[{"first": e.first, "size": e.size, "ids": e.ids} for e in es] for _, es in tops]
                same = back == text and all(e.same for _, es in tops for e in es)
                ids.append(array)
                rows.append((len(text), len(array), digest, score, [t for t, _ in tops], digests, edits, hashlib.sha256(back).hexdigest(), same))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), _EDITS, pa.string(), pa.bool_())
            own = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            own.insert(2, lists)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *own], [*keys, *_NAMES])

    return run


def encode_table(docs: DataFrame, model: str, n: int = N_BEST, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and text -> keys, piece ids of the best segmentation; of each of the n best its score, the digest of its ids and
    the edits that make it from the best; digest of the decoded text, and whether all segmentations decode to the text."""
    tokens.bound_batches(docs.sparkSession)
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(_encode_rows(model, n, list(keys)), f"{fields}, {_SCHEMA}")


def op1_sentencepiece_nbest(docs: DataFrame, model: str) -> DataFrame:
    return encode_table(docs, model)
