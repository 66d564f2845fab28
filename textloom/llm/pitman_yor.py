"""Hierarchical Pitman-Yor language model: one restaurant for each context word, all sharing the unigram restaurant as
parent, whose base is uniform over the training vocabulary and one unseen word.

Seating is a Chinese restaurant process sampled by Gibbs: a sweep draws, for every dish of every restaurant, its number of
tables given all other tables (blocked over the dish's customers, by generalised Stirling numbers), then the parent's
tables given the tables that its children send up. Scores are log10 of predictive probabilities averaged over the sweeps
after burn-in. Discounts come from counts of counts over the whole corpus.

Distribution: words are 64-bit hashes. The CONTEXTS most frequent training words have codes, which make them quick and change
no restaurant. Pairs (context, word) are dealt to shards by the word where it has no code, else by the context where that has
none, else by the pair: what belongs to one rare word is in one shard, and what belongs to frequent words is spread over all
shards. Where neither has a code, the pair is with its word, and the shard of its context adds up the restaurant's tables: by
the hash of the context, the one sends tables of pairs met twice or more, the other sends back their sum, once a sweep. For
scores, the shards of contexts answer with customers and tables what the words' shards have to know. Counts are added up per block
before they are shuffled. Pairs that are a HOT share of the training tokens or more, of which there are at most 1 / HOT, are
shipped with their probabilities and scored where the text is read, so no pair's tokens gather in one task. What a shard
needs besides its own pairs are arrays over the codes, of fixed size. Counts and scoring each shuffle packed, compressed token
blocks once; sweeps read and write rows of each shard in the shared folder and shuffle sums by code, rare words and messages.
Words, codes, shards and draws follow from training rows alone, so that held-out rows move nothing.

Sweeps are parallel: a draw sees the other restaurants' tables as the last sweep left them; the draw of a pair without any
code sees its context's tables as the sweep before left them, and there is none in the first sweep.

Defined results: a null or empty text is its end token alone; a null id counts as held out; repeated rows are scored each;
an empty table gives no rows; without training rows counts are 0 and words get the base measure; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import labelled, tokens
from textloom.tables import drop_scratch, materialize, write_scratch

MOD, HELD = 10, 0
#: Codes of words; the last two stand for any other word, and for a text's start (as context) or end (as word).
CODES = 1 << 16
RARE, EDGE = CODES - 2, CODES - 1
CONTEXTS = CODES - 2
#: Tokens of a shard, and bytes of text packed into one block per shard.
SHARD_TOKENS, BLOCK_BYTES = 1_500_000, 2 << 20
BURN_IN, SAMPLES, STRENGTH, SEED = 2, 3, 1.0, 11
#: Least share of training tokens of a pair that is scored where the text is read.
HOT = 2.0**-14
#: Customers of one dish up to which Stirling numbers are tabled; beyond, their ratios come from a saddle point. Numbers of
#: tables up to NARROW are weighed one by one.
EXACT, NARROW = 64, 128
SMOOTH = 0.1
#: Rows by shard: pairs of codes, rare words; tables of contexts without a code that never change, that a shard draws, and in
#: all; contexts asked for, and answers.
CORE, WORDS, ONCE, UP, DOWN, ASK, ANSWER = range(-9, -2)


def pack(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unpack(blob: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


# ---------------------------------------------------------------- seating


def stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers: [customers, tables]."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0
    for n in range(size):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            stay = np.where(t <= n, np.log(np.maximum(n - t * discount, 1e-300)) + out[n, t], -np.inf)
        out[n + 1, t] = np.logaddexp(out[n, t - 1], stay)
    return out


#: Grid of the saddle point's logarithm over log(customers / tables).
_GRID = np.linspace(0, 50, 8192)


def saddle(discount: float) -> np.ndarray:
    """log f(x) over _GRID, where f(x) = (1 - (1 - x)**discount) / discount and x * f'(x) / f(x) = customers / tables."""
    wanted = _GRID - np.log(discount)
    low, high = np.minimum(-wanted / (1 - discount) - 1, -1e-9), np.full(wanted.shape, -1e-9)  # log(1 - x)
    for _ in range(60):
        middle = (low + high) / 2
        more = np.log(-np.expm1(middle)) - (1 - discount) * middle - np.log(-np.expm1(discount * middle)) > wanted
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return np.log(-np.expm1(discount * low) / discount)


def _many(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many customers: from all numbers up to NARROW, or about a mode beyond NARROW / 2 by a normal draw.

    The log ratio of the probabilities of one table more and of t tables takes the ratio of generalised Stirling numbers from
    their saddle point, which depends on customers / t alone.
    """
    point = saddle(discount)

    def gain(t, rows=slice(None)):
        c, o, p = (x[rows] if t.ndim == 1 else x[rows][:, None] for x in (customers, others, base))
        return np.log((strength + discount * (o + t)) * p / t) + np.interp(np.log(np.maximum(c / t, 1)), _GRID, point)

    low, high = np.ones(len(customers)), customers.copy()
    for _ in range(48):
        middle = (low + high) / 2
        more = gain(middle) > 0
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    step = np.maximum(low * 0.01, 0.5)
    slope = (gain(np.minimum(low + step, customers)) - gain(np.maximum(low - step, 0.5))) / (np.minimum(low + step, customers) - np.maximum(low - step, 0.5))
    wide = rng.normal(low + 0.5, 1 / np.sqrt(np.maximum(-slope, 1e-12)))
    out = np.clip(np.rint(wide), 1, customers)
    few = np.flatnonzero(low <= NARROW / 2)
    t = np.arange(1, NARROW)[None, :]
    steps = np.where(t < customers[few, None], gain(np.minimum(t, customers[few, None] - 0.5), few), -np.inf)
    out[few] = (np.concatenate([np.zeros((len(few), 1)), np.cumsum(steps, 1)], 1) + rng.gumbel(size=(len(few), NARROW))).argmax(1) + 1
    return out.astype(np.int64)


def draw_tables(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish: customers of the dish, the restaurant's tables of other dishes, the dish's base probability."""
    out = np.minimum(customers, 1).astype(np.int64)
    first = np.minimum(customers, EXACT)
    for c in np.unique(first[first > 1]).tolist():
        rows = np.flatnonzero(first == c)
        for part in np.array_split(rows, max(1, len(rows) * c // 2_000_000)):
            j = np.arange(c)
            weight = np.cumsum(np.log(strength + discount * (others[part, None] + j)), 1) + np.log(base[part, None]) * (j + 1) + table[c, 1 : c + 1]
            out[part] = (weight + rng.gumbel(size=weight.shape)).argmax(1) + 1
    rows = np.flatnonzero(customers > EXACT)
    for part in np.array_split(rows, max(1, len(rows) * NARROW // 2_000_000)) if len(rows) else ():
        out[part] = _many(customers[part].astype(float), others[part], base[part], discount, strength, rng)
    return out


# ---------------------------------------------------------------- tokens to shards


def _chunks(batches: Iterator[pa.RecordBatch], size: int):
    """(doc_id, held_out, texts) lists of about `size` bytes of text."""
    ids, held, texts, n = [], [], [], 0
    for batch, some in tokens.text_batches(batches):
        ids += batch.column("doc_id").to_pylist()
        held += batch.column("held_out").to_pylist()
        texts += some
        n += sum(map(len, some))
        if n >= size:
            yield ids, np.array(held, bool), texts
            ids, held, texts, n = [], [], [], 0
    if texts:
        yield ids, np.array(held, bool), texts
    tokens.give_back()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of training words of a task, added up before they leave it; word 0 counts training tokens, word 1 all tokens."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["w", "n"])

    for _, held, texts in _chunks(batches, BLOCK_BYTES):
        hashes, sizes, _ = tokens.words(texts)
        learn = np.repeat(~held, sizes)
        own, n = np.unique(hashes[learn], return_counts=True)
        both, place = np.unique(np.concatenate([keys, own, np.arange(2, dtype=np.uint64)]), return_inverse=True)
        totals = [learn.sum() + (~held).sum(), len(hashes) + len(texts)]
        keys, counts = both, np.bincount(place, np.concatenate([counts, n, totals]), len(both)).astype(np.int64)
        if len(keys) > 1_000_000:
            yield flush()
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield flush()


@dataclass
class Stream:
    """Tokens of texts in order: codes of context and word, hash of the word, document, hash of the context."""

    context: np.ndarray
    word: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    before: np.ndarray

    def shard(self, n: int) -> np.ndarray:
        key = self.context.astype(np.uint64) << np.uint64(16) | self.word.astype(np.uint64)
        key = np.where(self.word == RARE, self.hashes, np.where(self.context == RARE, self.before, key))
        return (tokens.mix(key) % np.uint64(n)).astype(np.int64)

    def take(self, at: np.ndarray) -> Stream:
        return Stream(self.context[at], self.word[at], self.hashes[at], self.doc[at], self.before[at])


def stream(texts: list[bytes], frequent: np.ndarray) -> Stream:
    hashes, sizes, _ = tokens.words(texts)
    at = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
    codes = np.where(frequent[at] == hashes, at, RARE) if len(frequent) else np.full(len(hashes), RARE)
    word, spelled = np.full(len(hashes) + len(texts), EDGE, np.uint16), np.zeros(len(hashes) + len(texts), np.uint64)
    inner = np.ones(len(word), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    word[inner], spelled[inner] = codes, hashes
    before = np.concatenate([np.zeros(1, np.uint64), spelled[:-1]])
    return Stream(np.concatenate([[EDGE], word[:-1]]).astype(np.uint16), word, spelled, np.repeat(np.arange(len(texts)), sizes + 1), before)


def _blocks(s: Stream, n: int, doc: np.ndarray):
    """(shard, arrays) of a stream's tokens."""
    shard = s.shard(n)
    order = np.argsort(shard << 32 | s.context.astype(np.int64) << 16 | s.word.astype(np.int64), kind="stable")
    edges = np.searchsorted(shard[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        part = order[edges[k] : edges[k + 1]]
        rare, far = s.word[part] == RARE, s.context[part] == RARE
        yield k, {"u": s.context[part], "w": s.word[part], "h": s.hashes[part][rare], "g": s.before[part][far], "d": doc[part].astype(np.uint32)}


def _count_blocks(n: int, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, texts in _chunks(batches, BLOCK_BYTES):
            s = stream([t for t, h in zip(texts, held, strict=True) if not h], shipped.value)
            rows = []
            for k, block in _blocks(s, n, s.doc):
                key = block["u"].astype(np.uint32) << np.uint32(16) | block["w"]
                rare, far = block["w"] == RARE, block["u"] == RARE
                own, c = np.unique(key[~rare & ~far], return_counts=True)
                rows.append((k, pack(key=own, c=c.astype(np.uint32), u=block["u"][rare], h=block["h"], g=block["g"][rare[far]], xg=block["g"][~rare[far]], xw=block["w"][~rare & far])))
            yield _shard_rows(rows)

    return run


def _shard_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])


_STATE = "shard int, core binary, blob binary, code int, a bigint, b bigint, c bigint, d bigint"


def _rows(shards: list[int], code: int, blobs: list[bytes], sender: int = 0) -> pa.Table:
    """Rows for shards. Pairs of codes have a column of their own, so that they stay where they are in a sweep."""
    n, core = len(shards), code == CORE
    column, empty = pa.array(blobs, pa.binary()), pa.nulls(n, pa.binary())
    rest = {name: pa.nulls(n, pa.int64()) for name in "bcd"}
    return pa.table({
        "shard": pa.array(shards, pa.int32()), "core": column if core else empty, "blob": empty if core else column,
        "code": pa.array([code] * n, pa.int32()), "a": pa.array([sender] * n, pa.int64()), **rest,
    })


def _record(columns: int) -> np.dtype:
    """A hash with numbers, as shards send them to each other."""
    return np.dtype([("h", "<u8"), ("v", "<u4", (columns,))])


def _records(blobs: list[bytes], columns: int = 1) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), _record(columns))


def _deal(code: int, sender: int, to: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> pa.Table:
    """One row for each shard that is sent something: hashes with their rows of values."""
    order = np.argsort(to, kind="stable")
    records = np.zeros(len(order), _record(values.shape[1]))
    records["h"], records["v"] = hashes[order], values[order]
    targets, starts = np.unique(to[order], return_index=True)
    return _rows(targets.tolist(), code, [x.tobytes() for x in np.split(records, starts[1:])[: len(starts)]], sender)


def _owner(hashes: np.ndarray, n: int) -> np.ndarray:
    return (tokens.mix(hashes) % np.uint64(n)).astype(np.int64)


def _distinct(hashes: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((to, hashes))
    hashes, to = hashes[order], to[order]
    first = np.ones(len(order), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (to[1:] != to[:-1])
    return hashes[first], to[first]


def _sent(rows: list[tuple[int, int, bytes]], code: int) -> list[bytes]:
    return [blob for c, _, blob in rows if c == code]


def _total(index: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, x, n).astype(np.int64)


def _sum_rows(codes: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    n = len(codes)
    values = {name: pa.array(np.asarray(x, np.int64)) for name, x in zip("abcd", columns, strict=True)}
    return pa.table({"shard": pa.nulls(n, pa.int32()), "core": pa.nulls(n, pa.binary()), "blob": pa.nulls(n, pa.binary()), "code": pa.array(codes, pa.int32()), **values})


def _by_code(arrays: list[np.ndarray], offset: int = 0) -> pa.Table:
    """Four arrays over the codes as rows; rows of zeros are left out."""
    some = np.flatnonzero(np.any([a != 0 for a in arrays], 0))
    return _sum_rows(some + offset, [a[some] for a in arrays])


def _count_shard(shards: int, n: int):
    """Counts of a shard's pairs. Pairs met once sit at one table for good; only the others are kept for sampling.

    Contexts that the n shards of scoring have to know for training rows are asked for here.
    """

    def run(table: pa.Table) -> pa.Table:
        shard, parts = table.column("shard")[0].as_py(), [unpack(b.as_py()) for b in table.column("blob")]
        keys, place = np.unique(np.concatenate([p["key"] for p in parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([p["c"] for p in parts]), len(keys)).astype(np.int64)
        hashes, word = np.unique(np.concatenate([p["h"] for p in parts]), return_inverse=True)
        # Contexts without a code: of rare words they are other shards', of coded words the shard's own rare words.
        others, other = np.unique(np.concatenate([p["g"] for p in parts]), return_inverse=True)
        context = np.concatenate([p["u"] for p in parts]).astype(np.int64)
        context[context == RARE] = CODES + other
        rare_keys, rare_counts = np.unique(word.astype(np.int64) << 32 | context, return_counts=True)
        rare_word, rare_u = rare_keys >> 32, rare_keys & 0xFFFFFFFF
        own = np.searchsorted(hashes, np.concatenate([p["xg"] for p in parts])).astype(np.int64)
        own_keys, own_counts = np.unique(own << 16 | np.concatenate([p["xw"] for p in parts]), return_counts=True)
        own_u, own_w = own_keys >> 16, own_keys & 0xFFFF
        u, w = (keys >> np.uint32(16)).astype(np.int64), (keys & np.uint32(0xFFFF)).astype(np.int64)
        by = lambda code, x: _total(code, x, CODES)
        one, rare_one, own_one, near = counts == 1, rare_counts == 1, own_counts == 1, rare_u < CODES
        total_n = _total(rare_word, rare_counts, len(hashes))
        singles = _total(rare_word, rare_one, len(hashes))
        fixed = _total(rare_u[~near] - CODES, rare_one[~near], len(others))
        # Of other shards' contexts those stay that have a pair to draw.
        drawn, kept_u = np.unique(rare_u[~near & ~rare_one] - CODES, return_inverse=True)
        ru = rare_u[~rare_one].copy()
        ru[ru >= CODES] = CODES + kept_u
        asked, to = _distinct(others[rare_u[~near] - CODES], _owner(hashes, n)[rare_word[~near]])
        core = pack(key=keys[~one], c=counts[~one], t=np.ones((~one).sum(), np.int64), past=[])
        state = pack(
            rw=rare_word[~rare_one], ru=ru, rc=rare_counts[~rare_one], rt=np.ones(len(ru), np.int64), back=np.ones(len(kept_u), np.int64), others=others[drawn],
            h=hashes, n=total_n, s=singles, t0=np.ones(len(hashes), np.int64), past=[],
            ou=own_u[~own_one], ow=own_w[~own_one], oc=own_counts[~own_one], ot=np.ones((~own_one).sum(), np.int64), fixed=_total(own_u, own_one, len(hashes)),
        )
        customers = np.bincount(rare_word, minlength=len(hashes))
        arrays = [by(u, one) + by(rare_u[near], rare_one[near]), by(w, one) + by(own_w, own_one), by(w, counts) + by(own_w, own_counts), by(u, counts) + by(rare_u[near], rare_counts[near])]
        singly = int(one.sum() + rare_one.sum() + own_one.sum())
        twice = int((counts == 2).sum() + (rare_counts == 2).sum() + (own_counts == 2).sum())
        none = np.zeros(CODES, np.int64)
        tokens.give_back()
        return pa.concat_tables([
            _rows([shard], CORE, [core]),
            _rows([shard], WORDS, [state]),
            _deal(ONCE, shard, _owner(others[fixed > 0], shards), others[fixed > 0], fixed[fixed > 0, None]),
            _deal(UP, shard, _owner(others[drawn], shards), others[drawn], np.bincount(kept_u, minlength=len(drawn))[:, None]),
            _deal(ASK, shard, _owner(asked, shards), asked, to[:, None]),
            _by_code(arrays),
            _by_code([by(u, ~one) + by(rare_u[near], ~rare_one[near]), by(w, ~one) + by(own_w, ~own_one), none, none], CODES),  # one table each to begin with
            _sum_rows(np.array([-1, -2]), [np.array(x) for x in zip(
                (len(hashes), singly, twice, int(total_n.sum())),
                (int((customers == 1).sum()), int((customers == 2).sum()), int(customers.sum()), 0), strict=True)]),
        ])

    return run


# ---------------------------------------------------------------- sweeps


@dataclass
class Globals:
    """What every shard sees of the others: arrays over the codes and a few numbers."""

    discount: float
    discount0: float
    strength: float
    vocabulary: int
    tables: np.ndarray  # of each context
    customers: np.ndarray  # of each coded word in the parent
    tables0: np.ndarray  # of each coded word in the parent
    all_tables0: int
    all_customers: int

    def spread(self) -> float:
        """Parent's probability of a word without customers."""
        return (self.strength + self.discount0 * self.all_tables0) / (self.vocabulary + 1) / (self.strength + self.all_customers)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount0 * np.minimum(tables, customers)) / (self.strength + self.all_customers) + self.spread()


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Shards with their rows (code, sender, blob), which lie together."""
    shard, rows = None, []
    for batch in batches:
        for k, code, sender, blob in zip(*[batch.column(x).to_pylist() for x in ("shard", "code", "a", "blob")], strict=True):
            if k != shard and rows:
                yield shard, rows
                rows = []
            shard = k
            rows.append((code, sender, blob))
    if rows:
        yield shard, rows


def _sweep_core(s: dict, g: Globals, table: np.ndarray, rng: np.random.Generator, keep: bool) -> tuple[np.ndarray, np.ndarray]:
    """Draws of pairs of codes; tables by context and by word."""
    u, w = (s["key"] >> np.uint32(16)).astype(np.int64), (s["key"] & np.uint32(0xFFFF)).astype(np.int64)
    s["t"] = draw_tables(s["c"], g.tables[u] - s["t"], g.parent(g.customers, g.tables0)[w], g.discount, g.strength, table, rng)
    if keep:
        s["past"].append(s["t"].astype(np.uint32))
    return _total(u, s["t"], CODES), _total(w, s["t"], CODES)


def _sweep_words(s: dict, rows: list[tuple[int, int, bytes]], g: Globals, table: np.ndarray, table0: np.ndarray, rng: np.random.Generator, keep: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Draws of all other pairs and of rare words in the parent; tables of the shard's own contexts before, of other shards' contexts after."""
    n = len(s["h"])
    once, ups, downs = (_records(_sent(rows, code)) for code in (ONCE, UP, DOWN))
    s["fixed"] = s["fixed"] + _total(np.searchsorted(s["h"], once["h"]), once["v"][:, 0], n)
    tables = s["fixed"] + _total(s["ou"], s["ot"], n) + _total(np.searchsorted(s["h"], ups["h"]), ups["v"][:, 0], n)
    met = s["s"] + _total(s["rw"], s["rt"], n)
    rare_parent = g.parent(met, s["t0"])
    s["ot"] = draw_tables(s["oc"], tables[s["ou"]] - s["ot"], g.parent(g.customers, g.tables0)[s["ow"]], g.discount, g.strength, table, rng)
    near, last = s["ru"] < CODES, s["rt"]
    rest, s["rt"] = np.zeros(len(last), np.int64), last.copy()
    rest[near] = g.tables[s["ru"][near]] - last[near]
    told = np.zeros(len(s["others"]), np.int64)
    told[np.searchsorted(s["others"], downs["h"])] = downs["v"][:, 0]
    rest[~near] = told[s["ru"][~near] - CODES] - s["back"]
    s["back"] = last[~near]
    draw = np.flatnonzero(near | (len(downs) > 0))
    s["rt"][draw] = draw_tables(s["rc"][draw], rest[draw], rare_parent[s["rw"][draw]], g.discount, g.strength, table, rng)
    met = s["s"] + _total(s["rw"], s["rt"], n)
    s["t0"] = draw_tables(met, np.maximum(g.all_tables0 - s["t0"], 0), np.full(n, 1 / (g.vocabulary + 1)), g.discount0, g.strength, table0, rng)
    if keep:
        s["past"].append(tuple(s[x].astype(np.uint32) for x in ("rt", "t0", "ot")) + (met.astype(np.uint32),))
    return tables, [_total(s["ru"][near], s["rt"][near], CODES), _total(s["ow"], s["ot"], CODES), np.array([s["t0"].sum(), met.sum()])]


def _others(s: dict, rt: np.ndarray) -> np.ndarray:
    """Tables that a shard's rare words have at each of the other shards' contexts."""
    far = s["ru"] >= CODES
    return _total(s["ru"][far] - CODES, rt[far], len(s["others"]))


def _sweep(shipped, number: int, keep: bool, end: bool, shards: int):
    """After the last sweep shards send each other the tables of all kept sweeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Globals = shipped.value
        table, table0 = stirling(g.discount), stirling(g.discount0)
        sums, scalars = [np.zeros(CODES, np.int64) for _ in range(4)], np.zeros(4, np.int64)
        for shard, rows in _by_shard(batches):
            for blob in _sent(rows, CORE):
                s = unpack(blob)
                for total, x in zip(sums, _sweep_core(s, g, table, np.random.default_rng([SEED, number, shard]), keep), strict=False):
                    total += x
                yield from _rows([shard], CORE, [pack(**s)]).to_batches()
            for blob in _sent(rows, WORDS):
                s = unpack(blob)
                tables, (by_context, by_word, numbers) = _sweep_words(s, rows, g, table, table0, np.random.default_rng([SEED, number, shard, 1]), keep)
                sums[0] += by_context
                sums[1] += by_word
                scalars[:2] += numbers
                yield from _rows([shard], WORDS, [pack(**s)]).to_batches()
                mine = [_others(s, x[0]) for x in s["past"]] if end else [_others(s, s["rt"])]
                yield from _deal(UP, shard, _owner(s["others"], shards), s["others"], np.stack(mine, 1)).to_batches()
                if not end:
                    asked = [(sender, _records([x])["h"]) for code, sender, x in rows if code == UP]
                    to = np.repeat([x for x, _ in asked], [len(x) for _, x in asked]).astype(np.int64)
                    hashes = np.concatenate([np.zeros(0, np.uint64), *[x for _, x in asked]])
                    yield from _deal(DOWN, shard, to, hashes, tables[np.searchsorted(s["h"], hashes)][:, None]).to_batches()
        yield from _by_code(sums).to_batches()
        yield from _sum_rows(np.array([-1]), [scalars[k : k + 1] for k in range(4)]).to_batches()

    return run


def _core(state: DataFrame) -> DataFrame:
    return state.filter("core IS NOT NULL").select("shard", F.lit(CORE).alias("code"), F.lit(0).cast("long").alias("a"), F.col("core").alias("blob"))


def _rest(state: DataFrame) -> DataFrame:
    return state.filter(f"blob IS NOT NULL AND code <> {ASK}").select("shard", "code", "a", "blob")


def _sums(state: DataFrame) -> dict[int, tuple[int, ...]]:
    """Sums by code over all shards: 2 * CODES + 3 rows at most."""
    rows = state.filter("shard IS NULL").groupBy("code").agg(*[F.sum(c).alias(c) for c in "abcd"]).toArrow().to_pydict()
    return {k: x for k, *x in zip(*[rows[c] for c in ("code", "a", "b", "c", "d")], strict=True)}


def _array(sums: dict, column: int, offset: int = 0) -> np.ndarray:
    out = np.zeros(CODES, np.int64)
    for k, x in sums.items():
        if offset <= k < offset + CODES:
            out[k - offset] = x[column]
    return out


# ---------------------------------------------------------------- scoring


def _hot_rows(least: int):
    """Pairs of at least so many training tokens, with their tables in the kept sweeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                s = unpack(blob.as_py())
                hot = np.flatnonzero(s["c"] >= least)
                tables = [past[hot].tolist() for past in s["past"]]
                yield pa.RecordBatch.from_arrays([pa.array(s["key"][hot].astype(np.int64)), pa.array(s["c"][hot].astype(np.int64)), pa.array([list(t) for t in zip(*tables, strict=True)], pa.list_(pa.int64()))], ["key", "c", "t"])

    return run


def _hot_pairs(state: DataFrame, past: list[Globals], coded_n: np.ndarray, context_count: np.ndarray, train_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, scores and base scores of the hot pairs, in order of their keys."""
    found = state.mapInArrow(_hot_rows(max(2, int(np.ceil(HOT * train_tokens)))), "key bigint, c bigint, t array<bigint>").toArrow().sort_by("key").to_pydict()
    key, c = np.array(found["key"], np.int64), np.array(found["c"], np.int64)
    tables = np.array(found["t"], np.int64).reshape(len(key), len(past))
    u, w = key >> 16, key & 0xFFFF
    probability = sum((_pair_probability(c, tables[:, k], g.tables[u], context_count[u], g.parent(g.customers, g.tables0)[w], g) for k, g in enumerate(past)), np.zeros(len(key)))
    return key.astype(np.uint32), np.log10(probability / len(past)), _base(coded_n[w], train_tokens, past[-1].vocabulary)


def _base(n: np.ndarray, train_tokens: int, vocabulary: int) -> np.ndarray:
    return np.log10((n + SMOOTH) / (train_tokens + SMOOTH * (vocabulary + 1)))


def _score_blocks(n: int, shipped, hot_pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 40
        keys, score, base = hot_pairs.value
        for ids, held, texts in _chunks(batches, BLOCK_BYTES):
            s = stream(texts, shipped.value)
            sizes = np.bincount(s.doc, minlength=len(texts))
            pair = s.context.astype(np.uint32) << np.uint32(16) | s.word
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hot = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            sums = [np.bincount(s.doc[hot], x, len(texts)) for x in (None, base[at[hot]], score[at[hot]])] if len(keys) else [np.zeros(len(texts))] * 3
            rest = s.take(~hot)
            rows = [(k, pack(first=done, **block)) for k, block in _blocks(rest, n, rest.doc << 1 | held[rest.doc])]
            rows.append((int(tokens.mix(np.array([done], np.uint64))[0] % np.uint64(n)), pack(head=(done, ids, held, sizes, sums))))
            done += len(texts)
            packed = _shard_rows(rows)
            yield pa.RecordBatch.from_arrays([packed.column(0), pa.nulls(len(rows), pa.int32()), packed.column(1)], ["shard", "code", "blob"])

    return run


def _ask(n: int, shards: int, shipped):
    """Contexts without a code in held-out rows that the n shards of scoring have to know: requests to the contexts' shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, to = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def flush():
            asked, by = _distinct(np.concatenate(hashes), np.concatenate(to))
            del hashes[1:], to[1:]
            return _deal(ASK, 0, _owner(asked, shards), asked, by[:, None]).select(["shard", "code", "a", "blob"]).to_batches()

        for _, _, texts in _chunks(batches, BLOCK_BYTES):
            s = stream(texts, shipped.value)
            both = (s.word == RARE) & (s.context == RARE)
            hashes.append(s.before[both])
            to.append(_owner(s.hashes[both], n))
            if sum(map(len, hashes)) > 1_000_000:
                yield from flush()
        yield from flush()

    return run


def _context_tables(s: dict, ups: list[bytes]) -> np.ndarray:
    """Tables of the shard's own contexts, a column for each kept sweep."""
    sent = _records(ups, len(s["past"]))
    at, n = np.searchsorted(s["h"], sent["h"]), len(s["h"])
    return np.stack([s["fixed"] + _total(s["ou"], past[2], n) + _total(at, sent["v"][:, k], n) for k, past in enumerate(s["past"])], 1)


def _lookup(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes, and whether they are there."""
    at = np.searchsorted(sorted_hashes, wanted)
    if not len(sorted_hashes):
        return at, np.zeros(len(wanted), bool)
    return at, sorted_hashes[np.minimum(at, len(sorted_hashes) - 1)] == wanted


def _answer(table: pa.Table) -> pa.Table:
    """Customers and tables of the contexts asked for; a word is followed as often as it occurs. Words without customers get no answer."""
    rows = list(zip(*[table.column(x).to_pylist() for x in ("code", "a", "blob")], strict=True))
    found = _sent(rows, WORDS)
    if not found:
        return _deal(ANSWER, 0, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 1))).select(["shard", "code", "blob"])
    s, asked = unpack(found[0]), _records(_sent(rows, ASK))
    hashes, to = _distinct(asked["h"], asked["v"][:, 0].astype(np.int64))
    at, known = _lookup(s["h"], hashes)
    at, hashes, to = at[known], hashes[known], to[known]
    tables = _context_tables(s, _sent(rows, UP))
    return _deal(ANSWER, 0, to, hashes, np.concatenate([s["n"][at, None], tables[at]], 1)).select(["shard", "code", "blob"])


_PARTS = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _pair_probability(c, tables, context_tables, context_count, parent, g: Globals) -> np.ndarray:
    return (c - g.discount * np.minimum(tables, c) + (g.strength + g.discount * context_tables) * parent) / (g.strength + context_count)


def _score_shard(shipped):
    def run(table: pa.Table) -> pa.Table:
        past, coded_n, context_count, train_tokens = shipped.value  # one Globals per kept sweep
        g, out, blocks, core, state, ups, answers = past[-1], [], [], None, None, [], []
        for code, blob in zip(table.column("code").to_pylist(), table.column("blob"), strict=True):
            if code in (UP, ANSWER):
                (ups if code == UP else answers).append(blob.as_py())
                continue
            p = unpack(blob.as_py())
            if code == CORE:
                core = p
            elif code == WORDS:
                state = p
            elif "head" in p:
                out.append((p["head"][0], blob.as_py()))
            else:
                blocks.append(p)
        if not blocks:
            return _parts(out)
        u, w = (np.concatenate([b[k] for b in blocks]).astype(np.int32) for k in "uw")
        d = np.concatenate([b["d"] for b in blocks])
        chunks, ends = [b["first"] for b in blocks], np.cumsum([len(b["u"]) for b in blocks])
        train, rare, far = (d & np.uint32(1)) == 0, w == RARE, u == RARE
        hashes, before = np.concatenate([b["h"] for b in blocks]), np.concatenate([b["g"] for b in blocks])
        del blocks
        samples = len(past)
        plain, own = ~rare & ~far, ~rare & far
        if state is None:
            none, small = np.zeros(0, np.int64), np.zeros(0, np.uint32)
            state = {**dict.fromkeys(("n", "rw", "ru", "ou", "ow", "fixed"), none), **dict.fromkeys(("h", "others"), np.zeros(0, np.uint64)), "past": [(small,) * 4] * samples}
        # Coded words after coded words.
        keys, place = np.unique(u[plain].astype(np.int64) << 16 | w[plain], return_inverse=True)
        c = np.bincount(place, train[plain], len(keys)).astype(np.int64)
        ku, kw = keys >> 16, keys & 0xFFFF
        kept = np.searchsorted(core["key"], keys[c > 1].astype(np.uint32)) if core else np.zeros(0, np.int64)
        probability = np.zeros(len(keys))
        # Coded words after the shard's own rare words.
        contexts, context = np.unique(before[~rare[far]], return_inverse=True)
        own_keys, own_place = np.unique(context << 16 | w[own], return_inverse=True)
        oc = np.bincount(own_place, train[own], len(own_keys)).astype(np.int64)
        ow, (at, some) = own_keys & 0xFFFF, _lookup(state["h"], contexts)
        own_count, own_all = np.zeros(len(contexts), np.int64), np.zeros((len(contexts), samples), np.int64)
        own_count[some], own_all[some] = state["n"][at[some]], _context_tables(state, ups)[at[some]]
        ou, own_kept = own_keys >> 16, np.searchsorted(state["ou"] << 16 | state["ow"], at[own_keys[oc > 1] >> 16] << 16 | ow[oc > 1])
        own_probability = np.zeros(len(own_keys))
        # Rare words; contexts without a code are numbered after the codes.
        names, name = np.unique(hashes, return_inverse=True)
        others, other = np.unique(before[rare[far]], return_inverse=True)
        context = u[rare].astype(np.int64)
        context[context == RARE] = CODES + other
        rare_keys, rare_place = np.unique(name << 32 | context, return_inverse=True)
        del hashes, before, context, other, u, w
        rc = np.bincount(rare_place, train[rare], len(rare_keys)).astype(np.int64)
        rw, ru = rare_keys >> 32, rare_keys & 0xFFFFFFFF
        told = _records(answers, 1 + samples)
        told = told[np.argsort(told["h"])]
        at, some = _lookup(told["h"], others)
        other_values = np.zeros((len(others), 1 + samples), np.int64)
        other_values[some] = told["v"][at[some]]
        rare_count = np.concatenate([context_count, other_values[:, 0]])[ru]
        known, some = _lookup(state["h"], names)
        rare_n = np.zeros(len(names), np.int64)
        rare_n[some] = state["n"][known[some]]
        drawn = rc > 1
        stored_u = ru[drawn]
        stored_u[stored_u >= CODES] = CODES + np.searchsorted(state["others"], others[stored_u[stored_u >= CODES] - CODES])
        rare_kept = np.searchsorted(state["rw"].astype(np.int64) << 32 | state["ru"], known[rw[drawn]] << 32 | stored_u)
        rare_probability = np.zeros(len(rare_keys))
        for k, g in enumerate(past):
            parent = g.parent(g.customers, g.tables0)
            tables, own_tables, rare_tables = np.minimum(c, 1), np.minimum(oc, 1), np.minimum(rc, 1)
            rt, t0, ot, met = state["past"][k]
            if core:
                tables[c > 1] = core["past"][k][kept]
            own_tables[oc > 1], rare_tables[drawn] = ot[own_kept], rt[rare_kept]
            rare_met, rare_t0 = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            rare_met[some], rare_t0[some] = met[known[some]], t0[known[some]]
            probability += _pair_probability(c, tables, g.tables[ku], context_count[ku], parent[kw], g)
            own_probability += _pair_probability(oc, own_tables, own_all[ou, k], own_count[ou], parent[ow], g)
            rare_probability += _pair_probability(rc, rare_tables, np.concatenate([g.tables, other_values[:, 1 + k]])[ru], rare_count, g.parent(rare_met, rare_t0)[rw], g)
        n, score = np.zeros(len(d), np.int64), np.zeros(len(d))
        n[plain], n[own], n[rare] = coded_n[kw][place], coded_n[ow][own_place], rare_n[name]
        for part, p, where in ((plain, probability, place), (own, own_probability, own_place), (rare, rare_probability, rare_place)):
            score[part] = np.log10(p / samples)[where]
        base = _base(n, train_tokens, g.vocabulary)
        for first, start, end in zip(chunks, np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            doc, at = np.unique(d[start:end] >> np.uint32(1), return_inverse=True)
            sums = [np.bincount(at, x[start:end], len(doc)) for x in (n > 0, base, score)]
            out.append((first, pack(doc=doc, known=sums[0].astype(np.uint32), base=sums[1], score=sums[2])))
        tokens.give_back()
        return _parts(out)

    return run


def _parts(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=_PARTS)


def _add_chunk(table: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of all shards' parts, added in order of the parts' bytes so that reruns agree."""
    parts = [unpack(b) for b in sorted(table.column("blob").to_pylist())]
    _, ids, held, size, hot = next(p["head"] for p in parts if "head" in p)
    sums = [np.array(x, float) for x in hot]
    for p in (p for p in parts if "doc" in p):
        for total, name in zip(sums, ("known", "base", "score"), strict=True):
            total[p["doc"]] += p[name]
    return pa.table([pa.array(ids, pa.int64()), pa.array(held), pa.array(size, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=_SCORED)


def score_texts(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, contexts: int = CONTEXTS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, text -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows that are not held out."""
    spark = docs.sparkSession
    tokens.bound_batches(spark)
    texts = docs.select("doc_id", "held_out", "text")
    words = materialize(spark, texts.mapInArrow(_words, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1 OR w IN (0, 1)"), "words")
    totals = {r["w"]: r["n"] for r in words.filter("w IN (0, 1)").collect()}
    frequent = np.sort(words.filter("n > 1 AND w NOT IN (0, 1)").orderBy(F.desc("n"), "w").limit(contexts).toArrow().column("w").to_numpy().view(np.uint64))
    shards = max(1, -(-totals.get(0, 0) // shard_tokens))
    # Where most rows are held out, each shard's scoring is split further.
    splits = max(1, round(totals.get(1, 0) / (shards * shard_tokens)))
    known = spark.sparkContext.broadcast(frequent)
    counted = texts.mapInArrow(_count_blocks(shards, known), "shard int, blob binary").groupBy("shard").applyInArrow(_count_shard(shards, shards * splits), _STATE)
    path = write_scratch(spark, counted, "seating")
    sums = _sums(spark.read.schema(_STATE).parquet(path))
    asked = materialize(spark, spark.read.schema(_STATE).parquet(path).filter(F.col("code") == ASK).select("shard", "code", "a", "blob"), "asked")
    n1, s1, coded_n, context_count = (_array(sums, k) for k in range(4))
    rare_words, once, twice, rare_tokens = sums.get(-1, (0, 0, 0, 0))
    t, customers = n1 + _array(sums, 0, CODES), s1 + _array(sums, 1, CODES)
    rare_once, rare_twice, rare_customers, _ = sums.get(-2, (0, 0, 0, 0))
    ney = lambda a, b: min(max(a / (a + 2 * b), 0.1), 0.95) if a else 0.5
    train_tokens, vocabulary = int(coded_n.sum()) + rare_tokens, int((coded_n > 0).sum()) + rare_words
    g = Globals(
        ney(once, twice), ney(rare_once + int((customers == 1).sum()), rare_twice + int((customers == 2).sum())), STRENGTH, vocabulary,
        t, customers, np.minimum(customers, 1), rare_words + int((customers > 0).sum()), rare_customers + int(customers.sum()),
    )
    kept, table0 = [], stirling(g.discount0)
    for number in range(burn_in + samples):
        state = spark.read.schema(_STATE).parquet(path)
        rows = _core(state).union(_rest(state).repartition("shard").sortWithinPartitions("shard"))
        sweep = _sweep(spark.sparkContext.broadcast(g), number, number >= burn_in, number == burn_in + samples - 1, shards)
        after = write_scratch(spark, rows.mapInArrow(sweep, _STATE), "seating")
        drop_scratch(spark, path)
        path = after
        sums = _sums(spark.read.schema(_STATE).parquet(path))
        t, customers = n1 + _array(sums, 0), s1 + _array(sums, 1)
        rare_tables0, rare_customers, _, _ = sums.get(-1, (0, 0, 0, 0))
        base = np.full(CODES, 1 / (vocabulary + 1))
        tables0 = draw_tables(customers, np.maximum(g.all_tables0 - g.tables0, 0), base, g.discount0, g.strength, table0, np.random.default_rng([SEED, number]))
        g = Globals(g.discount, g.discount0, g.strength, vocabulary, t, customers, tables0, rare_tables0 + int(tables0.sum()), rare_customers + int(customers.sum()))
        if number >= burn_in:
            kept.append(g)
    shipped = spark.sparkContext.broadcast((kept, coded_n, context_count, train_tokens))
    state = spark.read.schema(_STATE).parquet(path)
    hot = spark.sparkContext.broadcast(_hot_pairs(_core(state), kept, coded_n, context_count, train_tokens))
    more = texts.filter("held_out").mapInArrow(_ask(shards * splits, shards, known), "shard int, code int, a bigint, blob binary")
    answers = asked.union(more).union(_rest(state)).groupBy("shard").applyInArrow(_answer, "shard int, code int, blob binary")
    blocks = texts.mapInArrow(_score_blocks(shards * splits, known, hot), "shard int, code int, blob binary")
    state = _core(state).union(_rest(state)).select("shard", "code", "blob")
    state = state.select(F.explode(F.sequence(F.col("shard"), F.col("shard") + shards * (splits - 1), F.lit(shards))).alias("shard"), "code", "blob") if splits > 1 else state
    parts = blocks.union(state).union(answers).groupBy("shard").applyInArrow(_score_shard(shipped), "chunk bigint, blob binary")
    whole = parts.groupBy("chunk").applyInArrow(_add_chunk, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    # Sums over blocks differ in their last bits with the blocks' order.
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), F.round("base_score", 8).alias("base_score"), F.round("score", 8).alias("score"))


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out -> perplexity per token of the model and of the smoothed unigram base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op6_pitman_yor(docs: DataFrame) -> DataFrame:
    """Contract columns."""
    return score_texts(docs.select("doc_id", (labelled.remainder(F.col("doc_id"), MOD) == HELD).alias("held_out"), "text"))
