"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Every sampled example is indexed with all its terms: folded words, and the STEM leading bytes of longer ones. A term weighs
(1 + log tf) * idf * tie, tie being the absolute log ratio of its shrunken shares in the examples of label 1 and of label 0
(supervised TF-IDF; TIE is its floor, so that no term is left out). Weights are not negative, so partial sums bound a
cosine from below, and partial sums plus the largest weights of a block's examples bound it from above: lists of rare terms
are read whole, those of frequent terms in order of weight until few examples can still be among the K nearest; these are
scored from their own vectors. The result is that of scoring every example (tested). Votes of the K nearest, weighted by
inverse distance, are mapped to probabilities by isotonic regression on votes from FOLDS indexes that lack the voter's fold.

Bounds: the sample has at most SAMPLE labelled documents, which is the bound for shipping the index. True copies in the
sample (equal term vectors, or a Jaccard similarity of COPY of the terms) are one example, whose label is their mean.

Defined results: a null or empty text, like any text without a term of the index, gets the smoothed share of label 1 among
such examples and no evidence; ties in similarity go to the lesser doc_id; without labels scores are 0; repeated rows score
alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import labelled, tokens

SAMPLE = 4_096
MOD, HELD = 3, 1
CUT = 0.7
K, BLOCK, FOLDS = 30, 32, 5
#: Leading bytes of a word that are a term of their own; floor and shrinkage (in examples) of a term's tie to the label.
STEM, TIE, SHRINK = 7, 0.01, 2.0
#: Terms of fewer examples are read whole. Frequent terms read at a time, and open examples at which reading stops.
FREQUENT, STEP, OPEN = 400, 64, 96
#: Jaccard similarity of copies; minimum hashes of a document, in bands.
COPY, BANDS, BAND = 0.8, 6, 3


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text: flat hashes and frequencies; number per text."""
    whole, counts, spans = tokens.words(texts, tokens.NOT_ALNUM, tokens.fold_latin)
    doc, longer = np.repeat(np.arange(len(texts)), counts), spans[:, 1] - spans[:, 0] > STEM
    # A word's stem follows the word.
    at = np.arange(len(whole)) + np.cumsum(longer) - longer
    hashes = np.zeros(len(whole) + int(longer.sum()), np.uint64)
    hashes[at], hashes[at[longer] + 1] = whole, tokens.prefixes(texts, spans[longer], STEM, tokens.fold_latin)
    doc = np.repeat(doc, 1 + longer)
    tokens.sort_within(hashes, np.bincount(doc, minlength=len(texts)))
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    return hashes[starts], np.diff(np.append(starts, len(hashes))), np.bincount(doc[starts], minlength=len(texts))


@dataclass
class Examples:
    """Labelled documents: ids, labels (means over copies), and their terms by place in a sorted vocabulary, flat."""

    ids: np.ndarray
    labels: np.ndarray
    vocabulary: np.ndarray
    sizes: np.ndarray
    term: np.ndarray
    tf: np.ndarray

    def part(self, keep: np.ndarray) -> Examples:
        inner = np.repeat(keep, self.sizes)
        return Examples(self.ids[keep], self.labels[keep], self.vocabulary, self.sizes[keep], self.term[inner], self.tf[inner])


def examples(ids: np.ndarray, labels: np.ndarray, hashes: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> Examples:
    """Examples in order of their ids, copies merged under the least id."""
    vocabulary, term = np.unique(hashes, return_inverse=True)
    group, ends = copies(vocabulary, term.astype(np.int64), sizes), np.cumsum(sizes)
    kept = np.flatnonzero(group == np.arange(len(ids)))
    share = np.bincount(group, labels, len(ids)) / np.maximum(np.bincount(group, minlength=len(ids)), 1)
    inner = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in kept]) if len(kept) else np.zeros(0, np.int64)
    return Examples(ids[kept], share[kept], vocabulary, sizes[kept], term[inner].astype(np.int32), tf[inner].astype(np.float32))


def copies(vocabulary: np.ndarray, term: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document the first one that it is a copy of, or itself. Documents without terms are no copies."""
    group, ends = np.arange(len(sizes)), np.cumsum(sizes)
    some = np.flatnonzero(sizes)
    if not len(some):
        return group
    least = np.stack([np.minimum.reduceat(tokens.mix(vocabulary ^ np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[term], (ends - sizes)[some]) for k in range(BANDS * BAND)], 1)
    for b in range(BANDS):
        first: dict[bytes, int] = {}
        for i, band in zip(some.tolist(), np.ascontiguousarray(least[:, b * BAND : (b + 1) * BAND]), strict=True):
            j = first.setdefault(band.tobytes(), i)
            if j == i or group[i] != i:
                continue
            one, other = (term[ends[x] - sizes[x] : ends[x]] for x in (i, j))
            shared = len(np.intersect1d(one, other, assume_unique=True))
            if shared >= COPY * (len(one) + len(other) - shared):
                group[i] = group[j]
    return group


def term_weights(e: Examples) -> np.ndarray:
    """idf times tie to the label, of each term of the vocabulary; 0 where no example has the term."""
    n, n1 = len(e.ids), float(e.labels.sum())
    df = np.bincount(e.term, minlength=len(e.vocabulary)).astype(float)
    a = np.bincount(e.term, np.repeat(e.labels, e.sizes), len(e.vocabulary))
    tie = np.ones(len(df))
    if 0 < n1 < n:
        p1 = (a + SHRINK * n1 / n) / (n1 + SHRINK)
        p0 = (np.maximum(df - a, 0) + SHRINK * (n - n1) / n) / (n - n1 + SHRINK)
        tie = TIE + np.abs(np.log(p1 / p0))
    return np.where(df > 0, np.log(1 + n / np.maximum(df, 1)) * tie, 0)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Postings by term, vectors by example, and the largest weight of each frequent term in each block of examples."""

    def __init__(self, e: Examples):
        self.vocabulary, self.weight = e.vocabulary, term_weights(e)
        row = np.repeat(np.arange(len(e.ids)), e.sizes)
        w = (1 + np.log(e.tf)) * self.weight[e.term]
        w /= np.sqrt(np.maximum(np.bincount(row, w * w, len(e.ids)), 1e-24))[row]
        bare = e.sizes == 0
        share = float(e.labels.mean()) if len(e.ids) else 0.0
        self.share, self.prior = share, float((e.labels[bare].sum() + 10 * share) / (bare.sum() + 10))
        # Like examples share blocks, which tightens the blocks' bounds: order by heaviest term.
        heaviest, used = np.zeros(len(e.ids), np.int64), np.flatnonzero(~bare)
        by_weight = np.lexsort((-w, row))
        heaviest[used] = e.term[by_weight[(np.cumsum(e.sizes) - e.sizes)[used]]]
        order = used[np.lexsort((e.ids[used], heaviest[used]))]
        place = np.zeros(len(e.ids), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.labels, self.n_blocks = e.ids[order], e.labels[order], -(-len(order) // BLOCK)
        at = np.lexsort((place[row], e.term))
        self.example, self.posting = place[row][at].astype(np.int32), w[at].astype(np.float32)
        self.df = np.bincount(e.term, minlength=len(self.vocabulary))
        self.start = np.cumsum(self.df) - self.df
        frequent = np.flatnonzero(self.df >= FREQUENT)
        self.rank = np.full(len(self.vocabulary), -1, np.int32)
        self.rank[frequent] = np.arange(len(frequent))
        self.block_max = np.zeros((len(frequent), self.n_blocks), np.float32)
        inner = self.rank[e.term[at]] >= 0
        np.maximum.at(self.block_max, (self.rank[e.term[at][inner]], self.example[inner] // BLOCK), self.posting[inner])
        # Each example's frequent terms.
        inner = np.flatnonzero(self.rank[e.term] >= 0)
        inner = inner[np.lexsort((e.term[inner], place[row[inner]]))]
        self.own_rank, self.own_weight = self.rank[e.term[inner]], w[inner].astype(np.float32)
        self.own_size = np.bincount(place[row[inner]], minlength=len(order))
        self.own_start = np.cumsum(self.own_size) - self.own_size
        self.heaviest = self.block_max.max(1, initial=0)
        self.votes = self.shares = np.zeros(0)

    def vector(self, hashes: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary places and unit-length weights of a text's terms; terms that no example has are left out."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes
        return self.unit(at[hit], tf[hit])

    def unit(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.weight[at]
        some = w > 0
        at, w = at[some], w[some]
        return at, w / max(np.sqrt((w * w).sum()), 1e-12)

    def _read(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(self.n_blocks * BLOCK)
        sizes = self.df[at]
        flat = _ranges(self.start[at], sizes)
        return np.bincount(self.example[flat], np.repeat(w, sizes) * self.posting[flat], self.n_blocks * BLOCK)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the k best examples with a positive cosine, best first."""
        rank = self.rank[at]
        sums = self._read(at[rank < 0], w[rank < 0])
        common, wide = at[rank >= 0], w[rank >= 0]
        order = np.argsort(-wide * self.heaviest[self.rank[common]], kind="stable")
        common, wide = common[order], wide[order].astype(np.float32)
        maxima, read = self.block_max[self.rank[common]], 0
        while True:
            rest = wide[read:] @ maxima[read:]
            least = np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) > k else 0.0
            upper = (sums.reshape(-1, BLOCK) + rest[:, None]).ravel()
            open_ = np.flatnonzero(upper >= max(least - 1e-6, 1e-12))
            if read >= len(common) or len(open_) <= max(OPEN, k):
                break
            sums += self._read(common[read : read + STEP], wide[read : read + STEP])
            read += STEP
        open_ = open_[open_ < len(self.ids)]
        sims = sums[open_]
        if read < len(common) and len(open_):
            unread = np.zeros(len(self.heaviest), np.float32)
            unread[self.rank[common[read:]]] = wide[read:]
            sizes = self.own_size[open_]
            flat = _ranges(self.own_start[open_], sizes)
            sims = sims + np.bincount(np.repeat(np.arange(len(open_)), sizes), unread[self.own_rank[flat]] * self.own_weight[flat], len(open_))
        some = sims > 0
        rows, sims = open_[some], sims[some]
        best = np.lexsort((self.ids[rows], -np.round(sims, 6)))[:k]
        return rows[best], sims[best]

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Share of label 1, each neighbour weighing the inverse of its distance; one further vote for the share of all."""
        weight = 1 / (1.05 - np.minimum(sims, 1))
        return float(((weight * self.labels[rows]).sum() + self.share) / (weight.sum() + 1))

    def score(self, at: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        rows, sims = self.nearest(at, w, K) if len(at) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(rows):
            return self.prior, rows, sims
        vote = self.vote(rows, sims)
        return float(np.interp(vote, self.votes, self.shares)) if len(self.votes) else vote, rows, sims


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: increasing places and shares."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            q, p = pools.pop(), pools[-1]
            n = p[2] + q[2]
            p[0], p[1], p[2] = (p[0] * p[2] + q[0] * q[2]) / n, (p[1] * p[2] + q[1] * q[2]) / n, n
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def build(e: Examples) -> Index:
    """Index of all examples, calibrated on votes for each fold by the others."""
    index = Index(e)
    fold = (tokens.mix(e.ids.astype(np.uint64)) % np.uint64(FOLDS)).astype(int)
    votes = np.full(len(e.ids), np.nan)
    for f in range(FOLDS) if 0 < e.labels.sum() < len(e.ids) else ():
        others, own = Index(e.part(fold != f)), np.flatnonzero(fold == f)
        starts = np.cumsum(e.sizes) - e.sizes
        for i in own.tolist():
            s = slice(starts[i], starts[i] + e.sizes[i])
            rows, sims = others.nearest(*others.unit(e.term[s], e.tf[s]), K) if e.sizes[i] and len(others.ids) else ([], [])
            if len(rows):
                votes[i] = others.vote(rows, sims)
    known = ~np.isnan(votes)
    if known.any():
        index.votes, index.shares = isotonic(votes[known], e.labels[known].astype(float))
    return index


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tokens.text_batches(batches):
        hashes, tf, counts = terms(texts)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hashes.view(np.int64), tf.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "terms", "tf"])


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Index:
    tokens.bound_batches(docs.sparkSession)
    sample = labelled.sample(docs, labels, "toxic", MOD, HELD, size).select("doc_id", "label", "text")
    rows = sample.mapInArrow(_term_rows, "doc_id bigint, label int, terms array<bigint>, tf array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return build(examples(*[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2))
    ids, label = (rows.column(c).to_numpy() for c in ("doc_id", "label"))
    terms_, tf = (rows.column(c).combine_chunks() for c in ("terms", "tf"))
    return build(examples(ids, label, terms_.flatten().to_numpy().view(np.uint64), tf.flatten().to_numpy(), terms_.value_lengths().to_numpy().astype(np.int64)))


def _score_rows(shipped):
    names = ["doc_id", "score", "evidence_ids", "evidence_labels", "evidence_similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shipped.value
        for batch, texts in tokens.text_batches(batches):
            hashes, tf, counts = terms(texts)
            ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
            at = np.minimum(np.searchsorted(index.vocabulary, hashes), max(len(index.vocabulary) - 1, 0))
            hit = index.vocabulary[at] == hashes if len(index.vocabulary) else np.zeros(len(hashes), bool)
            out = []
            for i in range(len(texts)):
                s = slice(ends[i], ends[i + 1])
                value, rows, sims = index.score(*index.unit(at[s][hit[s]], tf[s][hit[s]]))
                out.append((value, index.ids[rows[:3]].tolist(), index.labels[rows[:3]].tolist(), sims[:3].tolist()))
            types = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in out], t) for k, t in enumerate(types)]], names)

    return run


def op10_toxic_neighbours(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns, then the three nearest examples as evidence."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = docs.select("doc_id", "text").mapInArrow(_score_rows(shipped), "doc_id bigint, score double, evidence_ids array<bigint>, evidence_labels array<double>, evidence_similarity array<double>")
    return scored.select("doc_id", (labelled.remainder(F.col("doc_id"), MOD) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence_ids", "evidence_labels", "evidence_similarity")
