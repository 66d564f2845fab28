"""Quality by Bradley-Terry ranking: scores whose differences are the log odds that one document is preferred to another.

Features are counts of the text's form and the shares of its byte trigrams in GRAMS hash classes. Preference pairs are
documents of label 1 against documents of label 0 in the labelled sample; weights come from logistic loss on the pairs'
feature differences. The decision threshold is a quantile of the sample's scores: the share that label
0 has there, moved to the middle of the gap at that place. Scores are mapped to 0..1 so that the threshold is 0.3.

The sample is bounded (SAMPLE rows of FEATURES numbers reach the driver); scoring is one pass over all whole texts.

Defined results: a null or empty text is scored as having no words; without labels of both kinds every score is 0.5;
repeated rows score alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import labelled, tokens

#: Labelled documents that the fit may read, and pairs it draws from them.
SAMPLE, PAIRS = 20_000, 60_000
PENALTY = 1e-3
MOD, HELD = 5, 0
CUT = 0.3
#: Hash classes of byte trigrams, and rows of pairs that are multiplied at a time.
GRAMS, ROWS = 64, 10_000
FORM = ("log_words", "word_length", "symbols", "upper", "digits", "exclamations", "stops", "repeated_next", "repeated_shingles", "duplicate_lines", "distinct_words", "long_words", "few_words")
FEATURES = (*FORM, *[f"gram{k}" for k in range(GRAMS)])

_SYMBOL, _UPPER, _LETTER, _DIGIT, _STOP, _BANG, _LINE = (np.array([test(b) for b in range(256)]) for test in (
    lambda b: chr(b) in "#*$%&|<>", lambda b: 65 <= b <= 90, lambda b: b >= 128 or chr(b).isalpha(), lambda b: 48 <= b <= 57, lambda b: chr(b) in ".,;:", lambda b: b == 33, lambda b: b == 10,
))


def trigrams(texts: list[bytes]) -> np.ndarray:
    """(texts, GRAMS) shares of each text's byte trigrams, letters folded and digits alike, by hash class."""
    n, sizes = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.uint32)
    raw = np.where((raw >= 48) & (raw <= 57), np.uint32(48), raw)
    if len(raw) < 3:
        return np.zeros((n, GRAMS))
    kind = ((raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(26)
    doc = np.repeat(np.arange(n), sizes)
    inside = doc[2:] == doc[:-2]
    counts = np.bincount(doc[:-2][inside] * GRAMS + kind[inside], minlength=n * GRAMS).reshape(n, GRAMS)
    return counts / np.maximum(sizes - 2, 1)[:, None]


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, FEATURES) numbers, each a bounded ratio or logarithm."""
    n = len(texts)
    hashes, counts, spans = tokens.words(texts)
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1)])
    totals = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[edges]).astype(float)
    doc = np.repeat(np.arange(n), counts)
    words = np.maximum(counts, 1).astype(float)
    letters = np.maximum(totals(_LETTER), 1)
    lengths = spans[:, 1] - spans[:, 0]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    _, sets = tokens.shingles(hashes, counts, 5)
    most = np.maximum(np.where(counts >= 5, counts - 4, np.minimum(counts, 1)), 1)
    _, vocabulary = tokens.shingles(hashes, counts, 1)
    lines, line_counts, _ = tokens.words(texts, _LINE, bytes)
    _, line_sets = tokens.shingles(lines, line_counts, 1)
    of = lambda x: np.bincount(doc, x, n)
    return np.hstack([np.stack([
        np.log1p(counts), np.minimum(of(lengths) / words, 30), totals(_SYMBOL) / words, totals(_UPPER) / letters, totals(_DIGIT) / letters, totals(_BANG) / words,
        np.minimum(totals(_STOP) / words, 1), of(same) / words, 1 - np.minimum(sets / most, 1), 1 - line_sets / np.maximum(line_counts, 1),
        vocabulary / words**0.9, of(lengths > 25) / words, (counts < 20) * 1.0,
    ], 1), trigrams(texts)])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.threshold + np.log(CUT / (1 - CUT))
        return np.round(1 / (1 + np.exp(-np.clip(z, -60, 60))), 12)  # sums differ in the last bits with the batch


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Bradley-Terry weights from pairs, threshold from the quantile of label 0."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(CUT / (1 - CUT))))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    draw = np.random.default_rng(seed)
    better, worse = draw.choice(good, PAIRS), draw.choice(bad, PAIRS)
    w = np.zeros(k)
    for _ in range(30):  # Newton steps of the penalised loss, which is convex
        slope, curve = loss_slope(z, better, worse, w)
        step = np.linalg.solve(curve, -slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    at = min(max(len(bad), 1), len(s) - 1)
    threshold = (s[at - 1] + s[at]) / 2
    return Model(mean, scale, w, float(threshold))


def loss_slope(z: np.ndarray, better: np.ndarray, worse: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the penalised mean logistic loss of the pairs, a block of pairs at a time."""
    slope, curve = PENALTY * w, PENALTY * np.eye(len(w))
    for a in range(0, len(better), ROWS):
        gap = z[better[a : a + ROWS]] - z[worse[a : a + ROWS]]
        p = 1 / (1 + np.exp(-np.clip(gap @ w, -30, 30)))
        slope = slope - gap.T @ (1 - p) / len(better)
        curve = curve + (gap * (p * (1 - p))[:, None]).T @ gap / len(better)
    return slope, curve


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tokens.text_batches(batches):
        x = features(texts)
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    tokens.bound_batches(docs.sparkSession)
    rows = labelled.sample(docs, labels, "quality", MOD, HELD, size).select("label", "text").mapInArrow(_feature_rows, "label int, x array<double>").toArrow()
    y = rows.column("label").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # rows come in any order; the draw of pairs must not depend on it
    return fit(x[order], y[order])


def _score_rows(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tokens.text_batches(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], pa.array(model.score(features(texts)))], [*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score in column `name`, which replaces a column of that name."""
    plain = docs.drop(name) if name in docs.columns else docs
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(_score_rows(model, name), f"{fields}, `{name}` double")


def op8_bradley_terry_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (labelled.remainder(F.col("doc_id"), MOD) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
