"""Whole texts as numpy arrays: words and hashes of many documents at once, without an object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ has it.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash's base modulo 2**64, and of its inverse."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fold_latin(data: bytes) -> bytes:
    """Lower case for A-Z and for the capitals of Latin-1, in UTF-8."""
    raw = np.frombuffer(data.lower(), np.uint8).copy()
    second = raw[1:]
    second[(raw[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return raw.tobytes()


def prefixes(texts: list[bytes], spans: np.ndarray, size: int, fold=bytes.lower) -> np.ndarray:
    """Hash of the first `size` bytes of every span that words() gave; spans have to be longer. No word has the same hash but by chance."""
    raw = np.frombuffer(fold(b"\n".join(texts)), np.uint8)
    hashes = np.full(len(spans), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(size if len(spans) else 0):
        hashes = mix(hashes + raw[spans[:, 0] + k])
    return hashes


def words(texts: list[bytes], spaces: np.ndarray = SPACES, fold=bytes.lower) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every folded word of the texts, in order; number of words of each text; the words' byte spans in b"\\n".join(texts)."""
    data = fold(b"\n".join(texts))
    if not data:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), np.zeros((0, 2), np.int64)
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~spaces[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, np.diff(firsts), np.stack([starts, ends], 1)


def sort_within(values: np.ndarray, counts: np.ndarray) -> None:
    """Sort each document's run of values in place: many short sorts, each within cache."""
    ends = np.cumsum(counts)
    for start, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        values[start:end].sort()


def shingle_keys(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle that begins at each word, and the words' places of those that are shingles: whole, or all of a shorter document."""
    n, per_word = len(hashes), np.repeat(counts, counts)
    keys, length = np.zeros(n, np.uint64), np.minimum(width, per_word)
    for k in range(width):
        part = hashes[np.minimum(np.arange(n) + k, max(n - 1, 0))] * np.uint64((2 * k + 3) * 0x9FB21C651E98DF25 & _MASK | 1) if n else keys
        keys = np.where(length > k, mix(keys + part + np.uint64(k + 1)), keys)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    return keys, np.flatnonzero((place + width <= per_word) | (place == 0))


def distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each of n documents, in order of document and value, and their numbers. Sorts keys in place."""
    sort_within(keys, np.bincount(doc, minlength=n))
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[first], np.bincount(doc[first], minlength=n)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted by document and value; number of each. Fewer words than width: the whole sequence as one."""
    keys, at = shingle_keys(hashes, counts, width)
    return distinct(keys[at], np.repeat(np.arange(len(counts)), counts)[at], len(counts))


def bound_batches(spark, size: int = 16 << 20) -> None:
    """Hand texts to Python in batches of about `size` bytes, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """Return freed memory to the system: an idle Python worker would otherwise hold on to its peak."""
    import ctypes
    import ctypes.util

    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim:
        trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches cut to about `size` bytes of text (or one longer text), with the texts as bytes; null is empty."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        start = held = 0
        for i, x in enumerate(texts):
            held += len(x)
            if held >= size:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]
