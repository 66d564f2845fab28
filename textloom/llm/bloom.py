"""A Bloom filter of fixed size over 64-bit keys: it spares most rows of a large table a shuffle that only few need.

Its size never depends on the data; with too many keys it lets more rows through, and the join behind it stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25
_MASK = (1 << BITS) - 1


def build(keys: DataFrame, key: str) -> np.ndarray:
    """2**BITS bits as 64-bit words, two of them set for each key. Keys have to be hashes."""
    places = keys.select(F.explode(F.array(*[F.shiftrightunsigned(key, BITS * k).bitwiseAND(F.lit(_MASK)) for k in range(2)])).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros((1 << BITS) // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def contains(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys, hit = keys.view(np.uint64), np.ones(len(keys), bool)
    for k in range(2):
        p = keys >> np.uint64(BITS * k) & np.uint64(_MASK)
        hit &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def might_contain(shipped, key: str) -> Column:
    """Boolean column: whether the filter, a broadcast of build()'s words, may hold the key."""

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(contains(shipped.value, keys.to_numpy(np.int64)))

    return test(key)
