"""A bitmap of keys, of bounded size, that rows are tested against before they are shuffled to an exact join.

A key sets ``PROBES`` bits. Rows whose key is in the set always pass; others pass by chance, the more the fuller the
bitmap is, and are dropped by the join. However many keys there are, at most ``2**BITS`` bits are sent to the
executors: a bitmap too small for its keys costs a larger shuffle and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.words import mix

BITS, PROBES = 27, 4


def _place(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (h >> np.uint64(12 * k)) & np.uint64((1 << bits) - 1)


class Sieve(NamedTuple):
    bits: int
    sent: Broadcast

    def passing(self, keys: np.ndarray) -> np.ndarray:
        """The places of the unsigned keys that pass."""
        m, at = self.sent.value, np.arange(len(keys))
        h = mix(keys)
        for k in range(PROBES):
            p = _place(h, k, self.bits)
            ok = (m[p >> np.uint64(3)] >> (p & np.uint64(7)).astype("u1")) & 1 == 1
            h, at = h[ok], at[ok]
        return at

    def passes(self, key: Column) -> Column:
        """Whether each row's key, a long, passes."""

        def test(x: pd.Series) -> pd.Series:
            out = np.zeros(len(x), bool)
            out[self.passing(x.to_numpy().view("u8"))] = True
            return pd.Series(out)

        return F.pandas_udf(test, "boolean")(key)


def _bitmap(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros(1 << bits, bool)
        for b in batches:
            h = mix(b.key.to_numpy().view("u8"))
            for k in range(PROBES):
                m[_place(h, k, bits)] = True
        yield pd.DataFrame({"m": [np.packbits(m, bitorder="little").tobytes()]})

    return run


def _either(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    m = None
    for b in batches:
        for x in b.m:
            x = np.frombuffer(x, "u1")
            m = x if m is None else m | x
    if m is not None:
        yield pd.DataFrame({"m": [m.tobytes()]})


def sieve(keys: DataFrame, key: str, most: int = BITS) -> Sieve:
    """A bitmap of the keys (longs), with 64 bits a key up to the bound; ``keys`` is read twice."""
    bits = max(3, min(most, max(16, (64 * keys.count()).bit_length())))
    got = keys.select(F.col(key).alias("key")).coalesce(16).mapInPandas(_bitmap(bits), "m binary").repartition(1).mapInPandas(_either, "m binary").collect()
    m = np.frombuffer(got[0].m, "u1") if got else np.zeros(1 << bits >> 3, "u1")
    return Sieve(bits, keys.sparkSession.sparkContext.broadcast(m))
