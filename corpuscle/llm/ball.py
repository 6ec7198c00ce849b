"""Near-duplicate records with small edits, by prefix filter: every pair at the threshold is found.

A text is the set of its distinct word runs. Texts with the same set are one class; only classes are compared. All
runs are put in one order, the rarest first, and each class sends its first runs, as many as two classes at the
threshold can't both lack in common. Two such classes therefore meet in a run that both send. How rare a run is
comes from ``2**COUNT_BITS`` counters at most, in which runs may fall together; that decides the cost only, since any
one order gives the guarantee. A run whose counter is 1 is in a single text and is not sent.

Runs that are sent lie sorted; where classes meet, the sizes and the places of the run in both orders must allow the
similarity. Pairs left are made distinct, must pass a parity sketch (of which a differing run changes at most one
bit) and are verified on the texts themselves. All three tests only drop pairs that can't reach the threshold.

Runs whose counter is above ``HOT`` are counted as sent; one that more than ``BLOCK`` texts send is compared in pairs
of blocks, each a group of its own.

Defined results: null texts and texts with fewer than ``min_words`` words are no members; repeated rows count
once; an id with several texts takes part with each; text length is not limited.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.sieve import sieve
from corpuscle.llm.words import MIX, mix, run_hashes, scan
from corpuscle.session import cut

#: The counters are added up in ``SHARE`` slices (a power of two).
HOT, BLOCK, SKETCH_BITS, SHARE = 1000, 4000, 256, 64
COUNT_BITS = 24
#: Products with the threshold are rounded down by this before they are compared.
LEEWAY = 1e-9
WORD = regex.compile(r"[\p{L}\p{N}]+")


def _runs_of(batches: Iterator[pd.DataFrame], k: int, min_words: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Each batch with ``(row, hash)`` of its texts' distinct runs of words, a block of texts at a time."""
    for b in batches:
        for s in scan(b.text.tolist()):
            row, h = run_hashes(s, k, min_words)
            if len(row):
                yield b, row, h


def _counter(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype("i8")


def _counted(k: int, min_words: int, bits: int, shares: int):
    """In how many of a task's texts the runs at each counter are, by slices of the counters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(1 << bits, "u4")
        for _, _, h in _runs_of(batches, k, min_words):
            np.add.at(c, _counter(h, bits), np.uint32(1))
        yield pd.DataFrame({"s": np.arange(shares, dtype="i4"), "c": [zlib.compress(x, 1) for x in np.split(c, shares)]})

    return run


def _level(c: np.ndarray | int) -> np.ndarray:
    """A count on a scale of eight steps a doubling; the counts 0, 1 and 2 are apart."""
    return np.minimum(np.ceil(8 * np.log2(np.asarray(c, "f8") + 1)), 255).astype("u1")


def _levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = {}
    for b in batches:
        for s, x in zip(b.s, b.c):
            x = np.frombuffer(zlib.decompress(x), "u4")
            total[s] = total[s] + x if s in total else x
    for s, c in total.items():
        yield pd.DataFrame({"s": np.array([s], "i4"), "c": [_level(c).tobytes()]})


def _counts(all_: DataFrame, k: int, min_words: int) -> tuple[int, Broadcast]:
    """The bits of a counter's number, and in how many texts the runs at each counter are, as a level."""
    bits = min(COUNT_BITS, max(12, (64 * all_.count()).bit_length()))
    parts = all_.select("text").mapInPandas(_counted(k, min_words, bits, SHARE), "s int, c binary")
    got = sorted(parts.repartition("s").mapInPandas(_levels, "s int, c binary").collect())
    levels = np.frombuffer(b"".join(r.c for r in got), "u1") if got else np.zeros(1 << bits, "u1")
    return bits, all_.sparkSession.sparkContext.broadcast(levels)


def _prefixes(k: int, min_words: int, least: float, bits: int, levels: Broadcast, hot: int):
    """Each text's class, size, sketch, and the runs ``v`` that it sends with their places ``p``, of hot ones as -1 - place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, row, h in _runs_of(batches, k, min_words):
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            idx = row[at]
            n = np.diff(np.r_[at, len(row)])
            rep = np.add.reduceat(mix(h * MIX[1]), at) ^ n.astype("u8")
            place = (mix(h ^ MIX[2]) >> np.uint64(64 - 8)).astype("i8")
            nth = np.repeat(np.arange(len(at)), n)
            odd = (np.bincount(nth * SKETCH_BITS + place, minlength=len(at) * SKETCH_BITS) & 1).astype("u1").reshape(len(at), SKETCH_BITS)
            sketch = np.packbits(odd, axis=1).view("i8")
            level = levels.value[_counter(h, bits)]
            o = np.lexsort((h, level, row))
            level, p, size = level[o], np.arange(len(h)) - np.repeat(at, n), np.repeat(n, n)
            sent = (p <= size - np.ceil(least * size - LEEWAY)) & (level > _level(1))
            p = np.where(level > _level(hot), -1 - p, p)[sent].astype("i4")
            ends = np.cumsum(np.add.reduceat(sent.astype("i8"), at))[:-1]
            out = {"id": b.id.to_numpy()[idx], "th": b.th.to_numpy()[idx], "rep": rep.view("i8"), "n": n.astype("i4")}
            out |= {f"k{j}": sketch[:, j] for j in range(SKETCH_BITS // 64)}
            yield pd.DataFrame(out | {"v": np.split(h[o][sent].view("i8"), ends), "p": np.split(p, ends)})

    return run


def _verify(k: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok, memo = [], {}

            def runs(t: str, memo=memo) -> set:
                if t not in memo:
                    w = WORD.findall(t.lower())
                    memo[t] = set(zip(*[w[j:] for j in range(k)]))
                return memo[t]

            for x, y in zip(b.ta, b.tb):
                x, y = runs(x), runs(y)
                both = len(x & y)
                ok.append(both >= least * (len(x) + len(y) - both) - LEEWAY)
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    return run


def _meet(least: float):
    """Pairs of classes that meet in runs of rows sorted by run and size, if sizes and the run's places allow the similarity."""

    def pairs(x: pd.DataFrame) -> list[pd.DataFrame]:
        v, rep, n, p = (x[c].to_numpy() for c in ("v", "rep", "n", "p"))
        rest = n - np.where(p < 0, -1 - p, p)  # runs from this one on
        out = []
        at = np.arange(len(v))
        d = 1
        while len(at):
            at = at[at + d < len(v)]
            at = at[(v[at] == v[at + d]) & (n[at] >= n[at + d] * least - LEEWAY)]  # those further on are larger still
            # Of two classes the first run that both send has all they share in what is left of either.
            both = (n[at] + n[at + d]) * (least / (1 + least)) - LEEWAY
            ok = at[(np.minimum(rest[at], rest[at + d]) >= both) & (rep[at] != rep[at + d])]
            if len(ok):
                out.append(pd.DataFrame({"a": np.minimum(rep[ok], rep[ok + d]), "b": np.maximum(rep[ok], rep[ok + d])}).drop_duplicates())
            d += 1
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None  # rows of the last group, which may go on
        for b in batches:
            x = b if tail is None else pd.concat([tail, b], ignore_index=True)
            v = x.v.to_numpy()
            if not len(v):
                continue
            k = int(np.searchsorted(v, v[-1]))
            yield from pairs(x.iloc[:k])
            tail = x.iloc[k:]
        if tail is not None:
            yield from pairs(tail)

    return run


def _rows(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    return rows.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def classes(rows: DataFrame, id_col: str, text: str, k: int = 5, min_words: int = 1, least: float = 0.8, hot: int = HOT) -> DataFrame:
    """``(id, th, rep, n, k0.., v, p)``: each text's hash, class, size, sketch and the runs it sends."""
    sketch = ", ".join(f"k{j} long" for j in range(SKETCH_BITS // 64))
    all_ = _rows(rows, id_col, text)
    return all_.mapInPandas(_prefixes(k, min_words, least, *_counts(all_, k, min_words), hot), f"id string, th long, rep long, n int, {sketch}, v array<long>, p array<int>")


def _texts(rows: DataFrame, id_col: str, text: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rep, id, th, ..) with ``text``, one row per class; only texts that may be wanted are shuffled."""
    key = F.xxhash64("id", "th")
    known = sieve(wanted.select(key.alias("h")), "h")
    all_ = _rows(rows, id_col, text).where(known.passes(key))
    return all_.join(wanted, ["id", "th"]).dropDuplicates(["rep"])


def _groups(fp: DataFrame, block: int) -> DataFrame:
    """``(rep, n, v, p)``: the runs that classes send; ``v`` of those that many send is a pair of blocks."""
    row = ["rep", "n", "v", "p"]
    sent = fp.groupBy("rep", "n").agg(F.any_value("v").alias("v"), F.any_value("p").alias("p")).select("rep", "n", F.explode(F.arrays_zip("v", "p")).alias("x")).select("rep", "n", "x.v", "x.p")
    big = fp.select(F.explode(F.arrays_zip("v", "p")).alias("x")).where("x.p < 0").groupBy("x.v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block)
    big = cut(big.select("v", F.ceil(F.col("c") * 2 / block).cast("int").alias("blocks")))
    if big.isEmpty():
        return sent
    hot = sent.where("p < 0")
    split = hot.join(big, "v").withColumn("x", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("x <> y")
    split = split.withColumn("v", F.xxhash64("v", F.least("x", "y"), F.greatest("x", "y")))
    return sent.where("p >= 0").unionByName(hot.join(big, "v", "left_anti").select(*row)).unionByName(split.select(*row))


def similar_classes(rows: DataFrame, fp: DataFrame, id_col: str, text: str, k: int, min_words: int, least: float, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: the verified pairs of classes, smaller first."""
    sk = [f"k{j}" for j in range(SKETCH_BITS // 64)]
    one = cut(fp.groupBy("rep").agg(F.min(F.struct("id", "th", "n", *sk)).alias("o")).select("rep", "o.*"))
    met = cut(_groups(fp, block).repartition("v").sortWithinPartitions("v", "n").mapInPandas(_meet(least), "a long, b long").distinct())
    side = lambda c: one.select(F.col("rep").alias(c), *[F.col(x).alias(x + c) for x in ("n", *sk)])
    apart = sum((F.bit_count(F.col(x + "a").bitwiseXOR(F.col(x + "b"))) for x in sk), F.lit(0))
    most = (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + LEEWAY
    cand = cut(met.join(side("a"), "a").join(side("b"), "b").where(apart <= most).select("a", "b"))
    need = cut(cand.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(one.select("rep", "id", "th"), "rep"))
    held = _texts(rows, id_col, text, need)
    full = cand.join(held.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInPandas(_verify(k, least), "a long, b long")


def similar_pairs(rows: DataFrame, id_col: str, text: str, k: int = 5, min_words: int = 1, least: float = 0.8, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``(id_a, id_b)``: all pairs of different ids whose texts reach the similarity, copies expanded, smaller first."""
    fp = cut(classes(rows, id_col, text, k, min_words, least, hot))
    members = fp.select("rep", "id").distinct()
    pairs = similar_classes(rows, fp, id_col, text, k, min_words, least, block)
    many = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    ab = pairs.unionByName(many)
    out = ab.join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    return out.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
