"""Evaluation texts leaking into training text, by spaced-seed hashing.

Items and documents become word sequences (longest runs of letters and digits, lower case), so case,
punctuation, spacing, line prefixes and mark-up don't matter. Fixed masks lay a pattern over consecutive
words, of which the zeros are ignored; a seed is the hash of the words at the ones. A substituted word thus
falls on a zero of some mask, and an added or dropped word leaves whole seeds on either side of it.

The items' seeds are rows, and so are the corpus's; they are joined on their hash. Before that, the corpus's seeds
pass a bitmap of the items' seeds (at most ``2**BITMAP`` bits whatever the number of items; a fuller one only lets
more through), so that what is shuffled are hits and not the corpus, and the item side is repeated over
``SALTS`` so that a seed found in a large share of the documents is no single task. A hit's diagonal (its place
in the document less that in the item) is a candidate if the seeds on it and on those near it cover ``COVER`` words of
the item. Candidates meet their document once more, where the item
is aligned with the text in a band around the diagonals, all candidates of a batch at once: a match gains 1, a
substitution, drop or addition costs 2. Of an alignment's path the longest stretch that starts and ends with a
match and has at most one edit to ``RATIO`` words must hold ``LEAST`` words of the item, changed ones not counted;
where it doesn't, the next best path through other words of the item is measured.

Wording that recurs in many items (runs of ``COMMON_RUN`` words found in at least ``COMMON_ITEMS`` different
ones, over all items) is no evidence: such words go on with a stretch but don't count towards the least number, and
seeds of such words only start no search. Any other seed starts one for each item that has it, however many these are.

Defined results: null, empty and short items and texts give no case; items listed twice are both reported;
repeated documents each have their rows; texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.sieve import Sieve, sieve
from corpuscle.llm.words import MIX, mix, scan
from corpuscle.session import cut

#: Fixed masks, all of five words.
MASKS = ("11111", "110111", "111011", "1101011", "1010111", "1110101")
LEAST, RATIO = 15, 6
COMMON_RUN, COMMON_ITEMS = 8, 4
BITMAP, SALTS = 27, 8
#: Diagonals that are near each other are one band, up to this width, with a margin for drops and additions.
NEAR, WIDE, MARGIN = 8, 32, 8
#: Words of an item that the seeds of a band of diagonals must cover, each counted for ``SPAN`` words from its place on.
COVER, SPAN, POS_BITS = 7, 5, 31
_FACTOR = mix(np.arange(1, 9, dtype="u8") * MIX[0]) | np.uint64(1)


def seeds(h: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(hash, place, words covered)`` of each mask at each place where it fits into one text."""
    for mask in MASKS:
        n = len(mask)
        if len(h) < n:
            continue
        m = len(h) - n + 1
        s = np.zeros(m, "u8")
        for j, bit in enumerate(mask):
            if bit == "1":
                s += h[j : m + j] * _FACTOR[j]
        at = np.flatnonzero(row[:m] == row[n - 1 :])
        yield mix(s[at]), at, n


def run_hash(h: np.ndarray) -> np.ndarray:
    """The hash of the run of ``COMMON_RUN`` words that begins at each place."""
    m = max(0, len(h) - COMMON_RUN + 1)
    s = np.zeros(m, "u8")
    for j in range(COMMON_RUN if m else 0):
        s = mix(s * MIX[1] + h[j : m + j])
    return s


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for s in scan(b.text.tolist()):
            n = np.bincount(s.row, minlength=s.count)
            at = np.r_[0, np.cumsum(n)]
            some = [k for k in range(s.count) if n[k] >= LEAST]
            h = [s.hash[at[k] : at[k + 1]] for k in some]
            yield pd.DataFrame({"item": b.item.to_numpy()[s.first + np.array(some, "i8")], "cls": [int(np.bitwise_xor.reduce(mix(x + np.arange(len(x), dtype="u8") * MIX[0])).view("i8")) for x in h], "h": [x.view("i8") for x in h]})


def _item_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i, c, h in zip(b["item"], b.cls, b.h):
            r = run_hash(h.view("u8"))
            yield pd.DataFrame({"item": i, "cls": c, "pos": np.arange(len(r), dtype="i4"), "run": r.view("i8")})


def _common_of(n: int, starts: np.ndarray | None) -> np.ndarray:
    """Of an item's words, which belong to recurring wording, from where its recurring runs begin."""
    d = np.zeros(n + 1, "i4")
    if starts is not None and len(starts):
        np.add.at(d, starts, 1)
        np.add.at(d, np.minimum(np.asarray(starts) + COMMON_RUN, n), -1)
    return np.cumsum(d)[:n] > 0


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i, h, starts in zip(b["item"], b.h, b.starts):
            own = np.r_[0, np.cumsum(~_common_of(len(h), starts))]
            for s, at, n in seeds(h.view("u8"), np.zeros(len(h), "i1")):
                k = own[at + n] > own[at]
                yield pd.DataFrame({"seed": s[k].view("i8"), "item": i, "pos": at[k].astype("i4")})


def _hits(known: Sieve):
    """The texts that share seeds with items, with those seeds and their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in scan(b.text.tolist()):
                got = []
                for h, at, _ in seeds(s.hash, s.row):
                    k = known.passing(h)
                    got.append((h[k], at[k]))
                h, at = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, "u8"), np.empty(0, "i8"))
                if not len(h):
                    continue
                o = np.argsort(at, kind="stable")
                h, at = h[o].view("i8"), at[o]
                row = s.row[at]
                cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                rows = row[cuts]
                place = (at - np.searchsorted(s.row, row)).astype("i4")
                ends = np.r_[cuts[1:], len(h)]
                x = b.iloc[s.first + rows]
                yield pd.DataFrame({"doc": x.doc, "key": x.key, "text": x.text, "seed": [h[i:j] for i, j in zip(cuts, ends)], "at": [place[i:j] for i, j in zip(cuts, ends)]})

    return run


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each document and item the bands ``low``, ``high`` of near diagonals whose seeds cover enough of the item's words."""
    for b in batches:
        n = b.hits.map(len).to_numpy()
        if not len(n):
            continue
        both = np.concatenate(b.hits.to_numpy())
        diag, pos, pair = both >> POS_BITS, both & ((1 << POS_BITS) - 1), np.repeat(np.arange(len(n)), n)
        o = np.lexsort((diag, pair))
        diag, pos, pair = diag[o], pos[o], pair[o]
        band = np.cumsum(np.r_[True, (pair[1:] != pair[:-1]) | (diag[1:] - diag[:-1] > NEAR)]) - 1
        at = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        low, high = diag[at], diag[np.r_[at[1:], len(band)] - 1]
        o = np.lexsort((pos, band))
        p, c = pos[o], band[o]
        gap = np.r_[np.where(c[1:] == c[:-1], p[1:] - p[:-1], SPAN), SPAN]
        ok = np.bincount(c, np.minimum(gap, SPAN)) >= COVER
        low, high, pair = low[ok], high[ok], pair[at][ok]
        cuts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, "i8")
        x = b.iloc[pair[cuts]]
        yield pd.DataFrame({"key": x.key, "item": x["item"], "low": np.split(low, cuts[1:]) if len(cuts) else [], "high": np.split(high, cuts[1:]) if len(cuts) else []})


class Pair(NamedTuple):
    """An item beside a text, and the diagonals to be looked at."""

    item: np.ndarray
    common: np.ndarray
    text: np.ndarray
    low: int
    high: int


def stretch(own: np.ndarray, total: np.ndarray, edits: np.ndarray, ratio: int) -> int:
    """Own words held by the longest stretch of a path that starts and ends with a match and keeps to the ratio."""
    f = np.r_[0, np.cumsum(total - ratio * edits)]
    c = np.r_[0, np.cumsum(own)]
    at = np.flatnonzero(edits == 0)
    if not len(at):
        return 0
    lowest = np.minimum.accumulate(f[at])
    k = np.searchsorted(-lowest, -f[at + 1], "left")  # the first start from which the path up to here keeps to it
    ok = (k < len(at)) & (k <= np.arange(len(at)))
    return int((c[at + 1] - c[at[np.minimum(k, len(at) - 1)]])[ok].max(initial=0))


def overlaps(pairs: list[Pair], least: int = LEAST, ratio: int = RATIO) -> np.ndarray:
    """Of each pair, whether the item has a stretch of enough words in the text."""
    out = np.zeros(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k].item))
    step = 0
    while step < len(order):
        most = len(pairs[order[step]].item)
        size = max(1, min(256, 2_000_000 // (max(1, most) * (WIDE + 2 * MARGIN + 2))))
        part = order[step : step + size]
        step += size
        out[part] = _aligned([pairs[k] for k in part], least, ratio)
    return out


def _aligned(pairs: list[Pair], least: int, ratio: int) -> list[bool]:
    """Banded local alignment of all pairs at once: one array step a word of the items."""
    n = max(len(p.item) for p in pairs)
    width = max(p.high - p.low for p in pairs) + 1
    k = len(pairs)
    item = np.zeros((k, n), "u8")
    text = np.zeros((k, n + width), "u8")  # of pair p, the text's words from diagonal low on
    for i, p in enumerate(pairs):
        item[i, : len(p.item)] = p.item
        a, b = max(0, p.low), min(len(p.text), p.low + n + width)
        if a < b:
            text[i, a - p.low : b - p.low] = p.text[a:b]
    score = np.zeros((n + 1, k, width + 1), "i4")
    two = 2 * np.arange(width, dtype="i4")
    for i in range(n):
        prev = score[i]
        t = text[:, i : i + width]
        same = (t == item[:, i : i + 1]) & (t != 0)
        s = np.maximum(np.where(same, prev[:, :width] + 1, prev[:, :width] - 2), prev[:, 1:] - 2)
        s = np.maximum.accumulate(s + two, axis=1) - two
        np.maximum(s, 0, out=score[i + 1, :, :width])
    return [_measured(p, item[i], text[i], score[:, i], width, least, ratio) for i, p in enumerate(pairs)]


def _measured(p: Pair, item: np.ndarray, text: np.ndarray, score: np.ndarray, width: int, least: int, ratio: int) -> bool:
    rows = score[1 : len(p.item) + 1, :width].max(axis=1)
    while True:
        i = int(rows.argmax())
        if rows[i] < least // 2:
            return False
        j = int(score[i + 1, :width].argmax())
        i += 1
        steps = []
        last = i
        while i > 0 and 0 <= j < width and score[i, j] > 0:
            s = score[i, j]
            same = item[i - 1] == text[i - 1 + j] != 0
            if s == score[i - 1, j] + (1 if same else -2):
                steps.append((1, 0 if same else 1, i - 1))
                i -= 1
            elif s == score[i - 1, j + 1] - 2:
                steps.append((1, 1, i - 1))
                i, j = i - 1, j + 1
            else:
                steps.append((0, 1, i - 1))
                j -= 1
        x = np.array(steps[::-1], "i8").reshape(-1, 3)
        if stretch((x[:, 1] == 0) & ~p.common[x[:, 2]], x[:, 0], x[:, 1], ratio) >= least:
            return True
        rows[min(i, last - 1) : last] = 0


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by document: first its text, then an item with its diagonals each."""
    key, doc, text = None, None, None
    for b in batches:
        pairs, of, texts = [], [], {}
        known = b.text.notna().to_numpy()
        rows = np.flatnonzero(known)
        for s in scan(b.text[known].tolist()):
            at = np.r_[np.searchsorted(s.row, np.arange(s.count)), len(s.row)]
            for k in range(s.count):
                texts[rows[s.first + k]] = s.hash[at[k] : at[k + 1]]
        for k, (of_text, d, i, h, starts, low, high) in enumerate(zip(b.key, b.doc, b["item"], b.h, b.starts, b.low, b.high)):
            if known[k]:
                key, doc, text = of_text, int(d), texts[k]
            elif key == of_text:
                h = h.view("u8")
                common = _common_of(len(h), starts)
                for x, y in zip(low, high):
                    for z in range(int(x), int(y) + 1, WIDE):  # bands are no wider than this, but overlap
                        pairs.append(Pair(h, common, text, z - MARGIN, min(z + WIDE, int(y)) + MARGIN))
                        of.append((doc, i))
        ok = overlaps(pairs)
        yield pd.DataFrame(sorted({x for x, y in zip(of, ok) if y}), columns=["doc", "item"])


def leaks(docs: DataFrame, id_col: str, text: str, items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """``(id, item)``: each document with the items it gives away."""
    wanted = items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).distinct()
    words = cut(wanted.mapInPandas(_item_words, "item long, cls long, h array<long>"))
    runs = words.mapInPandas(_item_runs, "item long, cls long, pos int, run long")
    common = runs.select("run", "cls").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_ITEMS).select("run")
    starts = runs.join(common, "run", "left_semi").groupBy("item", "cls").agg(F.collect_list("pos").alias("starts"))
    listed = cut(words.join(starts, ["item", "cls"], "left").select("item", "h", "starts"))
    table = cut(listed.mapInPandas(_item_seeds, "seed long, item long, pos int"))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(id_col, text).alias("key"), F.col(text).alias("text"))
    near = cut(rows.mapInPandas(_hits(sieve(table, "seed", BITMAP)), "doc long, key long, text string, seed array<long>, at array<int>"))
    salted = table.select("item", "pos", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.xxhash64("seed", k))).alias("s"))
    hits = near.select("key", F.explode(F.arrays_zip("seed", "at")).alias("x")).select("key", F.xxhash64("x.seed", F.pmod("key", F.lit(SALTS)).cast("int")).alias("s"), "x.at")
    # Sizes of what Python made are estimated by what it was made from, here far too small: never broadcast by that estimate.
    diagonals = hits.join(salted.hint("merge"), "s").groupBy("key", "item").agg(F.collect_set(F.shiftleft((F.col("at") - F.col("pos")).cast("long"), POS_BITS) + F.col("pos")).alias("hits"))
    bands = diagonals.mapInPandas(_covered, "key long, item long, low array<long>, high array<long>")
    found = bands.join(listed, "item")
    void = lambda c, t: F.lit(None).cast(t).alias(c)
    texts = near.select("key", "doc", "text", void("item", "long"), void("h", "array<long>"), void("starts", "array<int>"), void("low", "array<long>"), void("high", "array<long>")).dropDuplicates(["key"])
    both = texts.unionByName(found.select("key", void("doc", "long"), void("text", "string"), "item", "h", "starts", "low", "high"))
    sorted_ = both.repartition("key").sortWithinPartitions("key", F.col("item").asc_nulls_first())
    return sorted_.mapInPandas(_verify, "doc long, item long").distinct().select(F.col("doc").alias(id_col), F.col("item").alias(item_col))
