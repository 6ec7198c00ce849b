"""Most similar vectors for every vector, by a hash-prefix forest.

Each tree gives every vector a 64-bit string of random-hyperplane signs. A tree is stored as the sorted array of its
strings: a range partitioning on (tree, string) cuts it into runs of near-equal size whatever the data's density, so
a dense region costs deeper prefixes, not a larger task. The rows at either end of a run are compared with those of
the next one, so what is found doesn't depend on the partitions.

A string's longest prefix matches are its neighbours in the array; places further out share shorter prefixes. From
there all strings of all trees ascend in step, one place further out on either side at a time. A candidate is a
string within the Hamming radius that the first trees' strings allow at the wanted cosine. A string goes on for
``reach`` places in any case, and then for as long as it has fewer than ``ENOUGH`` candidates in its tree, until the
prefix it shares is so short that about ``BLOCK_ROWS`` strings have it by chance (which depends on the number of
vectors), or ``FAR`` places are behind it. Pairs from all trees are then made distinct and verified with the true cosine.

A vector with ``reach`` verified neighbours or more lies in a dense region, where the walk's places need not hold
the nearest. All dense vectors are compared with everything that can be near, exactly: each goes to its nearest of
at most ``PIVOTS`` sampled dense vectors, every vector goes to all pivots that the triangle inequality on angles
doesn't rule out, and a pivot's two sides are multiplied in blocks. This costs the square of a dense group.

Equal vectors are one class: one vector per class is indexed, and each class offers its ``k + 1`` smallest
ids as neighbours, which is exact as ties go to smaller ids. A group of copies thus costs its size, not its
square.

The index is approximate: ``tests/llm`` and the README hold its recall against brute force. It has no fitted
part but the fixed seed.

Defined results: vectors that are null, of another length, not finite or all zero have no neighbours and are
none; repeated rows count once; ties in the cosine go to the smaller id; an id with several unlike vectors
is compared by each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import cut

TREES, REACH, ENOUGH, BLOCK_ROWS, FAR, SEED = 16, 32, 8, 128, 1024, 20240817
SKETCH_WORDS = 4
PIVOTS, BLOCK = 256, 2000


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, trees * 64)).astype("f4")


def usable(vector: str, dim: int):
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)


def _strings(dim: int, trees: int):
    """Rows of each tree from rows (rep, v): ``tree, s, rep`` and the sketch words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = _planes(dim, trees)
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b.v.to_numpy()).astype("f4")
            x /= np.abs(x).max(axis=1, keepdims=True)
            words = np.packbits((x @ planes) > 0, axis=1).view(">u8").astype("u8").view("i8")
            n = len(b)
            out = {"tree": np.repeat(np.arange(trees, dtype="i4"), n), "s": words.T.reshape(-1), "rep": np.tile(b.rep.to_numpy(), trees)}
            for k in range(SKETCH_WORDS):
                out[f"w{k}"] = np.tile(words[:, k], trees)
            yield pd.DataFrame(out)

    return run


EDGE = ["tree", "s", "rep", *[f"w{i}" for i in range(SKETCH_WORDS)]]


class _Ascent:
    """Candidate pairs of a sorted array that comes in pieces; the last ``FAR`` rows and what they have found are kept."""

    def __init__(self, reach: int, prefix: int, radius: int):
        self.reach, self.prefix, self.radius = reach, prefix, radius
        self.rows: pd.DataFrame | None = None
        self.found = np.empty(0, "i4")

    def add(self, b: pd.DataFrame) -> pd.DataFrame:
        """The pairs of the new rows with each other and with earlier ones."""
        old = 0 if self.rows is None else len(self.rows)
        x = b if self.rows is None else pd.concat([self.rows, b], ignore_index=True)
        found = np.r_[self.found, np.zeros(len(b), "i4")]
        s, t, r = x.s.to_numpy().view("u8"), x.tree.to_numpy(), x.rep.to_numpy()
        w = [x[f"w{k}"].to_numpy().view("u8") for k in range(SKETCH_WORDS)]
        shift = np.uint64(64 - self.prefix)
        lo, hi = [], []
        at = np.arange(len(x) - 1)  # places whose pair at this distance still shares the prefix
        for d in range(1, FAR + 1):
            at = at[at + d < len(x)]
            at = at[(t[at] == t[at + d]) & ((s[at] ^ s[at + d]) >> shift == 0)]
            if not len(at):
                break
            go = at[at + d >= old]
            if d > self.reach:
                go = go[(found[go] < ENOUGH) | (found[go + d] < ENOUGH)]
                if not len(go):
                    if d > self.reach + 64 and not (found[at] < ENOUGH).any():
                        break
                    continue
            ham = sum(np.bitwise_count(k[go] ^ k[go + d]).astype("i4") for k in w)
            ok = go[(ham <= self.radius) & (r[go] != r[go + d])]
            if len(ok):
                found[ok] += 1
                found[ok + d] += 1
                lo.append(np.minimum(r[ok], r[ok + d]))
                hi.append(np.maximum(r[ok], r[ok + d]))
        keep = min(len(x), FAR)
        self.rows, self.found = x.tail(keep), found[len(x) - keep :]
        if not lo:
            return pd.DataFrame({"a": np.empty(0, "i8"), "b": np.empty(0, "i8")})
        return pd.DataFrame({"a": np.concatenate(lo), "b": np.concatenate(hi)}).drop_duplicates()


def _walk(reach: int, prefix: int, radius: int):
    """The candidate pairs of each run, and the rows at its ends with the number of the boundary they lie at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, first, ascent = TaskContext.get().partitionId(), None, _Ascent(reach, prefix, radius)
        for b in batches:
            if not len(b):
                continue
            yield ascent.add(b).reindex(columns=["a", "b", *EDGE, "boundary"])
            if first is None or len(first) < reach:
                first = (b if first is None else pd.concat([first, b])).head(reach)
        if first is not None:
            for rows, boundary in ((first, here - 1), (ascent.rows.tail(reach), here)):
                yield rows.assign(a=None, b=None, boundary=boundary)[["a", "b", *EDGE, "boundary"]]

    return run


def _across(reach: int, prefix: int, radius: int):
    """The candidate pairs among the rows at one boundary."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(u=g.s.to_numpy().view("u8")).sort_values(["tree", "s"]).drop_duplicates(["tree", "s", "rep"])
        return _Ascent(reach, prefix, radius).add(g.reset_index(drop=True))

    return run


def radius_of(cosine: float, bits: int = 64 * SKETCH_WORDS, sigmas: float = 4.0) -> int:
    """The Hamming distance that pairs of at least this cosine stay within, but for ``sigmas`` standard deviations."""
    p = float(np.arccos(cosine) / np.pi)
    return int(np.ceil(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5))


def _units(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype("f4")
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c = _units(b.v) @ pivots.T
                p = c.argmax(axis=1)
                yield pd.DataFrame({"p": p.astype("i4"), "angle": np.arccos(np.clip(c[np.arange(len(b)), p], -1, 1)).astype("f8"), "rep": b.rep, "v": b.v})

    return run


def _reachable(pivots: np.ndarray, angle: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                row, p = np.nonzero(np.arccos(np.clip(_units(b.v) @ pivots.T, -1, 1)) <= angle)
                yield pd.DataFrame({"p": p.astype("i4"), "rep": b.rep.to_numpy()[row], "v": b.v.to_numpy()[row]})

    return run


def _multiply(take: int, least: float):
    """Of two sides, the ``take`` nearest of the other for each row of the dense one, and all at the last one's cosine."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        l, r = g[g.dense], g[~g.dense]
        if not len(l) or not len(r):
            return pd.DataFrame({"a": np.empty(0, "i8"), "b": np.empty(0, "i8")})
        x, y = l.rep.to_numpy(), r.rep.to_numpy()
        c = _units(l.v) @ _units(r.v).T
        c[x[:, None] == y[None, :]] = -2
        floor = np.full(len(x), least)
        if len(y) > take:
            floor = np.maximum(floor, np.partition(c, len(y) - take, axis=1)[:, len(y) - take])
        i, j = np.nonzero(c >= floor[:, None] - 1e-5)
        return pd.DataFrame({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j])})

    return run


def _exact(dense: DataFrame, vectors: DataFrame, take: int, least: float, block: int) -> DataFrame:
    """Candidate pairs ``(a, b)`` that hold the ``take`` nearest of each dense vector among all."""
    sampled = _units(dense.orderBy(F.xxhash64("rep"), "rep").limit(PIVOTS).toPandas().v)
    left = cut(dense.mapInPandas(_nearest(sampled), "p int, angle double, rep long, v array<float>"))
    sizes = {r.p: r for r in left.groupBy("p").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect()}
    angle = np.array([sizes[p].angle + np.arccos(least) + 2e-3 if p in sizes else -1.0 for p in range(len(sampled))])
    right = cut(vectors.mapInPandas(_reachable(sampled, angle), "p int, rep long, v array<float>"))
    blocks = [(r.p, -(-sizes[r.p].n // block), -(-r["n"] // block)) for r in right.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()]
    blocks = F.broadcast(dense.sparkSession.createDataFrame(blocks, "p int, nl long, nr long"))
    part = lambda n: F.pmod(F.xxhash64("rep"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    l = left.join(blocks, "p").select("p", part("nl").alias("i"), every("nr").alias("j"), "rep", "v", F.lit(True).alias("dense"))
    r = right.join(blocks, "p").select("p", every("nl").alias("i"), part("nr").alias("j"), "rep", "v", F.lit(False).alias("dense"))
    return l.unionByName(r).groupBy("p", "i", "j").applyInPandas(_multiply(take, least), "a long, b long").distinct()


def neighbours(rows: DataFrame, id_col: str, vector: str, dim: int = 64, k: int = 5, least: float = 0.90, trees: int = TREES, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """``(id, other, cosine, rank)``: up to ``k`` most similar other ids of each usable vector, with at least the cosine."""
    good = rows.where(F.col(id_col).isNotNull() & usable(vector, dim)).select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    keyed = good.withColumn("rep", F.xxhash64("v"))
    members = cut(keyed.select("rep", "id").distinct())
    vectors = cut(keyed.select("rep", "v").dropDuplicates(["rep"]))
    cols = ", ".join(f"w{i} long" for i in range(SKETCH_WORDS))
    strings = vectors.mapInPandas(_strings(dim, trees), f"tree int, s long, rep long, {cols}")
    prefix = max(1, int(np.log2(max(1, vectors.count()) / BLOCK_ROWS + 1)))
    rule = (reach, prefix, radius_of(least))
    runs = strings.repartitionByRange("tree", "s").sortWithinPartitions("tree", "s")
    walked = cut(runs.mapInPandas(_walk(*rule), f"a long, b long, tree int, s long, rep long, {cols}, boundary int"))
    ends = walked.where("boundary IS NOT NULL").select("boundary", *EDGE)
    found = walked.where("a IS NOT NULL").select("a", "b").unionByName(ends.groupBy("boundary").applyInPandas(_across(*rule), "a long, b long")).distinct()
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    unit = vectors.select("rep", "v", F.sqrt(dot("v", "v")).alias("n"))

    def verified(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(unit.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("n").alias("na")), "a")
            .join(unit.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb")), "b")
            .select("a", "b", (dot("va", "vb") / (F.col("na") * F.col("nb"))).alias("cosine"))
            .where(F.col("cosine") >= least)
        )

    close = cut(verified(found))
    dense = close.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= reach).select("rep")
    dense = cut(dense.join(vectors, "rep"))
    if not dense.isEmpty():
        most = members.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).head()[0]  # vectors of an id
        close = close.unionByName(verified(_exact(dense, vectors, (k + 1) * most, least, block))).distinct()
    directed = close.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("to")), F.struct(F.col("b").alias("rep"), F.col("a").alias("to")))).alias("p"), "cosine").select("p.rep", "p.to", "cosine")
    targets = members.withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("__r") <= k + 1).select(F.col("rep").alias("to"), F.col("id").alias("other"))
    many = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = many.select("rep", F.col("rep").alias("to"), F.lit(1.0).alias("cosine"))
    offered = directed.unionByName(own).join(targets, "to").join(members, "rep").where("id <> other").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), F.asc("other"))
    return offered.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: each pair of which either is a neighbour of the other, smaller id first."""
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
