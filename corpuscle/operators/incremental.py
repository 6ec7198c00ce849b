"""Processing only new or changed records, by a Merkle tree over key-hash ranges.

A record is ``(key, token)``: the token is a 64-bit digest of what identifies the record's content. The key
space is the range of ``xxhash64(key)``; a leaf is one of ``2**leaf_bits`` equal ranges, and each inner node
covers ``2**fan_bits`` children. Node digests are order-free (xor and sum of the record digests, with their
count), so they aggregate map-side and a tree costs one shuffle of at most ``2**leaf_bits`` rows per task. Sums are
over 24 bits of a digest, so they hold for up to 2**39 records.

A run compares the tree of the current records with the one published last, from the root down: of each level only
the children of nodes that differ are looked at, and records only in the leaves reached. Equal digests mean equal
records, so a skipped range holds no change. ``MerkleStore`` keeps the published trees; a version holds the records of
the leaves that changed in it and, in its tree, where those of the other leaves are, so publishing costs what changed.

Defined results: null keys are ignored; of several rows with one key the one with the greatest token (and then the
greatest content) holds, in every step of a run; an empty current side gives no rows; an empty saved side makes every
record new; keys that are gone are reported as removed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.errors import BusyError
from corpuscle.session import cut, scratch

LEAF_BITS, FAN_BITS = 16, 4
#: Up to this many leaves the changed ones are broadcast: at most 2**18 longs, 2 MB.
BROADCAST_LEAF_BITS = 18


def leaf_of(key: str | Column, leaf_bits: int = LEAF_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - leaf_bits)


def tree(records: DataFrame, key: str, token: str, leaf_bits: int = LEAF_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """All nodes: ``(level, node, d_xor, d_sum, n)``; level 0 is the root, the last level holds the leaves."""
    h = F.xxhash64(F.col(key), F.col(token))
    leaves = (
        records.where(F.col(key).isNotNull())
        .groupBy(leaf_of(key, leaf_bits).alias("leaf"))
        .agg(F.bit_xor(h).alias("d_xor"), F.sum(F.shiftrightunsigned(h, 40)).alias("d_sum"), F.count(F.lit(1)).alias("n"))
    )
    depth = -(-leaf_bits // fan_bits)
    path = [F.struct(F.lit(l).alias("level"), F.shiftrightunsigned(F.col("leaf"), min(leaf_bits, fan_bits * (depth - l))).alias("node")) for l in range(depth + 1)]
    return (
        leaves.withColumn("p", F.explode(F.array(*path)))
        .groupBy("p.level", "p.node")
        .agg(F.bit_xor("d_xor").alias("d_xor"), F.sum("d_sum").alias("d_sum"), F.sum("n").alias("n"))
    )


def changed_leaves(now: DataFrame, saved: DataFrame, leaf_bits: int = LEAF_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """``leaf`` of each leaf whose digest differs, found from the root down; ``now`` and ``saved`` are trees.

    Of a level only children of the nodes found to differ above it are read and compared.
    """
    depth = -(-leaf_bits // fan_bits)
    front = None
    for l in range(depth + 1):
        shift = fan_bits if l > 1 else leaf_bits - fan_bits * (depth - 1)
        sides = []
        for t, name in ((now, "a"), (saved, "b")):
            level = t.where(F.col("level") == l)
            if front is not None:
                up = front.select(F.col("node").alias("__up"))
                level = level.withColumn("__up", F.shiftrightunsigned("node", shift)).join(F.broadcast(up) if leaf_bits <= BROADCAST_LEAF_BITS else up, "__up", "left_semi")
            sides.append(level.select("node", F.struct("d_xor", "d_sum", "n").alias(name)))
        front = sides[0].join(sides[1], "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    return front.select(F.col("node").alias("leaf"))


def in_leaves(records: DataFrame, key: str, leaves: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """The records whose key falls into one of the leaves."""
    small = F.broadcast(leaves) if leaf_bits <= BROADCAST_LEAF_BITS else leaves
    return records.withColumn("__leaf", leaf_of(key, leaf_bits)).join(small.select(F.col("leaf").alias("__leaf")), "__leaf", "left_semi").drop("__leaf")


def norm(c: str) -> Column:
    """Hashes and statuses compare without letter case and outer blanks; empty counts as missing."""
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def content_token(side: str) -> Column:
    """Digest of (file_hash, file_size_bytes, modified_at). Two rows with equal tokens show the same content.

    With a hash only the hash counts. Without hash and time nothing can be shown to be equal: such rows get a
    token of their side, which never equals one of the other side.
    """
    return F.when(F.col("file_hash").isNotNull(), F.xxhash64(F.lit("hash"), "file_hash")).when(
        F.col("modified_at").isNotNull() & F.col("file_size_bytes").isNotNull(), F.xxhash64(F.lit("size"), "file_size_bytes", "modified_at")
    ).otherwise(F.xxhash64(F.lit(side), "file_size_bytes"))


def current_files(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per (scope_key, source_path): the entry updated last in the scope's latest complete run.

    Partitioned by source_path, so later steps keyed by path (or scope and path) need no further shuffle and a
    scope with a large share of the rows is spread over all tasks.
    """
    latest = (
        runs.where(norm("status").isin("complete", "completed"))
        .groupBy("scope_key")
        .agg(F.max(F.struct("updated_at", "run_id")).alias("r"))
        .select("scope_key", F.col("r.run_id").alias("run_id"))
    )
    cols = ["updated_at", "file_hash", "file_size_bytes", "modified_at"]
    e = entries.select("scope_key", "source_path", "run_id", norm("file_hash").alias("file_hash"), "file_size_bytes", "modified_at", "updated_at").where("source_path IS NOT NULL")
    return (
        e.join(latest, ["scope_key", "run_id"], "left_semi")
        .repartition("source_path")
        .groupBy("scope_key", "source_path")
        .agg(F.max(F.struct(*cols)).alias("e"))
        .select("scope_key", "source_path", "e.file_hash", "e.file_size_bytes", "e.modified_at")
    )


def last_completed(state: DataFrame) -> DataFrame:
    """One row per source_path: the latest completed state by processed_at, whatever was tried later."""
    return (
        state.where(norm("status").isin("complete", "completed") & F.col("source_path").isNotNull())
        .groupBy("source_path")
        .agg(F.max(F.struct("processed_at", norm("file_hash").alias("file_hash"), "file_size_bytes", "modified_at")).alias("s"))
        .select("source_path", "s.file_hash", "s.file_size_bytes", "s.modified_at")
    )


def _same(a: str, b: str) -> Column:
    """The null-tolerant comparison of contents."""
    c = lambda s, n: F.col(f"{s}.{n}")
    both = c(a, "file_hash").isNotNull() & c(b, "file_hash").isNotNull()
    return F.coalesce(
        F.when(both, c(a, "file_hash") == c(b, "file_hash")).otherwise((c(a, "file_size_bytes") == c(b, "file_size_bytes")) & (c(a, "modified_at") == c(b, "modified_at"))),
        F.lit(False),
    )


class MerkleStore:
    """Published versions of a keyed set of records: ``root/v-00000001/{records,tree,output,removed,_DONE}``.

    A version counts only once ``_DONE`` exists, and that file is created after everything else was written: output and
    tree become valid together. A run that breaks off leaves a version without it, and the next run compares with
    the last finished one, so it neither skips nor repeats records. ``records`` holds those of the leaves that changed;
    ``at`` in the tree says which version holds a leaf's. Once they are spread over ``KEEP`` versions all are written anew.
    A lock file keeps a second writer out; one that a broken run left is taken over after ``stale`` seconds.
    """

    KEEP = 16

    def __init__(self, spark: SparkSession, root: str, leaf_bits: int = LEAF_BITS, fan_bits: int = FAN_BITS, stale: float = 86_400):
        self.spark, self.root, self.stale = spark, root.rstrip("/"), stale
        self.leaf_bits, self.fan_bits = leaf_bits, fan_bits
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the finished versions, ascending."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and self._fs.exists(self._path(f"{self.root}/{n}/_DONE")))

    def dir(self, v: int) -> str:
        return f"{self.root}/v-{v:08d}"

    def read(self, v: int, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir(v)}/{part}")

    def lock(self) -> None:
        at = self._path(f"{self.root}/_LOCK")
        if self._fs.exists(at) and time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 > self.stale:
            self._fs.delete(at, False)
        try:
            self._fs.create(at, False).close()
        except Exception as e:
            raise BusyError(f"another run holds {self.root}/_LOCK") from e

    def unlock(self) -> None:
        self._fs.delete(self._path(f"{self.root}/_LOCK"), False)

    def leaves(self, now: DataFrame) -> DataFrame | None:
        """The leaves in which the tree ``now`` differs from the one published last; None before the first."""
        done = self.versions()
        return changed_leaves(now, self.read(done[-1], "tree"), self.leaf_bits, self.fan_bits) if done else None

    def saved(self, leaves: DataFrame) -> DataFrame:
        """The records published last of these leaves: ``key, token`` and what was saved with them."""
        v = self.versions()[-1]
        where = self.read(v, "tree").where(F.col("level") == -(-self.leaf_bits // self.fan_bits)).select(F.col("node").alias("leaf"), "at")
        used = [r["at"] for r in where.select("at").distinct().collect()]  # at most KEEP
        records = self.spark.read.parquet(*[f"{self.dir(x)}/records" for x in used or [v]])
        wanted = where.join(leaves, "leaf", "left_semi")
        return records.join(F.broadcast(wanted) if self.leaf_bits <= BROADCAST_LEAF_BITS else wanted, ["leaf", "at"], "left_semi").drop("leaf", "at")

    def current(self) -> DataFrame:
        """All records published last."""
        v = self.versions()[-1]
        return self.saved(self.read(v, "tree").where(F.col("level") == -(-self.leaf_bits // self.fan_bits)).select(F.col("node").alias("leaf")))

    def publish(self, records: DataFrame, now: DataFrame, leaves: DataFrame | None, output: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Write the records (``key, token, ..``) of the changed leaves, the tree, the output and the removed keys; then the mark."""
        done = self.versions()
        v = (done[-1] if done else 0) + 1
        at = self.dir(v)
        self._fs.delete(self._path(at), True)
        depth = -(-self.leaf_bits // self.fan_bits)
        held = None
        if done and leaves is not None:
            old = self.read(done[-1], "tree").where(F.col("level") == depth)
            if old.select("at").distinct().count() < self.KEEP:
                held = old.select("level", "node", "at").join(leaves.withColumnRenamed("leaf", "node"), "node", "left_anti")
        for part, df in (("output", output), ("removed", removed)):
            if df is not None:
                df.write.parquet(f"{at}/{part}")
        some = records if held is None else in_leaves(records, "key", leaves, self.leaf_bits)
        some.withColumns({"leaf": leaf_of("key", self.leaf_bits), "at": F.lit(v)}).write.parquet(f"{at}/records")
        tree_ = now.withColumn("at", F.lit(v)) if held is None else now.join(held, ["level", "node"], "left").withColumn("at", F.coalesce("at", F.lit(v)))
        tree_.write.parquet(f"{at}/tree")
        self._fs.create(self._path(f"{at}/_DONE"), False).close()
        if held is None:
            for x in done:  # nothing refers to their records any more
                self._fs.delete(self._path(f"{self.dir(x)}/records"), True)
        return v


def pending_files(runs: DataFrame, entries: DataFrame, state: DataFrame, leaf_bits: int = LEAF_BITS, store: MerkleStore | None = None) -> DataFrame:
    """``(scope_key, source_path)`` of the current files that are new or differ from what was last completed.

    What was last completed is published first, as the tree that the run then descends; the files found and the tree
    of the current ones are published together, and the files are read from there. Failed and broken attempts don't
    count: only completed states enter the saved tree. Paths that no longer exist make their leaf differ, cost a look
    at that leaf, and give no row.
    """
    spark = runs.sparkSession
    store = store or MerkleStore(spark, scratch(spark, "pending"), leaf_bits)
    grow = lambda df: cut(tree(df, "key", "token", leaf_bits, store.fan_bits))
    done = cut(last_completed(state).withColumn("token", content_token("saved")).withColumnRenamed("source_path", "key"))
    before = grow(done)
    store.publish(done, before, store.leaves(before))
    now = cut(current_files(runs, entries).withColumn("token", content_token("now")).withColumnRenamed("source_path", "key"))
    # A path listed by several scopes with unlike contents must make its leaf differ.
    by_path = now.groupBy("key").agg(F.min("token").alias("lo"), F.max("token").alias("hi")).select(
        "key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.xxhash64(F.lit("mixed"), "lo", "hi")).alias("token"))
    after = grow(by_path)
    leaves = cut(store.leaves(after))
    a, b = in_leaves(now, "key", leaves, leaf_bits).alias("a"), store.saved(leaves).alias("b")
    j = a.join(b, F.col("a.key") == F.col("b.key"), "left")
    pending = j.where(F.col("b.key").isNull() | ~_same("a", "b")).select(F.col("a.scope_key").alias("scope_key"), F.col("a.key").alias("source_path"))
    return store.read(store.publish(by_path, after, leaves, pending), "output")


class MerkleSync:
    """Incremental runs over a keyed table: each processes what is new or changed and publishes output and tree together."""

    def __init__(self, spark: SparkSession, root: str, key: str, content: list[str], leaf_bits: int = LEAF_BITS, fan_bits: int = FAN_BITS, stale: float = 86_400):
        self.store = MerkleStore(spark, root, leaf_bits, fan_bits, stale)
        self.key, self.content = key, content

    def versions(self) -> list[int]:
        return self.store.versions()

    def _snapshot(self, source: DataFrame) -> DataFrame:
        """One row per key, evaluated once: ``key, token, row``."""
        row = F.struct(*source.columns)
        token = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in self.content])
        one = source.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("string").alias("key"), token.alias("token"), row.alias("row"))
        return cut(one.groupBy("key").agg(F.max("token").alias("token"), F.max_by("row", F.struct("token", F.to_json("row"))).alias("row")))

    def _compare(self, source: DataFrame):
        src = self._snapshot(source)
        now = cut(tree(src, "key", "token", self.store.leaf_bits, self.store.fan_bits))
        leaves = self.store.leaves(now)
        if leaves is None:
            return src, now, None, src.select("row.*"), src.select("key").limit(0)
        leaves = cut(leaves)
        cand, saved = in_leaves(src, "key", leaves, self.store.leaf_bits), cut(self.store.saved(leaves))
        changed = cand.join(saved.select("key", "token"), ["key", "token"], "left_anti").select("row.*")
        return src, now, leaves, changed, saved.select("key").join(cand.select("key"), "key", "left_anti")

    def changes(self, source: DataFrame) -> DataFrame:
        """The rows of ``source`` that are new or changed since the last finished version; one row per key."""
        return self._compare(source)[3]

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int:
        """Process the changes and publish; gives the version's number."""
        self.store.lock()
        try:
            src, now, leaves, changed, removed = self._compare(source)
            return self.store.publish(src.select("key", "token"), now, leaves, process(changed), removed)
        finally:
            self.store.unlock()

    def output(self, v: int) -> DataFrame:
        return self.store.read(v, "output")

    def removed(self, v: int) -> DataFrame:
        """``key`` of each record that was there before version ``v`` and isn't any more."""
        return self.store.read(v, "removed")
