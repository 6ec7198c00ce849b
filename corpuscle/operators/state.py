"""States of files and scans: latest rows, skips, recovery, summaries, and the snapshot store they live in."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.classify import parse_status

STATE = ["source_path", "file_hash", "file_size_bytes", "modified_at", "processed_at", "chunk_count", "status", "error"]


def _time_agrees(a: str, b: str) -> Column:
    return F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))


def latest_state(history: DataFrame) -> DataFrame:
    """One row per path: the state processed last; its status in the usual spelling."""
    h = history.where("source_path IS NOT NULL").withColumn("status", parse_status("status"))
    rest = [c for c in STATE if c not in ("source_path", "processed_at")]
    return h.groupBy("source_path").agg(F.max(F.struct("processed_at", *rest)).alias("s")).select("source_path", *[f"s.{c}" for c in STATE[1:]])


def latest_failure(history: DataFrame) -> DataFrame:
    return history.where("source_path IS NOT NULL").groupBy("source_path").agg(F.max(F.struct("failed_at", "file_size_bytes", "modified_at", "reason", "file_hash")).alias("s")).select("source_path", "s.*")


def _seen(files: DataFrame, known: DataFrame, how: str) -> DataFrame:
    k = known.select(F.col("source_path").alias("__p"), F.col("file_size_bytes").alias("__s"), F.col("modified_at").alias("__m"))
    return files.join(k, (F.col("source_path") == F.col("__p")) & (F.col("file_size_bytes") == F.col("__s")) & _time_agrees("modified_at", "__m"), how)


def done(files: DataFrame, state: DataFrame) -> DataFrame:
    """The files that a completed state covers: same size, and same time where both are known."""
    return _seen(files, state.where(F.col("status") == "completed"), "left_semi")


def to_process(files: DataFrame, state: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """The files left to process: neither completed nor, where failures are given, failed in this very form."""
    left = _seen(files, state.where(F.col("status") == "completed"), "left_anti")
    return left if failures is None else _seen(left, failures, "left_anti")


def skipped_failures(files: DataFrame, failures: DataFrame) -> DataFrame:
    return _seen(files, failures, "left_semi")


def processed_summary(entries: DataFrame, state: DataFrame, failures: DataFrame) -> DataFrame:
    """``(scope_key, files, bytes)``: entries covered by a completed state or a failure, each once."""
    hit = done(entries, state).unionByName(skipped_failures(entries, failures)).select("scope_key", "source_path", "file_size_bytes").distinct()
    return hit.groupBy("scope_key").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size_bytes").alias("bytes"))


def scan_summary(entries: DataFrame) -> DataFrame:
    """``(scope_key, run_id, files, bytes)`` of the distinct entries of each run."""
    e = entries.groupBy("scope_key", "run_id", "source_path").agg(F.max_by("file_size_bytes", F.struct("updated_at", "file_size_bytes")).alias("size"))
    return e.groupBy("scope_key", "run_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def recover(state: DataFrame, reason: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """States and failures after a crash: what was being processed has failed."""
    broken = F.col("status") == "processing"
    fixed = state.withColumns({"error": F.when(broken, F.lit(reason)).otherwise(F.col("error")), "processed_at": F.when(broken, at).otherwise(F.col("processed_at")), "status": F.when(broken, F.lit("failed")).otherwise(F.col("status"))})
    failed = state.where(broken).select("source_path", "file_hash", "file_size_bytes", "modified_at", at.alias("failed_at"), F.lit(reason).alias("reason"))
    return fixed, failed


def current_entries(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """The entries of each scope's newest run; older ones are stale."""
    newest = runs.groupBy("scope_key").agg(F.max(F.struct("updated_at", "run_id")).alias("r")).select("scope_key", F.col("r.run_id").alias("run_id"))
    return entries.join(newest, ["scope_key", "run_id"], "left_semi")


def is_processed(files: DataFrame, state: DataFrame) -> DataFrame:
    """The files with ``processed``: whether a completed state has their path and hash."""
    k = state.where("status = 'completed'").select("source_path", "file_hash", F.lit(True).alias("__p")).distinct()
    return files.join(k, ["source_path", "file_hash"], "left").withColumn("processed", F.coalesce("__p", F.lit(False))).drop("__p")


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("source_path"), "source_path", "left_anti").unionByName(new.select(*old.columns))


def mark_processing(state: DataFrame, files: DataFrame, at: Column) -> DataFrame:
    """The state with these files ``(source_path, file_hash, file_size_bytes, modified_at)`` begun anew."""
    new = files.dropDuplicates(["source_path"]).select("source_path", "file_hash", "file_size_bytes", "modified_at", at.alias("processed_at"), F.lit(0).alias("chunk_count"), F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error"))
    return _replaced(state, new)


def mark_complete(state: DataFrame, failures: DataFrame, done_: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """``(state, failures)`` after these paths ``(source_path, chunk_count)`` are done: known ones are completed, and no failure of theirs is left."""
    d = done_.dropDuplicates(["source_path"]).select("source_path", F.col("chunk_count").alias("__n"), F.lit(True).alias("__d"))
    hit = F.col("__d").isNotNull()
    new = state.join(d, "source_path", "left").withColumns({"chunk_count": F.when(hit, F.col("__n")).otherwise(F.col("chunk_count")), "status": F.when(hit, "completed").otherwise(F.col("status")), "processed_at": F.when(hit, at).otherwise(F.col("processed_at")), "error": F.when(~hit, F.col("error"))})
    return new.select(*state.columns), clear_failure(failures, done_)


def mark_failed(state: DataFrame, failed: DataFrame, at: Column) -> DataFrame:
    """The state after these paths ``(source_path, error)`` failed; unknown paths change nothing."""
    d = failed.dropDuplicates(["source_path"]).select("source_path", F.col("error").alias("__e"), F.lit(True).alias("__d"))
    hit = F.col("__d").isNotNull()
    new = state.join(d, "source_path", "left").withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "processed_at": F.when(hit, at).otherwise(F.col("processed_at")), "error": F.when(hit, F.col("__e")).otherwise(F.col("error"))})
    return new.select(*state.columns)


def record_failure(failures: DataFrame, new: DataFrame) -> DataFrame:
    """The failures with new ones, which replace those of the same path."""
    return _replaced(failures, new.dropDuplicates(["source_path"]))


def clear_failure(failures: DataFrame, paths: DataFrame) -> DataFrame:
    return failures.join(paths.select("source_path").distinct(), "source_path", "left_anti")


def removed(state: DataFrame, failures: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State and failures without these paths."""
    return clear_failure(state, paths), clear_failure(failures, paths)


class StateStore:
    """Keyed tables as a log of changes: a write appends what it changes, reading takes each key's last.

    A version counts once its mark exists, so a broken write changes nothing. Once ``KEEP`` versions have gathered the
    next write takes all current rows over and drops the older ones. One writer at a time.
    """

    KEEP = 16

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: str):
        self.spark, self.root, self.key, self.schema = spark, root.rstrip("/"), key, schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def read(self) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        empty = self.spark.createDataFrame([], self.schema)
        log = self.spark.read.schema(f"{self.schema}, __v int, __gone boolean").parquet(*[f"{self.root}/v-{v}" for v in have])
        rest = [c for c in empty.columns if c not in self.key]
        last = log.groupBy(*self.key).agg(F.max_by(F.struct("__gone", *rest), "__v").alias("s"))
        return last.where("NOT s.__gone").select(*self.key, *[f"s.{c}" for c in rest]).select(*empty.columns)

    def _write(self, change: DataFrame, gone: bool) -> int:
        have = self.versions()
        v = max(have, default=0) + 1
        row = change.withColumns({"__v": F.lit(v), "__gone": F.lit(gone)})
        if len(have) >= self.KEEP:
            rest = self.read().join(change.select(*self.key), self.key, "left_anti").withColumns({"__v": F.lit(v), "__gone": F.lit(False)})
            row = rest if gone else rest.unionByName(row)
        row.write.mode("overwrite").parquet(f"{self.root}/v-{v}")
        if len(have) >= self.KEEP:
            for x in have:
                self._fs.delete(self._path(f"{self.root}/v-{x}"), True)
        return v

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those with the same key; of several new ones with one key the greatest holds."""
        cols = self.spark.createDataFrame([], self.schema).columns
        rest = [c for c in cols if c not in self.key]
        return self._write(rows.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("s")).select(*self.key, "s.*").select(*cols), False)

    def remove(self, keys: DataFrame) -> int:
        empty = self.spark.createDataFrame([], self.schema)
        return self._write(keys.select(*self.key).distinct().select(*[F.col(c) if c in self.key else F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in empty.columns]), True)

    def reset(self) -> None:
        self._fs.delete(self._path(self.root), True)


def new_run_id(now: float | None = None) -> str:
    """scan-<seconds>-<nanoseconds>."""
    ns = time.time_ns() if now is None else round(now * 1e9)
    return f"scan-{ns // 10**9}-{ns % 10**9}"


def rfc3339(c: str | Column) -> Column:
    """The instant that an RFC 3339 text names; null for anything else, a missing offset included."""
    t = F.col(c) if isinstance(c, str) else c
    ok = t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(F.upper(t), r"(\.\d{6})\d+", "$1")))


class ScanStore:
    """Resumable scans: a run that didn't finish is taken up again, a finished one is followed by a new one."""

    RUNS = "scope_key string, run_id string, files_seen bigint, bytes_seen bigint, status string, updated_at timestamp"
    ENTRIES = "scope_key string, source_path string, run_id string, file_size_bytes bigint, modified_at timestamp, updated_at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.runs = StateStore(spark, f"{root}/runs", ["scope_key"], self.RUNS)
        self.entries = StateStore(spark, f"{root}/entries", ["scope_key", "source_path"], self.ENTRIES)

    def run(self, scope: str):
        return self.runs.read().where(F.col("scope_key") == scope).head()

    def start(self, scope: str, run_id: str | None = None, reuse: bool = False) -> str:
        """The run to go on with: the unfinished one; with ``reuse`` a complete one, whose entries then stand for a new walk; else a new one."""
        have = self.run(scope)
        if have and (have.status == "scanning" or (reuse and have.status == "complete")):
            return have.run_id
        run_id = run_id or new_run_id()
        self._put(scope, run_id, 0, 0, "scanning")
        return run_id

    def reusable(self, scope: str) -> DataFrame | None:
        """The entries of the scope's complete run, None without one."""
        have = self.run(scope)
        return self.list(scope) if have and have.status == "complete" else None

    def list(self, scope: str) -> DataFrame:
        """The entries of the scope's run."""
        r = self.run(scope)
        return self.entries.read().where((F.col("scope_key") == scope) & (F.col("run_id") == (r.run_id if r else "")))

    def record(self, scope: str, files: DataFrame) -> None:
        """Add files ``(source_path, file_size_bytes, modified_at)`` to the scope's run; costs what is added."""
        r = self.run(scope)
        self.entries.upsert(files.select(F.lit(scope).alias("scope_key"), "source_path", F.lit(r.run_id).alias("run_id"), "file_size_bytes", "modified_at", F.current_timestamp().alias("updated_at")))

    def count(self, scope: str) -> tuple[int, int]:
        """Files and bytes seen by the scope's run; the run's counters follow."""
        r = self.run(scope)
        n = self.list(scope).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("b")).head()
        self._put(scope, r.run_id, n.n, n.b, r.status)
        return n.n, n.b

    def finish(self, scope: str) -> None:
        """Entries of older runs are dropped, the counters are set, the run is complete."""
        r = self.run(scope)
        stale = self.entries.read().where((F.col("scope_key") == scope) & (F.col("run_id") != r.run_id))
        self.entries.remove(stale)
        n, b = self.count(scope)
        self._put(scope, r.run_id, n, b, "complete")

    def _put(self, scope: str, run_id: str, files: int, size: int, status: str) -> None:
        row = self.spark.range(1).select(F.lit(scope).alias("scope_key"), F.lit(run_id).alias("run_id"), F.lit(files).cast("bigint").alias("files_seen"), F.lit(size).cast("bigint").alias("bytes_seen"), F.lit(status).alias("status"), F.current_timestamp().alias("updated_at"))
        self.runs.upsert(row)
