"""Ingestion as a stream: new files once each, chunks and index rows appended together per batch."""

from __future__ import annotations

import signal
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscle.operators import bm25, chunking


def read(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)


def ingest(docs: DataFrame, id_col: str, text: str, out: str, size: int = 512, overlap: int = 128):
    """A query that takes what is there and ends: chunks and postings of each batch go to ``out``.

    A batch's output lies in folders of its number and is overwritten if the batch is repeated, so a restart
    after a failure neither loses nor doubles rows.
    """

    def write(batch: DataFrame, n: int) -> None:
        b = batch.persist()
        chunking.chunk(b, id_col, text, size, overlap).write.mode("overwrite").parquet(f"{out}/chunks/batch={n}")
        i = bm25.build(b, id_col, text)
        i.postings.write.mode("overwrite").parquet(f"{out}/postings/batch={n}")
        i.doc_stats.write.mode("overwrite").parquet(f"{out}/doc_stats/batch={n}")
        b.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


class Shutdown:
    """A flag that a signal sets; streams end after the batch they are at, and loops can ask ``asked``."""

    def __init__(self, spark: SparkSession, *signals: int):
        self.spark, self.asked = spark, False
        for s in signals:
            signal.signal(s, self.ask)

    def ask(self, *_: object) -> None:
        self.asked = True

    def settle(self, seconds: float = 60.0) -> None:
        """If asked, stop the session's streams, each once no batch is running or the time is over."""
        end = time.time() + seconds
        for q in self.spark.streams.active if self.asked else ():
            while q.isActive and q.status["isTriggerActive"] and time.time() < end:
                time.sleep(0.05)
            q.stop()


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """``(key, start, n, total)`` per window of event time; late events are waited for."""
    e = events.withColumn("__t", F.col(time).cast("timestamp"))
    return e.withWatermark("__t", late).groupBy(F.window("__t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


KEEP = 16


def latest_by_key(events: DataFrame, key: str, order: str, out: str):
    """Keep the newest row of each key below ``out`` while events stream in.

    A batch writes its own newest rows only; every ``KEEP`` batches the earlier ones are taken over, so reading costs a
    bounded number of versions. A repeated batch overwrites its own folder.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        rows = batch
        if n and n % KEEP == 0:
            rows = rows.unionByName(_read_batches(spark, out, range(max(0, n - KEEP), n)).select(*batch.columns))
        newest_by(rows, key, order).withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batches/b-{n}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def newest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; ties by the other columns."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("s")).select(key, "s.*").select(*rows.columns)


def _read_batches(spark: SparkSession, out: str, numbers) -> DataFrame:
    return spark.read.parquet(*[f"{out}/batches/b-{n}" for n in numbers])


def read_latest(spark: SparkSession, out: str, key: str | None = None, order: str | None = None) -> DataFrame:
    """What ``latest_by_key`` keeps: the newest row of each key since the last take-over. Key and order are the first two columns unless given."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batches")
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    have = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(file) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    first = max((n for n in have if n % KEEP == 0), default=0)
    rows = _read_batches(spark, out, [n for n in have if n >= first]).drop("__batch")
    return newest_by(rows, key or rows.columns[0], order or rows.columns[1])
