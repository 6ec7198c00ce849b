"""Bringing a corpus up to date: new and changed documents are chunked, embedded and indexed in one published version."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.config import Config
from corpuscle.operators import bm25, chunking
from corpuscle.operators.incremental import MerkleSync
from corpuscle.operators.models import Embedder, embedding

POINT = "id string, source string, chunk_index int, total_chunks int, text string, embedding array<float>"


def attempt(write: Callable[[], object], attempts: int = 4, wait: float = 0.1) -> object:
    """Call ``write`` until it succeeds, waiting twice as long after each failure; the last failure is raised."""
    for k in range(attempts):
        try:
            return write()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("no attempts")


class Corpus:
    """``root/sync`` holds what was processed when, each version with the points of the documents it changed.

    A document's newest version replaces its older points and postings; those of documents that are gone from the
    source are left out. Output and state are one version, so a run that breaks off is simply done again. Once points
    lie in ``KEEP`` versions the next one takes all current ones over, and the older outputs are dropped.
    """

    KEEP = 16

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, config: Config = Config()):
        self.spark, self.embedder, self.config = spark, embedder, config
        self.sync = MerkleSync(spark, f"{root}/sync", "source_path", ["file_hash"])

    def points_of(self, docs: DataFrame) -> DataFrame:
        """``POINT`` columns; documents without words give one row with null text, which marks them done."""
        c = chunking.chunk(docs.where("content IS NOT NULL"), "source_path", "content", self.config.chunk_size, self.config.chunk_overlap)
        p = c.select("id", F.col("document_id").alias("source"), "chunk_index", "total_chunks", F.col("content").alias("text"))
        rest = docs.select(F.col("source_path").alias("source")).join(p.select("source").distinct(), "source", "left_anti")
        none = rest.select(F.lit(None).cast("string").alias("id"), "source", F.lit(0).alias("chunk_index"), F.lit(0).alias("total_chunks"), F.lit(None).cast("string").alias("text"))
        return p.unionByName(none).withColumn("embedding", embedding("text", self.embedder, self.config.embedding_batch_size))

    def _outputs(self) -> list[int]:
        store = self.sync.store
        return [v for v in self.sync.versions() if store._fs.exists(store._path(f"{store.dir(v)}/output"))]

    def update(self, docs: DataFrame) -> int:
        """Process what is new or changed in ``docs(source_path, file_hash, content)``; gives the version."""
        old = self._outputs()
        if len(old) < self.KEEP:
            return attempt(lambda: self.sync.run(docs, self.points_of))
        kept = self._newest(docs.select(F.col("source_path").alias("source")).distinct())

        def all_points(changed: DataFrame) -> DataFrame:
            return self.points_of(changed).unionByName(kept.join(changed.select(F.col("source_path").alias("source")), "source", "left_anti"))

        v = attempt(lambda: self.sync.run(docs, all_points))
        for x in old:
            self.sync.store._fs.delete(self.sync.store._path(f"{self.sync.store.dir(x)}/output"), True)
        return v

    def _newest(self, here: DataFrame) -> DataFrame:
        """The newest points of these documents, with the rows that only mark a document done."""
        out = None
        for v in self._outputs():
            part = self.sync.output(v).withColumn("__v", F.lit(v))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], POINT)
        newest = out.groupBy("source").agg(F.max("__v").alias("__v"))
        return out.join(newest, ["source", "__v"], "left_semi").join(here, "source", "left_semi").drop("__v")

    def points(self) -> DataFrame:
        """The current points: of each document those of its newest version."""
        if not self.sync.versions():
            return self.spark.createDataFrame([], POINT)
        return self._newest(self.sync.store.current().select(F.col("key").alias("source"))).where("text IS NOT NULL")

    def index(self) -> bm25.Index:
        return bm25.build(self.points(), "id", "text")


def upsert(points: DataFrame, files: DataFrame, write: Callable[[DataFrame], object], at=None, attempts: int = 4, wait: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Write points with retries; ``(state, failures)`` rows of ``files(source_path, file_hash, file_size_bytes, modified_at)``.

    If a write succeeds its files are completed with the number of their points, and earlier failures no longer hold;
    if the last attempt fails they are failed, each with the reason.
    """
    at = F.current_timestamp() if at is None else at
    try:
        attempt(lambda: write(points), attempts, wait)
        error = None
    except Exception as e:
        error = str(e).splitlines()[0][:500] if str(e) else type(e).__name__
    n = points.groupBy(F.col("source").alias("source_path")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    cols = ["source_path", "file_hash", "file_size_bytes", "modified_at"]
    count = F.coalesce("chunk_count", F.lit(0)) if error is None else F.lit(0)
    state = files.join(n, "source_path", "left").select(*cols, at.alias("processed_at"), count.alias("chunk_count"), F.lit("completed" if error is None else "failed").alias("status"), F.lit(error).cast("string").alias("error"))
    failures = files.where(F.lit(error is not None)).select(*cols, at.alias("failed_at"), F.lit(error).cast("string").alias("reason"))
    return state, failures
