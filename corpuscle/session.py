"""Session helpers: settings, table access, lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpuscle.errors import ConfigError

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName("corpuscle")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one below the warehouse where that is unset in local mode (tests). On a cluster it must be set."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").removeprefix("file:")
        d = os.path.join(base, "checkpoints")
    sc.setCheckpointDir(d)
    return d


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, removed when the session's process ends."""
    at = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder, so a lost executor costs a read, not a recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
