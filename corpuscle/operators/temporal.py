"""Times as features of vectors, and the span of time that groups cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature(rows: DataFrame, id_col: str, time: str) -> DataFrame:
    """``(id, feature)``: each row's time between the first (0) and the last (1) of all; 0.5 without a time or where all are one."""
    t = F.unix_micros(F.col(time))
    ends = rows.agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    share = (t - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0))
    return rows.crossJoin(F.broadcast(ends)).select(id_col, F.round(F.coalesce(share, F.lit(0.5)), 6).alias("feature"))


def augment(vectors: DataFrame, vector: str, features: DataFrame, id_col: str) -> DataFrame:
    """``(id, vector)``: the vectors with their feature as one more number."""
    return vectors.join(features, id_col).select(id_col, F.concat(F.transform(vector, lambda x: x.cast("double")), F.array("feature")).alias(vector))


def date_range(rows: DataFrame, group: str, time: str) -> DataFrame:
    """``(group, first, last, n)``."""
    return rows.groupBy(group).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
