"""Search among vectors: the nearest of a query vector, exactly; filters; fetching points by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import vectors as V
from corpuscle.errors import QueryError
from corpuscle.session import cut


def all_of(*conditions: Column | None) -> Column | None:
    """The conjunction of the given conditions; None without any."""
    have = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, have) if have else None


def source_filter(source: str | None, column: str = "source") -> Column | None:
    """The trimmed text must stand somewhere in the source; a blank one filters nothing."""
    return F.contains(F.col(column), F.lit(source.strip())) if source and source.strip() else None


def type_filter(kind: str | None, column: str = "classification") -> Column | None:
    return F.col(column) == kind.strip().lower() if kind and kind.strip() else None


def least_score(score: float | None, column: str = "score") -> Column | None:
    """Off unless a least score is given."""
    return F.col(column) >= score if score is not None else None


def time_filter(since: str | None, until: str | None, column: str = "commit_time") -> Column | None:
    """From the start of the first day to the last second of the last, both YYYY-MM-DD."""
    for d in (since, until):
        if d is not None and (len(d) != 10 or d[4] != "-" or d[7] != "-" or not d.replace("-", "").isdigit()):
            raise QueryError(f"not a date: {d}")
    return all_of(
        F.col(column) >= F.to_timestamp(F.lit(f"{since} 00:00:00")) if since else None,
        F.col(column) <= F.to_timestamp(F.lit(f"{until} 23:59:59")) if until else None,
    )


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """``(id, score)`` of the nearest k by cosine, ties by id; the query's length is divided out once."""
    v = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return v.select(F.col(id_col).alias("id"), V.cosine(vector, q).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


#: Query vectors that are sent to the vectors at once.
BLOCK = 4096


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, query_id: str, query_vector: str, block: int = BLOCK) -> DataFrame:
    """``(query_id, id, score, rank)`` of each query's nearest k, exactly.

    The queries are a stated set and go to the vectors in blocks of about ``block``, so what is broadcast is
    bounded; each partition keeps only its own best k of each query before anything is shuffled.
    """
    q = queries.select(F.col(query_id).alias("query_id"), V.unit(query_vector).alias("qv"))
    v = vectors.select(F.col(id_col).alias("id"), V.unit(vector).alias("v"))
    n = -(-queries.count() // block) or 1
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("id"))
    out = None
    for b in range(n):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        s = v.crossJoin(F.broadcast(part)).select("query_id", "id", V.dot("v", "qv").alias("score"))
        best = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        best = best if n == 1 else cut(best)  # one block's plan at a time, however many blocks there are
        out = best if out is None else out.unionByName(best)
    return out


def points(vectors: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The wanted ids with their rows, null where there is none."""
    return ids.select(F.col(ids.columns[0]).alias(id_col)).distinct().join(vectors, id_col, "left")


def mean_pool(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, centroid)``: the mean of each group's vectors at length 1."""
    m = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return c.select(group, V.unit("c").alias("centroid"))
