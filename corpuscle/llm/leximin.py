"""One ranking from several differently-scaled scores: leximin over percentiles.

Each leg's scores become percentiles among the query's hits of that leg (share of those hits scored no
higher, so the best has 1.0); a leg that lacks the hit gives 0. A hit's percentiles sorted ascending form its
vector, and vectors are compared lexicographically, larger first: the weaker leg decides, the stronger breaks
ties, so no strong score masks a weak one and no leg's range counts.

Percentiles are exact for a query of any size. Equal scores are counted before anything is ranked; a query's
distinct scores are spread over buckets cut at its approximate quantiles; only the few bucket totals are
summed per query, and ranks within a bucket are counted where the bucket lies. The top hits come from a
rank limit that Spark also applies before the shuffle.

Defined results: repeated rows count once; of several rows of one hit each leg's highest score holds; NaN
scores count as missing; rows without query or item are dropped; a hit missing in all legs ranks last; ties
in all percentiles go to the smaller item id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def percentiles(hits: DataFrame, query: str, item: str, legs: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``(query, item, p)`` with p an array of one percentile per leg, 0.0 where the leg has no score."""
    one = hits.where(F.col(query).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(query).alias("q"), F.col(item).alias("i")).agg(
        *[F.max(F.when(~F.isnan(c), F.col(c))).alias(f"s{k}") for k, c in enumerate(legs)])
    long = one.select("q", "i", F.posexplode(F.array(*[F.col(f"s{k}").cast("double") for k in range(len(legs))])).alias("leg", "v"))
    scored = long.where("v IS NOT NULL")
    counts = scored.groupBy("q", "leg", "v").agg(F.count(F.lit(1)).alias("c"))
    cuts = counts.groupBy("q", "leg").agg(F.percentile_approx("v", [(k + 1) / buckets for k in range(buckets - 1)], buckets * 8).alias("cuts"), F.sum("c").alias("n"))
    placed = counts.join(cuts, ["q", "leg"]).withColumn("b", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    totals = placed.groupBy("q", "leg", "b").agg(F.sum("c").alias("t"))
    before = totals.withColumn("off", F.sum("t").over(Window.partitionBy("q", "leg").orderBy("b")) - F.col("t")).drop("t")
    within = F.sum("c").over(Window.partitionBy("q", "leg", "b").orderBy("v"))
    pct = placed.join(before, ["q", "leg", "b"]).select("q", "leg", "v", ((F.col("off") + within) / F.col("n")).alias("p"))
    # Only scores are joined: hits that lack a leg, which may be most of a query's, bring their 0 along.
    have = scored.join(pct, ["q", "leg", "v"]).select("q", "i", "leg", "p")
    lack = one.where(" OR ".join(f"s{k} IS NULL" for k in range(len(legs)))).select("q", "i", F.lit(0).alias("leg"), F.lit(0.0).alias("p"))
    got = have.unionByName(lack).groupBy("q", "i").agg(*[F.coalesce(F.max(F.when(F.col("leg") == k, F.col("p"))), F.lit(0.0)).alias(f"p{k}") for k in range(len(legs))])
    return got.select(F.col("q").alias(query), F.col("i").alias(item), F.array(*[f"p{k}" for k in range(len(legs))]).alias("p"))


def ranked(hits: DataFrame, query: str, item: str, legs: list[str], top: int | None = None) -> DataFrame:
    """``(query, item, vector, rank)``: the leximin ranking of each query, or its first ``top`` hits."""
    v = percentiles(hits, query, item, legs).withColumn("vector", F.sort_array("p")).drop("p")
    w = Window.partitionBy(query).orderBy(F.desc("vector"), F.asc(item))
    r = v.withColumn("rank", F.row_number().over(w))
    return r if top is None else r.where(F.col("rank") <= top)


def ranked_by_sql(hits: str, query: str, item: str, legs: list[str], top: int) -> str:
    """The same first ``top`` hits as SQL."""
    best = ", ".join(f"max({c}) AS s{k}" for k, c in enumerate(legs))
    pct = ", ".join(f"CASE WHEN s{k} IS NULL THEN 0.0 ELSE (count(s{k}) OVER (PARTITION BY q ORDER BY s{k} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / count(s{k}) OVER (PARTITION BY q) END AS p{k}" for k in range(len(legs)))
    arr = "list_sort([" + ", ".join(f"p{k}" for k in range(len(legs))) + "])"
    return f"""
WITH one AS (SELECT {query} AS q, {item} AS i, {best} FROM {hits} WHERE {query} IS NOT NULL AND {item} IS NOT NULL GROUP BY 1, 2),
p AS (SELECT q, i, {pct} FROM one),
v AS (SELECT q, i, {arr} AS v FROM p)
SELECT q AS {query}, i AS {item} FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY v DESC, i) <= {top}"""
