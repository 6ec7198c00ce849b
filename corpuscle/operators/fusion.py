"""One result list from a vector and a lexical leg, with texts, reranking and rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import display as D
from corpuscle.functions import text as T
from corpuscle.functions import vectors as V



def normalized(leg: DataFrame, score: str = "score") -> DataFrame:
    """The leg with its scores between 0 and 1. A leg is a search's result and bounded by its limit, so it may be gathered in one place."""
    all_ = Window.partitionBy(F.lit(1))
    return leg.withColumn("norm", V.minmax(F.col(score), F.min(score).over(all_), F.max(score).over(all_)))


def joined(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Full outer join of two legs ``(doc_id, score)``, each with its normalised score and rank."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.asc("doc_id"))
    a = normalized(vector).withColumn("r", F.row_number().over(w)).select("doc_id", F.col("score").alias("vs"), F.col("norm").alias("vn"), F.col("r").alias("vr"))
    b = normalized(lexical).withColumn("r", F.row_number().over(w)).select("doc_id", F.col("score").alias("bs"), F.col("norm").alias("bn"), F.col("r").alias("br"))
    return a.join(b, "doc_id", "full_outer")


def _top(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def weighted(vector: DataFrame, lexical: DataFrame, wv: float | Column, wb: float | Column, k: int) -> DataFrame:
    """``(doc_id, score, vector_score, bm25_score)``; a missing leg adds nothing, scores not above 0 are not shown."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    shown = lambda c: F.when(F.col(c) > 0, F.col(c))
    j = joined(vector, lexical).withColumn("score", lit(wv) * F.coalesce("vn", F.lit(0.0)) + lit(wb) * F.coalesce("bn", F.lit(0.0)))
    return _top(j.select("doc_id", "score", shown("vs").alias("vector_score"), shown("bs").alias("bm25_score")), k)


def adaptive(vector: DataFrame, lexical: DataFrame, wv: float, wb: float, k: int, threshold: float = 0.65, low: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """As ``weighted``, but by the low weights where the best vector score is below the threshold."""
    best = vector.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"))
    j = joined(vector, lexical).crossJoin(F.broadcast(best))
    sure = F.col("best") >= threshold
    s = F.when(sure, wv).otherwise(low[0]) * F.coalesce("vn", F.lit(0.0)) + F.when(sure, wb).otherwise(low[1]) * F.coalesce("bn", F.lit(0.0))
    shown = lambda c: F.when(F.col(c) > 0, F.col(c))
    return _top(j.select("doc_id", s.alias("score"), shown("vs").alias("vector_score"), shown("bs").alias("bm25_score")), k)


def reciprocal(vector: DataFrame, lexical: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal ranks: each leg adds 1 / (constant + rank)."""
    inv = lambda r: F.coalesce(1 / (constant + F.col(r)), F.lit(0.0))
    j = joined(vector, lexical).withColumn("score", inv("vr") + inv("br"))
    return _top(j.select("doc_id", "score", F.col("vs").alias("vector_score"), F.col("bs").alias("bm25_score")), k)


def overlap(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """One row: hits of both legs, and of each alone."""
    j = vector.select("doc_id", F.lit(True).alias("v")).join(lexical.select("doc_id", F.lit(True).alias("b")), "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("v") & F.col("b")).alias("both"), F.count_if(F.col("v") & F.col("b").isNull()).alias("vector_only"), F.count_if(F.col("v").isNull() & F.col("b")).alias("bm25_only"))


def hydrate(hits: DataFrame, docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """The hits with text, source and citation; without a document an empty text, and the id for the source."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__t"), F.col(source).alias("__s"))
    src = F.coalesce(F.nullif("__s", F.lit("")), F.col("doc_id").cast("string"))
    return hits.join(d, "doc_id", "left").withColumns({"text": F.coalesce("__t", F.lit("")), "source": src}).withColumn("citation", D.citation("source")).drop("__t", "__s")


def lexical_relevance(query: str) -> Callable[[Column], Column]:
    """A stand-in for a cross-encoder: the sigmoid of the shared share of tokens."""
    toks = F.array_distinct(T.index_tokens(F.lit(query)))

    def of(text: Column) -> Column:
        t = F.array_distinct(T.index_tokens(text))
        return V.sigmoid(F.when(F.size(F.array_union(t, toks)) > 0, F.size(F.array_intersect(t, toks)) / F.size(F.array_union(t, toks))).otherwise(0.0))

    return of


def rerank(hits: DataFrame, text: str, relevance: Callable[[Column], Column], k: int) -> DataFrame:
    """The best k hits by a model's relevance of their texts."""
    return _top(hits.withColumn("score", relevance(F.col(text))), k)


def as_json(results: DataFrame) -> DataFrame:
    """One row: all results, best first, as a JSON object."""
    row = F.struct(F.col("doc_id").cast("string").alias("id"), "score", "text", "citation", "source")
    return results.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), row.alias("r")))).alias("a")).select(F.to_json(F.struct(F.transform("a", lambda x: x["r"]).alias("results"))).alias("json"))


def as_text(results: DataFrame, width: int = 100) -> DataFrame:
    """Of each result the lines shown: rank, citation, score, and its text wrapped."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.asc("doc_id"))
    head = F.concat(F.row_number().over(w).cast("string"), F.lit(". "), F.col("citation"), F.lit(" ("), F.format_number("score", 4), F.lit(")"))
    return results.select("doc_id", F.concat(F.array(head), T.wrap("text", width), F.array(F.lit("-" * 40))).alias("lines"))
