"""Search over an indexed corpus: by words, by vector or by both, with filters, reranking and diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.config import Config
from corpuscle.errors import QueryError
from corpuscle.operators import bm25, dense, fusion
from corpuscle.operators.models import Embedder


@dataclass
class Retriever:
    """``points(id, embedding, text, source, ...)`` with their lexical index; the index's doc_id is the points' id."""

    points: DataFrame
    index: bm25.Index
    embedder: Embedder
    config: Config = Config()

    def _allowed(self, source: str | None, author: str | None, since: str | None, until: str | None) -> Column | None:
        return dense.all_of(dense.source_filter(source), F.col("author_email") == author if author else None, dense.time_filter(since, until))

    def legs(self, query: str, k: int, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The best k of each leg; filters hold for both."""
        v = dense.top_k(self.points, self.embedder.embed([query])[0].tolist(), k, where=where).select(F.col("id").alias("doc_id"), "score")
        ok = None if where is None else self.points.where(where).select(F.col("id").alias("doc_id"))
        return v, bm25.search(self.index, query, k, allowed=ok)

    def search(self, query: str, mode: str | None = None, top_k: int | None = None, source: str | None = None, author: str | None = None, since: str | None = None, until: str | None = None, newest_first: bool = False, relevance: Callable[[str], Callable[[Column], Column]] | None = None) -> DataFrame:
        """``(doc_id, score, text, source, citation)``, best first; with ``newest_first`` the found ones by commit time."""
        c, mode = self.config, mode or self.config.mode
        if not query.strip():
            raise QueryError("the query is empty")
        k = top_k or c.top_k
        initial = k * (3 if c.rerank else 1)
        where = self._allowed(source, author, since, until)
        v, b = self.legs(query, 2 * initial if mode == "hybrid" else initial, where)
        if mode == "vector":
            hits = v
        elif mode == "bm25":
            hits = b
        elif mode == "hybrid":
            fuse = fusion.adaptive(v, b, c.vector_weight, c.bm25_weight, initial, c.adaptive_threshold, (c.low_vector_weight, c.low_bm25_weight)) if c.adaptive else fusion.weighted(v, b, c.vector_weight, c.bm25_weight, initial)
            hits = fuse.select("doc_id", "score")
        else:
            raise QueryError(f"no such mode: {mode}")
        full = fusion.hydrate(hits, self.points, "id", "text", "source")
        if c.rerank:
            full = fusion.rerank(full, "text", (relevance or fusion.lexical_relevance)(query), min(c.rerank_top_k, initial))
        else:
            full = full.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)
        if newest_first:
            times = self.points.select(F.col("id").alias("doc_id"), "commit_time")
            full = full.join(times, "doc_id", "left").orderBy(F.desc_nulls_last("commit_time"), "doc_id")
        return full

    def explain(self, query: str, k: int = 20) -> DataFrame:
        """One row: how the legs overlap and how sure the vector leg is."""
        v, b = self.legs(query, k)
        best = v.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best_vector_score"))
        return fusion.overlap(v, b).crossJoin(best).withColumn("low_confidence", F.col("best_vector_score") < self.config.adaptive_threshold)

    def verify(self, least: float = 0.99) -> DataFrame:
        """``id, cosine`` of the points whose stored vector isn't that of their text."""
        from corpuscle.functions import vectors as V
        from corpuscle.operators.models import embedding

        fresh = self.points.withColumn("fresh", embedding("text", self.embedder))
        return fresh.select("id", V.cosine("embedding", "fresh").alias("cosine")).where(F.col("cosine") < least)

