"""Lexical index and BM25 scores: three flat tables, joined by term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.errors import QueryError
from corpuscle.session import cut

K1, B = 1.5, 0.75


@dataclass
class Index:
    """postings(term, doc_id, tf, dl), doc_stats(doc_id, doc_length), and the corpus's one row (num_docs, avg_doc_length).

    A posting carries its document's length, so scores need no join with the documents.
    """

    postings: DataFrame
    doc_stats: DataFrame

    @property
    def corpus(self) -> DataFrame:
        return self.doc_stats.agg(F.count(F.lit(1)).alias("num_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"))

    def term_stats(self) -> DataFrame:
        """``(term, df, cf)``: documents with the term, and its occurrences."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def without(self, ids: DataFrame, id_col: str = "doc_id") -> Index:
        """The index after removal of documents; terms that only they had are gone with them."""
        gone = ids.select(F.col(id_col).alias("doc_id")).distinct()
        return Index(self.postings.join(gone, "doc_id", "left_anti"), self.doc_stats.join(gone, "doc_id", "left_anti"))

    def plus(self, other: Index) -> Index:
        """The index with another's documents; those replace documents of the same id."""
        kept = self.without(other.doc_stats)
        return Index(kept.postings.unionByName(other.postings), kept.doc_stats.unionByName(other.doc_stats))

    def term_freq(self, pairs: DataFrame) -> DataFrame:
        """``(term, doc_id, tf)`` of the wanted pairs, 0 where the document lacks the term."""
        return pairs.select("term", "doc_id").distinct().join(self.postings, ["term", "doc_id"], "left").select("term", "doc_id", F.coalesce("tf", F.lit(0)).alias("tf"))

    def doc_length(self, ids: DataFrame) -> DataFrame:
        """``(doc_id, doc_length)`` of the wanted documents, 0 for unknown ones."""
        return ids.select("doc_id").distinct().join(self.doc_stats, "doc_id", "left").select("doc_id", F.coalesce("doc_length", F.lit(0)).alias("doc_length"))

    def doc_ids(self) -> DataFrame:
        return self.doc_stats.select("doc_id")

    def save(self, path: str) -> None:
        """A new version beside the old one, which is dropped once the new one is whole: a crash leaves one of them.

        Postings lie sorted by term, so a query reads only the row groups of its terms.
        """
        old = _version(self.postings.sparkSession, path)
        at = f"{path}/v-{old + 1}"
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{at}/postings")
        self.doc_stats.write.mode("overwrite").parquet(f"{at}/doc_stats")
        fs, file = _files(self.postings.sparkSession, path)
        fs.create(file(f"{at}/_DONE"), True).close()
        if old:
            fs.delete(file(f"{path}/v-{old}"), True)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """The index saved last; an empty one where nothing was saved."""
        v = _version(spark, path)
        if not v:
            return Index(spark.createDataFrame([], "term string, doc_id string, tf int, dl int"), spark.createDataFrame([], "doc_id string, doc_length int"))
        return Index(spark.read.parquet(f"{path}/v-{v}/postings"), spark.read.parquet(f"{path}/v-{v}/doc_stats"))


def _files(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path
    return file(path).getFileSystem(spark._jsc.hadoopConfiguration()), file


def _version(spark: SparkSession, path: str) -> int:
    fs, file = _files(spark, path)
    if not fs.exists(file(path)):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(file(path))]
    return max((int(n[2:]) for n in names if n.startswith("v-") and fs.exists(file(f"{path}/{n}/_DONE"))), default=0)


def build(docs: DataFrame, id_col: str, text: str) -> Index:
    """Documents without tokens count in the statistics; null texts are empty."""
    t = docs.select(F.col(id_col).alias("doc_id"), T.index_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    postings = t.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return Index(postings.select("term", "doc_id", "tf", "dl"), t.select("doc_id", F.size("tokens").alias("doc_length")))


def score(tf, df, dl, n, avg, k1: float = K1, b: float = B):
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))


def search_batch(index: Index, queries: DataFrame, query_id: str, text: str, k: int, k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best k documents of each query; a term named twice counts twice.

    Only the queries' terms are joined; document frequencies are counted for those terms alone. With ``allowed``
    (doc_id) only its documents are ranked, by the whole corpus's statistics. A query's hits are limited in each
    partition before they are shuffled.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(T.index_tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = q.select("term").distinct()
    hit = cut(index.postings.join(terms, "term", "left_semi"))  # read for frequencies and for scores, made once
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = (
        hit.join(df, "term").join(q, "term").crossJoin(F.broadcast(index.corpus))
        .groupBy("query_id", "doc_id")
        .agg(F.sum(score(F.col("tf"), F.col("df"), F.col("dl"), F.col("num_docs"), F.col("avg_doc_length"), k1, b) * F.col("qtf")).alias("score"))
        .where("score > 0")
    )
    if allowed is not None:
        scored = scored.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, query: str, k: int, k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> DataFrame:
    """``(doc_id, score)`` of the best k documents; none for a query without tokens."""
    if not query.strip():
        raise QueryError("the query is empty")
    spark = index.postings.sparkSession
    q = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"))
    return search_batch(index, q, "query_id", "text", k, k1, b, allowed).select("doc_id", "score").orderBy(F.desc(F.round("score", 9)), "doc_id")
