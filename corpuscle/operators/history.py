"""A corpus of commits: their chunks with all that is known of each commit, kept by repository, searched and shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import classify as C
from corpuscle.functions import display as D
from corpuscle.functions import text as T
from corpuscle.operators import bm25, commits, dense
from corpuscle.operators.models import Embedder, embedding

#: Columns that a point of a commit carries beside its id and vector.
PAYLOAD = "text commit_hash repository_name repository_path chunk_type chunk_index total_chunks author_name author_email committer_name committer_email commit_time classification files_changed_count insertions deletions file_paths".split()
METADATA = "commit_hash author_name author_email commit_time classification insertions deletions repository_name".split()


def points(found: DataFrame, strategy: str = "summary", size: int = 512, overlap: int = 128) -> DataFrame:
    """``(id, PAYLOAD..)`` of the chunks of commits ``(id, repository_path, message, author_name, author_email, commit_time, diff_text)``.

    A commit without a committer of its own was committed by its author. The id is made from repository, hash and chunk.
    """
    c = found.withColumns({k: F.col(k) if k in found.columns else F.col(k.replace("committer", "author")) for k in ("committer_name", "committer_email")})
    c = c.withColumns({"repository_name": D.basename("repository_path"), "classification": C.commit_type("message")})
    c = c.join(commits.diff_stats(c, "id", "diff_text"), "id")
    parts = commits.chunks(c, strategy, size, overlap).select("id", "chunk_type", "chunk_index", "total_chunks", F.col("content").alias("text"))
    all_ = parts.join(c.drop("message", "diff_text"), "id").withColumnsRenamed({"id": "commit_hash", "files_changed": "files_changed_count"})
    return all_.select(F.sha2(F.concat_ws("#", "repository_path", "commit_hash", "chunk_index"), 256).alias("id"), *PAYLOAD)


def write(points_: DataFrame, path: str, embedder: Embedder | None = None, batch: int = 32) -> None:
    """Upsert points: the repositories' commits among them are replaced, others stay. Partitioned by repository, so only theirs are rewritten."""
    spark = points_.sparkSession
    p = points_ if embedder is None else points_.withColumn("embedding", embedding("text", embedder, batch))
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(file):
        names = p.select("repository_name").distinct()
        old = spark.read.parquet(path).join(F.broadcast(names), "repository_name", "left_semi").join(p.select("repository_path", "commit_hash").distinct(), ["repository_path", "commit_hash"], "left_anti")
        from corpuscle.session import cut

        p = cut(p.unionByName(old.select(*p.columns)))
    p.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_name").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def condition(kind: str | None = None, author: str | None = None, repository: str | None = None, since: str | None = None, until: str | None = None) -> Column | None:
    """All given filters: type and author are equal, the repository's path holds the text, times are whole days."""
    return dense.all_of(dense.type_filter(kind), F.col("author_email") == author if author else None, dense.source_filter(repository, "repository_path"), dense.time_filter(since, until))


def search(points_: DataFrame, query: str, k: int, where: Column | None = None, least: float | None = None) -> DataFrame:
    """``(id, score, text, metadata)``: the best k chunks by words, by the statistics of all."""
    allowed = None if where is None else points_.where(where).select(F.col("id").alias("doc_id"))
    hits = bm25.search(bm25.build(points_, "id", "text"), query, k, allowed=allowed)
    keep = dense.least_score(least)
    hits = (hits if keep is None else hits.where(keep)).withColumnRenamed("doc_id", "id")
    return hits.join(points_, "id").select("id", "score", "text", metadata().alias("metadata")).orderBy(F.desc(F.round("score", 9)), "id")


def newest_first(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.desc_nulls_last(F.col("metadata")["commit_time"]), "id")


def metadata() -> Column:
    """What a result tells of its commit, as a map of texts; paths joined, missing values left out."""
    pairs = [F.struct(F.lit(c).alias("key"), (F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX") if c == "commit_time" else F.col(c).cast("string")).alias("value")) for c in METADATA]
    files = F.struct(F.lit("file_paths").alias("key"), F.nullif(F.array_join("file_paths", ", "), F.lit("")).alias("value"))
    return F.map_from_entries(F.filter(F.array(*pairs, files), lambda x: x["value"].isNotNull()))


def payload_text(value: Column) -> Column:
    """A value of any kind (a variant) as text: strings, numbers and truth values; null for anything else."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*|BOOLEAN)$"), F.try_variant_get(value, "$", "string"))


def as_text(hits: DataFrame, width: int = 100) -> DataFrame:
    """``(id, lines)``: what is shown of each commit found."""
    m = lambda k, none: F.coalesce(F.col("metadata")[k], F.lit(none))
    wrapped = T.wrap("text", width)
    body = F.when(F.size(wrapped) > 0, F.transform(wrapped, lambda l: F.concat(F.lit("  "), l))).otherwise(F.array(F.lit("  [empty]")))
    files = F.when(m("file_paths", "") != "", F.array(F.concat(F.lit("files: "), m("file_paths", "")))).otherwise(F.array().cast("array<string>"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("score", 9)), F.asc("id"))  # hits are bounded by the search's limit
    head = F.array(
        F.concat(F.lit("result "), F.row_number().over(w).cast("string")),
        F.concat(F.lit("score: "), F.format_string("%.4f", "score")),
        F.concat(F.lit("["), F.when(F.col("metadata")["commit_hash"].isNull(), "unknown").otherwise(F.substring(F.col("metadata")["commit_hash"], 1, 7)), F.lit("] "), m("classification", "unknown"), F.lit(": "), D.first_line("text")),
        F.concat(F.lit("repository: "), m("repository_name", "unknown")),
        F.concat(F.lit("author: "), m("author_name", "unknown"), F.lit(" <"), m("author_email", ""), F.lit(">")),
        F.concat(F.lit("date: "), m("commit_time", "unknown")),
    )
    changes = F.array(F.concat(F.lit("changes: +"), m("insertions", "0"), F.lit(" -"), m("deletions", "0")), F.lit(""), F.lit("message:"))
    return hits.select("id", F.concat(head, files, changes, body, F.array(F.lit("-" * 40))).alias("lines"))
