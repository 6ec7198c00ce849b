"""Queries of the training-data operators, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import ball, forest, handwritten, leak, leximin, ocr, secrets, subject, tokens
from corpuscle.session import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.noise(table(spark, d, "pdf_lines"))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every document with scanned lines."""
    return ocr.repaired(table(spark, d, "pdf_lines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = cut(secrets.in_documents(table(spark, d, "source_documents"), "id", "content", "source_path", with_values=True))
    chunks = secrets.in_chunks(table(spark, d, "chunks"), "id", "content", "document_id", found)
    lines = found.select(F.col("id").alias("record_id"), "line_no").distinct()
    return lines.unionByName(chunks.select(F.col("id").alias("record_id"), F.lit(1).alias("line_no")))


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its credentials masked."""
    return secrets.masked(table(spark, d, "source_documents").select("id", "source_path", "content"), "content", "source_path").select("id", "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return leximin.ranked(table(spark, d, "fused_results"), "query_id", "doc_id", ["vector_score", "bm25_score"], 5).select("query_id", "doc_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.neighbour_pairs(forest.neighbours(table(spark, d, "chunks"), "id", "embedding", 64, 5, 0.90))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "source_documents"), "id", "source_path", "content")


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each kind there are, and how many of them bear no mark of it."""
    return handwritten.composition(table(spark, d, "source_documents"), "id", "source_path", "content")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Three words and 0.6 are what TESTDATA sets for this query; the operator's own defaults are five and 0.8."""
    return ball.similar_pairs(table(spark, d, "chunks"), "id", "content", 3, 40, 0.6)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    names = subject.subject_names(table(spark, d, "subject_areas"))
    model = subject.train(docs, "doc_id", "text", table(spark, d, "subject_labels"), "doc_id", "subject", "annotator", names)
    return subject.subjects_of(docs, "doc_id", "text", model).select("doc_id", "subject")


QUERIES = {"p2_found": p2_found, "p2_text": p2_text, "p3_found": p3_found, "p3_masked": p3_masked, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_kinds": p6_kinds, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}
#: Every pair compared. Chunks without 64 finite numbers, or with zeros only, are left out; ties go to the smaller id.
P5_SQL = """
WITH g AS (SELECT DISTINCT id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM chunks WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[64] AS v FROM g),
c AS (SELECT a.id AS a, b.id AS b, max(array_inner_product(a.v, b.v)) AS cosine FROM u a JOIN u b ON a.id <> b.id WHERE array_inner_product(a.v, b.v) >= 0.9 - 1e-12 GROUP BY 1, 2),
n AS (SELECT a, b FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(cosine, 12) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n"""
#: Every pair that shares a run of three words counted.
P7_SQL = """
WITH w AS (SELECT id, h, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT id, content, md5(content) AS h FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL)),
r AS (SELECT DISTINCT id, h, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM w WHERE len(w) >= 40),
n AS (SELECT id, h, count(*) AS n FROM r GROUP BY 1, 2),
s AS (SELECT a.id AS a, a.h AS ha, b.id AS b, b.h AS hb, count(*) AS both FROM r a JOIN r b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2, 3, 4)
SELECT DISTINCT s.a AS id_a, s.b AS id_b FROM s JOIN n x ON x.id = s.a AND x.h = s.ha JOIN n y ON y.id = s.b AND y.h = s.hb WHERE s.both >= 0.6 * (x.n + y.n - s.both)"""

SQL = {"p4_found": leximin.ranked_by_sql("fused_results", "query_id", "doc_id", ["vector_score", "bm25_score"], 5), "p5_found": P5_SQL, "p7_found": P7_SQL}
