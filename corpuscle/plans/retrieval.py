"""Queries of the lexical index, vectors, fusion and rendering, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import display as D
from corpuscle.functions import vectors as V
from corpuscle.operators import bm25, dense, fusion
from corpuscle.operators.models import MockEmbedder, embedding
from corpuscle.session import table

QUERY = "vaccine against infection, query index of the database"
#: The query vector of single searches: the vector with this id.
PROBE = 7


def _index(spark: SparkSession, d: str) -> bm25.Index:
    return bm25.build(table(spark, d, "documents"), "doc_id", "text")


_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) > 1)"


def _tok(c: str) -> str:
    return _TOK.format(c=c)


_IDX = f"""tok AS (SELECT doc_id, {_tok('text')} AS t FROM documents),
stats AS (SELECT doc_id, len(t) AS dl FROM tok),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY 1, 2),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats)"""
_SCORE = "sum(q.qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))"


def _bm25_sql(k: int, name: str = "hits") -> str:
    q = QUERY.replace("'", "''")
    return f"""q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_tok(f"'{q}'")}) AS term) GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
{name} AS (SELECT doc_id, {_SCORE} AS score FROM post JOIN q USING (term) JOIN df USING (term) JOIN stats USING (doc_id) CROSS JOIN corpus GROUP BY doc_id
  QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= {k})"""


def bm25_term_stats(spark, d):
    return _index(spark, d).term_stats()


def bm25_corpus_stats(spark, d):
    return _index(spark, d).corpus.select("num_docs", F.round("avg_doc_length", 6).alias("avg_doc_length"))


def bm25_topk(spark, d):
    return bm25.search(_index(spark, d), QUERY, 10).select("doc_id", F.round("score", 6).alias("score"))


def bm25_batch(spark, d):
    r = bm25.search_batch(_index(spark, d), table(spark, d, "eval_items"), "item_id", "text", 5)
    return r.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def bm25_remove_docs(spark, d):
    gone = table(spark, d, "subject_labels").select("doc_id")
    i = _index(spark, d).without(gone)
    return i.term_stats()


def _leg_v(spark, d, k=40):
    e = table(spark, d, "embeddings")
    probe = e.where(F.col("vec_id") == PROBE).select(F.col("embedding").alias("q"))
    s = e.crossJoin(F.broadcast(probe)).select(F.col("vec_id").alias("doc_id"), V.cosine("embedding", "q").alias("score"))
    return s.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def _leg_b(spark, d, k=40):
    return bm25.search(_index(spark, d), QUERY, k).limit(k)


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_VLEG = f"""vhits AS (SELECT a.vec_id AS doc_id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = {PROBE}
  QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= 40)"""


def vector_topk(spark, d):
    return _leg_v(spark, d, 10).select(F.col("doc_id").alias("vec_id"), F.round("score", 6).alias("score"))


def vector_topk_filtered(spark, d):
    e = table(spark, d, "embeddings").where(F.col("label").isin(1, 2, 3))
    probe = table(spark, d, "embeddings").where(F.col("vec_id") == PROBE).select(F.col("embedding").alias("q"))
    s = e.crossJoin(F.broadcast(probe)).select("vec_id", F.round(V.cosine("embedding", "q"), 6).alias("score"))
    return s.orderBy(F.desc("score"), "vec_id").limit(10)


def vector_batch_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    r = dense.top_k_batch(e, q, 5, "vec_id", "embedding", "q", "qe")
    return r.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"))


def unit_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.unit("embedding"), lambda x: F.round(x, 5)).alias("unit"))


def centroid_mean_pool(spark, d):
    return dense.mean_pool(table(spark, d, "embeddings"), "label", "embedding").select("label", F.transform("centroid", lambda x: F.round(x, 5)).alias("centroid"))


def points_by_id(spark, d):
    ids = table(spark, d, "eval_items").select(F.col("item_id").alias("vec_id"))
    return dense.points(table(spark, d, "embeddings").select("vec_id", "label"), ids, "vec_id")


def minmax_scores(spark, d):
    return fusion.normalized(_leg_v(spark, d)).select("doc_id", F.round("norm", 6).alias("norm"))


_R = lambda df: df.select("doc_id", *[F.round(c, 6).alias(c) for c in ("score", "vector_score", "bm25_score")])


def fusion_weighted(spark, d):
    return _R(fusion.weighted(_leg_v(spark, d), _leg_b(spark, d), 0.7, 0.3, 15))


def fusion_rrf(spark, d):
    return _R(fusion.reciprocal(_leg_v(spark, d), _leg_b(spark, d), 15))


def fusion_adaptive(spark, d):
    return _R(fusion.adaptive(_leg_v(spark, d).where("score < 0.5"), _leg_b(spark, d), 0.5, 0.5, 15))


def fusion_overlap(spark, d):
    return fusion.overlap(_leg_v(spark, d), _leg_b(spark, d))


def hydrate_hits(spark, d):
    return fusion.hydrate(_leg_b(spark, d), table(spark, d, "documents"), "doc_id", "text", "source_path").select("doc_id", F.round("score", 6).alias("score"), "text", "source", "citation")


def rerank_lexical(spark, d):
    h = fusion.hydrate(_leg_b(spark, d), table(spark, d, "documents"), "doc_id", "text", "source")
    return fusion.rerank(h, "text", fusion.lexical_relevance(QUERY), 5).select("doc_id", F.round("score", 6).alias("score"))


def source_filter(spark, d):
    return table(spark, d, "documents").where(dense.source_filter(" -notes ")).select("doc_id", "source")


def min_score(spark, d):
    return _leg_v(spark, d).where(dense.least_score(0.2)).select("doc_id", F.round("score", 6).alias("score"))


def bm25_lookups(spark, d):
    """Frequencies of the query's terms in the labelled documents, with the documents' lengths."""
    from corpuscle.functions import text as T

    i = _index(spark, d)
    ids = table(spark, d, "subject_labels").select("doc_id").distinct()
    terms = spark.range(1).select(F.explode(F.array_distinct(T.index_tokens(F.lit(QUERY)))).alias("term"))
    return i.term_freq(ids.crossJoin(F.broadcast(terms))).join(i.doc_length(ids), "doc_id")


def bm25_doc_ids(spark, d):
    return _index(spark, d).doc_ids()


def payload_text(spark, d):
    """The values of events' properties as texts, and those of some other kinds."""
    from corpuscle.operators.history import payload_text as of

    v = F.try_variant_get(F.parse_json("props"), "$.k", "variant")
    kinds = [F.parse_json(F.lit(x)) for x in ('"a b"', "12", "true", "null", "[1]", '{"k": 1}')]
    return table(spark, d, "events").select("event_id", of(v).alias("k"), *[of(x).alias(f"x{i}") for i, x in enumerate(kinds)])


def results_json(spark, d):
    h = fusion.hydrate(_leg_b(spark, d, 3), table(spark, d, "documents"), "doc_id", "text", "source").withColumn("score", F.round("score", 4))
    return fusion.as_json(h)


def results_text(spark, d):
    h = fusion.hydrate(_leg_b(spark, d, 5), table(spark, d, "documents"), "doc_id", "text", "source")
    return fusion.as_text(h)


def citation_labels(spark, d):
    s = table(spark, d, "source_documents").select("source_path", F.col("metadata.size_bytes").alias("n"))
    return s.select("source_path", D.citation("source_path").alias("citation"), D.show_source("source_path", "basename").alias("base"), D.show_source("source_path", "hash", "s").alias("hashed"), D.show_source("source_path", "redact").alias("redacted"), D.bytes_short("n").alias("size")).distinct()


def mock_embed(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.transform(V.mock_embedding("text", 4), lambda x: F.round(x, 6)).alias("v"))


def embed_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", embedding("text", MockEmbedder(4)).alias("v")).select("doc_id", F.transform("v", lambda x: F.round(x.cast("double"), 3)).alias("v"))


_FUSE = f"""WITH {_IDX}, {_bm25_sql(40, 'bhits')}, {_VLEG},
v AS (SELECT doc_id, score AS vs, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS vn, row_number() OVER (ORDER BY score DESC, doc_id) AS vr FROM vhits @WHERE@),
b AS (SELECT doc_id, score AS bs, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS bn, row_number() OVER (ORDER BY score DESC, doc_id) AS br FROM bhits),
j AS (SELECT coalesce(v.doc_id, b.doc_id) AS doc_id, vs, vn, vr, bs, bn, br FROM v FULL JOIN b ON v.doc_id = b.doc_id)
"""
_SHOW = "CASE WHEN vs > 0 THEN round(vs, 6) END AS vector_score, CASE WHEN bs > 0 THEN round(bs, 6) END AS bm25_score"
_ORD = " QUALIFY row_number() OVER (ORDER BY round({s}, 9) DESC, doc_id) <= 15"
_W = "0.7 * coalesce(vn, 0) + 0.3 * coalesce(bn, 0)"
_RRF = "coalesce(1.0 / (60 + vr), 0) + coalesce(1.0 / (60 + br), 0)"
_AD = "CASE WHEN coalesce((SELECT max(vs) FROM v), 0) >= 0.65 THEN 0.5 ELSE 0.2 END * coalesce(vn, 0) + CASE WHEN coalesce((SELECT max(vs) FROM v), 0) >= 0.65 THEN 0.5 ELSE 0.8 END * coalesce(bn, 0)"
_STEM = "regexp_extract(source_path, '[^/]*$')"
_QT = "list_distinct(" + _tok("'" + QUERY + "'") + ")"
_BYTES = lambda n: f"lpad(CASE WHEN {n} >= 1073741824 THEN printf('%.1fg', {n} / 1073741824.0) WHEN {n} >= 1048576 THEN printf('%.1fm', {n} / 1048576.0) WHEN {n} >= 1024 THEN concat({n} // 1024, 'k') ELSE concat({n}, 'b') END, 5, ' ')"

QUERIES = {f.__name__: f for f in (bm25_term_stats, bm25_corpus_stats, bm25_topk, bm25_batch, bm25_remove_docs, vector_topk, vector_topk_filtered, vector_batch_topk, vector_norms, unit_vectors, centroid_mean_pool, points_by_id, minmax_scores, fusion_weighted, fusion_rrf, fusion_adaptive, fusion_overlap, hydrate_hits, rerank_lexical, source_filter, min_score, bm25_lookups, bm25_doc_ids, payload_text, results_json, results_text, citation_labels, mock_embed, embed_documents)}
SQL = {
    "bm25_term_stats": f"WITH {_IDX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
    "bm25_corpus_stats": f"WITH {_IDX} SELECT n AS num_docs, round(avgdl, 6) AS avg_doc_length FROM corpus",
    "bm25_topk": f"WITH {_IDX}, {_bm25_sql(10)} SELECT doc_id, round(score, 6) AS score FROM hits",
    "bm25_batch": f"""WITH {_IDX}, q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_tok('text')}) AS term FROM eval_items) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)
SELECT query_id, doc_id, round(s, 6) AS score FROM (SELECT query_id, doc_id, {_SCORE} AS s FROM post JOIN q USING (term) JOIN df USING (term) JOIN stats USING (doc_id) CROSS JOIN corpus GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) <= 5""",
    "bm25_remove_docs": f"WITH {_IDX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post WHERE doc_id NOT IN (SELECT doc_id FROM subject_labels WHERE doc_id IS NOT NULL) GROUP BY term",
    "vector_topk": f"WITH {_VLEG} SELECT doc_id AS vec_id, round(score, 6) AS score FROM vhits QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) <= 10",
    "vector_topk_filtered": f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {PROBE} AND a.label IN (1, 2, 3) QUALIFY row_number() OVER (ORDER BY round({_COS}, 6) DESC, a.vec_id) <= 10",
    "vector_batch_topk": f"SELECT b.vec_id AS query_id, a.vec_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COS}, 9) DESC, a.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 QUALIFY rank <= 5",
    "vector_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "unit_vectors": "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5)) AS unit FROM embeddings",
    "centroid_mean_pool": "WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1) SELECT label, list_transform(c, lambda x: round(x / sqrt(list_dot_product(c, c)), 5)) AS centroid FROM c",
    "points_by_id": "SELECT i.vec_id, label FROM (SELECT DISTINCT item_id AS vec_id FROM eval_items) i LEFT JOIN embeddings USING (vec_id)",
    "minmax_scores": f"WITH {_VLEG} SELECT doc_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS norm FROM vhits",
    "fusion_weighted": _FUSE.replace("@WHERE@", "") + f"SELECT doc_id, round({_W}, 6) AS score, {_SHOW} FROM j" + _ORD.format(s=_W),
    "fusion_rrf": _FUSE.replace("@WHERE@", "") + f"SELECT doc_id, round({_RRF}, 6) AS score, round(vs, 6) AS vector_score, round(bs, 6) AS bm25_score FROM j" + _ORD.format(s=_RRF),
    "fusion_adaptive": _FUSE.replace("@WHERE@", "WHERE score < 0.5") + f"SELECT doc_id, round({_AD}, 6) AS score, {_SHOW} FROM j" + _ORD.format(s="(" + _AD + ")"),
    "fusion_overlap": f"WITH {_IDX}, {_bm25_sql(40, 'bhits')}, {_VLEG} SELECT count(*) FILTER (v.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both, count(*) FILTER (b.doc_id IS NULL) AS vector_only, count(*) FILTER (v.doc_id IS NULL) AS bm25_only FROM vhits v FULL JOIN bhits b ON v.doc_id = b.doc_id",
    "hydrate_hits": f"WITH {_IDX}, {_bm25_sql(40)}, h AS (SELECT doc_id, round(score, 6) AS score, coalesce(d.text, '') AS text, coalesce(nullif(d.source_path, ''), doc_id::VARCHAR) AS source FROM hits LEFT JOIN documents d USING (doc_id)), s AS (SELECT *, regexp_extract(source, '[^/]*$') AS b FROM h) SELECT doc_id, score, text, source, coalesce(nullif(CASE WHEN regexp_matches(b, '^.+\\.[^.]*$') THEN regexp_extract(b, '^(.+)\\.[^.]*$', 1) ELSE b END, ''), 'unknown') AS citation FROM s",
    "rerank_lexical": f"WITH {_IDX}, {_bm25_sql(40)}, t AS (SELECT doc_id, list_distinct({_tok('text')}) AS t, {_QT} AS q FROM hits JOIN documents USING (doc_id)), s AS (SELECT doc_id, 1 / (1 + exp(-(len(list_intersect(t, q))::DOUBLE / len(list_distinct(list_concat(t, q)))))) AS score FROM t) SELECT doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= 5",
    "source_filter": "SELECT doc_id, source FROM documents WHERE contains(source, '-notes')",
    "min_score": f"WITH {_VLEG} SELECT doc_id, round(score, 6) AS score FROM vhits WHERE score >= 0.2",
    "bm25_doc_ids": "SELECT doc_id FROM documents",
    "bm25_lookups": f"WITH {_IDX}, i AS (SELECT DISTINCT doc_id FROM subject_labels), t AS (SELECT unnest({_QT}) AS term) SELECT i.doc_id, t.term, coalesce(tf, 0)::INT AS tf, coalesce(dl, 0)::INT AS doc_length FROM i CROSS JOIN t LEFT JOIN post ON post.doc_id = i.doc_id AND post.term = t.term LEFT JOIN stats ON stats.doc_id = i.doc_id",
    "payload_text": "SELECT event_id, json_extract_string(props, '$.k') AS k, 'a b' AS x0, '12' AS x1, 'true' AS x2, NULL AS x3, NULL AS x4, NULL AS x5 FROM events",
    "embed_documents": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN list_transform(range(1, 5), lambda i: round(((coalesce(list_sum(list_transform(range(1, strlen(text) + 1), lambda k: ('0x' || substr(hex(encode(text)), 2 * k - 1, 2))::BIGINT)), 0)::BIGINT * i) % 1000) / 1000.0, 3)) END AS v FROM documents",
    "results_json": f"WITH {_IDX}, {_bm25_sql(3)} SELECT to_json(struct_pack(results := list(struct_pack(id := doc_id::VARCHAR, score := round(score, 4), text := coalesce(text, ''), citation := source, source := source) ORDER BY score DESC)))::VARCHAR AS json FROM hits JOIN documents USING (doc_id)",
    "results_text": f"WITH {_IDX}, {_bm25_sql(5)}, x AS (SELECT doc_id, score, source, row_number() OVER (ORDER BY score DESC, doc_id) AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: w <> '') AS w FROM hits JOIN documents USING (doc_id)) SELECT doc_id, list_concat(list_concat([r || '. ' || source || ' (' || printf('%.4f', score) || ')'], CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE string_split(list_reduce(w, lambda a, b: CASE WHEN strlen(split_part(a, chr(10), -1)) + strlen(b) + 1 <= 100 THEN a || ' ' || b ELSE a || chr(10) || b END), chr(10)) END), ['----------------------------------------']) AS lines FROM x",
    "citation_labels": f"SELECT DISTINCT source_path, coalesce(nullif(CASE WHEN regexp_matches({_STEM}, '^.+\\.[^.]*$') THEN regexp_extract({_STEM}, '^(.+)\\.[^.]*$', 1) ELSE {_STEM} END, ''), 'unknown') AS citation, coalesce(nullif({_STEM}, ''), 'unknown') AS base, 'src_' || substr(sha256('s' || source_path), 1, 12) AS hashed, 'redacted' AS redacted, {_BYTES('metadata.size_bytes')} AS size FROM source_documents",
    "mock_embed": "SELECT item_id, list_transform(range(1, 5), lambda i: round(((list_sum(list_transform(range(1, strlen(text) + 1), lambda k: ('0x' || substr(hex(encode(text)), 2 * k - 1, 2))::BIGINT))::BIGINT * i) % 1000) / 1000.0, 6)) AS v FROM eval_items",
}
