"""Queries of file states, scans, page layout, JSON schemas, scheduling, time features and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import classify as C
from corpuscle.operators import chunking, dag, incremental, layout, schema, state, temporal
from corpuscle.plans import texts
from corpuscle.session import scratch, table
from corpuscle.streaming import ingest

AT = "2026-01-01 00:00:00"


def _state(spark, d):
    return state.latest_state(table(spark, d, "processing_state"))


def _fail(spark, d):
    return state.latest_failure(table(spark, d, "processing_failures"))


def _now(spark, d):
    return incremental.current_files(table(spark, d, "scan_runs"), table(spark, d, "scan_entries"))


def latest_state(spark, d):
    return _state(spark, d).select("source_path", "status", "file_size_bytes", "processed_at", "chunk_count")


def count_completed(spark, d):
    return _state(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def should_skip(spark, d):
    return state.done(_now(spark, d), _state(spark, d)).select("scope_key", "source_path")


def to_process(spark, d):
    return state.to_process(_now(spark, d), _state(spark, d), _fail(spark, d)).select("scope_key", "source_path")


def skip_failures(spark, d):
    return state.skipped_failures(_now(spark, d), _fail(spark, d)).select("scope_key", "source_path")


def processed_summary(spark, d):
    return state.processed_summary(_now(spark, d), _state(spark, d), _fail(spark, d))


def scan_summary(spark, d):
    return state.scan_summary(table(spark, d, "scan_entries"))


def stale_entries(spark, d):
    return state.current_entries(table(spark, d, "scan_entries"), table(spark, d, "scan_runs")).select("scope_key", "source_path").distinct()


def finalize_incomplete(spark, d):
    s, _ = state.recover(_state(spark, d), "interrupted", F.lit(AT).cast("timestamp"))
    return s.select("source_path", "status", "error", "processed_at")


def finalize_failures(spark, d):
    _, f = state.recover(_state(spark, d), "interrupted", F.lit(AT).cast("timestamp"))
    return f.select("source_path", "reason", "failed_at")


def status_parse(spark, d):
    return table(spark, d, "processing_state").select(C.parse_status("status").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _lines(spark, d):
    return layout.distinct_lines(table(spark, d, "pdf_lines"))


def page_text(spark, d):
    return layout.page_texts(_lines(spark, d))


def document_text(spark, d):
    return layout.document_texts(_lines(spark, d))


def font_median(spark, d):
    return layout.median_font(_lines(spark, d), layout.PAGE).select(*layout.PAGE, F.round("median_font", 4).alias("median_font"))


def header_footer(spark, d):
    return layout.margin_lines(_lines(spark, d))


def header_footer_stats(spark, d):
    return layout.margin_stats(_lines(spark, d))


def lines_without_margins(spark, d):
    return layout.without_margins(_lines(spark, d)).select(*layout.PAGE, "line_no")


def headings(spark, d):
    return layout.headings(_lines(spark, d)).select("doc_id", "page_number", "line_no", "heading", "level")


def sections(spark, d):
    return layout.sections(_lines(spark, d))


def section_contents(spark, d):
    l = _lines(spark, d)
    return layout.section_contents(l, layout.sections(l))


def ocr_stats(spark, d):
    return layout.ocr_stats(_lines(spark, d))


def bbox_overlap(spark, d):
    l = _lines(spark, d).withColumn("y", F.col("y").cast("double"))
    return layout.overlapping(l.select(*layout.PAGE, "line_no", F.col("x").cast("double").alias("x"), "y", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")), layout.PAGE, "line_no")


def json_paths(spark, d):
    return schema.infer(table(spark, d, "events"), "props").select("path", F.array_join("types", ",").alias("types"), "n", "required")


def json_files(spark, d):
    s = table(spark, d, "source_documents").where("source_path LIKE '%.json'").select("id", "content").distinct()
    return schema.infer(s, "content").select("path", F.array_join("types", ",").alias("types"), "n", "required")


def field_hints(spark, d):
    s = table(spark, d, "source_documents").where("source_path LIKE '%.json'").select("id", "content").distinct()
    return schema.field_hints(schema.infer(s, "content"))


def create_table_text(spark, d):
    """The CREATE TABLE statements that the corpus's documents hold, as a model's answer would."""
    t = table(spark, d, "source_documents").select("id", "content").unionByName(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))).distinct()
    return t.select("id", schema.create_table_col("content").alias("ddl"))


def _edges(spark, d):
    """Nations that depend on two smaller ones each."""
    k = F.col("n_nationkey")
    both = F.array(F.floor((k - 1) / 2).cast("int"), F.floor((k - 1) / 3).cast("int"))
    return table(spark, d, "nation").select(k.alias("task"), F.explode_outer(F.when(k > 0, both)).alias("depends_on"))


def dag_levels(spark, d):
    return dag.levels(_edges(spark, d))


def _files(spark, d):
    """The files of the documents, one row per path."""
    t = table(spark, d, "source_documents").where("source_path IS NOT NULL")
    row = F.struct("metadata.loaded_at", "id", F.col("file_hash"), F.col("metadata.size_bytes").alias("file_size_bytes"))
    return t.groupBy("source_path").agg(F.max(row).alias("r")).select("source_path", "r.file_hash", "r.file_size_bytes", F.col("r.loaded_at").alias("modified_at"))


def _fails(spark, d):
    return _fail(spark, d).select("source_path", "file_hash", "file_size_bytes", "modified_at", "failed_at", "reason")


def _at():
    return F.lit(AT).cast("timestamp")


def mark_processing(spark, d):
    return state.mark_processing(_state(spark, d), _files(spark, d), _at()).select("source_path", "status", "chunk_count", "file_size_bytes", "processed_at", "error")


def _chunked(spark, d):
    c = table(spark, d, "chunks").groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("id").cast("int").alias("n"))
    s = table(spark, d, "source_documents").where("source_path IS NOT NULL").select("id", "source_path").distinct()
    return s.join(c, "id").groupBy("source_path").agg(F.max("n").alias("chunk_count"))


def mark_complete(spark, d):
    s, _ = state.mark_complete(_state(spark, d), _fails(spark, d), _chunked(spark, d), _at())
    return s.select("source_path", "status", "chunk_count", "processed_at", "error")


def mark_complete_failures(spark, d):
    """The failures that are left once the chunked files are complete."""
    return state.mark_complete(_state(spark, d), _fails(spark, d), _chunked(spark, d), _at())[1].select("source_path", "reason")


def mark_failed(spark, d):
    return state.mark_failed(_state(spark, d), _fails(spark, d).select("source_path", F.col("reason").alias("error")), _at()).select("source_path", "status", "processed_at", "error")


def record_failure(spark, d):
    """Every failed state recorded as a failure."""
    new = _state(spark, d).where("status = 'failed'").select("source_path", "file_hash", "file_size_bytes", "modified_at", _at().alias("failed_at"), F.coalesce("error", F.lit("unknown")).alias("reason"))
    return state.record_failure(_fails(spark, d), new).select("source_path", "failed_at", "reason")


def clear_failure(spark, d):
    return state.clear_failure(_fails(spark, d), _state(spark, d).where("status = 'completed'")).select("source_path", "reason")


def remove_paths(spark, d):
    """State without the paths that no scan lists any more."""
    listed = table(spark, d, "scan_entries").select("source_path").distinct()
    gone = _state(spark, d).select("source_path").join(listed, "source_path", "left_anti")
    return state.removed(_state(spark, d), _fails(spark, d), gone)[0].select("source_path", "status")


def is_processed(spark, d):
    return state.is_processed(_files(spark, d).select("source_path", "file_hash"), _state(spark, d))


def all_paths(spark, d):
    return _state(spark, d).select("source_path")


def headings_simple(spark, d):
    l = _lines(spark, d)
    m = layout.median_font(l, layout.PAGE)
    return l.join(m, layout.PAGE).where(layout.simple_heading("font_size", "median_font")).select(*layout.PAGE, "line_no")


def chunk_tokenizer(spark, d):
    """Windows of 256 model tokens over the corpus."""
    return chunking.chunk_tokens(table(spark, d, "documents"), "doc_id", "text", 256, 64)


def token_counts_model(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.token_count("text").alias("tokens"))


def schema_ddl(spark, d):
    """The DDL, the prompt and the described schema that the JSON files give."""
    s = table(spark, d, "source_documents").where("source_path LIKE '%.json'").select("id", "content").distinct()
    paths = schema.infer(s, "content")
    told, hints = schema.to_json_schema(paths), schema.hints_of(paths)
    rows = [("ddl", schema.with_retry(schema.Placeholder(paths, "files"), "")), ("prompt", schema.ddl_prompt(told, hints)), ("schema", schema.pretty(schema.enhanced(told, hints)))]
    return spark.createDataFrame(rows, "kind string, text string")


def temporal_feature(spark, d):
    return temporal.feature(table(spark, d, "documents"), "doc_id", "loaded_at")


def temporal_augment(spark, d):
    f = temporal_feature(spark, d).withColumnRenamed("doc_id", "vec_id")
    return temporal.augment(table(spark, d, "embeddings"), "embedding", f, "vec_id").select("vec_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("vector"))


def cluster_date_range(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return temporal.date_range(table(spark, d, "documents").join(e, "doc_id"), "label", "loaded_at")


def chunk_sections(spark, d):
    l = _lines(spark, d)
    return chunking.chunk_sections(layout.section_contents(l, layout.sections(l)), ["doc_id", "start_page", "line_no"], "content", 64, 16).select("doc_id", "start_page", "line_no", "chunk_index", "total_chunks", "content")


def event_windows(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def _streamed(spark, d, name, start, read):
    """Run a stream over what a folder holds and read what it wrote; the folder lies beside the checkpoints."""
    out = scratch(spark, f"stream-{name}")
    start(out).awaitTermination()
    return read(out)


def stream_ingest(spark, d):
    """Chunks of the corpus, ingested as a stream of files."""
    src = spark.read.parquet(f"{d}/documents.parquet")
    stream = spark.readStream.schema(src.schema).parquet(f"{d}/documents.parquet*").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _streamed(spark, d, "ingest", lambda out: ingest.ingest(stream, "doc_id", "text", out), lambda out: spark.read.parquet(f"{out}/chunks").select(F.col("document_id").alias("doc_id"), "chunk_index", "content"))


def stream_windows(spark, d):
    """Daily counts of events by type, as a stream that waits for late events: each batch writes the windows it changed, and windows behind the watermark leave the state."""
    src = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(src.schema).parquet(f"{d}/events.parquet*")
    agg = ingest.windowed_counts(stream, "ts", "event_type", "value")

    def start(out):
        return agg.writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("__n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/v/batch={n}")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()

    def last(out):
        v = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/v")
        return v.groupBy("event_type", "start").agg(F.max_by(F.struct("n", "total"), "__n").alias("s")).select("event_type", "start", "s.n", F.round("s.total", 4).alias("total"))

    return _streamed(spark, d, "windows", start, last)


def stream_latest(spark, d):
    """The newest event of each user, kept while events stream in."""
    src = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(src.schema).parquet(f"{d}/events.parquet*").select("user_id", "ts", "event_id")
    return _streamed(spark, d, "latest", lambda out: ingest.latest_by_key(stream, "user_id", "ts", out), lambda out: ingest.read_latest(spark, out))


_ST = "st AS (SELECT source_path, CASE WHEN lower(trim(status)) IN ('completed', 'complete') THEN 'completed' WHEN lower(trim(status)) IN ('pending', 'processing') THEN lower(trim(status)) ELSE 'failed' END AS status, file_size_bytes, modified_at, processed_at, chunk_count, error FROM processing_state WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY processed_at DESC) = 1)"
_STH = _ST.replace("st AS (SELECT source_path,", "sth AS (SELECT source_path, file_hash,")
_AT = f"TIMESTAMPTZ '{AT}+00'"
_FR = "fr AS (SELECT source_path, failed_at, reason FROM processing_failures WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY failed_at DESC) = 1)"
_FI = "fi AS (SELECT source_path, file_hash AS hash, metadata.size_bytes AS size FROM source_documents WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY metadata.loaded_at DESC NULLS LAST, id DESC NULLS LAST, file_hash DESC NULLS LAST) = 1)"
_CH = "cc AS (SELECT source_path, max(n)::INT AS n FROM (SELECT DISTINCT id, source_path FROM source_documents WHERE source_path IS NOT NULL) s JOIN (SELECT document_id, count(DISTINCT id) AS n FROM chunks GROUP BY 1) c ON c.document_id = s.id GROUP BY 1)"
_JT = """jd AS (SELECT DISTINCT id, content FROM source_documents WHERE source_path LIKE '%.json' AND json_valid(content)),
jt AS (SELECT t.type, regexp_replace(regexp_replace(substr(t.fullkey, 2), '\\[[0-9]+\\]', '.[]', 'g'), '^[.]', '') AS path FROM jd, json_tree(jd.content) t QUALIFY row_number() OVER (PARTITION BY jd.id, jd.content, t.fullkey ORDER BY t.id DESC) = 1),
v AS (SELECT CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL', 'BOOLEAN') THEN lower(type) WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS type, path, regexp_extract(path, '[^.]*$') AS leaf, CASE WHEN path <> '' THEN regexp_replace(path, '(^|[.])[^.]*$', '') END AS up FROM jt)"""
_FA = "fa AS (SELECT source_path, file_size_bytes, modified_at FROM processing_failures QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY failed_at DESC) = 1)"
_CUR = "lr AS (SELECT scope_key, arg_max(run_id, updated_at) AS run_id FROM scan_runs WHERE lower(trim(status)) IN ('complete', 'completed') GROUP BY 1), cur AS (SELECT scope_key, source_path, file_size_bytes AS s, modified_at AS m FROM scan_entries SEMI JOIN lr USING (scope_key, run_id) QUALIFY row_number() OVER (PARTITION BY scope_key, source_path ORDER BY updated_at DESC) = 1)"
_MATCH = "k.source_path = c.source_path AND k.file_size_bytes = c.s AND (k.modified_at IS NULL OR c.m IS NULL OR k.modified_at = c.m)"
_DONE = f"EXISTS (SELECT 1 FROM st k WHERE k.status = 'completed' AND {_MATCH})"
_FAILED = f"EXISTS (SELECT 1 FROM fa k WHERE {_MATCH})"
_L = "l AS (SELECT DISTINCT ON (doc_id, page_number, line_no) * FROM pdf_lines)"
_NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_ML = f"""{_L}, z AS (SELECT doc_id, page_number, CASE WHEN page_height - y <= 72 THEN 'header' WHEN y <= 72 THEN 'footer' END AS zone, {_NORM} AS norm FROM l),
p AS (SELECT doc_id, count(DISTINCT page_number) AS pages FROM l GROUP BY 1 HAVING count(DISTINCT page_number) >= 3),
m AS (SELECT doc_id, zone, norm, count(*) AS n, any_value(pages) AS pages FROM z JOIN p USING (doc_id) WHERE zone IS NOT NULL AND norm <> '' GROUP BY 1, 2, 3 HAVING count(*) >= ceil(any_value(pages) * 0.5)
  QUALIFY row_number() OVER (PARTITION BY doc_id, zone ORDER BY count(*) DESC, norm) <= 20)"""
_H = f"""{_L}, md AS (SELECT doc_id, quantile_cont(font_size::DOUBLE, 0.5) AS med FROM l GROUP BY 1),
c AS (SELECT *, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS letters, suffix(trim(text), '.') AS dot FROM l JOIN md USING (doc_id) WHERE font_size::DOUBLE >= 10 AND font_size::DOUBLE > med * 1.2 AND strlen(text) BETWEEN 3 AND 200),
h0 AS (SELECT doc_id, page_number, line_no, trim(text) AS heading, font_size FROM c WHERE (letters = upper(letters) AND NOT dot) OR NOT dot OR strlen(text) < 50),
h AS (SELECT *, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC), 5)::INT AS level FROM h0)"""
_SEC = """, e AS (SELECT a.doc_id, a.page_number, a.line_no, a.heading, a.level, min(b.page_number) FILTER (b.level <= a.level AND (b.page_number, b.line_no) > (a.page_number, a.line_no)) AS nxt FROM h a LEFT JOIN h b USING (doc_id) GROUP BY 1, 2, 3, 4, 5),
lp AS (SELECT doc_id, max(page_number) AS last FROM l GROUP BY 1),
s AS (SELECT doc_id, heading, level, page_number AS start_page, line_no, CASE WHEN nxt IS NULL THEN last ELSE greatest(nxt - 1, page_number) END AS end_page FROM e JOIN lp USING (doc_id))"""
_PT = "pt AS (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY line_no) AS text, sum(strlen(text))::BIGINT AS chars FROM l GROUP BY 1, 2)"
_TF = "(SELECT doc_id, round(coalesce((epoch_us(loaded_at) - min(epoch_us(loaded_at)) OVER ())::DOUBLE / (max(epoch_us(loaded_at)) OVER () - min(epoch_us(loaded_at)) OVER ()), 0.5), 6) AS feature FROM documents)"
_EV = "SELECT event_type, date_trunc('day', ts)::TIMESTAMPTZ AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

QUERIES = {f.__name__: f for f in (latest_state, count_completed, should_skip, to_process, skip_failures, processed_summary, scan_summary, stale_entries, finalize_incomplete, finalize_failures, status_parse, page_text, document_text, font_median, header_footer, header_footer_stats, lines_without_margins, headings, sections, section_contents, chunk_sections, ocr_stats, bbox_overlap, json_paths, json_files, field_hints, create_table_text, dag_levels, mark_processing, mark_complete, mark_complete_failures, mark_failed, record_failure, clear_failure, remove_paths, is_processed, all_paths, headings_simple, chunk_tokenizer, token_counts_model, schema_ddl, stream_latest, temporal_feature, temporal_augment, cluster_date_range, event_windows, stream_ingest, stream_windows)}
SQL = {
    "latest_state": f"WITH {_ST} SELECT source_path, status, file_size_bytes, processed_at, chunk_count FROM st",
    "count_completed": f"WITH {_ST} SELECT status, count(*) AS n FROM st GROUP BY 1",
    "should_skip": f"WITH {_ST}, {_CUR} SELECT scope_key, source_path FROM cur c WHERE {_DONE}",
    "to_process": f"WITH {_ST}, {_FA}, {_CUR} SELECT scope_key, source_path FROM cur c WHERE NOT {_DONE} AND NOT {_FAILED}",
    "skip_failures": f"WITH {_FA}, {_CUR} SELECT scope_key, source_path FROM cur c WHERE {_FAILED}",
    "processed_summary": f"WITH {_ST}, {_FA}, {_CUR} SELECT scope_key, count(*) AS files, sum(s)::BIGINT AS bytes FROM cur c WHERE {_DONE} OR {_FAILED} GROUP BY 1",
    "scan_summary": "SELECT scope_key, run_id, count(*) AS files, sum(s)::BIGINT AS bytes FROM (SELECT scope_key, run_id, source_path, arg_max(file_size_bytes, (updated_at, file_size_bytes)) AS s FROM scan_entries GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "stale_entries": "SELECT DISTINCT scope_key, source_path FROM scan_entries SEMI JOIN (SELECT scope_key, arg_max(run_id, updated_at) AS run_id FROM scan_runs GROUP BY 1) USING (scope_key, run_id)",
    "finalize_incomplete": f"WITH {_ST} SELECT source_path, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' THEN 'interrupted' ELSE error END AS error, CASE WHEN status = 'processing' THEN TIMESTAMPTZ '{AT}+00' ELSE processed_at END AS processed_at FROM st",
    "finalize_failures": f"WITH {_ST} SELECT source_path, 'interrupted' AS reason, TIMESTAMPTZ '{AT}+00' AS failed_at FROM st WHERE status = 'processing'",
    "status_parse": "SELECT CASE WHEN lower(trim(status)) IN ('completed', 'complete') THEN 'completed' WHEN lower(trim(status)) IN ('pending', 'processing') THEN lower(trim(status)) ELSE 'failed' END AS status, count(*) AS n FROM processing_state GROUP BY 1",
    "page_text": f"WITH {_L}, {_PT} SELECT * FROM pt",
    "document_text": f"WITH {_L}, {_PT} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM pt GROUP BY 1",
    "font_median": f"WITH {_L} SELECT doc_id, page_number, round(coalesce(quantile_cont(font_size::DOUBLE, 0.5), 12), 4) AS median_font FROM l GROUP BY 1, 2",
    "header_footer": f"WITH {_ML} SELECT doc_id, zone, norm, n FROM m",
    "header_footer_stats": f"WITH {_ML}, per AS (SELECT doc_id, count(*) FILTER (zone = 'header') AS headers, count(*) FILTER (zone = 'footer') AS footers FROM m GROUP BY 1), r AS (SELECT doc_id, count(*) AS removed FROM z SEMI JOIN m USING (doc_id, norm) GROUP BY 1) SELECT doc_id, headers, footers, removed FROM per LEFT JOIN r USING (doc_id)",
    "lines_without_margins": f"WITH {_ML} SELECT doc_id, page_number, line_no FROM (SELECT *, {_NORM} AS norm FROM l) ANTI JOIN m USING (doc_id, norm)",
    "headings": f"WITH {_H} SELECT doc_id, page_number, line_no, heading, level FROM h",
    "sections": f"WITH {_H}{_SEC} SELECT * FROM s",
    "section_contents": f"WITH {_H}{_SEC}, {_PT} SELECT s.doc_id, start_page, line_no, string_agg(text, chr(10) ORDER BY page_number) AS content FROM s JOIN pt ON pt.doc_id = s.doc_id AND page_number BETWEEN start_page AND end_page GROUP BY 1, 2, 3",
    "chunk_sections": f"WITH {_H}{_SEC}, {_PT}, sc AS (SELECT s.doc_id, start_page, line_no, string_agg(text, chr(10) ORDER BY page_number) AS content FROM s JOIN pt ON pt.doc_id = s.doc_id AND page_number BETWEEN start_page AND end_page GROUP BY 1, 2, 3), src AS (SELECT {{'d': doc_id, 'p': start_page, 'l': line_no}} AS id, {texts._words('content')} AS w FROM sc), {texts._windows('src', 64, 16)} SELECT id.d AS doc_id, id.p AS start_page, id.l AS line_no, i AS chunk_index, k AS total_chunks, array_to_string(c, ' ') AS content FROM win",
    "ocr_stats": f"WITH {_L}, p AS (SELECT doc_id, page_number, sum(strlen(text)) AS n, bool_or(coalesce(is_ocr, false)) AS o FROM l GROUP BY 1, 2) SELECT doc_id, count(*) AS pages, count(*) FILTER (n < 50) AS needing, count(*) FILTER (o) AS having FROM p GROUP BY 1",
    "bbox_overlap": f"WITH {_L}, b AS (SELECT doc_id, page_number, line_no, x::DOUBLE AS x, y::DOUBLE AS y, width::DOUBLE AS width, height::DOUBLE AS height FROM l) SELECT l.doc_id, l.page_number, l.line_no AS a, r.line_no AS b FROM b l JOIN b r ON l.doc_id = r.doc_id AND l.page_number = r.page_number AND l.line_no < r.line_no AND l.x < r.x + r.width AND r.x < l.x + l.width AND l.y < r.y + r.height AND r.y < l.y + l.height",
    "json_paths": "SELECT 'k' AS path, 'number' AS types, count(*) AS n, true AS required FROM events WHERE json_extract(props, '$.k') IS NOT NULL UNION ALL SELECT '', 'object', count(*), false FROM events",
    "create_table_text": r"SELECT id, nullif(trim(regexp_extract(regexp_replace(trim(content), '(?m)^```\w*[\t\n\f\r ]*$', '', 'g'), '(?is)(create\s+table\b.*?)(\n\s*\n|$)', 1)), '') AS ddl FROM (SELECT id, content FROM source_documents UNION SELECT doc_id::VARCHAR, text FROM documents)",
    "dag_levels": "WITH RECURSIVE e AS (SELECT n_nationkey AS task, unnest(CASE WHEN n_nationkey > 0 THEN [(n_nationkey - 1) // 2, (n_nationkey - 1) // 3] ELSE [NULL] END) AS dep FROM nation), w AS (SELECT task, 0 AS level FROM e WHERE dep IS NULL UNION SELECT e.task, w.level + 1 FROM w JOIN e ON e.dep = w.task) SELECT task, max(level) AS level FROM w GROUP BY 1",
    "mark_processing": f"WITH {_ST}, {_FI} SELECT source_path, status, chunk_count, file_size_bytes, processed_at, error FROM st ANTI JOIN fi USING (source_path) UNION ALL SELECT source_path, 'processing', 0, size, {_AT}, NULL FROM fi",
    "mark_complete": f"WITH {_ST}, {_CH} SELECT source_path, CASE WHEN n IS NULL THEN status ELSE 'completed' END AS status, coalesce(n, chunk_count) AS chunk_count, CASE WHEN n IS NULL THEN processed_at ELSE {_AT} END AS processed_at, CASE WHEN n IS NULL THEN error END AS error FROM st LEFT JOIN cc USING (source_path)",
    "mark_complete_failures": f"WITH {_FR}, {_CH} SELECT source_path, reason FROM fr ANTI JOIN cc USING (source_path)",
    "mark_failed": f"WITH {_ST}, {_FR} SELECT source_path, CASE WHEN fr.source_path IS NULL THEN status ELSE 'failed' END AS status, CASE WHEN fr.source_path IS NULL THEN processed_at ELSE {_AT} END AS processed_at, CASE WHEN fr.source_path IS NULL THEN error ELSE reason END AS error FROM st LEFT JOIN fr USING (source_path)",
    "record_failure": f"WITH {_ST}, {_FR}, n AS (SELECT source_path, {_AT} AS failed_at, coalesce(error, 'unknown') AS reason FROM st WHERE status = 'failed') SELECT source_path, failed_at, reason FROM fr ANTI JOIN n USING (source_path) UNION ALL SELECT * FROM n",
    "clear_failure": f"WITH {_ST}, {_FR} SELECT source_path, reason FROM fr ANTI JOIN (SELECT source_path FROM st WHERE status = 'completed') USING (source_path)",
    "remove_paths": f"WITH {_ST} SELECT source_path, status FROM st SEMI JOIN scan_entries USING (source_path)",
    "is_processed": f"WITH {_STH}, {_FI} SELECT source_path, hash AS file_hash, EXISTS (SELECT 1 FROM sth k WHERE k.status = 'completed' AND k.source_path = fi.source_path AND k.file_hash = fi.hash) AS processed FROM fi",
    "all_paths": "SELECT DISTINCT source_path FROM processing_state WHERE source_path IS NOT NULL",
    "headings_simple": f"WITH {_L}, m AS (SELECT doc_id, page_number, coalesce(quantile_cont(font_size::DOUBLE, 0.5), 12) AS med FROM l GROUP BY 1, 2) SELECT doc_id, page_number, line_no FROM l JOIN m USING (doc_id, page_number) WHERE font_size::DOUBLE > med * 1.2",
    "stream_latest": "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
    "json_files": f"WITH {_JT} SELECT path, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, count(*) AS n, coalesce(any_value(v.up) IS NOT NULL AND any_value(leaf) <> '[]' AND count(*) >= (SELECT count(*) FROM v p WHERE p.path = any_value(v.up) AND p.type = 'object'), false) AS required FROM v GROUP BY path",
    "field_hints": f"WITH {_JT} SELECT DISTINCT 'timestamps' AS kind, path FROM v WHERE leaf NOT IN ('', '[]') AND regexp_matches(lower(leaf), 'date|time|updated|created') UNION SELECT DISTINCT 'folders', path FROM v WHERE leaf NOT IN ('', '[]') AND regexp_matches(lower(leaf), 'folder|path|group|category|tag')",
    "temporal_feature": f"SELECT * FROM {_TF}",
    "temporal_augment": f"SELECT vec_id, list_append(list_transform(embedding::DOUBLE[], lambda x: round(x, 6)), feature) AS vector FROM embeddings JOIN {_TF} f ON f.doc_id = vec_id",
    "cluster_date_range": "SELECT label, min(loaded_at) AS first, max(loaded_at) AS last, count(*) AS n FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1",
    "stream_ingest": texts.SQL["chunk_words"].replace("SELECT id AS doc_id, i AS chunk_index, k AS total_chunks, len(c)::INT AS tokens, array", "SELECT id AS doc_id, i AS chunk_index, array"),
    "event_windows": _EV,
    "stream_windows": _EV,
}
