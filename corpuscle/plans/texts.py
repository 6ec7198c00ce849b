"""Queries of text functions, chunking, commits and classification, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import classify as C
from corpuscle.functions import lang as L
from corpuscle.functions import text as T
from corpuscle.operators import chunking, commits, history
from corpuscle.session import table

COMMIT_QUERY = "parser index build"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _diffs(spark, d):
    """The corpus's commit messages with their diffs."""
    return commits.split_message(table(spark, d, "documents"), "doc_id", "text").where("diff_text <> ''")


def chunk_words(spark, d):
    return chunking.chunk(_docs(spark, d), "doc_id", "text", 512, 128).select(F.col("document_id").alias("doc_id"), "chunk_index", "total_chunks", "tokens", "content")


def chunk_stats(spark, d):
    c = chunking.chunk(table(spark, d, "source_documents").select("id", "content").distinct(), "id", "content", 100, 20)
    return c.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def chunk_bytes(spark, d):
    return table(spark, d, "chunks").dropDuplicates(["id"]).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


def chunk_sentences(spark, d):
    return chunking.pack_sentences(table(spark, d, "documents"), "doc_id", "text", 64, 16)


def window_commit_style(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunking.commit_windows("text", 512, 128)).alias("i", "content")).where("content <> ''")


def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.tokens("text")).alias("tokens"), F.size(T.index_tokens("text")).alias("indexed"), T.word_count("text").alias("words"), F.octet_length("text").alias("bytes"), F.length("text").alias("chars"))


def estimate_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.estimate_tokens("text").alias("tokens"))


def truncate_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.truncate_to_tokens("text", 40).alias("short"))


def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize("text").alias("text"))


def collapse_ws(spark, d):
    return _docs(spark, d).select("doc_id", T.collapse("text").alias("text"))


def strip_nonprintable(spark, d):
    return _docs(spark, d).select("doc_id", T.drop_control("text").alias("text"))


def sentence_stats(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.size(T.sentence_pieces("text")).alias("n"))


def sentences_unicode(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences("text")).alias("i", "sentence"))


def wrap_text(spark, d):
    return table(spark, d, "eval_items").select("item_id", T.wrap("text", 60).alias("lines"))


def sha256_dups(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def line_counts(spark, d):
    t = F.col("content")
    return table(spark, d, "source_documents").select("id", "content").distinct().select("id", (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when(F.endswith(t, F.lit("\n")) | (t == ""), 0).otherwise(1)).alias("lines"))


def ext_language(spark, d):
    p = table(spark, d, "source_documents").select("source_path").distinct()
    return p.select("source_path", L.language("source_path").alias("lang"), L.category("source_path").alias("category"), L.is_code("source_path").alias("is_code"))


def format_detect(spark, d):
    return table(spark, d, "source_documents").select("source_path").distinct().groupBy(L.document_format("source_path").alias("format")).agg(F.count(F.lit(1)).alias("n"))


def extension_preset(spark, d):
    from corpuscle.functions.display import extension

    return table(spark, d, "source_documents").select("source_path").distinct().where(extension("source_path").isin(L.expand_extensions(["code", "docs", "PDF"])))


def excluded_paths(spark, d):
    return table(spark, d, "scan_entries").select("source_path").distinct().where(L.excluded("source_path"))


def classify_messages(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", C.commit_type("text").alias("type"), C.conventional_type("text").alias("conventional"))


def diff_files(spark, d):
    return commits.file_diffs(_diffs(spark, d), "id", "diff_text")


def diff_hunks(spark, d):
    return commits.hunks(_diffs(spark, d), "id", "diff_text").select("id", "file_path", "hunk_pos", "header", "content")


def commit_chunks_by_file(spark, d):
    return commits.chunks(_diffs(spark, d), "file")


def commit_chunks_by_hunk(spark, d):
    return commits.chunks(_diffs(spark, d), "hunk")


def commit_chunks_message(spark, d):
    return commits.chunks(_diffs(spark, d), "message")


def commit_chunks_window(spark, d):
    return commits.chunks(_diffs(spark, d), "window", 20, 5)


def _commits(spark, d):
    """Orders as commits, line items as changed files, customers as developers."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    cm = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("hash"), F.concat(F.lit("dev"), F.col("o_custkey").cast("string")).alias("email"), F.col("c_name").alias("name"), F.col("o_orderdate").alias("time"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("repo"))
    ch = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("insertions"), F.col("l_linenumber").cast("long").alias("deletions"))
    return cm, ch


def commit_summary(spark, d):
    cm, ch = _commits(spark, d)
    s = ch.groupBy("hash").agg(F.count_distinct("path").alias("f"), F.sum("insertions").alias("i"), F.sum("deletions").alias("x"))
    return cm.join(s, "hash").select("hash", commits.summary(F.col("type"), F.col("f"), F.col("i"), F.col("x")).alias("content"))


def commit_diff_stats(spark, d):
    s = commits.diff_stats(_diffs(spark, d))
    return s.select("id", "files_changed", "insertions", "deletions", F.array_join("file_paths", ",").alias("paths"), F.array_join("languages", ",").alias("languages"))


def commit_chunks_summary(spark, d):
    c = _diffs(spark, d)
    return commits.chunks(c.join(commits.diff_stats(c), "id"), "summary")


def _history(spark, d):
    """The corpus's commit messages as commits of the repositories that their source names."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/srv/git/"), F.coalesce("source", F.lit("none"))).alias("repository_path"), F.concat(F.lit("dev"), (F.col("doc_id") % 7).cast("string")).alias("author_name"), F.concat(F.lit("dev"), (F.col("doc_id") % 7).cast("string"), F.lit("@x.org")).alias("author_email"), F.col("loaded_at").alias("commit_time"))
    return _diffs(spark, d).join(t, "id").withColumn("id", F.sha2(F.col("id").cast("string"), 256))


def commit_payload(spark, d):
    """The points of the corpus's commits, without their vectors."""
    p = history.points(_history(spark, d), "summary")
    return p.select(*[c for c in history.PAYLOAD if c not in ("file_paths", "text")], F.array_join("file_paths", ", ").alias("file_paths"), F.col("text"))


def commit_type_filter(spark, d):
    return history.points(_history(spark, d), "message").where(history.condition(kind=" FIX ", author="dev3@x.org")).select("commit_hash", "classification")


def commit_search(spark, d):
    p = history.points(_history(spark, d), "message")
    return history.search(p, COMMIT_QUERY, 10, history.condition(kind="docs")).select(F.col("metadata")["commit_hash"].alias("commit_hash"), F.round("score", 6).alias("score"))


def commit_metadata(spark, d):
    p = history.points(_history(spark, d), "message")
    return p.select("id", F.explode(history.metadata()).alias("key", "value"))


def commit_text(spark, d):
    p = history.points(_history(spark, d), "message")
    return history.as_text(history.search(p, COMMIT_QUERY, 5)).select(F.array_join(F.slice("lines", 3, 100), "\n").alias("shown"))


def developer_order(spark, d):
    s = commits.by_commits(commits.developer_stats(*_commits(spark, d))).limit(20)
    return s.select("email", "commit_count")


def file_commits(spark, d):
    f = commits.file_commits(*_commits(spark, d))
    return f.select("path", F.array_join("hashes", ",").alias("hashes"), F.array_join("contributors", ",").alias("contributors"))


def rfc3339_times(spark, d):
    from corpuscle.operators.state import rfc3339

    t = F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(t, F.lit("Z"))).when(k == 1, F.concat(t, F.lit(".25+02:00"))).when(k == 2, t).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", rfc3339(raw).alias("at"))


def developer_stats(spark, d):
    return commits.developer_stats(*_commits(spark, d))


def developer_types(spark, d):
    return commits.developer_types(_commits(spark, d)[0]).select("email", F.explode("types").alias("type", "n"))


def file_evolution(spark, d):
    return commits.file_evolution(*_commits(spark, d))


def file_history(spark, d):
    cm, ch = _commits(spark, d)
    return commits.file_history(cm, ch, 1).select("hash", "email", "insertions", "deletions")


def commit_range(spark, d):
    from corpuscle.operators.dense import time_filter

    cm, _ = _commits(spark, d)
    return cm.where(time_filter("1995-01-01", "1995-12-31", "time")).select("hash", "email")


def max_commits_per_repo(spark, d):
    return commits.newest_per_repo(_commits(spark, d)[0], "repo", 50).select("repo", "hash", "rn")


_W = r"list_filter(regexp_split_to_array({c}, '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda w: w <> '')"
_D = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _words(c: str) -> str:
    return _W.format(c=c)


def _windows(src: str, size: int, over: int) -> str:
    """CTEs ``n`` and ``win`` over a CTE ``src(id, w)``."""
    step = size - over
    return f"""k AS (SELECT id, w, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {size} THEN 1 ELSE ceil((len(w) - {size}) / {step}.0)::INT + 1 END AS k FROM {src}),
win AS (SELECT id, k, i::INT AS i, w[i * {step} + 1 : i * {step} + {size}] AS c FROM (SELECT *, unnest(range(0, k)) AS i FROM k))"""


_CM = """cm AS (SELECT o_orderkey AS hash, 'dev' || o_custkey AS email, c_name AS name, o_orderdate AS time, o_orderpriority AS type, o_orderstatus AS repo FROM orders JOIN customer ON o_custkey = c_custkey),
ch AS (SELECT l_orderkey AS hash, l_partkey AS path, l_quantity::BIGINT AS insertions, l_linenumber::BIGINT AS deletions FROM lineitem)"""
_EXT = "lower(regexp_extract(regexp_extract(source_path, '[^/]*$'), '^.+\\.([^.]*)$', 1))"


def _lookup(i: int) -> str:
    rows = ", ".join(f"('{e}', '{v[i]}')" for e, v in L.by_extension().items())
    return f"(SELECT v FROM (VALUES {rows}) m(e, v) WHERE m.e = {_EXT})"


_FMT = "CASE WHEN {e} = 'pdf' THEN 'pdf' WHEN {e} IN ('md', 'markdown') THEN 'markdown' WHEN {e} IN ('json', 'jsonc') THEN 'json' WHEN {e} IN ('py','js','rs','ts','go','kt','java','cpp','h','sh','bash','c','toml','ini','yaml','yml','conf','txt') THEN 'text' END"
_KW = "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with(lower(text), '{w[1:]}')" if w[0] == "^" else f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{t}'" for t, ws in C.RULES) + " ELSE 'unknown' END"
_CONV = f"nullif(regexp_extract(split_part(text, chr(10), 1), '^({'|'.join(C.TYPES)})(\\(.+\\))?!?:', 1), '')"
_EXCL = "|".join(x.replace(".", "\\.") for x in L.EXCLUDED)
_NAMES = ", ".join(f"'{x}'" for x in L.EXCLUDED)

_TRIM = "trim({c}, ' ' || chr(9) || chr(13) || chr(10))"
_LFOFF = "CASE WHEN suffix({c}, chr(10)) THEN left({c}, length({c}) - 1) ELSE {c} END"
_DIFF = f"""sp AS (SELECT doc_id AS id, text, regexp_split_to_array(text, '(?m)^diff --git ') AS p FROM documents WHERE text IS NOT NULL),
cm AS (SELECT id, {_TRIM.format(c='p[1]')} AS message, substr(text, length(p[1]) + 1) AS diff_text, p FROM sp WHERE len(p) > 1),
pa AS (SELECT id, pos::INT AS pos, {_LFOFF.format(c="('diff --git ' || p[pos + 2])")} AS part FROM (SELECT id, p, unnest(range(0, len(p) - 1)) AS pos FROM cm)),
pb AS (SELECT id, pos, part, regexp_split_to_array(part, '(?m)^@@') AS h, split_part(part, chr(10), 1) AS line FROM pa),
df AS (SELECT id, pos, coalesce(string_split(line, ' b/')[2], nullif(regexp_extract(string_split(line, ' a/')[2], '^\\s*(\\S+)', 1), ''), 'unknown') AS file_path,
  CASE WHEN len(h) > 1 THEN {_LFOFF.format(c='h[1]')} ELSE part END AS header, CASE WHEN len(h) > 1 THEN '@@' || array_to_string(h[2:], '@@') || chr(10) ELSE '' END AS content FROM pb),
hp AS (SELECT id, pos AS file_pos, file_path, i::INT AS hunk_pos, '@@' || h[i + 2] AS part FROM (SELECT *, unnest(range(0, len(h) - 1)) AS i FROM (SELECT id, pos, file_path, regexp_split_to_array(content, '(?m)^@@') AS h FROM df WHERE content <> ''))),
hl AS (SELECT *, list_filter(string_split(part, chr(10))[2:], lambda l: left(l, 1) IN ('+', '-', ' ', chr(92))) AS lines FROM hp),
hk AS (SELECT id, file_pos, file_path, hunk_pos, split_part(part, chr(10), 1) AS header, CASE WHEN len(lines) > 0 THEN array_to_string(lines, chr(10)) || chr(10) ELSE '' END AS content, lines FROM hl)"""
_DSTAT = f"""dp AS (SELECT id, count(DISTINCT file_path)::INT AS files_changed, list_sort(list(DISTINCT file_path)) AS paths, list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)) AS langs FROM (SELECT id, file_path, {_lookup(0).replace('source_path', 'file_path')} AS lang FROM df) GROUP BY 1),
dl AS (SELECT id, sum(len(list_filter(lines, lambda l: left(l, 1) = '+')))::BIGINT AS insertions, sum(len(list_filter(lines, lambda l: left(l, 1) = '-')))::BIGINT AS deletions FROM hk GROUP BY 1),
ds AS (SELECT cm.id, coalesce(files_changed, 0) AS files_changed, coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions, paths, coalesce(langs, []) AS langs FROM cm LEFT JOIN dp USING (id) LEFT JOIN dl USING (id))"""
_SUMM = "message || chr(10) || chr(10) || 'Files changed: ' || files_changed || ', Insertions: ' || insertions || ', Deletions: ' || deletions"
_MSG = "SELECT id, 0 AS chunk_index, 'message' AS chunk_type, NULL::VARCHAR AS file_path, {c} AS content FROM cm"
_CHUNKS = f"SELECT id, chunk_index, (count(*) OVER (PARTITION BY id))::INT AS total_chunks, chunk_type, file_path, {_lookup(0).replace('source_path', 'file_path')} AS language, content, floor(len({_words('content')})::FLOAT * 1.3::FLOAT)::INT AS tokens FROM rows WHERE chunk_type = 'message' OR content <> ''"
_ITOK = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) > 1)"
_CLS = f"coalesce({_CONV}, {_KW})".replace("text", "message")
_HIST = f"""hi AS (SELECT cm.id, message, sha256(cm.id::VARCHAR) AS commit_hash, '/srv/git/' || coalesce(source, 'none') AS repository_path, coalesce(source, 'none') AS repository_name, 'dev' || cm.id % 7 AS author_name, 'dev' || cm.id % 7 || '@x.org' AS author_email, loaded_at AS commit_time, {_CLS} AS classification FROM cm JOIN documents ON doc_id = cm.id)"""


def _short(c: str, tokens: int) -> str:
    n = T.words_for(tokens)
    return f"CASE WHEN len({_words(c)}) > {n} THEN array_to_string({_words(c)}[1:{n}], ' ') || '...' ELSE {c} END"


QUERIES = {f.__name__: f for f in (chunk_words, chunk_stats, chunk_bytes, chunk_sentences, window_commit_style, token_counts, estimate_tokens, truncate_tokens, normalize_text, collapse_ws, strip_nonprintable, sentence_stats, sentences_unicode, wrap_text, sha256_dups, line_counts, ext_language, format_detect, extension_preset, excluded_paths, classify_messages, diff_files, diff_hunks, commit_chunks_by_file, commit_chunks_by_hunk, commit_chunks_message, commit_chunks_window, commit_summary, commit_diff_stats, commit_chunks_summary, commit_payload, commit_type_filter, commit_search, commit_metadata, commit_text, developer_order, file_commits, rfc3339_times, developer_stats, developer_types, file_evolution, file_history, commit_range, max_commits_per_repo)}
SQL = {
    "chunk_words": f"WITH {_D}, src AS (SELECT doc_id AS id, {_words('text')} AS w FROM docs), {_windows('src', 512, 128)} SELECT id AS doc_id, i AS chunk_index, k AS total_chunks, len(c)::INT AS tokens, array_to_string(c, ' ') AS content FROM win",
    "chunk_stats": f"WITH src AS (SELECT id, {_words('content')} AS w FROM (SELECT DISTINCT id, content FROM source_documents)), {_windows('src', 100, 20)} SELECT id AS document_id, count(*) AS n, sum(len(c))::BIGINT AS tokens FROM win GROUP BY id",
    "chunk_bytes": "SELECT document_id, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM (SELECT DISTINCT id, document_id, content FROM chunks) GROUP BY 1",
    "window_commit_style": f"WITH {_D}, s AS (SELECT doc_id, {_words('text')} AS w FROM docs), x AS (SELECT doc_id, w, unnest(range(0, len(w), 295)) AS s FROM s) SELECT doc_id, (s // 295)::INT AS i, array_to_string(w[s + 1 : s + 393], ' ') AS content FROM x WHERE s = 0 OR len(w) - s >= 147",
    "token_counts": f"WITH {_D} SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))::INT AS tokens, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) > 1))::INT AS indexed, len({_words('text')})::INT AS words, strlen(text)::INT AS bytes, length(text)::INT AS chars FROM docs",
    "estimate_tokens": f"WITH {_D} SELECT doc_id, floor(len({_words('text')})::FLOAT * 1.3::FLOAT)::INT AS tokens FROM docs",
    "truncate_tokens": f"WITH {_D}, s AS (SELECT doc_id, text, {_words('text')} AS w FROM docs) SELECT doc_id, CASE WHEN len(w) > 30 THEN array_to_string(w[1:30], ' ') || '...' ELSE text END AS short FROM s",
    "normalize_text": f"WITH {_D}, n AS (SELECT doc_id, regexp_replace(nfc_normalize(text), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g') AS text FROM docs) SELECT doc_id, array_to_string({_words('text')}, ' ') AS text FROM n",
    "collapse_ws": f"WITH {_D} SELECT doc_id, array_to_string({_words('text')}, ' ') AS text FROM docs",
    "strip_nonprintable": f"WITH {_D} SELECT doc_id, regexp_replace(text, '[\\x{{00}}-\\x{{08}}\\x{{0e}}-\\x{{1f}}\\x{{7f}}-\\x{{84}}\\x{{86}}-\\x{{9f}}]', '', 'g') AS text FROM docs",
    "sentence_stats": "SELECT item_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::INT AS n FROM eval_items",
    "sha256_dups": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "line_counts": "SELECT id, (length(content) - length(replace(content, chr(10), '')) + CASE WHEN content = '' OR suffix(content, chr(10)) THEN 0 ELSE 1 END)::INT AS lines FROM (SELECT DISTINCT id, content FROM source_documents)",
    "ext_language": f"SELECT source_path, {_lookup(0)} AS lang, {_lookup(2)} AS category, coalesce({_lookup(2)} IN ('programming', 'shell', 'query'), false) AS is_code FROM (SELECT DISTINCT source_path FROM source_documents)",
    "format_detect": f"SELECT {_FMT.format(e=_EXT)} AS format, count(*) AS n FROM (SELECT DISTINCT source_path FROM source_documents) GROUP BY 1",
    "extension_preset": f"SELECT DISTINCT source_path FROM source_documents WHERE {_EXT} IN ({', '.join(repr(x) for x in (L.CODE_PRESET + ' ' + L.DOCS_PRESET + ' pdf').split())})",
    "excluded_paths": f"SELECT DISTINCT source_path FROM scan_entries WHERE regexp_matches(source_path, '/(?:{_EXCL})/') OR regexp_extract(source_path, '[^/]*$') IN ({_NAMES})",
    "classify_messages": f"SELECT doc_id, coalesce({_CONV}, {_KW}) AS type, {_CONV} AS conventional FROM documents WHERE text IS NOT NULL",
    "diff_files": f"WITH {_DIFF} SELECT id, pos, file_path, header, content FROM df",
    "diff_hunks": f"WITH {_DIFF} SELECT id, file_path, hunk_pos, header, content FROM hk",
    "commit_chunks_message": f"WITH {_DIFF}, rows AS ({_MSG.format(c='message')}) {_CHUNKS}",
    "commit_chunks_summary": f"WITH {_DIFF}, {_DSTAT}, rows AS (SELECT id, 0 AS chunk_index, 'message' AS chunk_type, NULL::VARCHAR AS file_path, {_SUMM} AS content FROM cm JOIN ds USING (id)) {_CHUNKS}",
    "commit_chunks_by_file": f"WITH {_DIFF}, rows AS ({_MSG.format(c='message')} UNION ALL SELECT id, pos + 1, 'diff_content', file_path, {_short('x', 512)} FROM (SELECT *, 'File: ' || file_path || chr(10) || header || chr(10) || content AS x FROM df)) {_CHUNKS}",
    "commit_chunks_by_hunk": f"WITH {_DIFF}, rows AS ({_MSG.format(c='message')} UNION ALL SELECT id, (row_number() OVER (PARTITION BY id ORDER BY file_pos, hunk_pos))::INT, 'diff_content', file_path, {_short('x', 512)} FROM (SELECT *, 'File: ' || file_path || chr(10) || header || chr(10) || content AS x FROM hk)) {_CHUNKS}",
    "commit_chunks_window": f"WITH {_DIFF}, ww AS (SELECT id, w, unnest(range(0, len(w), 12)) AS s FROM (SELECT id, {_words('diff_text')} AS w FROM cm)), rows AS ({_MSG.format(c='message')} UNION ALL SELECT id, (s // 12 + 1)::INT, 'diff_content', NULL, array_to_string(w[s + 1 : s + 15], ' ') FROM ww WHERE s = 0 OR len(w) - s >= 6) {_CHUNKS}",
    "commit_diff_stats": f"WITH {_DIFF}, {_DSTAT} SELECT id, files_changed, insertions, deletions, array_to_string(paths, ',') AS paths, array_to_string(langs, ',') AS languages FROM ds",
    "commit_payload": f"WITH {_DIFF}, {_DSTAT}, {_HIST} SELECT commit_hash, repository_name, repository_path, 'message' AS chunk_type, 0 AS chunk_index, 1 AS total_chunks, author_name, author_email, author_name AS committer_name, author_email AS committer_email, commit_time, classification, files_changed AS files_changed_count, insertions, deletions, array_to_string(paths, ', ') AS file_paths, {_SUMM} AS text FROM hi JOIN ds USING (id)",
    "commit_type_filter": f"WITH {_DIFF}, {_HIST} SELECT commit_hash, classification FROM hi WHERE classification = 'fix' AND author_email = 'dev3@x.org'",
    "commit_search": f"""WITH {_DIFF}, {_HIST}, tok AS (SELECT commit_hash, sha256(repository_path || '#' || commit_hash || '#0') AS id, classification, {_ITOK.format(c='message')} AS t FROM hi),
stats AS (SELECT id, len(t) AS dl FROM tok), post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY 1, 2), co AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_ITOK.format(c="'" + COMMIT_QUERY + "'")}) AS term) GROUP BY 1), dfr AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
h AS (SELECT id, sum(q.qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN q USING (term) JOIN dfr USING (term) JOIN stats USING (id) CROSS JOIN co GROUP BY id)
SELECT commit_hash, round(score, 6) AS score FROM h JOIN tok USING (id) WHERE classification = 'docs' QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, id) <= 10""",
    "commit_metadata": f"""WITH {_DIFF}, {_DSTAT}, {_HIST}, x AS (SELECT hi.*, sha256(repository_path || '#' || commit_hash || '#0') AS pid, insertions, deletions, array_to_string(paths, ', ') AS fp FROM hi JOIN ds USING (id))
SELECT pid AS id, k.key, k.value FROM (SELECT pid, unnest([struct_pack(key := 'commit_hash', value := commit_hash), struct_pack(key := 'author_name', value := author_name), struct_pack(key := 'author_email', value := author_email), struct_pack(key := 'commit_time', value := strftime(timezone('UTC', commit_time), '%Y-%m-%dT%H:%M:%SZ')), struct_pack(key := 'classification', value := classification), struct_pack(key := 'insertions', value := insertions::VARCHAR), struct_pack(key := 'deletions', value := deletions::VARCHAR), struct_pack(key := 'repository_name', value := repository_name), struct_pack(key := 'file_paths', value := nullif(fp, ''))]) AS k FROM x) WHERE k.value IS NOT NULL""",
    "chunk_sentences": f"""WITH RECURSIVE p AS (SELECT doc_id::VARCHAR AS d, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: {_words('x')}), lambda x: len(x) > 0) AS s FROM documents WHERE text <> ''),
r(d, i, cur, done) AS (SELECT d, 0, []::VARCHAR[], []::VARCHAR[] FROM p UNION ALL
  SELECT d, i + 1, CASE WHEN len(x) > 64 THEN [] ELSE list_concat(list_concat(c, x[1 : len(x) - 1]), [x[len(x)] || '.']) END,
    CASE WHEN len(x) > 64 THEN list_concat(list_concat(o, CASE WHEN len(c) > 0 THEN [array_to_string(c, ' ')] ELSE [] END), list_transform(range(0, len(x) - 16, 48), lambda k: array_to_string(x[k + 1 : k + 64], ' '))) ELSE o END
  FROM (SELECT r.d, i, x, CASE WHEN len(cur) > 0 AND len(cur) + len(x) > 64 THEN list_concat(done, [array_to_string(cur, ' ')]) ELSE done END AS o, CASE WHEN len(cur) > 0 AND len(cur) + len(x) > 64 THEN cur[-8:] ELSE cur END AS c FROM (SELECT r.*, p.s[r.i + 1] AS x FROM r JOIN p USING (d) WHERE r.i < len(p.s)) r)),
f AS (SELECT r.d, CASE WHEN len(cur) > 0 THEN list_concat(done, [array_to_string(cur, ' ')]) ELSE done END AS c FROM r JOIN p ON p.d = r.d AND r.i = len(p.s))
SELECT d AS document_id, (unnest(range(0, len(c))))::INT AS chunk_index, unnest(c) AS content FROM f""",
    "commit_text": f"""WITH {_DIFF}, {_DSTAT}, {_HIST}, tok AS (SELECT hi.*, insertions, deletions, array_to_string(paths, ', ') AS fp, sha256(repository_path || '#' || commit_hash || '#0') AS pid, {_ITOK.format(c='message')} AS t FROM hi JOIN ds USING (id)),
stats AS (SELECT pid, len(t) AS dl FROM tok), post AS (SELECT term, pid, count(*) AS tf FROM (SELECT pid, unnest(t) AS term FROM tok) GROUP BY 1, 2), co AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_ITOK.format(c="'" + COMMIT_QUERY + "'")}) AS term) GROUP BY 1), dfr AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
h AS (SELECT pid, sum(q.qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN q USING (term) JOIN dfr USING (term) JOIN stats USING (pid) CROSS JOIN co GROUP BY pid QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, pid) <= 5),
x AS (SELECT *, {_words('message')} AS w FROM h JOIN tok USING (pid))
SELECT '[' || left(commit_hash, 7) || '] ' || classification || ': ' || split_part(message, chr(10), 1) || chr(10) || 'repository: ' || repository_name || chr(10) || 'author: ' || author_name || ' <' || author_email || '>' || chr(10) || 'date: ' || coalesce(strftime(timezone('UTC', commit_time), '%Y-%m-%dT%H:%M:%SZ'), 'unknown') || chr(10)
  || CASE WHEN fp <> '' THEN 'files: ' || fp || chr(10) ELSE '' END || 'changes: +' || insertions || ' -' || deletions || chr(10) || chr(10) || 'message:' || chr(10)
  || CASE WHEN len(w) = 0 THEN '  [empty]' ELSE '  ' || replace(list_reduce(w, lambda a, b: CASE WHEN strlen(split_part(a, chr(10), -1)) + strlen(b) + 1 <= 100 THEN a || ' ' || b ELSE a || chr(10) || b END), chr(10), chr(10) || '  ') END || chr(10) || repeat('-', 40) AS shown FROM x""",
    "developer_order": f"WITH {_CM} SELECT email, count(*) AS commit_count FROM cm GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "file_commits": f"WITH {_CM}, j AS (SELECT DISTINCT path, hash, email, name, time FROM ch JOIN cm USING (hash)) SELECT path, array_to_string(list(hash ORDER BY time DESC, hash DESC), ',') AS hashes, array_to_string(list_sort(list(DISTINCT name || ' <' || email || '>')), ',') AS contributors FROM j GROUP BY 1",
    "rfc3339_times": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN date_trunc('second', loaded_at) WHEN 1 THEN date_trunc('second', loaded_at) + INTERVAL 250 MILLISECOND - INTERVAL 2 HOUR END AS at FROM documents",
    "wrap_text": f"SELECT item_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE string_split(list_reduce(w, lambda acc, x: CASE WHEN strlen(split_part(acc, chr(10), -1)) + strlen(x) + 1 <= 60 THEN acc || ' ' || x ELSE acc || chr(10) || x END), chr(10)) END AS lines FROM (SELECT item_id, {_words('text')} AS w FROM eval_items)",
    "commit_summary": f"WITH {_CM}, s AS (SELECT hash, count(DISTINCT path) AS f, sum(insertions)::BIGINT AS i, sum(deletions)::BIGINT AS x FROM ch GROUP BY 1) SELECT hash, type || chr(10) || chr(10) || 'Files changed: ' || f || ', Insertions: ' || i || ', Deletions: ' || x AS content FROM cm JOIN s USING (hash)",
    "developer_stats": f"WITH {_CM}, p AS (SELECT hash, sum(insertions) AS i, sum(deletions) AS x FROM ch GROUP BY 1), b AS (SELECT email, arg_max(name, (time, hash)) AS name, count(*) AS commit_count, coalesce(sum(i), 0)::BIGINT AS insertions, coalesce(sum(x), 0)::BIGINT AS deletions, min(time) AS first_commit, max(time) AS last_commit FROM cm LEFT JOIN p USING (hash) GROUP BY 1), f AS (SELECT email, count(DISTINCT path) AS n FROM ch JOIN cm USING (hash) GROUP BY 1) SELECT b.*, coalesce(f.n, 0) AS files_modified FROM b LEFT JOIN f USING (email)",
    "developer_types": f"WITH {_CM} SELECT email, type, count(*) AS n FROM cm GROUP BY 1, 2",
    "file_evolution": f"WITH {_CM} SELECT path, count(DISTINCT hash) AS commits, sum(insertions + deletions)::BIGINT AS total_changes, count(DISTINCT name || ' <' || email || '>') AS contributors, min(time) AS first_change, max(time) AS last_change FROM ch JOIN cm USING (hash) GROUP BY 1",
    "file_history": f"WITH {_CM} SELECT hash, email, i AS insertions, x AS deletions FROM (SELECT hash, sum(insertions)::BIGINT AS i, sum(deletions)::BIGINT AS x FROM ch WHERE path = 1 GROUP BY 1) JOIN cm USING (hash)",
    "commit_range": f"WITH {_CM} SELECT hash, email FROM cm WHERE time >= '1995-01-01' AND time <= '1995-12-31 23:59:59'",
    "max_commits_per_repo": f"WITH {_CM} SELECT repo, hash, row_number() OVER (PARTITION BY repo ORDER BY time DESC, hash)::INT AS rn FROM cm QUALIFY rn <= 50",
}
