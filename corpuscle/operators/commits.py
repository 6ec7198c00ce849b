"""Commits: their diffs as files and hunks, chunks of them, and statistics by developer and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import lang as L
from corpuscle.functions import text as T
from corpuscle.functions.text import col
from corpuscle.operators import chunking

STRATEGIES = ("message", "summary", "file", "hunk", "window")


def diff_path(line: str | Column) -> Column:
    """The new path of a "diff --git" line, else its old one, else "unknown"."""
    c = col(line)
    b, a = F.try_element_at(F.split(c, " b/"), F.lit(2)), F.try_element_at(F.split(c, " a/"), F.lit(2))
    return F.coalesce(b, F.nullif(F.regexp_extract(a, r"^\s*(\S+)", 1), F.lit("")), F.lit("unknown"))


def split_message(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, message, diff_text)``: a text up to its first "diff --git" line, trimmed, and from there on."""
    at = F.expr(f"regexp_instr(`{text}`, '(?md)^diff --git ')")
    body = F.expr(f"substr(`{text}`, regexp_instr(`{text}`, '(?md)^diff --git '))")
    cut_ = F.expr(f"substr(`{text}`, 1, regexp_instr(`{text}`, '(?md)^diff --git ') - 1)")
    return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), T.collapse_ends(F.when(at > 0, cut_).otherwise(F.col(text))).alias("message"), F.when(at > 0, body).otherwise("").alias("diff_text"))


def _line_off(c: Column) -> Column:
    """Without one line end at the end."""
    return F.when(F.endswith(c, F.lit("\n")), F.substring(c, 1, F.length(c) - 1)).otherwise(c)


def file_diffs(commits: DataFrame, key: str, diff: str) -> DataFrame:
    """``(key, pos, file_path, header, content)`` of each file of each diff; what stands before the first is left out.

    Files begin at lines with "diff --git ", contents at the first line with "@@"; only line feeds end lines.
    """
    parts = F.filter(F.split(col(diff), r"(?md)(?=^diff --git )"), lambda p: F.startswith(p, F.lit("diff --git ")))
    p = commits.select(key, F.posexplode(parts).alias("pos", "part")).withColumn("part", _line_off(F.col("part")))
    at = F.expr("regexp_instr(part, '(?md)^@@')")
    head = F.when(at > 0, _line_off(F.substring("part", F.lit(1), at - 1))).otherwise(F.col("part"))
    body = F.when(at > 0, F.concat(F.expr("substr(part, regexp_instr(part, '(?md)^@@'))"), F.lit("\n"))).otherwise(F.lit(""))
    return p.select(key, "pos", diff_path(F.substring_index("part", "\n", 1)).alias("file_path"), head.alias("header"), body.alias("content"))


def hunks(commits: DataFrame, key: str, diff: str) -> DataFrame:
    """``(key, file_pos, hunk_pos, file_path, header, content)``: of each hunk its mark and the diff's lines."""
    f = file_diffs(commits, key, diff).where("content <> ''")
    h = f.select(key, F.col("pos").alias("file_pos"), "file_path", F.posexplode(F.filter(F.split("content", r"(?md)(?=^@@)"), lambda x: F.startswith(x, F.lit("@@")))).alias("hunk_pos", "part"))
    all_ = F.split("part", "\n")
    lines = F.filter(F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0))), lambda l: F.substring(l, 1, 1).isin("+", "-", " ", "\\"))
    text = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return h.select(key, "file_pos", "hunk_pos", "file_path", F.substring_index("part", "\n", 1).alias("header"), text.alias("content"))


def diff_stats(commits: DataFrame, key: str = "id", diff: str = "diff_text") -> DataFrame:
    """``(key, files_changed, insertions, deletions, file_paths, languages)`` of every commit; paths and languages sorted, without repeats."""
    count = lambda c, sign: F.size(F.filter(F.split(c, "\n"), lambda l: F.startswith(l, F.lit(sign))))
    f = file_diffs(commits, key, diff).select(key, "file_path", L.language("file_path").alias("lang"))
    paths = f.groupBy(key).agg(F.count_distinct("file_path").cast("int").alias("files_changed"), F.array_sort(F.collect_set("file_path")).alias("file_paths"), F.array_sort(F.collect_set("lang")).alias("languages"))
    lines = hunks(commits, key, diff).groupBy(key).agg(F.sum(count(F.col("content"), "+")).alias("insertions"), F.sum(count(F.col("content"), "-")).alias("deletions"))
    none = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return commits.select(key).join(paths, key, "left").join(lines, key, "left").select(key, zero("files_changed"), zero("insertions"), zero("deletions"), F.coalesce("file_paths", none).alias("file_paths"), F.coalesce("languages", none).alias("languages"))


def summary(message: Column, files: Column, insertions: Column, deletions: Column) -> Column:
    return F.concat(message, F.lit("\n\nFiles changed: "), files.cast("string"), F.lit(", Insertions: "), insertions.cast("string"), F.lit(", Deletions: "), deletions.cast("string"))


def chunks(commits: DataFrame, strategy: str, size: int = 512, overlap: int = 128, key: str = "id") -> DataFrame:
    """``(key, chunk_index, total_chunks, chunk_type, file_path, language, content, tokens)`` by one of the strategies.

    Expects message and diff_text, and for summaries files_changed, insertions and deletions. A commit without
    what a strategy cuts gives its message only.
    """
    msg = commits.select(key, F.lit(0).alias("chunk_index"), F.lit("message").alias("chunk_type"), F.lit(None).cast("string").alias("file_path"), F.col("message").alias("content"))
    if strategy == "message":
        rows = msg
    elif strategy == "summary":
        rows = commits.select(key, F.lit(0).alias("chunk_index"), F.lit("message").alias("chunk_type"), F.lit(None).cast("string").alias("file_path"), summary(F.col("message"), F.col("files_changed"), F.col("insertions"), F.col("deletions")).alias("content"))
    elif strategy == "file":
        f = file_diffs(commits, key, "diff_text")
        text = T.truncate_to_tokens(F.concat(F.lit("File: "), "file_path", F.lit("\n"), "header", F.lit("\n"), "content"), size)
        rows = msg.unionByName(f.select(key, (F.col("pos") + 1).alias("chunk_index"), F.lit("diff_content").alias("chunk_type"), "file_path", text.alias("content")))
    elif strategy == "hunk":
        w = Window.partitionBy(key).orderBy("file_pos", "hunk_pos")
        h = hunks(commits, key, "diff_text").withColumn("n", F.row_number().over(w))
        text = T.truncate_to_tokens(F.concat(F.lit("File: "), "file_path", F.lit("\n"), "header", F.lit("\n"), "content"), size)
        rows = msg.unionByName(h.select(key, F.col("n").alias("chunk_index"), F.lit("diff_content").alias("chunk_type"), "file_path", text.alias("content")))
    elif strategy == "window":
        w = commits.select(key, F.posexplode(chunking.commit_windows("diff_text", size, overlap)).alias("pos", "content"))
        rows = msg.unionByName(w.select(key, (F.col("pos") + 1).alias("chunk_index"), F.lit("diff_content").alias("chunk_type"), F.lit(None).cast("string").alias("file_path"), "content").where("content <> ''"))
    else:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    total = F.count(F.lit(1)).over(Window.partitionBy(key)).cast("int")
    return rows.select(key, "chunk_index", total.alias("total_chunks"), "chunk_type", "file_path", L.language("file_path").alias("language"), "content", T.estimate_tokens("content").alias("tokens"))


def developer_stats(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per email: name of the newest commit, commits, insertions, deletions, distinct files, first and last time.

    ``commits(hash, email, name, time)``, ``changes(hash, path, insertions, deletions)``. Changes are summed per
    commit before the join, so its rows are the commits'.
    """
    per = changes.groupBy("hash").agg(F.sum("insertions").alias("ins"), F.sum("deletions").alias("dels"))
    base = commits.join(per, "hash", "left").groupBy("email").agg(
        F.max_by("name", F.struct("time", "hash")).alias("name"), F.count(F.lit(1)).alias("commit_count"), F.coalesce(F.sum("ins"), F.lit(0)).alias("insertions"), F.coalesce(F.sum("dels"), F.lit(0)).alias("deletions"), F.min("time").alias("first_commit"), F.max("time").alias("last_commit"))
    files = changes.join(commits.select("hash", "email"), "hash").groupBy("email").agg(F.count_distinct("path").alias("files_modified"))
    return base.join(files, "email", "left").withColumn("files_modified", F.coalesce("files_modified", F.lit(0)))


def by_commits(stats: DataFrame) -> DataFrame:
    """Developers with the most commits first, ties by email."""
    return stats.orderBy(F.desc("commit_count"), "email")


def developer_types(commits: DataFrame) -> DataFrame:
    """``(email, types)``: how many commits of each type, as a map."""
    t = commits.groupBy("email", "type").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("email").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))


def file_evolution(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per path: commits, all changed lines, contributors, first and last time. Distinct commits are counted, as a commit may list a path twice."""
    j = changes.join(commits.select("hash", "email", "name", "time"), "hash")
    return j.groupBy("path").agg(
        F.count_distinct("hash").alias("commits"), F.sum(F.col("insertions") + F.col("deletions")).alias("total_changes"),
        F.count_distinct(F.concat("name", F.lit(" <"), "email", F.lit(">"))).alias("contributors"), F.min("time").alias("first_change"), F.max("time").alias("last_change"))


def file_commits(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per path: its commits, newest first, and its contributors by name, sorted. As large as the path's own history."""
    j = changes.select("hash", "path").distinct().join(commits.select("hash", "email", "name", "time"), "hash")
    return j.groupBy("path").agg(
        F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("time", "hash")))), lambda x: x["hash"]).alias("hashes"),
        F.array_sort(F.collect_set(F.concat("name", F.lit(" <"), "email", F.lit(">")))).alias("contributors"))


def file_history(commits: DataFrame, changes: DataFrame, path) -> DataFrame:
    """The commits of one path, newest first."""
    return changes.where(F.col("path") == path).groupBy("hash").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions")).join(commits, "hash").orderBy(F.desc("time"), "hash")


def newest_per_repo(commits: DataFrame, repo: str, most: int) -> DataFrame:
    w = Window.partitionBy(repo).orderBy(F.desc("time"), F.asc("hash"))
    return commits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
