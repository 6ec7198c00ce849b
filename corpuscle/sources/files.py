"""Files as rows: walking directories, decoding texts, repositories and commits."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import lang as L
from corpuscle.functions.display import basename, extension
from corpuscle.functions.text import col
from corpuscle.sources import ignore, pdf

MAX_SIZE = 10 * 1024 * 1024


def _below(roots: list[str]) -> Column:
    """A path without its root: exclusions are about what lies below."""
    return F.regexp_replace("source_path", "^(?:" + "|".join(re.escape(r.removeprefix("file:").rstrip("/")) for r in roots) + ")", "")


def candidates(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, honor_excluded: bool = True, honor_ignore: bool = False) -> DataFrame:
    """``(source_path, file_size_bytes, modified_at)`` of the files below the roots; contents aren't read.

    Roots that aren't folders are left out. A mounted file system is walked by the tasks, hidden files included, and
    excluded or ignored folders (those that ignore files name, with ``honor_ignore``) aren't entered.
    """
    roots = [r for r in roots if _is_dir(spark, r)]
    schema = "source_path string, file_size_bytes long, modified_at timestamp"
    if not roots:
        return spark.createDataFrame([], schema)
    if all(r.startswith(("/", "file:")) for r in roots):
        local = [os.path.abspath(re.sub("^file:/*", "/", r)) for r in roots]
        tops, files = _spread(local, 4 * spark.sparkContext.defaultParallelism, honor_excluded, honor_ignore)
        f = spark.createDataFrame(tops or [("", "")], "root string, top string").repartition(max(1, len(tops))).mapInPandas(_walk(honor_excluded, honor_ignore), "source_path string, file_size_bytes long, modified long")
        f = f.unionByName(spark.createDataFrame(files, "source_path string, file_size_bytes long, modified long")).distinct().select("source_path", "file_size_bytes", F.timestamp_micros("modified").alias("modified_at"))
    else:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select(F.regexp_replace("path", "^file:/*", "/").alias("source_path"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified_at"))
        f = f.where(~L.excluded(_below(roots))) if honor_excluded else f
    if extensions:
        f = f.where(extension("source_path").isin(L.expand_extensions(extensions)))
    return f.where("file_size_bytes > 0")


def _list(folder: str, rules: ignore.Rules | None, honor_excluded: bool) -> tuple[list[str], list[tuple]]:
    """Folders and files right below a folder that nothing leaves out; what can't be read is left out."""
    dirs, files = [], []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return dirs, files
    for e in entries:
        try:
            is_dir = e.is_dir(follow_symlinks=False)
            if (honor_excluded and e.name in L.EXCLUDED) or (rules is not None and rules.ignored(e.path, is_dir)):
                continue
            if is_dir:
                dirs.append(e.path)
            elif e.is_file():
                st = e.stat()
                files.append((e.path, st.st_size, st.st_mtime_ns // 1000))
        except OSError:
            continue
    return dirs, files


def _rules(root: str, folder: str) -> ignore.Rules:
    """The rules of a folder and of those above it up to the root."""
    r = ignore.Rules(None, root)
    at = root
    for part in os.path.relpath(folder, root).split(os.sep):
        if part != ".":
            at = os.path.join(at, part)
            r = ignore.Rules(r, at)
    return r


def _spread(roots: list[str], enough: int, honor_excluded: bool, honor_ignore: bool, depth: int = 4) -> tuple[list[tuple[str, str]], list[tuple]]:
    """Folders to walk, enough for all tasks, and the files above them."""
    tops, files = [(r, r) for r in roots], []
    for _ in range(depth):
        if len(tops) >= enough:
            break
        below = []
        for root, top in tops:
            d, f = _list(top, _rules(root, top) if honor_ignore else None, honor_excluded)
            below += [(root, x) for x in d]
            files += f
        tops = below
    return tops, files


def _walk(honor_excluded: bool, honor_ignore: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for root, top in zip(b.root, b.top):
                todo, rows = [(top, _rules(root, top) if honor_ignore else None)] if top else [], []
                while todo:
                    folder, rules = todo.pop()
                    dirs, files = _list(folder, rules, honor_excluded)
                    rows += files
                    todo += [(d, ignore.Rules(rules, d) if rules is not None else None) for d in dirs]
                    if len(rows) > 10_000:
                        yield pd.DataFrame(rows, columns=["source_path", "file_size_bytes", "modified"])
                        rows = []
                yield pd.DataFrame(rows, columns=["source_path", "file_size_bytes", "modified"])

    return run


def _is_dir(spark: SparkSession, root: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _decode(raw: bytes | None) -> tuple[str | None, str | None]:
    """``(text, error)``: UTF-8, else UTF-16 by its mark or its zero bytes, else UTF-8 with gaps unless binary."""
    if raw is None:
        return None, "missing"
    try:
        return raw.decode("utf-8"), None
    except UnicodeDecodeError:
        pass
    kind = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(raw[:2])
    if kind:
        return raw[2 : len(raw) // 2 * 2].decode(kind, "replace"), None
    head = raw[:100]
    if len(head) >= 4:
        odd, even = head[1::2].count(0) / len(head[1::2]), head[::2].count(0) / len(head[::2])
        if odd > 0.4 or even > 0.4:
            return raw[: len(raw) // 2 * 2].decode("utf-16-le" if odd > 0.4 else "utf-16-be", "replace"), None
    control = sum(b < 9 or (13 < b < 32 and b != 27) for b in raw)
    if control > 0.1 * len(raw):
        return None, "binary"
    return raw.decode("utf-8", "replace"), None


def decoded(content: str | Column) -> Column:
    """``struct(text, error)`` of a binary column."""

    @F.pandas_udf("text string, error string")
    def f(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decode(x) for x in s], columns=["text", "error"])

    return f(col(content))


def load(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, max_size: int = MAX_SIZE) -> DataFrame:
    """Documents ``(id, source_path, file_hash, content, metadata, error)``; what can't be read has its reason in error."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select(F.regexp_replace("path", "^file:/*", "/").alias("source_path"), F.col("length").alias("size_bytes"), "content")
    f = f.where(~L.excluded(_below(roots)) & (F.col("size_bytes") > 0))
    if extensions:
        f = f.where(extension("source_path").isin(L.expand_extensions(extensions)))
    kind = L.document_format("source_path")
    read = F.when((F.col("size_bytes") <= max_size) & kind.isNotNull(), F.col("content"))  # else neither hashed nor decoded
    d = f.select("source_path", "size_bytes", kind.alias("format"), read.alias("raw"))
    pdf_pages = pdf.pages(d.where("format = 'pdf' AND raw IS NOT NULL"), "source_path", "raw")
    tags = [t.lower() for t in pdf.TAGS]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n\n")
    texts = pdf_pages.groupBy("source_path").agg(body.alias("pdf_text"), F.max("error").alias("pdf_error"), F.struct(*[F.max(t).alias(t) for t in tags]).alias("pdf_metadata"))
    d = d.select("source_path", "size_bytes", "format", F.sha2("raw", 256).alias("file_hash"), decoded(F.when(F.col("format") != "pdf", F.col("raw"))).alias("d")).join(texts, "source_path", "left")
    is_pdf = F.col("format") == "pdf"
    text = F.when(is_pdf, F.col("pdf_text")).otherwise(F.col("d.text"))
    error = F.when(F.col("size_bytes") > max_size, "too large").when(F.col("format").isNull(), "unsupported format").when(is_pdf, F.col("pdf_error")).otherwise(F.col("d.error"))
    error = F.coalesce(error, F.when((F.col("format") == "json") & relaxed_json(text).isNull(), "invalid JSON"))
    meta = F.struct(basename("source_path").alias("filename"), "format", "size_bytes", F.current_timestamp().alias("loaded_at"), "pdf_metadata")
    return d.select(F.sha2("source_path", 256).alias("id"), "source_path", "file_hash", F.when(error.isNull(), text).alias("content"), meta.alias("metadata"), error.alias("error"))


def relaxed_json(text: str | Column) -> Column:
    """A variant of JSON with comments and trailing commas; null if it can't be read even so."""
    string = r'("(?:[^"\\]|\\.)*")'
    t = F.regexp_replace(col(text), string + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.try_parse_json(F.regexp_replace(t, string + r"|,(?=\s*[}\]])", "$1"))


def repo_of(files: DataFrame, path: str, repos: DataFrame, root: str) -> DataFrame:
    """The files with the nearest repository above them, null without one."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = files.select(path, F.explode(above).alias("__up")).join(repos.select(F.col(root).alias("__up")).distinct(), "__up")
    return files.join(up.groupBy(path).agg(F.max_by("__up", F.length("__up")).alias("repo")), path, "left")


def find_repos(root: str, max_depth: int = 10) -> list[str]:
    """Repositories below a directory, by their real paths; excluded directories aren't entered."""
    out = set()
    for at, dirs, _ in os.walk(root):
        if ".git" in dirs or os.path.exists(os.path.join(at, ".git")):
            out.add(os.path.realpath(at))
        depth = os.path.relpath(at, root).count(os.sep) + (at != root)
        dirs[:] = [d for d in dirs if d not in L.EXCLUDED] if depth < max_depth else []
    return sorted(out)


COMMIT = "id string, repository_path string, message string, author_name string, author_email string, committer_name string, committer_email string, commit_time long, parent_hashes string, diff_text string, error string"


def _log(repo: str, args: list[str]) -> Iterator[tuple]:
    """Commits of ``git log`` as they come: one is held at a time. A failing repository gives one row with the error."""
    fmt = "%x1e%H%x1f%an%x1f%ae%x1f%cn%x1f%ce%x1f%ct%x1f%P%x1f%B%x1f"
    p = subprocess.Popen(["git", "-C", repo, "log", "--diff-merges=first-parent", "-p", "--unified=3", "--inter-hunk-context=0", f"--format={fmt}", *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    rest = b""

    def row(raw: bytes) -> tuple:
        h, name, mail, cname, cmail, when, parents, msg, diff = (raw.decode("utf-8", "replace").split("\x1f", 8) + [""] * 9)[:9]
        return h, repo, msg.strip(), name, mail, cname, cmail, int(when or 0), parents, diff.strip("\n"), None

    while block := p.stdout.read(1 << 20):
        *whole, rest = (rest + block).split(b"\x1e")
        yield from (row(x) for x in whole if x.strip())
    if rest.strip():
        yield row(rest)
    said = p.stderr.read().decode("utf-8", "replace")
    if p.wait() != 0:
        yield None, repo, None, None, None, None, None, None, None, None, said.strip() or f"git ended with {p.returncode}"


def commits(spark: SparkSession, repos: list[str], most: int = 1000, since: str | None = None, hash_: str | None = None) -> DataFrame:
    """Commits from each repository's head, newest first and merged branches included, with their diffs to the first parent.

    Older ones than ``since`` are skipped, not the end. With ``hash_`` that one commit. One task per repository, one
    row of ``error`` where a repository can't be read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in COMMIT.split(", ")]
        for b in batches:
            for repo in b.repo:
                args = ["-n", "1", hash_] if hash_ else ["-n", str(most)] + ([f"--since-as-filter={since}T00:00:00Z"] if since else [])
                part = []
                for r in _log(repo, args):
                    part.append(r)
                    if len(part) == 100:
                        yield pd.DataFrame(part, columns=names).astype({"commit_time": "Int64"})
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=names).astype({"commit_time": "Int64"})

    r = spark.createDataFrame([(x,) for x in repos], "repo string").repartition(max(1, len(repos)))
    return r.mapInPandas(read, COMMIT).withColumns({"commit_time": F.timestamp_seconds("commit_time"), "parent_hashes": F.filter(F.split("parent_hashes", " "), lambda x: x != "")})


def commit(spark: SparkSession, repo: str, hash_: str) -> DataFrame:
    """One commit by its hash."""
    return commits(spark, [repo], hash_=hash_)


def page_lines(pages: DataFrame, doc: str, page: str, text: str, height: str) -> DataFrame:
    """Lines of extracted page texts, with a plain geometry: font 12, 15 points a line, blank ones counted but left out."""
    l = pages.select(F.col(doc).alias("doc_id"), F.col(page).alias("page_number"), F.col(height).alias("page_height"), F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    return l.where("trim(text) <> ''").select("doc_id", "page_number", "line_no", "text", F.lit(12.0).alias("font_size"), (F.col("page_height") - F.col("line_no") * 15).alias("y"), "page_height", F.lit(False).alias("is_ocr"))
