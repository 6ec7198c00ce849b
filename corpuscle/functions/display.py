"""Labels, citations and sizes as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.text import col
from corpuscle.errors import QueryError

MODES = ("full", "basename", "hash", "redact")


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: str | Column) -> Column:
    """Lower-case extension; null without one (a leading dot starts no extension)."""
    return F.nullif(F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)), F.lit(""))


def citation(path: str | Column) -> Column:
    """The file's name without its extension, "unknown" without a name."""
    b = basename(path)
    stem = F.when(b.rlike(r"^.+\.[^.]*$"), F.regexp_extract(b, r"^(.+)\.[^.]*$", 1)).otherwise(b)
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("unknown"))


def hash_label(c: str | Column, secret: str = "") -> Column:
    return F.concat(F.lit("src_"), F.substring(F.sha2(F.concat(F.lit(secret), col(c)), 256), 1, 12))


def show_source(c: str | Column, mode: str = "full", secret: str = "") -> Column:
    s = F.coalesce(col(c), F.lit("unknown"))
    if mode == "full":
        return s
    if mode == "basename":
        return F.coalesce(F.nullif(basename(s), F.lit("")), F.lit("unknown"))
    if mode == "hash":
        return hash_label(s, secret)
    if mode == "redact":
        return F.lit("redacted")
    raise QueryError(f"mode must be one of {MODES}")


def show_citation(cited: str | Column, source: str | Column, mode: str = "full", secret: str = "") -> Column:
    if mode in ("full", "basename"):
        return col(cited)
    return show_source(F.coalesce(col(source), col(cited)), mode, secret)


def bytes_short(n: str | Column) -> Column:
    """Five characters: bytes, whole KiB, or MiB and GiB with one decimal."""
    n, k = col(n), 1024
    s = (
        F.when(n >= k**3, F.concat(F.format_string("%.1f", n / k**3), F.lit("g")))
        .when(n >= k**2, F.concat(F.format_string("%.1f", n / k**2), F.lit("m")))
        .when(n >= k, F.concat(F.floor(n / k).cast("string"), F.lit("k")))
        .otherwise(F.concat(n.cast("string"), F.lit("b")))
    )
    return F.when(F.length(s) < 5, F.lpad(s, 5, " ")).otherwise(s)


def scan_message(files: str | Column, size: str | Column, path: str | Column) -> Column:
    return F.concat(col(files).cast("string"), F.lit(" files "), col(size).cast("string"), F.lit(" bytes "), col(path))


def first_line(c: str | Column) -> Column:
    return F.substring_index(col(c), "\n", 1)


def scope_key(paths: str | Column, extensions: str | Column, git_only: bool, honor_ignore: bool) -> Column:
    """The canonical name of a scan's scope."""
    t = lambda b: "true" if b else "false"
    return F.concat(F.lit("paths="), F.array_join(F.sort_array(col(paths)), "|"), F.lit(";ext="), F.array_join(F.sort_array(col(extensions)), "|"), F.lit(f";git_only={t(git_only)};honor_gitignore={t(honor_ignore)}"))
