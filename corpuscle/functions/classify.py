"""Types of commits by their messages, and statuses of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.display import first_line
from corpuscle.functions.text import col

#: Types, in the order of the keyword rules, with what a message of the type contains.
RULES = (
    ("test", ("test",)),
    ("fix", ("fix", "bug", "patch", "hotfix")),
    ("refactor", ("refactor", "restructure", "clean up")),
    ("docs", ("docs", "documentation", "readme")),
    ("feat", ("add", "implement", "feature")),
    ("chore", ("chore", "maintenance", "deps", "depend")),
    ("style", ("style", "format", "lint")),
    ("perf", ("perf", "performance", "optimize")),
    ("ci", ("github actions", "workflow", "pipeline", " ci ", "^ci ", " ci/")),
    ("build", ("build", "compile", "cargo")),
    ("revert", ("revert",)),
)
TYPES = tuple(t for t, _ in RULES)
#: Other spellings of types.
ALIASES = {"feature": "feat", "refact": "refactor", "doc": "docs", "performance": "perf"}


def conventional_type(message: str | Column) -> Column:
    """The type that the first line names in the conventional form; null otherwise."""
    return F.nullif(F.regexp_extract(first_line(message), r"^(" + "|".join(TYPES) + r")(\(.+\))?!?:", 1), F.lit(""))


def keyword_type(message: str | Column) -> Column:
    low = F.lower(col(message))
    out = F.lit("unknown")
    for t, words in reversed(RULES):
        out = F.when(low.rlike("|".join(words)), F.lit(t)).otherwise(out)
    return out


def commit_type(message: str | Column) -> Column:
    return F.coalesce(conventional_type(message), keyword_type(message))


def parse_type(c: str | Column) -> Column:
    low = F.lower(col(c))
    out = F.when(low.isin(list(TYPES)), low).otherwise(F.lit("unknown"))
    for a, t in ALIASES.items():
        out = F.when(low == a, F.lit(t)).otherwise(out)
    return out


def parse_status(c: str | Column) -> Column:
    """pending, processing, completed or failed; whatever else counts as failed."""
    low = F.lower(F.trim(col(c)))
    return F.when(low.isin("completed", "complete"), "completed").when(low.isin("pending", "processing"), low).otherwise("failed")
