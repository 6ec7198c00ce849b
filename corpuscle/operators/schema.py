"""Schemas of JSON: inferred as rows of paths, with hints, as JSON Schema and as DDL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.errors import SchemaError

EXAMPLES = 3
#: Parts of key names that hint at times and at folders.
TIME_PARTS = ("date", "time", "updated", "created")
FOLDER_PARTS = ("folder", "path", "group", "category", "tag")


_LEAF = r'(^|\.)("(?:[^"\\]|\\.)*"|[^."]*)$'


def _part(key: str) -> str:
    """A key as part of a path; quoted where it would be read as something else."""
    return json.dumps(key, ensure_ascii=False) if "." in key or '"' in key or key in ("", "[]") else key


def split_path(path: str) -> tuple[str, str]:
    """The parent's path and the key of a path's last part; arrays have the part []."""
    m = re.search(_LEAF, path)
    last = m.group(2)
    return path[: m.start()], json.loads(last) if last.startswith('"') else last


def _walk(v, path: str) -> Iterator[tuple[str, str, str | None]]:
    kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
    yield path, kind, json.dumps(v, ensure_ascii=False) if kind in ("boolean", "number", "string") else None
    if kind == "object":
        for k, x in v.items():
            yield from _walk(x, f"{path}.{_part(k)}" if path else _part(k))
    elif kind == "array":
        for x in v:
            yield from _walk(x, f"{path}.[]" if path else "[]")


def json_values(docs: DataFrame, column: str) -> DataFrame:
    """``(path, type, n, example)``: how often each path has each type, counted per batch; texts that aren't JSON give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[tuple[str, str], list] = {}
            for t in b.iloc[:, 0]:
                try:
                    values = list(_walk(json.loads(t), "")) if t else ()
                except (ValueError, RecursionError):
                    continue
                for path, kind, example in values:
                    have = seen.setdefault((path, kind), [0, example])
                    have[0] += 1
                    if example is not None and example < have[1]:
                        have[1] = example
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["path", "type", "n", "example"])

    return docs.select(column).mapInPandas(run, "path string, type string, n long, example string")


def infer(docs: DataFrame, column: str) -> DataFrame:
    """``(path, types, n, required, examples)``: of each path its types, how often it stands, and whether wherever its parent does.

    Keys with dots or quotes stand quoted in a path. Only distinct paths, types and a few examples are gathered.
    """
    per = json_values(docs, column).groupBy("path", "type").agg(F.sum("n").alias("n"), F.min("example").alias("example"))
    g = per.groupBy("path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("n").alias("n"), F.max(F.when(F.col("type") == "object", F.col("n"))).alias("objects"), F.slice(F.array_sort(F.collect_set("example")), 1, EXAMPLES).alias("examples"))
    up = F.regexp_replace("path", _LEAF, "")
    parents = g.select(F.col("path").alias("up"), F.col("objects").alias("parent_objects"))
    j = g.withColumn("up", F.when(F.col("path") == "", None).otherwise(up)).join(parents, "up", "left")
    leaf = F.regexp_extract("path", _LEAF, 2)
    return j.select("path", "types", "n", F.coalesce((leaf != "[]") & (F.col("n") >= F.col("parent_objects")), F.lit(False)).alias("required"), "examples")


def _hint(parts: tuple[str, ...]) -> Column:
    key = F.lower(F.regexp_extract("path", _LEAF, 2))
    return (key != "[]") & (key != "") & key.rlike("|".join(parts))


def field_hints(paths: DataFrame) -> DataFrame:
    """``(kind, path)``: paths whose key hints at times (timestamps) or at folders."""
    return paths.where(_hint(TIME_PARTS)).select(F.lit("timestamps").alias("kind"), "path").unionByName(paths.where(_hint(FOLDER_PARTS)).select(F.lit("folders").alias("kind"), "path")).distinct()


def to_json_schema(paths: DataFrame) -> dict:
    """JSON Schema of inferred paths; a schema is as large as its paths, so they are read to the driver."""
    root: dict = {}
    nodes = {"": root}
    for r in paths.orderBy("path").toLocalIterator():
        node = nodes.setdefault(r.path, {})
        node["type"] = r.types[0] if len(r.types) == 1 else list(r.types)
        if r.examples:
            node["examples"] = [json.loads(x) for x in r.examples]
        if r.path:
            up, key = split_path(r.path)
            parent = nodes.setdefault(up, {})
            if r.path.endswith("[]") and not r.path.endswith('"'):
                parent["items"] = node
            else:
                parent.setdefault("properties", {})[key] = node
                if r.required:
                    parent.setdefault("required", []).append(key)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | root


_SQL_TYPES = {"string": "TEXT", "number": "DOUBLE PRECISION", "boolean": "BOOLEAN", "array": "JSONB", "object": "JSONB", "null": "TEXT"}


def to_ddl(paths: DataFrame, name: str) -> str:
    """A CREATE TABLE of the top-level keys; keys that hint at times become timestamps."""
    times = {r.path for r in field_hints(paths).where("kind = 'timestamps'").toLocalIterator()}
    cols = []
    for r in paths.where(F.expr("path <> '' AND path <> '[]'") & (F.regexp_replace("path", _LEAF, "") == "")).orderBy("path").toLocalIterator():
        kinds = [t for t in r.types if t != "null"] or ["string"]
        kind = "TIMESTAMPTZ" if r.path in times and kinds == ["string"] else _SQL_TYPES[kinds[0]] if len(kinds) == 1 else "JSONB"
        cols.append(f'  "{split_path(r.path)[1].replace(chr(34), chr(34) * 2)}" {kind}' + (" NOT NULL" if r.required and "null" not in r.types else ""))
    if not cols:
        raise SchemaError("there are no keys to make columns of")
    return f"CREATE TABLE {name} (\n" + ",\n".join(cols) + "\n);"


def create_table_of(text: str) -> str:
    """The CREATE TABLE statement of a model's answer, without the fence around it, up to a blank line."""
    t = re.sub(r"(?s)^\s*```\w*\s*\n(.*?)\n?```.*$", r"\1", text.strip())
    m = re.search(r"(?is)create\s+table\b.*?(?=\n\s*\n|\Z)", t)
    if not m:
        raise SchemaError("the text holds no CREATE TABLE")
    return m.group().strip()


def create_table_col(c: str | Column) -> Column:
    """The same as an expression, null where there is none."""
    t = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"(?m)^```\w*\s*$", "")
    return F.nullif(F.trim(F.regexp_extract(t, r"(?is)(create\s+table\b.*?)(\n\s*\n|$)", 1)), F.lit(""))


def with_retry(generate: Callable[[str], str], prompt: str, attempts: int = 3) -> str:
    """Ask a model for DDL; each failure's message goes into the next prompt."""
    said = prompt
    for k in range(attempts):
        try:
            return create_table_of(generate(said))
        except SchemaError as e:
            if k == attempts - 1:
                raise
            said = f"{prompt}\n\nThe last answer could not be used: {e}"
    raise SchemaError("no attempts")


class Placeholder:
    """Stands in for a language model: the DDL of what was inferred, the same for the same prompt."""

    def __init__(self, paths: DataFrame | None = None, name: str = "documents"):
        self.paths, self.name = paths, name

    def __call__(self, prompt: str) -> str:
        return to_ddl(self.paths, self.name) if self.paths is not None else "{}"


def backend(env: Mapping[str, str], have: Mapping[str, Callable[[str], str]] | None = None) -> str:
    """The backend that the environment asks for, else the first that it has a key or host for, else the placeholder.

    Only the placeholder is shipped; others are callables that the caller hands to ``generate``.
    """
    said = env.get("LLM_BACKEND", "").strip().lower()
    if said:
        return {"claude": "anthropic", "offline": "placeholder"}.get(said, said if said in ("ollama", "openai", "anthropic") else "placeholder")
    for key, name in (("ANTHROPIC_API_KEY", "anthropic"), ("OPENAI_API_KEY", "openai"), ("OLLAMA_HOST", "ollama")):
        if key in env:
            return name
    return "placeholder"


def hints_of(paths: DataFrame) -> dict[str, list[str]]:
    """Sorted names of the fields that hint at times and folders."""
    out: dict[str, list[str]] = {"timestamps": [], "folders": []}
    for r in field_hints(paths).orderBy("kind", "path").toLocalIterator():
        out[r.kind].append(r.path)
    return out


def ddl_prompt(schema: dict, hints: dict[str, list[str]]) -> str:
    """What a model is asked for: one CREATE TABLE for the schema, with the hints."""
    told = [f"{label}: {', '.join(hints[k])}" for k, label in (("timestamps", "fields that look like times"), ("folders", "fields that look like folders or tags")) if hints.get(k)]
    rules = ("have columns for address and title", "have time columns where the data has times", "keep folder or path columns where the data has them", "have a column for an embedding vector", "choose plain types and constraints, always the same for the same data", "answer with the statement only")
    return "Write one CREATE TABLE statement for this data:\n" + "".join(f"- {r}\n" for r in rules) + f"\nJSON Schema:\n{json.dumps(schema, indent=2, ensure_ascii=False)}\n\nHints:\n" + ("\n".join(told) or "none")


def enhanced(schema: dict, hints: dict[str, list[str]], generate: Callable[[str], str] | None = None) -> dict:
    """The schema with descriptions: a model's, or plain ones made from types and hints where none is given."""
    if generate is not None:
        told = "\n".join(f"{k}: {', '.join(v) or 'none'}" for k, v in hints.items())
        try:
            return json.loads(generate(f"Add a description to each field of this JSON Schema and answer with it only.\n\nHints:\n{told}\n\nSchema:\n{json.dumps(schema, indent=2, ensure_ascii=False)}"))
        except ValueError as e:
            raise SchemaError("the model's answer is no JSON") from e
    kind = {p: k for k, ps in hints.items() for p in ps}

    def walk(node: dict, path: str) -> dict:
        t = node.get("type", "object")
        out = node | {"description": {"timestamps": "A point in time", "folders": "A folder, path or tag"}.get(kind.get(path), f"{' or '.join(t if isinstance(t, list) else [t])} value")}
        if "properties" in node:
            out["properties"] = {k: walk(v, f"{path}.{_part(k)}" if path else _part(k)) for k, v in node["properties"].items()}
        if "items" in node:
            out["items"] = walk(node["items"], f"{path}.[]" if path else "[]")
        return out

    return walk(schema, "")


def pretty(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def generate(docs: DataFrame, column: str, out: str, name: str = "documents", model: Callable[[str], str] | None = None, describe: bool = False) -> dict[str, str]:
    """Infer, hint, ask and write ``name.sql`` and ``name.schema.json`` into a folder; gives the paths of both."""
    from corpuscle.session import cut

    paths = cut(infer(docs, column))
    schema, hints = to_json_schema(paths), hints_of(paths)
    ddl = with_retry(model or Placeholder(paths, name), ddl_prompt(schema, hints))
    told = enhanced(schema, hints) if describe else schema
    spark = docs.sparkSession
    files = {"ddl": (f"{out}/{name}.sql", ddl + "\n"), "schema": (f"{out}/{name}.schema.json", pretty(told) + "\n")}
    for path, text in files.values():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
    return {k: p for k, (p, _) in files.items()}
