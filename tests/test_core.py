from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscle import config
from corpuscle.errors import ChunkingError, ConfigError, DagError, QueryError, SchemaError
from corpuscle.functions import classify, display, lang, text, vectors
from corpuscle.operators import bm25, chunking, commits, dag, dense, fusion, layout, models, schema, state


def one(spark, c, **cols):
    df = spark.createDataFrame([tuple(cols.values())] if cols else [(1,)], list(cols) or ["x"])
    return df.select(c.alias("r")).head().r


WORDS = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize(
    ("t", "size", "over", "want"),
    [
        (WORDS, 3, 1, ["one two three", "three four five", "five six seven", "seven eight nine", "nine ten"]),
        ("a b c d e f", 2, 0, ["a b", "c d", "e f"]),
        ("", 2, 0, []),
        ("  　\t ", 2, 0, []),
        (WORDS, 100, 10, [WORDS]),
    ],
)
def test_windows(spark, t, size, over, want):
    assert one(spark, chunking.windows(text.words("t"), size, over), t=t) == want


@pytest.mark.parametrize(("size", "over"), [(0, 0), (3, 3), (3, 4)])
def test_windows_refused(size, over):
    with pytest.raises(ChunkingError):
        chunking.check(size, over)


def test_commit_windows(spark):
    t = " ".join(f"w{i}" for i in range(1000))
    got = one(spark, chunking.commit_windows("t", 512, 128), t=t)
    starts = [s for s in range(0, 1000, 295) if s == 0 or 1000 - s >= 147]
    assert [g.split()[0] for g in got] == [f"w{s}" for s in starts] and len(got[0].split()) == 393


def test_pack_sentences(spark):
    d = spark.createDataFrame([("d", "One two. Three four five! " + " ".join("x" for _ in range(12)) + ". End"), ("e", None), ("f", "")], "id string, t string")
    got = [r.content for r in chunking.pack_sentences(d, "id", "t", 5, 2).orderBy("chunk_index").collect()]
    assert got[0] == "One two. Three four five." and got[-1] == "End." and all(len(g.split()) <= 5 for g in got)


def test_tokens(spark):
    assert one(spark, text.tokens("t"), t="user@example.com, hello-world_test") == ["user", "example", "com", "hello", "world", "test"]
    assert one(spark, text.index_tokens("t"), t="Café naïve résumé a é") == ["café", "naïve", "résumé", "é"]
    assert one(spark, text.tokens("t"), t="... --- !!!") == []
    assert [one(spark, text.estimate_tokens("t"), t=" ".join("w" * n)) for n in (0, 4, 90)] == [0, 5, 116]


def test_normalize(spark):
    assert one(spark, text.normalize("t"), t="  é​ \t\n x﻿ ") == "é x"
    assert one(spark, text.drop_control("t"), t="a\x00b\n\x7f") == "ab\n"
    s = "Hello world. How are you? I am fine."
    got = one(spark, text.sentences("t"), t=s)
    assert len(got) == 3 and "".join(got) == s
    assert one(spark, text.wrap("t", 9), t="aa bb cc dd muchtoolongword e") == ["aa bb cc", "dd", "muchtoolongword", "e"]


def test_display(spark):
    sizes = {512: " 512b", 46 * 1024: "  46k", int(1.2 * 1024**3): " 1.2g", 5 * 1024**2: " 5.0m"}
    assert {n: one(spark, display.bytes_short("n"), n=n) for n in sizes} == sizes
    assert one(spark, display.citation("p"), p="/a/b.tar.gz") == "b.tar" and one(spark, display.citation("p"), p="") == "unknown"
    assert one(spark, display.hash_label("p"), p="x").startswith("src_") and one(spark, display.extension("p"), p="/a/.env") is None
    with pytest.raises(QueryError):
        display.show_source("p", "other")


def test_languages(spark):
    got = {p: one(spark, lang.language("p"), p=p) for p in ("a.RS", "x/y.tsx", "q.sql", "no", "k.unknown")}
    assert got == {"a.RS": "rust", "x/y.tsx": "typescript", "q.sql": "sql", "no": None, "k.unknown": None}
    assert one(spark, lang.is_code("p"), p="a.md") is False and one(spark, lang.is_code("p"), p="a.sh") is True
    assert one(spark, lang.document_format("p"), p="a.PDF") == "pdf" and one(spark, lang.document_format("p"), p="a.exe") is None
    assert len(lang.presets()["code"]) == 143 and lang.expand_extensions(["docs", ".RS"]) == ["adoc", "md", "rs", "rst", "txt"]
    assert [one(spark, lang.excluded("p"), p=p) for p in ("/a/node_modules/x", "/a/metadata", "/a/build")] == [True, False, True]
    assert one(spark, lang.excluded("p", True), p="/a/metadata") is True


@pytest.mark.parametrize(
    ("m", "want"),
    [("feat: x", "feat"), ("fix(core)!: y", "fix"), ("Revert thing", "revert"), ("add latest", "test"), ("clean up", "refactor"), ("ci tweaks", "ci"), ("hello", "unknown"), ("FEAT: x", "unknown"), ("speed", "unknown"), ("cargo bump", "build")],
)
def test_commit_types(spark, m, want):
    assert one(spark, classify.commit_type("m"), m=m) == want


def test_vectors(spark):
    assert one(spark, vectors.cosine("a", "b"), a=[3.0, 4.0], b=[6.0, 8.0]) == pytest.approx(1)
    assert one(spark, vectors.unit("a"), a=[0.0, 0.0]) == [0.0, 0.0] and one(spark, vectors.sigmoid("x"), x=0.0) == 0.5
    assert [one(spark, vectors.batch_size("n", 256), n=n) for n in (10, 600 * 1024, 2 * 1024**2)] == [32, 85, 256]
    e = models.MockEmbedder(4)
    assert one(spark, vectors.mock_embedding("t", 4), t="añ") == pytest.approx(e.embed(["añ"])[0].tolist())


def _index(spark, rows):
    return bm25.build(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text")


DOCS = [("doc1", "machine learning optimization"), ("doc2", "deep learning neural networks"), ("doc3", "machine learning algorithms"), ("doc4", None)]


def test_bm25(spark, tmp_path):
    i = _index(spark, DOCS)
    hits = bm25.search(i, "machine learning", 10).collect()
    assert [h.doc_id for h in hits] == ["doc1", "doc3", "doc2"] and i.corpus.head().num_docs == 4
    assert bm25.search(i, "!!", 5).count() == 0
    with pytest.raises(QueryError):
        bm25.search(i, "  ", 5)
    less = i.without(spark.createDataFrame([("doc2",)], "doc_id string"))
    assert less.term_stats().where("term = 'neural'").count() == 0
    again = i.plus(_index(spark, [("doc1", "new words")]))
    assert again.corpus.head().num_docs == 4 and again.postings.where("doc_id = 'doc1'").count() == 2
    i.save(str(tmp_path / "i"))
    assert bm25.Index.load(spark, str(tmp_path / "i")).postings.count() == i.postings.count()
    assert bm25.Index.load(spark, str(tmp_path / "none")).doc_stats.count() == 0


def test_fusion(spark):
    v = spark.createDataFrame([("doc1", 0.9), ("doc2", 0.7)], "doc_id string, score double")
    b = spark.createDataFrame([("doc2", 5.0), ("doc3", 3.0)], "doc_id string, score double")
    got = {r.doc_id: round(r.score, 6) for r in fusion.weighted(v, b, 0.6, 0.4, 10).collect()}
    assert got == {"doc1": 0.6, "doc2": 0.4, "doc3": 0.0}
    assert fusion.reciprocal(v, b, 3).head().doc_id == "doc2"
    assert tuple(fusion.overlap(v, b).head()) == (1, 1, 1)
    low = fusion.adaptive(v.withColumn("score", F.col("score") / 2), b, 0.5, 0.5, 3).head()
    assert low.doc_id == "doc2" and round(low.score, 6) == 0.8
    d = spark.createDataFrame([("doc1", "some text here", ""), ("doc2", "other", "/a/b.md")], "id string, t string, s string")
    h = {r.doc_id: (r.text, r.source, r.citation) for r in fusion.hydrate(fusion.weighted(v, b, 0.6, 0.4, 3), d, "id", "t", "s").collect()}
    assert h == {"doc1": ("some text here", "doc1", "doc1"), "doc2": ("other", "/a/b.md", "b"), "doc3": ("", "doc3", "doc3")}
    assert fusion.normalized(v.limit(0)).count() == 0


def test_dense(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "id string, embedding array<double>")
    assert [r.id for r in dense.top_k(v, [1.0, 0.1], 2).collect()] == ["a", "c"]
    assert dense.all_of(None) is None
    with pytest.raises(QueryError):
        dense.time_filter("yesterday", None)


def test_config():
    assert config.from_env({"TOP_K": "7", "RERANK": "yes"}).fetch_limits() == (21, 42)
    for bad in ({"CHUNK_SIZE": "0"}, {"CHUNK_OVERLAP": "600"}, {"VECTOR_WEIGHT": "0.9"}, {"BM25_B": "2"}, {"TOP_K": "x"}, {"RERANK": "maybe"}):
        with pytest.raises(ConfigError):
            config.from_env(bad)


def test_commit_chunks(spark):

    c = spark.createDataFrame(list(DIFFS), "id string, message string, diff_text string")
    f = commits.chunks(c, "file").orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index, r.total_chunks, r.language) for r in f] == [("c1", 0, 3, None), ("c1", 1, 3, "rust"), ("c1", 2, 3, "markdown"), ("c2", 0, 2, None), ("c2", 1, 2, "python"), ("c3", 0, 1, None)]
    assert f[1].content.startswith("File: src/main.rs\ndiff --git")
    assert [r.header for r in commits.hunks(c, "id", "diff_text").where("id = 'c2'").orderBy("hunk_pos").collect()] == ["@@ -1,3 +1,4 @@", "@@ -10,2 +11,3 @@"]
    paths = {"diff --git a/x b/y z": "y z", "diff --git a/only": "only", "what": "unknown"}
    assert {l: one(spark, commits.diff_path("l"), l=l) for l in paths} == paths


def _line(doc, page, no, text_, font=12.0, y=400.0, x=50.0, ocr=False):
    return (doc, page, no, text_, font, float(x), float(y), 100.0, 12.0, ocr, 600.0, 800.0)


LINE = "doc_id string, page_number int, line_no int, text string, font_size double, x double, y double, width double, height double, is_ocr boolean, page_width double, page_height double"


def test_layout(spark):
    rows = [_line("d", p, 0, "My  Header", y=750) for p in (1, 2, 3)]
    rows += [_line("d", 1, 1, "Intro", 24.0), _line("d", 2, 1, "Part", 18.0), _line("d", 3, 1, "Other", 24.0), _line("d", 3, 2, "body text that goes on.", ocr=True)]
    rows += [_line("d", p, 5 + k, "plain words in a line.") for p in (1, 2, 3) for k in range(3)]
    l = spark.createDataFrame(rows, LINE)
    assert [(r.zone, r.norm, r.n) for r in layout.margin_lines(l).collect()] == [("header", "My Header", 3)]
    assert layout.without_margins(l).count() == len(rows) - 3
    got = [(r.heading, r.level, r.start_page, r.end_page) for r in layout.sections(l).orderBy("start_page").collect()]
    assert got == [("Intro", 1, 1, 2), ("Part", 2, 2, 2), ("Other", 1, 3, 3)]
    assert layout.median_font(l, ["doc_id"]).head().median_font == 12.0
    assert tuple(layout.ocr_stats(l).head()) == ("d", 3, 0, 1)
    assert layout.sections(l.limit(0)).count() == 0


def test_state_store(spark, tmp_path):
    s = state.StateStore(spark, str(tmp_path / "s"), ["k"], "k string, v int")
    assert s.read().count() == 0
    s.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    s.upsert(spark.createDataFrame([("b", 3)], "k string, v int"))
    assert sorted(map(tuple, s.read().collect())) == [("a", 1), ("b", 3)]
    s.remove(spark.createDataFrame([("a",)], "k string"))
    assert s.read().count() == 1
    for v in range(2 * state.StateStore.KEEP):
        s.upsert(spark.createDataFrame([("c", v), ("c", v - 1)], "k string, v int"))
        assert len(s.versions()) <= state.StateStore.KEEP + 1
    assert sorted(map(tuple, s.read().collect())) == [("b", 3), ("c", v)]
    s.reset()
    assert s.version() == 0


def test_state_transitions(spark):
    at = F.lit("2026-01-05").cast("timestamp")
    new = spark.createDataFrame([("a", "h", 1, None), ("b", "h", 2, None)], "source_path string, file_hash string, file_size_bytes bigint, modified_at timestamp")
    none = spark.createDataFrame([], "source_path string, file_hash string, file_size_bytes bigint, modified_at timestamp, processed_at timestamp, chunk_count int, status string, error string")
    failures = spark.createDataFrame([("a", "old"), ("z", "old")], "source_path string, reason string")
    s = state.mark_processing(none, new, at)
    assert {r.status for r in s.collect()} == {"processing"} and not state.is_processed(new, s).where("processed").count()
    s, f = state.mark_complete(s, failures, spark.createDataFrame([("a", 3), ("q", 1)], "source_path string, chunk_count int"), at)
    s = state.mark_failed(s, spark.createDataFrame([("b", "boom"), ("q", "x")], "source_path string, error string"), at)
    assert sorted((r.source_path, r.status, r.chunk_count, r.error) for r in s.collect()) == [("a", "completed", 3, None), ("b", "failed", 0, "boom")]
    assert [r.source_path for r in f.collect()] == ["z"] and [r.processed for r in state.is_processed(new, s).orderBy("source_path").collect()] == [True, False]
    f = state.record_failure(f, spark.createDataFrame([("z", "new"), ("b", "boom")], "source_path string, reason string"))
    assert sorted(map(tuple, f.collect())) == [("b", "boom"), ("z", "new")]
    s, f = state.removed(s, f, spark.createDataFrame([("b",)], "source_path string"))
    assert s.count() == 1 and f.count() == 1


def test_upsert_gives_states_and_failures(spark):
    from corpuscle.operators import sync

    files = spark.createDataFrame([("a", "h", 1, None), ("b", "h", 2, None)], "source_path string, file_hash string, file_size_bytes bigint, modified_at timestamp")
    points = spark.createDataFrame([("p1", "a"), ("p2", "a")], "id string, source string")
    tries = []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("away")

    s, f = sync.upsert(points, files, flaky, wait=0.001)
    assert len(tries) == 3 and f.count() == 0 and sorted((r.source_path, r.chunk_count, r.status) for r in s.collect()) == [("a", 2, "completed"), ("b", 0, "completed")]

    def broken(_):
        raise OSError("gone")

    s, f = sync.upsert(points, files, broken, attempts=2, wait=0.001)
    assert {r.status for r in s.collect()} == {"failed"} and {(r.source_path, r.reason) for r in f.collect()} == {("a", "gone"), ("b", "gone")}


def test_scan_store(spark, tmp_path):
    from datetime import datetime

    s = state.ScanStore(spark, str(tmp_path / "scan"))
    f = lambda *r: spark.createDataFrame(list(r), "source_path string, file_size_bytes bigint, modified_at timestamp")
    assert s.start("x", "r1") == "r1"
    s.record("x", f(("/path/a", 10, datetime(2026, 1, 1)), ("/path/b", 5, None)))
    assert s.count("x") == (2, 15) and (s.run("x").files_seen, s.run("x").bytes_seen) == (2, 15)
    assert s.start("x", "r2") == "r1" and s.reusable("x") is None
    s.finish("x")
    assert s.start("x", "r2", reuse=True) == "r1" and s.reusable("x").count() == 2  # asked for, a complete scan stands for a walk
    assert s.start("x", "r2") == "r2" and s.run("x").files_seen == 0
    assert state.new_run_id(12.5) == "scan-12-500000000"


def test_schema(spark):
    d = spark.createDataFrame([('{"name":"a","age":1,"tags":[1,"x"]}',), ('{"name":null,"folder":{"created_at":"t"}}',), ("no json",), (None,)], "j string")
    p = schema.infer(d, "j").cache()
    got = {r.path: (r.types, r.required) for r in p.collect()}
    assert got["name"] == (["null", "string"], True) and got["age"] == (["number"], False) and got["tags.[]"] == (["number", "string"], False)
    assert {(r.kind, r.path) for r in schema.field_hints(p).collect()} == {("folders", "tags"), ("folders", "folder"), ("timestamps", "folder.created_at")}
    js = schema.to_json_schema(p)
    assert js["type"] == "object" and js["required"] == ["name"] and js["properties"]["tags"]["items"]["type"] == ["number", "string"]
    assert '"age" DOUBLE PRECISION' in schema.to_ddl(p, "t")
    with pytest.raises(SchemaError):
        schema.create_table_of("SELECT 1")
    answers = iter(["nothing", "```sql\nCREATE TABLE a (b int);\n```"])
    assert schema.with_retry(lambda _: next(answers), "p") == "CREATE TABLE a (b int);"


def test_schema_generation(spark, tmp_path):
    d = spark.createDataFrame([('{"a.b":{"x":1},"url":"u","created":"t","[]":2}',)], "j string")
    p = schema.infer(d, "j")
    assert {r.path for r in p.collect()} == {"", '"a.b"', '"a.b".x', "url", "created", '"[]"'}
    js = schema.to_json_schema(p)
    assert set(js["properties"]) == {"a.b", "url", "created", "[]"} and js["properties"]["a.b"]["properties"]["x"]["type"] == "number"
    prompt = schema.ddl_prompt(js, schema.hints_of(p))
    assert "created" in prompt and '"properties"' in prompt
    files = schema.generate(d, "j", str(tmp_path), "t", describe=True)
    assert '"a.b" JSONB' in open(files["ddl"]).read() and "A point in time" in open(files["schema"]).read()
    assert schema.enhanced(js, {"timestamps": [], "folders": []}, lambda _: '{"x": 1}') == {"x": 1}
    with pytest.raises(SchemaError):
        schema.enhanced(js, {"timestamps": [], "folders": []}, lambda _: "no")
    assert [schema.backend(e) for e in ({}, {"LLM_BACKEND": "Claude"}, {"OPENAI_API_KEY": "k"}, {"LLM_BACKEND": "x"})] == ["placeholder", "anthropic", "openai", "placeholder"]


DIFFS = (
    ("c1", "fix: handle empty input", "diff --git a/src/main.rs b/src/main.rs\nindex 1..2 100644\n--- a/src/main.rs\n+++ b/src/main.rs\n@@ -1,3 +1,4 @@\n fn main() {\n+    run();\n }\ndiff --git a/README.md b/README.md\nindex 3..4 100644\n--- a/README.md\n+++ b/README.md\n@@ -1 +1 @@\n-old\n+new\n"),
    ("c2", "update the parser", "diff --git a/lib/p.py b/lib/p.py\n--- a/lib/p.py\n+++ b/lib/p.py\n@@ -1,3 +1,4 @@\n a\n+b\n@@ -10,2 +11,3 @@\n c\n-d\n"),
    ("c3", "empty commit", ""),
)


def test_diffs_of_texts(spark):
    df = spark.createDataFrame([(i, f"{m}\n\n{d}") for i, m, d in DIFFS] + [("n", None)], "id string, t string")
    c = commits.split_message(df, "id", "t")
    assert sorted((r.id, r.message, r.diff_text) for r in c.collect()) == sorted(DIFFS)
    got = {r.id: (r.files_changed, r.insertions, r.deletions, r.file_paths, r.languages) for r in commits.diff_stats(c).collect()}
    assert got == {"c1": (2, 2, 1, ["README.md", "src/main.rs"], ["markdown", "rust"]), "c2": (1, 1, 1, ["lib/p.py"], ["python"]), "c3": (0, 0, 0, [], [])}
    f = {(r.id, r.pos): (r.file_path, r.header, r.content) for r in commits.file_diffs(c, "id", "diff_text").collect()}
    assert f["c1", 1] == ("README.md", "diff --git a/README.md b/README.md\nindex 3..4 100644\n--- a/README.md\n+++ b/README.md", "@@ -1 +1 @@\n-old\n+new\n") and len(f) == 3
    h = {(r.id, r.hunk_pos): (r.header, r.content) for r in commits.hunks(c.where("id = 'c2'"), "id", "diff_text").collect()}
    assert h == {("c2", 0): ("@@ -1,3 +1,4 @@", " a\n+b\n"), ("c2", 1): ("@@ -10,2 +11,3 @@", " c\n-d\n")}


def test_dag_levels(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "task string, depends_on string")
    diamonds = edges(("a0", None), *[(f"{x}{i + 1}", f"{y}{i}") for i in range(12) for x in "ab" for y in "ab"])  # 2**12 paths
    got = {r.task: r.level for r in dag.levels(diamonds).collect()}
    assert got["a12"] == 12 and got["b12"] == 12 and got["b0"] == 0
    with pytest.raises(DagError):
        dag.levels(edges(("a", "b"), ("b", "a"), ("c", None)))
    assert dag.levels(edges(("a", None)).limit(0)).count() == 0


def test_dag(spark):
    assert dag.plan({"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}) == [["a"], ["b", "c"], ["d"]]
    for bad in ({"a": ["b"], "b": ["a"]}, {"a": ["zzz"]}):
        with pytest.raises(DagError):
            dag.plan(bad)
    assert dag.run({"a": [], "b": ["a"]}, {"a": lambda _: 1, "b": lambda r: r["a"] + 1}) == {"a": 1, "b": 2}


def test_files(spark, tmp_path):
    from corpuscle.sources import files

    (tmp_path / "node_modules").mkdir()
    for n, b in {"a.py": b"x = 1\n", "b.txt": "é".encode("utf-16"), "c.md": b"\x01\x02\x03\xff" * 20, "empty.py": b"", "d.exe": b"hi", "node_modules/e.js": b"1"}.items():
        (tmp_path / n).write_bytes(b)
    got = {r.source_path.rsplit("/", 1)[-1]: (r.content, r.error) for r in files.load(spark, [str(tmp_path)]).collect()}
    assert got == {"a.py": ("x = 1\n", None), "b.txt": ("é", None), "c.md": (None, "binary"), "d.exe": (None, "unsupported format")}
    assert files.candidates(spark, [str(tmp_path)], ["py"]).count() == 1


def test_walk_follows_ignore_files(spark, tmp_path):
    from corpuscle.sources import files

    for f in ("a.log", "keep.log", "b.txt", ".hidden", "sub/c.log", "sub/build/x.txt", "build/y.txt", "tmp2/z.txt", "node_modules/m.js", "deep/a/b/c/d.md", "docs/x/y/draft.md"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n/build\n!keep.log\n# none\ntmp?/\ndocs/**/draft.md\n")
    (tmp_path / "sub/.gitignore").write_text("!c.log\n")
    names = lambda **k: {r.source_path[len(str(tmp_path)) + 1 :] for r in files.candidates(spark, [str(tmp_path), str(tmp_path / "none"), str(tmp_path / "b.txt")], **k).collect()}
    assert names(honor_ignore=True) == {".gitignore", ".hidden", "keep.log", "b.txt", "sub/.gitignore", "sub/c.log", "deep/a/b/c/d.md"}
    assert "build/y.txt" not in names() and "a.log" in names() and "node_modules/m.js" in names(honor_excluded=False)
    assert names(extensions=["docs"]) == {"b.txt", "tmp2/z.txt", "deep/a/b/c/d.md", "docs/x/y/draft.md"}


def _pdf(pages, extra=b""):
    import zlib

    out, kids = b"%PDF-1.4\n", b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + kids + b"] /MediaBox [0 0 600 800] >>", 9: b"<< /Title (A \\(b\\)) /Author () /Producer <FEFF00E9> >>", 8: b"<< /Type /Font >>"}
    for k, p in enumerate(pages):
        z = zlib.compress(p)
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 8 0 R >> >> >>" % (11 + 2 * k)
        objects[11 + 2 * k] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(z) + z + b"\nendstream"
    return out + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in objects.items()) + b"trailer << /Root 1 0 R /Info 9 0 R " + extra + b">>\n%%EOF"


def test_pdf_files(spark, tmp_path):
    from corpuscle.sources import files, pdf

    (tmp_path / "a.pdf").write_bytes(_pdf([b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET", b"BT /F1 9 Tf <4F6E65> Tj T* (two) ' ET"]))
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.pdf").write_bytes(_pdf([b""], b"/Encrypt 7 0 R "))
    got = {r.source_path[-5:]: r for r in files.load(spark, [str(tmp_path)]).collect()}
    assert got["a.pdf"].content == "Hello (world)\nsecond line\n\nOne\ntwo" and got["a.pdf"].metadata.pdf_metadata.title == "A (b)" and got["a.pdf"].metadata.pdf_metadata.author is None and got["a.pdf"].metadata.pdf_metadata.producer == "é"
    assert (got["b.pdf"].error, got["c.pdf"].error) == ("no PDF file", "encrypted")
    raw = spark.createDataFrame([("a", bytearray((tmp_path / "a.pdf").read_bytes()))], "path string, content binary")
    p = pdf.pages(raw)
    l = files.page_lines(p, "source_path", "page_number", "text", "page_height").orderBy("page_number", "line_no").collect()
    assert [(x.page_number, x.text, x.y) for x in l] == [(1, "Hello (world)", 800.0), (1, "second line", 785.0), (2, "One", 800.0), (2, "two", 785.0)]
    image = p.withColumn("image", F.lit(b"img"))
    assert {r.text for r in pdf.recognized(image, "image", lambda b: f" {len(b)} \n\n read ").where("is_ocr").collect()} == {"3\nread"}
    assert pdf.recognized(image, "image").where("is_ocr").count() == 0


def test_relaxed_json(spark):
    from corpuscle.sources import files

    rows = ['{"a": 1, // x\n "b": ["http://x", 2,],}', '/* c */ {"a": "1,]"}', '{"a" 1}', None]
    d = spark.createDataFrame([(x,) for x in rows], "t string").select(files.relaxed_json("t").cast("string").alias("j"))
    assert [r.j for r in d.collect()] == ['{"a":1,"b":["http://x",2]}', '{"a":"1,]"}', None, None]


def test_sentences_by_the_annex(spark):
    cases = [
        ("Mr. Smith went. He came back!", ["Mr. ", "Smith went. ", "He came back!"]), ("It cost 3.50 dollars. Cheap.", ["It cost 3.50 dollars. ", "Cheap."]), ("the U.S. army is here. Yes", ["the U.S. army is here. ", "Yes"]),
        ("He said (really?) no.", ["He said (really?) ", "no."]), ("“Go.” He went", ["“Go.” ", "He went"]), ("etc. and so on", ["etc. and so on"]), ("One\nTwo\r\nThree", ["One\n", "Two\r\n", "Three"]), ("What?! Now", ["What?! ", "Now"]), ("c.d", ["c.d"]), ("", []), ("好。吃", ["好。", "吃"]),
    ]
    for given, want in cases:
        assert text.split_sentences(given) == want, given
    df = spark.createDataFrame([("A b.  C d. ",), (None,)], "t string")
    assert [r.s for r in df.select(text.sentences_filtered("t").alias("s")).collect()] == [["A b.", "C d."], None]


def test_windows_of_model_tokens(spark):
    import os

    if not os.path.exists(chunking.TOKENIZER):
        pytest.skip("no tokenizer files")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(chunking.TOKENIZER)
    texts = ["", "short", "words and words " * 40, "é日本 x " * 30, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunking.chunk_tokens(df, "id", "text", 16, 4).orderBy("chunk_index").collect():
        got.setdefault(int(r.document_id), []).append((r.tokens, r.content, r.total_chunks))
    for i, text in enumerate(texts):
        o = t.encode(text or "", add_special_tokens=False).offsets
        want, at = [], 0
        while at < len(o):
            end = min(at + 16, len(o))
            want.append((end - at, text[o[at][0] : o[end - 1][1]]))
            at = len(o) if end == len(o) else at + 12
        assert [x[:2] for x in got.get(i, [])] == want and all(x[2] == len(want) for x in got.get(i, []))
    assert [r.n for r in df.select(chunking.token_count("text").alias("n")).collect()] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert chunking.chunk_tokens(df, "id", "text", 16, 4, None).count() > 0


def test_model_registry(tmp_path):
    m = models.EMBEDDING_MODELS["default"]
    assert (m.dims, m.capped(2048).max_tokens, m.capped(0).max_tokens) == (768, 2048, 8192) and "CPUExecutionProvider" in models.providers()
    with pytest.raises(FileNotFoundError):
        m.local(str(tmp_path))


def test_latest_rows_of_a_stream(spark, tmp_path):
    from corpuscle.streaming import ingest

    schema_ = "k string, at int, v string"
    stream = lambda: spark.readStream.schema(schema_).parquet(str(tmp_path / "in"))
    for n in range(ingest.KEEP + 3):
        spark.createDataFrame([("a", n if n != 5 else -1, f"v{n}"), (f"k{n}", 0, "x")], schema_).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.latest_by_key(stream(), "k", "at", str(tmp_path / "out")).awaitTermination()
    got = {r.k: (r.at, r.v) for r in ingest.read_latest(spark, str(tmp_path / "out")).collect()}
    assert got["a"] == (n, f"v{n}") and len(got) == n + 2


def test_traces(spark):
    import json

    from corpuscle import trace

    lines = []
    with trace.span("step", lines.append, run="r") as told:
        df, o = trace.counted(spark.range(7), "rows_of_step")
        df.write.format("noop").mode("overwrite").save()
        told["rows"] = o.get["rows"]
    with pytest.raises(ValueError), trace.span("bad", lines.append):
        raise ValueError("no")
    a, b = map(json.loads, lines)
    assert (a["span"], a["run"], a["rows"], a["ok"]) == ("step", "r", 7, True) and a["seconds"] >= 0 and (b["ok"], b["error"]) == (False, "ValueError: no")


def test_streams_end_when_asked(spark, tmp_path):
    from corpuscle.streaming import ingest

    q = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start()
    stop = ingest.Shutdown(spark)
    stop.settle()
    assert q.isActive
    stop.ask()
    stop.settle(10)
    assert stop.asked and not q.isActive


def test_temporal(spark):
    from datetime import datetime

    from corpuscle.operators import temporal

    d = spark.createDataFrame([(1, datetime(2026, 1, 1), "a"), (2, datetime(2026, 1, 3), "a"), (3, None, "b"), (4, datetime(2026, 1, 2), "b")], "id int, t timestamp, g string")
    f = temporal.feature(d, "id", "t")
    assert {r.id: r.feature for r in f.collect()} == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5}
    assert [r.feature for r in temporal.feature(d.where("id = 1"), "id", "t").collect()] == [0.5]
    v = spark.createDataFrame([(1, [0.5, 2.0])], "id int, v array<float>")
    assert temporal.augment(v, "v", f, "id").head().v == [0.5, 2.0, 0.0]
    assert {(r.g, r.n, r.first.day) for r in temporal.date_range(d, "g", "t").collect()} == {("a", 2, 1), ("b", 2, 2)}


def test_registry_has_no_llm():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "corpuscle"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            names = [getattr(n, "module", None) or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n for n in names), p
