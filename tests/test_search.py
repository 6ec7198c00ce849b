from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from corpuscle.config import Config
from corpuscle.errors import QueryError
from corpuscle.operators import dense
from corpuscle.operators.models import MockEmbedder
from corpuscle.operators.search import Retriever
from corpuscle.operators.sync import Corpus


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    c = Corpus(spark, str(tmp_path_factory.mktemp("corpus")), MockEmbedder(8), Config(chunk_size=4, chunk_overlap=1))
    docs = [("/a.md", "h1", "machine learning for search engines and ranking"), ("/b.md", "h2", "gardens and flowers"), ("/c.md", "h3", "  "), ("/d.md", "h4", None)]
    c.update(spark.createDataFrame(docs, "source_path string, file_hash string, content string"))
    return c


def test_sync_replaces_and_removes(spark, corpus):
    first = {(r.source, r.text) for r in corpus.points().collect()}
    assert ("/b.md", "gardens and flowers") in first and {s for s, _ in first} == {"/a.md", "/b.md"}
    docs = [("/a.md", "h1", "machine learning for search engines and ranking"), ("/b.md", "h9", "cooking at home"), ("/c.md", "h3", "  ")]
    v = corpus.update(spark.createDataFrame(docs, "source_path string, file_hash string, content string"))
    assert {r.source for r in corpus.sync.output(v).collect()} == {"/b.md"}
    assert {(r.source, r.text) for r in corpus.points().where("source = '/b.md'").collect()} == {("/b.md", "cooking at home")}


@pytest.mark.parametrize("mode", ["vector", "bm25", "hybrid"])
def test_modes(spark, corpus, mode):
    r = Retriever(corpus.points(), corpus.index(), corpus.embedder, Config(top_k=2))
    got = r.search("machine learning", mode).collect()
    assert 0 < len(got) <= 2 and all(x.source and x.text for x in got)
    if mode == "bm25":
        assert got[0].text == "machine learning for search" and got[0].citation == "a"
        assert r.search("machine learning", mode, source="/b.md").count() == 0


def test_rerank_explain_verify(spark, corpus):
    r = Retriever(corpus.points(), corpus.index(), corpus.embedder, Config(top_k=2, rerank=True, rerank_top_k=1))
    assert r.search("machine learning for search").head().text == "machine learning for search"
    e = r.explain("machine learning").head()
    assert e.both + e.vector_only > 0 and r.verify().count() == 0
    for bad in (("", "bm25"), ("x", "other")):
        with pytest.raises(QueryError):
            r.search(*bad)


def test_batches_in_blocks(spark):
    v = spark.range(40).selectExpr("id", "array(cast(id + 1 as double), cast(40 - id as double)) AS e")
    q = v.where("id % 4 = 0").selectExpr("id AS q", "e AS qe")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(dense.top_k_batch(v, q, 3, "id", "e", "q", "qe", block=3)) == key(dense.top_k_batch(v, q, 3, "id", "e", "q", "qe"))


def _repository(path):
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=N", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for k in (1, 2):
        (path / "f.txt").write_text(f"line {k}\n")
        run("add", "."), run("commit", "-q", "-m", f"feat: step {k}")
    run("checkout", "-q", "-b", "side", "HEAD~1")
    (path / "g.py").write_text("x = 1\n")
    run("add", "."), run("commit", "-q", "-m", "fix: on a branch\n\nmore")
    run("checkout", "-q", "main"), run("merge", "-q", "--no-ff", "-m", "merge side", "side")


def test_commits_from_a_repository(spark, tmp_path):
    from corpuscle.sources import files

    _repository(tmp_path)
    got = {c.message.split("\n")[0]: c for c in files.commits(spark, [str(tmp_path)], 10).collect()}
    assert set(got) == {"feat: step 1", "feat: step 2", "fix: on a branch", "merge side"}  # merged commits too
    assert "+line 2" in got["feat: step 2"].diff_text and got["feat: step 2"].parent_hashes == [got["feat: step 1"].id]
    assert "g.py" in got["merge side"].diff_text and "f.txt" not in got["merge side"].diff_text and len(got["merge side"].parent_hashes) == 2
    assert got["feat: step 1"].committer_email == "n@x" and "+line 1" in got["feat: step 1"].diff_text
    one = files.commit(spark, str(tmp_path), got["fix: on a branch"].id).collect()
    assert [c.id for c in one] == [got["fix: on a branch"].id] and one[0].message == "fix: on a branch\n\nmore"
    assert files.find_repos(str(tmp_path)) == [str(tmp_path.resolve())] and files.commits(spark, [str(tmp_path)], 1).count() == 1
    assert files.commits(spark, [str(tmp_path)], since="2090-01-01").count() == 0
    bad = files.commits(spark, [str(tmp_path / "none")]).collect()
    assert len(bad) == 1 and bad[0].error and bad[0].id is None


def test_commit_corpus(spark, tmp_path):
    from corpuscle.operators import history
    from corpuscle.sources import files

    (tmp_path / "repo").mkdir()
    _repository(tmp_path / "repo")
    found = files.commits(spark, [str(tmp_path / "repo")]).drop("error", "parent_hashes")
    p = history.points(found, "file")
    out = str(tmp_path / "points")
    history.write(p, out, MockEmbedder(4))
    n = history.read(spark, out).count()
    history.write(p, out, MockEmbedder(4))  # the same again changes nothing
    again = history.read(spark, out)
    assert again.count() == n and set(history.PAYLOAD) <= set(again.columns)
    other = history.points(found.withColumn("repository_path", F.lit("/x/other")), "message")
    history.write(other, out, MockEmbedder(4))
    assert history.read(spark, out).count() == n + 4
    hits = history.search(p, "branch", 5, history.condition(kind="Fix", author="n@x", repository=" repo ", since="2000-01-01"))
    shown = history.as_text(history.newest_first(hits)).head().lines
    assert shown[2].endswith("] fix: fix: on a branch") and "author: N <n@x>" in shown and "files: g.py" in shown and "changes: +1 -0" in shown and shown[-1] == "-" * 40
    assert history.search(p, "branch", 5, history.condition(kind="docs")).count() == 0
    assert history.search(p, "branch", 5, least=1e9).count() == 0


def test_corpus_takes_old_versions_over(spark, tmp_path):
    c = Corpus(spark, str(tmp_path), MockEmbedder(4), Config(chunk_size=4, chunk_overlap=1))
    c.KEEP = 3
    rows = [(f"/{k}", "h0", f"text of {k}") for k in range(6)]
    for v in range(7):
        rows[v % 5] = (f"/{v % 5}", f"h{v}", f"new words {v}")
        c.update(spark.createDataFrame(rows[: 6 - (v == 6)], "source_path string, file_hash string, content string"))
        assert len(c._outputs()) <= 4
        want = {(r[0], r[2]) for r in rows[: 6 - (v == 6)]}
        assert {(r.source, r.text) for r in c.points().collect()} == want
