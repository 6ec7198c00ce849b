from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import incremental as I

T = lambda d: datetime(2026, 1, d)
RUNS = "scope_key string, run_id string, files_seen bigint, bytes_seen bigint, status string, updated_at timestamp, token string"
ENTRIES = "scope_key string, source_path string, run_id string, file_size_bytes bigint, modified_at timestamp, updated_at timestamp, file_hash string, leaf int"
STATE = "source_path string, file_hash string, file_size_bytes bigint, modified_at timestamp, processed_at timestamp, chunk_count int, status string, error string"


def _pending(spark, entries, state, runs=None):
    runs = runs or [("s", "r1", 0, 0, "complete", T(1), "x")]
    r, e, s = spark.createDataFrame(runs, RUNS), spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(state, STATE)
    return sorted(tuple(x) for x in I.pending_files(r, e, s, leaf_bits=8).collect())


def _e(path, size=1, m=T(1), h="a", at=T(1), run="r1", scope="s"):
    return (scope, path, run, size, m, at, h, 0)


def _s(path, h="a", size=1, m=T(1), at=T(2), status="completed"):
    return (path, h, size, m, at, 1, status, None)


@pytest.mark.parametrize(
    ("entry", "state", "pending"),
    [
        (_e("p"), None, True),
        (_e("p"), _s("p"), False),
        (_e("p", h=" A "), _s("p", h="a"), False),
        (_e("p", h="b"), _s("p"), True),
        (_e("p", h=None), _s("p"), False),
        (_e("p", h=None, size=2), _s("p"), True),
        (_e("p", h=None, m=None), _s("p"), True),
        (_e("p", h=None, m=None), _s("p", h=None, m=None), True),
        (_e("p"), _s("p", status="failed"), True),
        (_e("p"), _s("p", status=" Complete "), False),
        (_e("p", h=""), _s("p"), False),
    ],
)
def test_cases(spark, entry, state, pending):
    assert _pending(spark, [entry], [state] if state else []) == ([("s", "p")] if pending else [])


def test_latest_of_everything(spark):
    runs = [("s", "r1", 0, 0, "complete", T(1), ""), ("s", "r2", 0, 0, "COMPLETE", T(2), ""), ("s", "r3", 0, 0, "scanning", T(3), "")]
    entries = [_e("old", run="r1"), _e("x", h="new", at=T(5), run="r2"), _e("x", h="a", at=T(4), run="r2"), _e("y", run="r3"), _e("x", h="new", at=T(5), run="r2")]
    assert _pending(spark, entries, [_s("x")], runs) == [("s", "x")]
    assert _pending(spark, entries, [_s("x", h="new", at=T(9)), _s("x", at=T(3)), _s("x", status="failed", at=T(10))], runs) == []


def test_same_path_in_two_scopes(spark):
    runs = [("s", "r1", 0, 0, "complete", T(1), ""), ("t", "r1", 0, 0, "complete", T(1), "")]
    assert _pending(spark, [_e("p"), _e("p", h="z", scope="t")], [_s("p")], runs) == [("t", "p")]


def test_empty_tables(spark):
    assert _pending(spark, [], []) == []
    assert _pending(spark, [_e("p")], [], [("s", "r1", 0, 0, "scanning", T(1), "")]) == []


@pytest.mark.parametrize("bits", [4, 7, 12])
def test_descent_finds_exactly_the_changed_leaves(spark, bits):
    a = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("t"))
    b = a.withColumn("t", F.when(F.col("k").isin("5", "77", "2999"), 2).otherwise(1))
    got = {r.leaf for r in I.changed_leaves(I.tree(a, "k", "t", bits), I.tree(b, "k", "t", bits), bits).collect()}
    want = {r.l for r in a.where("k in ('5','77','2999')").select(I.leaf_of("k", bits).alias("l")).collect()}
    assert got == want
    assert I.changed_leaves(I.tree(a, "k", "t", bits), I.tree(a, "k", "t", bits), bits).count() == 0


def test_sync_survives_a_broken_run(spark, tmp_path):
    sync = I.MerkleSync(spark, str(tmp_path / "sync"), "k", ["v"], leaf_bits=6)
    src = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    assert sync.run(src, lambda d: d) == 1 and sync.output(1).count() == 3
    new = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4), ("c", None)], "k string, v int")

    def broken(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        sync.run(new, broken)
    assert sync.versions() == [1]
    assert sync.run(new, lambda d: d) == 2
    assert sorted(r.k for r in sync.output(2).collect()) == ["b", "d"]
    assert sync.run(new, lambda d: d) == 3 and sync.output(3).count() == 0


def test_sync_of_repeated_keys_removed_ones_and_many_versions(spark, tmp_path):
    sync = I.MerkleSync(spark, str(tmp_path / "sync"), "k", ["v"], leaf_bits=6)
    rows = [(f"k{i}", 0, {"m": i}) for i in range(40)]
    make = lambda rows: spark.createDataFrame(rows, "k string, v int, extra map<string,int>").repartition(5)
    assert sync.output(sync.run(make([*rows, ("k0", 7, None), ("k0", 7, {"m": 1}), (None, 1, None)]), lambda d: d)).count() == 40
    assert sync.changes(make([("k0", 7, None), *rows, rows[0]])).count() == 0  # the same row of k0 again, whatever the order
    for v in range(2, I.MerkleStore.KEEP + 4):
        rows[v] = (f"k{v}", v, None)
        assert sync.run(make([("k0", 7, None), *rows]), lambda d: d) == v
        assert [r.k for r in sync.output(v).collect()] == [f"k{v}"] and sync.removed(v).count() == 0
    written = [sync.store.read(v, "records").count() for v in sync.versions() if (tmp_path / f"sync/v-{v:08d}/records").exists()]
    assert written[0] == 40 and all(n < 40 for n in written[1:]) and len(written) <= I.MerkleStore.KEEP
    last = sync.run(make(rows[2:]), lambda d: d)
    assert sorted(r.key for r in sync.removed(last).collect()) == ["k0", "k1"] and sync.output(last).count() == 0


def test_sync_keeps_a_second_writer_out(spark, tmp_path):
    from corpuscle.errors import BusyError

    sync = I.MerkleSync(spark, str(tmp_path / "sync"), "k", ["v"], leaf_bits=4)
    src = spark.createDataFrame([("a", 1)], "k string, v int")
    sync.store.lock()
    with pytest.raises(BusyError):
        sync.run(src, lambda d: d)
    sync.store.stale = -1
    assert sync.run(src, lambda d: d) == 1


def test_digests_hold_for_many_records(spark):
    """The sum of digests overflowed at 16.8 million records once."""
    n = 20_000_000
    t = I.tree(spark.range(n).select("id", F.lit(1).alias("t")), "id", "t", 8)
    assert t.where("level = 0").head().n == n
