"""Tasks that depend on each other: their levels as a query, and running them level by level."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.errors import DagError
from corpuscle.session import cut


def levels(edges: DataFrame) -> DataFrame:
    """``(task, level)``: 0 without dependencies, else one more than the highest of them. Edges ``(task, depends_on)``, null for none.

    Each round takes the tasks all of whose dependencies have a level, so a task is visited once however many paths
    lead to it, and tasks that depend on each other are an error. A dependency that is no task itself counts as one.
    """
    deps = cut(edges.where("depends_on IS NOT NULL").select("task", "depends_on").distinct())
    left = cut(edges.select("task").unionByName(deps.select(F.col("depends_on").alias("task"))).where("task IS NOT NULL").distinct())
    out, level = None, 0
    while not left.isEmpty():
        ready = left.join(deps.select("task"), "task", "left_anti")
        part = cut(ready.select("task", F.lit(level).alias("level")))
        if part.isEmpty():
            raise DagError("tasks depend on each other")
        out = part if out is None else out.unionByName(part)
        left = cut(left.join(part.select("task"), "task", "left_anti"))
        deps = cut(deps.join(part.select(F.col("task").alias("depends_on")), "depends_on", "left_anti"))
        level += 1
    return edges.sparkSession.createDataFrame([], "task string, level int") if out is None else out


def plan(tasks: dict[str, list[str]]) -> list[list[str]]:
    """Tasks by level; missing and circular dependencies are errors."""
    missing = {d for ds in tasks.values() for d in ds} - set(tasks)
    if missing:
        raise DagError(f"missing tasks: {sorted(missing)}")
    out, left = [], {t: set(d) for t, d in tasks.items()}
    while left:
        ready = sorted(t for t, d in left.items() if not d)
        if not ready:
            raise DagError(f"tasks depend on each other: {sorted(left)}")
        out.append(ready)
        left = {t: d - set(ready) for t, d in left.items() if t not in ready}
    return out


def run(tasks: dict[str, list[str]], work: dict[str, Callable[[dict], object]], workers: int = 4) -> dict[str, object]:
    """Run each level's tasks side by side (their Spark jobs share the cluster); each gets the results so far."""
    done: dict[str, object] = {}
    with ThreadPoolExecutor(workers) as pool:
        for level in plan(tasks):
            got = list(pool.map(lambda t: work[t](dict(done)), level))
            done |= dict(zip(level, got))
    return done
