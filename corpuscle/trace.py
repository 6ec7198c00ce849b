"""Traces of what runs: spans as JSON lines, and row counts that jobs gather on their way."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("corpuscle")


def to_log(line: str) -> None:
    LOG.info(line)


@contextmanager
def span(name: str, sink: Callable[[str], None] = to_log, **fields: object) -> Iterator[dict]:
    """Times a step; the dict that it gives takes further fields. An error is told and goes on."""
    told: dict = {"span": name, "start": round(time.time(), 6), **fields}
    began = time.perf_counter()
    try:
        yield told
        told["ok"] = True
    except BaseException as e:
        told |= {"ok": False, "error": f"{type(e).__name__}: {e}".splitlines()[0]}
        raise
    finally:
        sink(json.dumps(told | {"seconds": round(time.perf_counter() - began, 6)}, default=str))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows with an observation of how many there were, filled by the first action on them."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o
