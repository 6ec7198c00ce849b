"""Vectors and scores as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.text import col


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column) -> Column:
    """The vector at length 1; a null vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n)).otherwise(F.transform(col(a), lambda x: x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def logit_of(logits: str | Column) -> Column:
    """Of one logit itself, of two that of the second class."""
    c = col(logits)
    return F.when(F.size(c) == 2, c[1]).otherwise(c[0])


def minmax(score: Column, lo: Column, hi: Column) -> Column:
    """Between 0 and 1; 1 where all scores are equal."""
    return F.when(hi == lo, F.lit(1.0)).otherwise((score - lo) / (hi - lo))


def batch_size(size_bytes: str | Column, batch: int, cpu: bool = False) -> Column:
    """Texts a worker takes at once: few for small inputs, more for large ones."""
    if cpu:
        return F.lit(min(batch, 16))
    kb = F.floor(col(size_bytes) / 1024)
    grown = F.when(kb < 64, 32).when(kb < 1024, 32 + F.floor((kb - 64) / 960.0 * 96)).otherwise(min(batch, 256))
    return F.least(F.greatest(grown.cast("int"), F.lit(min(16, batch))), F.lit(batch))


def mock_embedding(text: str | Column, dim: int) -> Column:
    """A deterministic stand-in for a model: the sum of the text's bytes, times the place, in thousandths."""
    h = F.aggregate(F.split(F.hex(F.encode(col(text), "UTF-8")), "(?<=\\G..)"), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.conv(x, 16, 10).cast("long"), F.lit(0)))
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: ((h * i) % 1000) / 1000.0)
