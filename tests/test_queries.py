"""Every query with SQL gives what the SQL gives, on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import timezone
from decimal import Decimal

import pytest

from corpuscle.plans import registry

D = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if getattr(v, "tzinfo", None):
        return v.astimezone(timezone.utc).replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    rows = df.collect()
    if name not in registry.SQL:
        return
    r = duck.sql(registry.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    assert Counter(tuple(norm(x[c]) for c in cols) for x in rows) == Counter(tuple(norm(x[i]) for i in at) for x in r.fetchall())
