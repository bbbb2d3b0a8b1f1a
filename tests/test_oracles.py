"""Every query against its SQL over the small tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def canonical(df):
    cols = sorted(df.columns)
    cell = lambda v: None if v is None or v is not v or str(v) == "<NA>" else round(float(v), 5) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in ("i", "u", "f", "b") else str(v)
    return cols, sorted((tuple(cell(v) for v in t) for t in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not (n.startswith("op") and n[2].isdigit())))
def test_query(spark, duck, name):
    for f in os.listdir(DATA):
        duck.sql(f"create or replace view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = canonical(entry.queries()[name](spark, DATA).toPandas()), canonical(duck.sql(entry.oracle_sql()[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-5) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
