"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lepidus import plans

plans.load()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(norm, v)) + "]"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if v.__class__.__name__ == "Decimal":
        return repr(int(v)) if v == int(v) else repr(float(v))
    return repr(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(name, spark, duck, data):
    df = plans.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted("|".join(map(norm, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(plans.SQL[name])
    names = [d[0] for d in result.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == columns
    assert got == sorted("|".join(norm(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(name, spark, data):
    assert plans.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
