"""Registered queries against their SQL, and the driver's entry points."""

import duckdb
import pytest

import __spark_entry__
from tracewise.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_sql(spark, sf, duck, name):
    got = queries.queries()[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    plain = lambda rows: sorted((tuple(v + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: str([round(v, 4) if isinstance(v, float) else v for v in r]))
    a, b = plain(tuple(r) for r in got.collect()), plain(duck.execute(f"SELECT {columns} FROM ({oracles.SQL[name]})").fetchall())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for v, w in zip(x, y, strict=True):
            assert v == pytest.approx(w, abs=2e-5) if isinstance(v, float) and w is not None else v == w


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.SQL)))
def test_without_sql(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_are_pruned(spark, sf):
    plan = queries.queries()["eval_auc"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double,props:string>" in plan and "user_id" not in plan
