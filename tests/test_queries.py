"""Every registered query against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import tessella.plans as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted([plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got or name.startswith(("flag_", "salvage_"))
        return
    made = db.execute(sql)
    names = [d[0] for d in made.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == sorted([plain(r[i]) for i in order] for r in made.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
