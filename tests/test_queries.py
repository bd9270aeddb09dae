"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from docweave import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, int | str | bool) else str(v)
    return sorted((tuple(show(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    got = queries.queries()[name](spark, SF)
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), columns)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_plans_prune_and_push_down(spark):
    physical = lambda name: queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualNullSafe(o_orderstatus,F)], ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in physical("path_filter_eq")
    assert "GreaterThanOrEqual(o_totalprice,200000" in physical("path_filter_cmp")
    assert "Or(LessThan(o_totalprice,20000" in physical("path_filter_and_or")
    assert "GreaterThan(o_orderdate,1996-01-01T00:00)" in physical("path_filter_date")
    plan = queries.queries()["put_computed"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double,l_discount:double>" in plan
