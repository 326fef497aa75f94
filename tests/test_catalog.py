import duckdb
import pytest

SF = "/root/testdata/sf0.01"
TABLES = "customer supplier part orders lineitem events documents embeddings pages labels conversations".split()


def _plans():
    from vigilake.plans import audit, catalog, findings, projects, reporting, stored

    return catalog, findings, audit, projects, reporting, stored


def _names():
    return [name for plan in _plans() for name in plan.oracle_sql()]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    assert all(plan.queries().keys() == plan.oracle_sql().keys() for plan in _plans())
    assert len(_names()) == len(set(_names()))


@pytest.mark.parametrize("name", _names())
def test_equals_its_sql(spark, con, name):
    plan = next(p for p in _plans() if name in p.queries())
    df = plan.queries()[name](spark, SF)
    want = con.sql(plan.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
