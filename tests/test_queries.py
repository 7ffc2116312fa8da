"""Every core query against its SQL, on the smallest tables, and on tables with nothing in them."""

import math
import os

import pytest

DATA = os.environ.get("FOLIOFLOW_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def names():
    from folioflow.plans import catalogue

    return sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[: -len('.parquet')]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", names())
def test_same_as_sql(spark, duck, name):
    from folioflow.plans import catalogue

    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalogue.ORACLE_SQL:
        cur = duck.execute(catalogue.ORACLE_SQL[name])
        at = [x[0] for x in cur.description]
        assert sorted(at) == cols
        want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert got == want


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).coalesce(1).write.parquet(str(folder / f))
    return str(folder)


@pytest.mark.parametrize("name", names())
def test_empty_tables(spark, empty, name):
    from folioflow.plans import catalogue

    assert len(catalogue.QUERIES[name](spark, empty).collect()) <= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
