"""Every named core query against its SQL in DuckDB over the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from facetmill.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    d = duckdb.connect()
    d.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        d.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return d


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        cur = db.execute(sql)
        have = [x[0] for x in cur.description]
        assert sorted(have) == cols
        assert got == Counter(tuple(cell(r[have.index(c)]) for c in cols) for r in cur.fetchall())


def test_flagship(spark):
    assert catalogue.flagship(spark, str(DATA)).count() > 0
