"""Every registered query over the smallest tables, against its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

from codeloom.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (int, bool)):
        return f"{float(v):.6g}" if abs(v) < 10**5 else str(int(v))
    return str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(dict(zip(names, row))[c]) for c in cols) for row in r.fetchall())
