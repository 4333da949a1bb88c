"""Every query of this folder over the smallest tables, against its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

from codeloom.llm.queries import ORACLES, QUERIES



def plain(v):
    return "" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)


DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
FOUND = {"p1_found": {"file_id"}, "p2_found": {"id", "name"}, "p3_found": {"id", "line"}, "p4_found": {"id_1", "id_2"}, "p5_found": {"id", "defect"}, "p6_found": {"file_id"}, "p7_found": {"id"}, "p8_found": {"doc_id"}, "p9_found": {"mix_name", "source"}, "p10_found": {"doc_id"}}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    if name in FOUND:
        assert set(df.columns) == FOUND[name] and len(rows) == len(set(rows))
    if name in ORACLES:
        con = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        r = con.execute(ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(map(plain, x)) for x in rows) == sorted(tuple(plain(dict(zip(names, x))[c]) for c in sorted(names)) for x in r.fetchall())
