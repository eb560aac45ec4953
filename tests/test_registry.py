import glob
import os

import duckdb
import pytest

import __spark_entry__ as E

FOLDER = "/root/testdata/sf0.001"
CHEAP = ["text_primary_tokens", "text_segments", "text_claim_units", "bm25_top10", "dense_top10", "gold_metrics", "unit_index", "verbatim_members", "carrier_classes", "answer_grading", "rates_pooled", "packed_blocks", "hyphen_summary", "p7_found"]


def test_sql_has_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 60


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if not isinstance(v, (int, bool)) else float(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", CHEAP)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(E.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(value(x) for x in r) for r in cur.fetchall()), key=repr)
    df = E.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(value(x) for x in r) for r in df.select(*names).collect()), key=repr)
    assert got == want
