"""The pipeline's stages on the smallest tables, and every query against its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gridhazard.session import configure, cut_lineage

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_eleven_queries():
    assert sorted(int(n.split("_")[0][2:]) for n in NAMES) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    rows = sorted(map(repr, map(tuple, got.select(*sorted(got.columns)).collect())))
    if name in entry.oracle_sql():
        cur = con.execute(entry.oracle_sql()[name])
        at = [[d[0] for d in cur.description].index(c) for c in sorted(got.columns)]
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
    elif name.startswith("op6"):
        assert 0 < len(rows) <= 5 * con.execute("SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0").fetchone()[0]
    else:
        ids = {r[0] for r in got.select("doc_id").collect()}
        assert ids == {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}


def test_stages_decide_and_compose(spark):
    configure(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, SF))
        after = docs.count()
        assert docs.columns == columns and 0.6 * before < after <= before, name
        assert after == before if name == "secret_scan" else after < before or name == "benchmark_decontamination"
        before = after
    pieces = corpus_pipeline.packing(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == before
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.select("doc_id", "start", "length", "ids_crc32").collect())) and again.columns == pieces.columns
