"""The entry module: names, oracle keys and a few queries against DuckDB."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["A06_roc_auc", "A08_A09_tpr_at_fpr", "J08_hamming_leaks", "T10_T11_resolution_matched", "W09_shards", "M05_U07_fusion_lattice"])
def test_queries_equal_duckdb(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = e.queries()[name](spark, SF)
    got = con.execute(e.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str(r) for r in got.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want


def test_every_oracle_has_a_query(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 90
    rows = e.entry(spark).collect()
    assert rows and all(r.auc is None or not math.isnan(r.auc) for r in rows)
