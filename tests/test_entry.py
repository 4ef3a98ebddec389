import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["order_tree_scope_cut", "event_ci_by_group", "identical_document_groups", "user_dispatch_rule", "program_diff_links", "program_scope_blocks", "program_sigma_blocks"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer orders lineitem events documents part".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
    cols = df.columns
    assert sorted(key([r[c] for c in cols]) for r in df.collect()) == sorted(map(key, con.sql(f"select {','.join(cols)} from want").fetchall()))
