import duckdb

import __spark_entry__ as E
from fathom.plans import catalog
from fathom.plans.contract import ALL_TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["event_id", "ts", "user_id", "event_type", "value"]


def test_every_query_has_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_sample_of_queries_match_duckdb(spark):
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["clean_all", "profile_percentiles", "query_group_agg", "scan_text", "t_label"]:
        s = E.queries()[name](spark, SF).toPandas()
        d = con.execute(E.oracle_sql()[name]).df()
        cols = sorted(s.columns)
        assert cols == sorted(d.columns), name
        key = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
        assert key(s) == key(d), name
