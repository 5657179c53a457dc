"""User code per group: groups that share an Arrow batch, or lie in several, come whole and with their own types."""

import pandas as pd
import pytest

from fathom.operators.udf import apply_groups

ROWS = [(k, i, None if (k or 0) % 5 == 1 and i % 3 == 0 else (1 << 53) + i, None if k == 4 and i == 1 else i % 2 == 0) for k in [None, *range(40)] for i in range(1 + (k or 0) % 7 * 3)]
SCHEMA = "k long, i int, v long, b boolean"
WANT = "k long, i int, n long, total long, types string, calls int"


def _seen():
    def seen(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.groupby("k", dropna=False)["i"]
        v = pdf["v"].fillna(0).astype("int64").groupby(pdf["k"], dropna=False).transform("sum")
        return pd.DataFrame({"k": pdf["k"], "i": pdf["i"], "n": g.transform("size"), "total": v, "types": ",".join(map(str, pdf.dtypes)), "calls": [1] + [0] * (len(pdf) - 1)})
    return seen


seen = _seen()        # made in a function, so that workers get it by value


@pytest.mark.parametrize("batch", [4, 10_000])
@pytest.mark.parametrize("many", [False, True])
def test_groups_as_apply_in_pandas_gives_them(spark, batch, many):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    want = df.groupBy("k").applyInPandas(seen, WANT).collect()
    spark.conf.set(key, str(batch))
    try:
        got = apply_groups(df, ["k"], seen, WANT, many=many).collect()
    finally:
        spark.conf.set(key, before)
    order = lambda rows: sorted(map(repr, (tuple(r)[:5] for r in rows)))
    assert order(got) == order(want)
    calls = sum(r.calls for r in got)
    assert calls == 41 if not many else calls <= 41
    if many and batch > len(ROWS):
        assert calls < 41


def test_results_of_other_types_and_without_rows(spark):
    df = spark.createDataFrame([(k, (1 << 53) + k) for k in range(30) for _ in range(2)], "k long, v long")
    some = apply_groups(df, ["k"], lambda p: pd.DataFrame() if p.k[0] % 3 == 0 else p.assign(v=p.v if p.k[0] % 3 == 1 else None), "k long, v long")
    assert sorted(map(tuple, some.distinct().collect())) == [(k, (1 << 53) + k if k % 3 == 1 else None) for k in range(30) if k % 3]


def test_no_stream_for_each_group(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert "FlatMapGroupsInPandas" not in apply_groups(df, ["k"], seen, WANT)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in apply_groups(df, ["k"], lambda key, p: seen(p), WANT)._jdf.queryExecution().executedPlan().toString()
