import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathom.operators.dates import OTHER, detect_date_formats, parse_dates


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)


def found(df, prefer=None):
    return {s.shape: s for s in detect_date_formats(df, "t", prefer)}


def dates(df, prefer=None):
    return [r["t"] for r in parse_dates(df, "t", detect_date_formats(df, "t", prefer)).orderBy("id").collect()]


def test_days_above_twelve_decide_for_every_shape(spark):
    df = frame(spark, ["03/04/2020", "5/6/2020", "25-12-2020", " 2020-02-30 ", "2020-1-9", "May 5, 2021", "20210711", None, "soon", "x" * 60, "1.2.2020 3"])
    got = found(df)
    assert got["D/D/Y"].status == "by_column" and got["D/D/Y"].formats == ("d/M/yyyy",)
    assert got["D-D-Y"].status == "clear" and got["D-D-Y"].formats == ("d-M-yyyy",)
    assert got["Y-D-D"].status == "mixed" and got["Y-D-D"].read == (1,)      # 30 February is no date
    assert got["a D, Y"].status == "clear" and got[OTHER].n == 3
    d = dt.date
    assert dates(df) == [d(2020, 4, 3), d(2020, 6, 5), d(2020, 12, 25), None, d(2020, 1, 9), d(2021, 5, 5), d(2021, 7, 11), None, None, None, None]


def test_ambiguous_is_reported_and_not_guessed(spark):
    df = frame(spark, ["03/04/2020", "05/06/2020", "7/7/2020"])
    assert found(df)["D/D/Y"].status == "ambiguous" and dates(df) == [None] * 3
    assert found(df, "month")["D/D/Y"].status == "preferred"
    assert dates(df, "month")[0] == dt.date(2020, 3, 4) and dates(df, "day")[0] == dt.date(2020, 4, 3)
    same = frame(spark, ["3/3/2020", "4/4/2021"])      # both orders give the same dates
    assert found(same)["D/D/Y"].status == "clear" and dates(same)[1] == dt.date(2021, 4, 4)
    with pytest.raises(ValueError):
        detect_date_formats(df, "t", "year")


def test_contradicting_values_are_mixed(spark):
    df = frame(spark, ["25/12/2020", "12/25/2020", "26/12/2020", "01/02/2020"])
    got = found(df)["D/D/Y"]
    assert got.status == "mixed" and got.formats == ("d/M/yyyy", "M/d/yyyy") and got.read == (3, 2)
    assert dates(df) == [dt.date(2020, 12, 25), dt.date(2020, 12, 25), dt.date(2020, 12, 26), dt.date(2020, 2, 1)]


def test_months_by_name_times_and_no_values(spark):
    df = frame(spark, ["1 Sep 2020", "2 September 2020", "30-Jan-2020", "2020-01-02T03:04:05", "2020-01-02 3:04"])
    assert dates(df) == [dt.date(2020, 9, 1), dt.date(2020, 9, 2), dt.date(2020, 1, 30), dt.date(2020, 1, 2), dt.date(2020, 1, 2)]
    empty = frame(spark, ["x"]).where(F.lit(False))
    assert detect_date_formats(empty, "t") == [] and dates(empty) == []
