import csv
import inspect
import json

import pytest
from pyspark.sql import functions as F

from fathom.sources import jdbc
from fathom.sources.files import read_csv, read_json, read_tables
from fathom.sources.sinks import json_safe, write_cleaned, write_csv, write_json


def test_csv_sep_line_quotes_and_blanks(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text('sep=;\n a ;b;c\n1;"x;y";\n2;;3\n3\n')
    df = read_csv(spark, str(p), sep_line=True, on_malformed="null")
    assert df.columns == ["a", "b", "c"]
    rows = df.orderBy("a").collect()
    assert rows[0]["b"] == "x;y" and rows[0]["c"] is None
    assert rows[1]["b"] is None and rows[1]["c"] == 3
    assert rows[2]["b"] is None and rows[2]["c"] is None
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "int"}
    empty = tmp_path / "e.csv"
    empty.write_text("sep=,\nk,blank\n1,\n2,\n")
    assert dict(read_csv(spark, str(empty), sep_line=True).dtypes) == {"k": "int", "blank": "string"}


def test_csv_plain(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("k,v\n1,2.5\n")
    assert read_csv(spark, str(p)).first().asDict() == {"k": 1, "v": 2.5}


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "none.csv")).collect()
    tables, errors = read_tables(spark, {"ok": str(tmp_path), "bad": str(tmp_path / "missing")}, fmt="csv")
    assert "bad" in dict(errors)


@pytest.mark.parametrize("orient,doc", [
    ("records", [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]),
    ("columns", {"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}),
    ("index", {"0": {"a": 1, "b": "x"}, "1": {"a": 2, "b": "y"}}),
    ("values", [[1, "x"], [2, "y"]]),
])
def test_json_layouts(spark, tmp_path, orient, doc):
    p = tmp_path / f"{orient}.json"
    p.write_text(json.dumps(doc))
    df = read_json(spark, str(p), orient=orient, schema="a long, b string", lines=False)
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, "x"), (2, "y")]


def test_json_write_layouts_and_safe_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    write_json(df, str(tmp_path / "r"), orient="records")
    assert sorted(r["a"] for r in read_json(spark, str(tmp_path / "r")).collect()) == [1, 2]
    write_json(df, str(tmp_path / "v"), orient="values")
    back = read_json(spark, str(tmp_path / "v"), orient="values", schema="a long, b string")
    assert sorted((r["a"], r["b"]) for r in back.collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        write_json(df, str(tmp_path / "i"), orient="index")
    odd = spark.sql("""SELECT CAST(1.50 AS DECIMAL(10,2)) AS d, double('NaN') AS n, CAST(NULL AS INT) AS z,
                       DATE'2024-01-02' AS dt, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS ts,
                       TIMESTAMP_NTZ'2024-01-02 03:04:05.25' AS ts2, array(double('NaN'), 1.0) AS arr,
                       map(1, DATE'2024-01-02') AS m, named_struct('p', CAST(2.5 AS DECIMAL(3,1))) AS st""")
    r = json_safe(odd).first()
    assert r["d"] == "1.50" and r["n"] is None and r["z"] is None and r["dt"] == "2024-01-02"
    assert r["ts"] == "2024-01-02T03:04:05" and r["ts2"] == "2024-01-02T03:04:05.250000"
    assert r["arr"] == [None, 1.0] and r["m"] == {"1": "2024-01-02"} and r["st"]["p"] == "2.5"


def test_write_cleaned(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    path = write_cleaned(df, str(tmp_path), "sales")
    assert path.endswith("sales_cleaned.csv")
    assert read_csv(spark, path).first().asDict() == {"a": 1, "b": "x"}


def test_jdbc_options_and_modes():
    o = jdbc.jdbc_read_options("jdbc:x", table="t", partition_column="id", lower_bound=0, upper_bound=100,
                               num_partitions=4)
    assert o["dbtable"] == "t" and o["numPartitions"] == "4"
    assert jdbc.jdbc_read_options("jdbc:x", query="select 1")["query"] == "select 1"
    with pytest.raises(ValueError):
        jdbc.jdbc_read_options("jdbc:x")
    assert [jdbc.jdbc_write_mode(m) for m in ("replace", "append", "fail")] == ["overwrite", "append", "errorifexists"]
    with pytest.raises(ValueError):
        jdbc.jdbc_write_mode("upsert")


def test_partitioned_query_and_default_write_mode():
    o = jdbc.jdbc_read_options("jdbc:x", query="select * from t", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=3)
    assert o["dbtable"] == "(select * from t) AS fathom_query" and o["partitionColumn"] == "id" and "query" not in o
    assert inspect.signature(jdbc.write_sql).parameters["if_exists"].default == "fail"


def test_csv_written_by_other_tools(spark, tmp_path):
    p = tmp_path / "rfc.csv"
    with open(p, "w", newline="") as f:
        csv.writer(f).writerows([["k", " note ", "", "z"], [1, 'say ""hi"", ok', "dropped", "C:\\dir\\"], [2, "two\nlines, \"quoted\"", "", "x"], [3, "", "", 'a"b']])
    rows = read_csv(spark, str(p), multi_line=True).orderBy("k").collect()
    assert rows[0].asDict() == {"k": 1, "note": 'say ""hi"", ok', "z": "C:\\dir\\"}
    assert rows[1]["note"] == 'two\nlines, "quoted"' and rows[2]["note"] is None and rows[2]["z"] == 'a"b'


def test_csv_keeps_empty_text_apart_from_null(spark, tmp_path):
    df = spark.createDataFrame([(1, ""), (2, None), (3, 'q"q'), (4, "a\nb")], "k long, v string")
    write_csv(df, str(tmp_path / "o"))
    assert sorted(read_csv(spark, str(tmp_path / "o"), schema=df.schema, multi_line=True).collect()) == sorted(df.collect())


def test_csv_rows_of_the_wrong_length(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("a,b\n1,x\n2,y,extra\n3\n")
    with pytest.raises(Exception):
        read_csv(spark, str(p), schema="a long, b string").collect()
    kept = {r["a"]: r["_malformed"] for r in read_csv(spark, str(p), schema="a long, b string", on_malformed="keep").collect()}
    assert kept == {1: None, 2: "2,y,extra", 3: "3"}
    assert read_csv(spark, str(p), on_malformed="null").count() == 3
    with pytest.raises(ValueError):
        read_csv(spark, str(p), on_malformed="ignore")


def test_sep_files_have_their_own_hint_and_keep_rows_like_the_header(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text("sep=;\nk;v\nk;v\n1;x\n1;x\n")
    (tmp_path / "d" / "2.csv").write_text('sep=|\nk|v\n2|"y|z"\nsep=|\n')
    rows = read_csv(spark, str(tmp_path / "d"), sep_line=True, on_malformed="null").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("k", "v"), ("1", "x"), ("1", "x"), ("2", "y|z"), ("sep=", None)], key=str)
    (tmp_path / "plain.csv").write_text("k,v\n1,2\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "plain.csv"), sep_line=True)


def test_json_form_is_said_not_guessed(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n\n[\n {"a": 1},\n {"a": 2}\n]\n')
    assert sorted(r["a"] for r in read_json(spark, str(tmp_path / "a.json"), lines=False).collect()) == [1, 2]
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path / "a.json"), schema="a long").collect()
    (tmp_path / "two").mkdir()
    for k in (1, 2):
        (tmp_path / "two" / f"{k}.json").write_text(json.dumps({"a": {"0": k}, "b": {"0": "x"}}))
    assert sorted(r["a"] for r in read_json(spark, str(tmp_path / "two"), orient="columns", schema="a long, b string").collect()) == [1, 2]


def test_a_null_struct_stays_null_in_json(spark):
    df = spark.sql("SELECT CAST(NULL AS STRUCT<a: DOUBLE>) AS s UNION ALL SELECT named_struct('a', 1.0D)")
    assert sorted(json_safe(df).collect(), key=str) == sorted(df.collect(), key=str)
