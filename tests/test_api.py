from fathom import api


def test_read_metadata_by_extension(spark, tmp_path):
    csv = tmp_path / "scores.csv"
    csv.write_text("id,score\nS1,1.5\nS2,2.5\nS3,\n")
    frame, files, errors = api.read_metadata(spark, str(csv))
    prof = {r["column_name"]: r for r in frame.collect()}
    assert not errors and files[0]["format"] == "csv" and files[0]["size_bytes"] == csv.stat().st_size and files[0]["delimiter"] == ","
    assert prof["score"]["null_count"] == 1 and prof["score"]["mean"] == 2.0
    assert prof["id"]["table_name"] == "scores" and prof["id"]["type"] == "string"
    spark.range(0, 3).write.parquet(str(tmp_path / "ids.parquet"))
    both, files, errors = api.read_metadata(spark, {"a": str(csv), "b": str(tmp_path / "ids.parquet"), "c": str(tmp_path / "none.csv"), "d": "x.xyz"})
    assert {r["table_name"] for r in both.collect()} == {"a", "b"} == {f["table_name"] for f in files}
    assert [name for name, _ in errors] == ["c", "d"]
    assert api.read_metadata(spark, str(tmp_path / "none.csv"))[0] is None
    assert api.file_format("/x/y.csv.gz") == ("csv", ".csv")


def test_query_chart_and_json(spark, tmp_path):
    t = {"t": spark.createDataFrame([("x", 1.0), ("y", 3.0)], "k string, v double")}
    q = api.run_code(spark, t, "SELECT k, v * 2 AS v FROM t")
    assert sorted(r["v"] for r in q.collect()) == [2.0, 6.0]
    assert {r["label"] for r in api.chart(q, ["bar"]).collect()} == {"x", "y"}
    path = api.to_json(q, str(tmp_path / "out.json"))
    assert api.read_json_file(spark, path).count() == 2
