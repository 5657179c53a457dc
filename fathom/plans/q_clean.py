"""Contract queries for cleaning (keys ``clean_*``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import clean as C
from fathom.operators.dates import detect_date_formats, parse_dates
from fathom.operators.group_bounds import cap_outliers_by, flag_outliers_by
from fathom.plans.contract import DIRTY_EVENTS_SQL, dirty_events, register, rnd, sql_rnd, table

DIRTY = DIRTY_EVENTS_SQL

# C1
register("clean_drop_nulls", f"SELECT * FROM {DIRTY} AS d WHERE value IS NOT NULL")(
    lambda spark, d: C.drop_nulls(dirty_events(spark, d)))

# C2
register("clean_fill_mean", f"""
SELECT event_id, ts, user_id, event_type,
       {sql_rnd("coalesce(value, (SELECT avg(value) FROM " + DIRTY + " AS m))", 4)} AS value
FROM {DIRTY} AS d""")(
    lambda spark, d: C.fill_nulls(dirty_events(spark, d), {"value": "mean"}).withColumn("value", rnd("value", 4)))

# C3 full-row duplicates
register("clean_dedup_rows", f"SELECT DISTINCT * FROM {DIRTY} AS d")(
    lambda spark, d: C.drop_duplicates(dirty_events(spark, d)))

# C3 subset key, survivor chosen by an explicit order
_KEEP_ORDER = ["l_extendedprice DESC", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus", "l_shipdate"]
register("clean_dedup_keep_first", f"""
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(_KEEP_ORDER)}) = 1""")(
    lambda spark, d: C.drop_duplicates(
        table(spark, d, "lineitem"), subset=["l_orderkey", "l_linenumber"],
        order_by=[F.desc("l_extendedprice"), *[F.asc(c) for c in _KEEP_ORDER[1:]]]))

# C4
register("clean_cap_p99", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       {sql_rnd("least(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem))", 4)}
         AS l_extendedprice
FROM lineitem""")(
    lambda spark, d: C.cap_outliers(table(spark, d, "lineitem"), "l_extendedprice", upper=0.99).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", rnd("l_extendedprice", 4).alias("l_extendedprice")))

# C5 IQR rule (k = 1.5)
register("clean_outliers_iqr", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q
WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)""")(
    lambda spark, d: C.drop_outliers(table(spark, d, "events"), "value", "iqr").select("event_id", "value"))

# C5 z-score rule (k = 3)
register("clean_outliers_zscore", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT event_id, value, value > m + 3 * sd OR value < m - 3 * sd AS value_outlier FROM events, s""")(
    lambda spark, d: C.flag_outliers(table(spark, d, "events"), "value", "zscore").select(
        "event_id", "value", "value_outlier"))

# C6 numeric text -> number: ' 1,234 ' style text built from the order total
_NUM_TEXT_SPARK = """CASE WHEN o_orderkey % 5 = 0 THEN (CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '12d' WHEN 2 THEN 'NaN' ELSE '0x1p3' END)
  WHEN o_orderkey % 5 = 1 THEN concat(' ', CAST(CAST(floor(o_totalprice) AS BIGINT) DIV 1000 AS STRING), ',',
                                   lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'), ' ')
  ELSE CAST(o_totalprice AS STRING) END"""
_NUM_TEXT_DUCK = """CASE WHEN o_orderkey % 5 = 0 THEN (CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '12d' WHEN 2 THEN 'NaN' ELSE '0x1p3' END)
  WHEN o_orderkey % 5 = 1 THEN concat(' ', CAST(CAST(floor(o_totalprice) AS BIGINT) // 1000 AS VARCHAR), ',',
                                   lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0'), ' ')
  ELSE CAST(o_totalprice AS VARCHAR) END"""
register("clean_to_number", f"""
SELECT o_orderkey, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(t AS DOUBLE) END AS amount
FROM (SELECT o_orderkey, regexp_replace({_NUM_TEXT_DUCK}, '[, \\t]', '', 'g') AS t FROM orders)""")(
    lambda spark, d: C.to_number(
        table(spark, d, "orders").select("o_orderkey", F.expr(_NUM_TEXT_SPARK).alias("amount")), "amount"))

# C7 dates in three formats -> one date
register("clean_dates", """
SELECT o_orderkey, strftime(coalesce(try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%d/%m/%Y'),
                            try_strptime(txt, '%Y%m%d'))::DATE, '%Y-%m-%d') AS order_day
FROM (SELECT o_orderkey,
             CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                                 WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
                                 ELSE strftime(o_orderdate, '%Y%m%d') END AS txt
      FROM orders)""")(
    lambda spark, d: C.to_date(
        table(spark, d, "orders").select("o_orderkey", F.expr(
            "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
            "WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'yyyyMMdd') END"
        ).alias("order_day")), "order_day", ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"]).select(
        "o_orderkey", F.date_format("order_day", "yyyy-MM-dd").alias("order_day")))

# C8 nested records -> flat columns
register("clean_flatten", """
SELECT event_id AS rec_id, event_type AS rec_meta_type, user_id AS rec_meta_user, ts AS rec_meta_ts FROM events""")(
    lambda spark, d: C.flatten(table(spark, d, "events").select(F.struct(
        F.col("event_id").alias("id"),
        F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.col("ts").alias("ts")).alias("meta"),
    ).alias("rec"))))

# C9 arrays -> rows (empty or NULL arrays keep one row)
register("clean_explode", """
SELECT vec_id, (i - 1)::INTEGER AS pos, round(embedding[i]::DOUBLE, 5) + 0.0 AS x
FROM embeddings, LATERAL (SELECT unnest(generate_series(1, greatest(len(embedding), 1))) AS i)""")(
    lambda spark, d: C.explode_column(table(spark, d, "embeddings").select("vec_id", "embedding"),
                                      "embedding", position="pos", out="x").select(
        "vec_id", "pos", rnd("x", 5).alias("x")))

# C10 JSON text -> typed fields
register("clean_parse_json", """
SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")(
    lambda spark, d: C.parse_json(table(spark, d, "events"), "props", "k int").select(
        "event_id", F.col("props.k").alias("k")))

# C11 merge tables with different columns
register("clean_merge_tables", """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment,
       'customer' AS source FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""")(
    lambda spark, d: C.merge_tables({
        "customer": table(spark, d, "customer").selectExpr(
            "c_custkey AS id", "c_name AS name", "c_nationkey AS nationkey", "c_acctbal AS acctbal",
            "c_mktsegment AS segment"),
        "supplier": table(spark, d, "supplier").selectExpr(
            "s_suppkey AS id", "s_name AS name", "s_nationkey AS nationkey", "s_acctbal AS acctbal"),
    }))

# C12 nulls -> duplicates -> cap value at p99 (the flagship)
CLEAN_RULES = C.CleanRules(null_subset=["value"], outlier_cols={"value": "cap"})
_CLEAN_ALL_SQL = f"""
WITH nn AS (SELECT * FROM {DIRTY} AS d WHERE value IS NOT NULL),
     dd AS (SELECT DISTINCT * FROM nn),
     p AS (SELECT quantile_cont(value, 0.99) AS hi FROM dd)
SELECT event_id, ts, user_id, event_type, {sql_rnd("least(value, hi)", 4)} AS value FROM dd, p"""
register("clean_all", _CLEAN_ALL_SQL)(
    lambda spark, d: C.clean(dirty_events(spark, d), CLEAN_RULES)[0].withColumn("value", rnd("value", 4)))

# C13 cleaning report
register("clean_report", f"""
WITH d AS (SELECT * FROM {DIRTY} AS x),
     nn AS (SELECT * FROM d WHERE value IS NOT NULL),
     dd AS (SELECT DISTINCT * FROM nn),
     p AS (SELECT quantile_cont(value, 0.99) AS hi FROM dd)
SELECT 'drop_nulls' AS step, 'value' AS "column", (SELECT count(*) FROM d) AS rows_in,
       (SELECT count(*) FROM nn) AS rows_out, (SELECT count(*) FROM d) - (SELECT count(*) FROM nn) AS affected
UNION ALL
SELECT 'drop_duplicates', NULL, (SELECT count(*) FROM nn), (SELECT count(*) FROM dd),
       (SELECT count(*) FROM nn) - (SELECT count(*) FROM dd)
UNION ALL
SELECT 'cap_p99', 'value', (SELECT count(*) FROM dd), (SELECT count(*) FROM dd),
       (SELECT count(*) FROM dd, p WHERE value > hi)""")(
    lambda spark, d: C.cleaning_report_frame(dirty_events(spark, d), CLEAN_RULES))

# C14 output information of the cleaned table
register("clean_output_info", f"""
WITH nn AS (SELECT * FROM {DIRTY} AS d WHERE value IS NOT NULL),
     dd AS (SELECT DISTINCT * FROM nn)
SELECT position, column_name, data_type, (SELECT count(*) FROM dd) AS rows
FROM (VALUES (0, 'event_id', 'bigint'), (1, 'ts', 'timestamp_ntz'), (2, 'user_id', 'bigint'),
             (3, 'event_type', 'string'), (4, 'value', 'double')) AS t(position, column_name, data_type)""")(
    lambda spark, d: C.describe_output(C.clean(dirty_events(spark, d), CLEAN_RULES)[0]))

# C2 with a median fill
register("clean_fill_median", f"""
SELECT event_id, ts, user_id, event_type,
       {sql_rnd("coalesce(value, (SELECT quantile_cont(value, 0.5) FROM " + DIRTY + " AS m))", 4)} AS value
FROM {DIRTY} AS d""")(
    lambda spark, d: C.fill_nulls(dirty_events(spark, d), {"value": "median"}).withColumn("value", rnd("value", 4)))


def _nan_events(spark, d):
    """events with NaN as the value of every 7th row; the SQL below reads those as NULL."""
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("value"))


_NAN_EVENTS_SQL = "(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"

# C4, C5 with NaN: a missing value is neither capped nor an outlier
register("clean_cap_nan", f"""
SELECT event_id, {sql_rnd("least(value, (SELECT quantile_cont(value, 0.99) FROM " + _NAN_EVENTS_SQL + " AS m)) + value * 0", 4)} AS value
FROM {_NAN_EVENTS_SQL} AS e""")(
    lambda spark, d: C.cap_outliers(_nan_events(spark, d), "value", upper=0.99).select("event_id", rnd("value", 4).alias("value")))

register("clean_outliers_nan", f"""
WITH e AS {_NAN_EVENTS_SQL}, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e)
SELECT event_id, value IS NULL AS missing FROM e, q
WHERE value IS NULL OR (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))""")(
    lambda spark, d: C.drop_outliers(_nan_events(spark, d), "value", "iqr").select("event_id", F.isnan("value").alias("missing")))


# C13 with conversions and a fill: text amounts to numbers, missing ones filled with 0
_CONVERT_RULES = C.CleanRules(to_numbers=["amount"], fills={"amount": 0.0}, null_subset=["amount"], dedup=False)
register("clean_report_conversions", f"""
WITH o AS (SELECT o_orderkey, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(t AS DOUBLE) END AS amount
           FROM (SELECT o_orderkey, regexp_replace({_NUM_TEXT_DUCK}, '[, \\t]', '', 'g') AS t FROM orders))
SELECT 'to_number' AS step, 'amount' AS "column", count(*) AS rows_in, count(*) AS rows_out, count(amount) AS affected FROM o
UNION ALL SELECT 'fill_nulls', 'amount', count(*), count(*), count(*) - count(amount) FROM o
UNION ALL SELECT 'drop_nulls', 'amount', count(*), count(*), 0 FROM o""")(
    lambda spark, d: C.cleaning_report_frame(
        table(spark, d, "orders").select("o_orderkey", F.expr(_NUM_TEXT_SPARK).alias("amount")), _CONVERT_RULES))

# C7 with the formats found from the data: four shapes, one of them open until another shows that days come first.
_TEXT_DAYS = ("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') "
              "WHEN 2 THEN date_format(o_orderdate, 'd MMM yyyy') ELSE date_format(o_orderdate, 'MMMM d, yyyy') END")


def _text_days(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(_TEXT_DAYS).alias("order_day"))


def _detected(spark, d):
    days = _text_days(spark, d)
    return parse_dates(days, "order_day", detect_date_formats(days, "order_day")).select(
        "o_orderkey", F.date_format("order_day", "yyyy-MM-dd").alias("order_day"))


register("clean_dates_detected", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders""")(_detected)


def _shapes(spark, d):
    found = detect_date_formats(_text_days(spark, d), "order_day")
    return spark.createDataFrame([(s.shape, s.n, list(s.formats)[0] if s.formats else None, s.status) for s in found],
                                 "shape string, n long, format string, status string")


register("clean_date_shapes", """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Y-D-D' WHEN 1 THEN 'D/D/Y' WHEN 2 THEN 'D a Y' ELSE 'a D, Y' END AS shape, count(*) AS n,
       CASE o_orderkey % 4 WHEN 0 THEN 'yyyy-M-d' WHEN 1 THEN 'd/M/yyyy' WHEN 2 THEN 'd MMM yyyy' ELSE 'MMMM d, yyyy' END AS format, 'clear' AS status
FROM orders GROUP BY 1, 3""")(_shapes)

# C4, C5 with bounds per group
register("clean_cap_by_group", f"""
WITH b AS (SELECT l_returnflag AS f, l_linestatus AS s, quantile_cont(l_extendedprice, 0.99) AS hi, quantile_cont(l_extendedprice, 0.05) AS lo FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, {sql_rnd("greatest(least(l_extendedprice, hi), lo)", 4)} AS l_extendedprice
FROM lineitem JOIN b ON l_returnflag = f AND l_linestatus = s""")(
    lambda spark, d: cap_outliers_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", lower=0.05, upper=0.99).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", rnd("l_extendedprice", 4).alias("l_extendedprice")))

register("clean_outliers_by_group", f"""
WITH e AS (SELECT * FROM {DIRTY} AS d),
     b AS (SELECT event_type AS t, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e GROUP BY 1)
SELECT event_id, event_type, value, coalesce(value < q1 - 0.5 * (q3 - q1) OR value > q3 + 0.5 * (q3 - q1), false) AS value_outlier FROM e JOIN b ON event_type = t""")(
    lambda spark, d: flag_outliers_by(dirty_events(spark, d), ["event_type"], "value", "iqr", k=0.5).select("event_id", "event_type", "value", "value_outlier"))
