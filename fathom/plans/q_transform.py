"""Contract queries for the suggested transformations (keys ``t_*``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import transform as X
from fathom.plans.contract import register, rnd, sql_rnd, table

_EV = "events"

register("t_normalize", f"""
SELECT event_id, {sql_rnd("(value - mn) / (mx - mn)", 6)} AS value_normalized
FROM events, (SELECT min(value) AS mn, max(value) AS mx FROM events)""")(
    lambda spark, d: X.normalize(table(spark, d, _EV), "value").select(
        "event_id", rnd("value_normalized", 6).alias("value_normalized")))

register("t_scale", f"""
SELECT event_id, {sql_rnd("(value - m) / s", 6)} AS value_scaled
FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""")(
    lambda spark, d: X.scale(table(spark, d, _EV), "value").select(
        "event_id", rnd("value_scaled", 6).alias("value_scaled")))

register("t_log", f"""
SELECT event_id, {sql_rnd("CASE WHEN value > -1 THEN ln(1 + value) END", 6)} AS value_log FROM events""")(
    lambda spark, d: X.log_transform(table(spark, d, _EV), "value").select(
        "event_id", rnd("value_log", 6).alias("value_log")))

register("t_binning", """
SELECT event_id, least(floor((value - mn) / ((mx - mn) / 10)), 9)::INTEGER AS value_bin
FROM events, (SELECT min(value) AS mn, max(value) AS mx FROM events)""")(
    lambda spark, d: X.binning(table(spark, d, _EV), "value", bins=10).select("event_id", "value_bin"))

register("t_one_hot", """
SELECT event_id,
       (event_type = 'click')::INTEGER AS event_type_click, (event_type = 'error')::INTEGER AS event_type_error,
       (event_type = 'purchase')::INTEGER AS event_type_purchase,
       (event_type = 'signup')::INTEGER AS event_type_signup, (event_type = 'view')::INTEGER AS event_type_view
FROM events""")(
    lambda spark, d: X.one_hot_encode(table(spark, d, _EV).select("event_id", "event_type"), "event_type",
                                      sorted(r[0] for r in X.categories(table(spark, d, _EV), "event_type").collect()))
    .drop("event_type"))

register("t_label", """
SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS o_orderpriority_label
FROM orders""")(
    lambda spark, d: X.label_encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"),
                                    "o_orderpriority").select("o_orderkey", "o_orderpriority_label"))

register("t_tokens", """
SELECT token, count(*)::BIGINT AS count
FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS token FROM documents)
WHERE token <> '' GROUP BY token""")(
    lambda spark, d: X.token_counts(table(spark, d, "documents"), "text"))

register("t_string_clean", r"""
SELECT conv_id, turn, lower(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS text FROM conversations""")(
    lambda spark, d: X.string_cleaning(table(spark, d, "conversations"), "text").select("conv_id", "turn", "text"))

register("t_regex", """
SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS url_extract FROM pages""")(
    lambda spark, d: X.regex_extract(table(spark, d, "pages"), "url", r"^https?://([^/:?#]+)", 1).select(
        "page_id", "url_extract"))

register("t_year", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year FROM orders")(
    lambda spark, d: X.extract_year(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "o_orderdate_year"))

register("t_month", "SELECT o_orderkey, month(o_orderdate)::INTEGER AS o_orderdate_month FROM orders")(
    lambda spark, d: X.extract_month(table(spark, d, "orders"), "o_orderdate").select(
        "o_orderkey", "o_orderdate_month"))

register("t_time_delta", f"""
SELECT event_id, user_id,
       {sql_rnd("date_sub('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6", 6)}
         AS ts_delta_seconds
FROM events""")(
    lambda spark, d: X.time_delta(table(spark, d, _EV), "ts", key=["user_id"], tiebreak=["event_id"]).select(
        "event_id", "user_id", rnd("ts_delta_seconds", 6).alias("ts_delta_seconds")))

register("t_dow", "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_dow FROM orders")(
    lambda spark, d: X.day_of_week(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "o_orderdate_dow"))

register("t_time_bin", """
SELECT event_id, date_trunc('hour', ts) AS ts_hour, time_bucket(INTERVAL '15 minutes', ts) AS ts_15min FROM events""")(
    lambda spark, d: X.time_binning(
        X.time_binning(table(spark, d, _EV), "ts", unit="hour", out="ts_hour"), "ts", width="15 minutes",
        out="ts_15min").select("event_id", "ts_hour", "ts_15min"))

register("t_time_delta_between", f"""
SELECT l_orderkey, l_linenumber, {sql_rnd("date_sub('microsecond', o_orderdate, l_shipdate) / 1e6", 1)}
         AS ship_delay_seconds
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")(
    lambda spark, d: X.time_delta(
        table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")),
        "l_shipdate", other="o_orderdate", out="ship_delay_seconds").select(
        "l_orderkey", "l_linenumber", rnd("ship_delay_seconds", 1).alias("ship_delay_seconds")))

# Rows without a timestamp stay, without a bucket.
register("t_time_bin_null", """
SELECT event_id, time_bucket(INTERVAL '15 minutes', CASE WHEN event_id % 5 <> 0 THEN ts END) AS ts_15min FROM events""")(
    lambda spark, d: X.time_binning(table(spark, d, _EV).withColumn("ts", F.when(F.col("event_id") % 5 != 0, F.col("ts"))), "ts", width="15 minutes",
                                    out="ts_15min").select("event_id", "ts_15min"))

# NaN is missing: it has no bin and moves no bound.
register("t_binning_nan", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)
SELECT event_id, CASE WHEN value IS NOT NULL THEN least(floor((value - mn) / ((mx - mn) / 10)), 9) END::INTEGER AS value_bin
FROM e, (SELECT min(value) AS mn, max(value) AS mx FROM e)""")(
    lambda spark, d: X.binning(table(spark, d, _EV).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(F.lit(float("nan")))),
                               "value", bins=10).select("event_id", "value_bin"))

# One sequence over all rows, without a key.
register("t_time_delta_all", f"""
SELECT event_id, {sql_rnd("date_sub('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) / 1e6", 6)} AS ts_delta_seconds FROM events""")(
    lambda spark, d: X.time_delta(table(spark, d, _EV).select("event_id", "ts"), "ts", tiebreak=["event_id"]).select(
        "event_id", rnd("ts_delta_seconds", 6).alias("ts_delta_seconds")))
