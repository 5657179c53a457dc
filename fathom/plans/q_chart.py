"""Contract queries for chart data (keys ``chart_*``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators.chart import chart_data, line_pixels
from fathom.plans.contract import register, rnd, sql_rnd, table


def _bar_sql(where: str = "", having: str = "") -> str:
    parts = []
    for pos, m in [(1, "l_quantity"), (2, "l_extendedprice")]:
        parts.append(f"SELECT l_returnflag AS label, '{m}' AS series, {pos} AS series_index, {pos % 3} AS color_index, "
                     f"{sql_rnd(f'sum({m})', 2)} AS value FROM lineitem {where} GROUP BY l_returnflag "
                     + (having.format(m=m) if having else ""))
    return "\nUNION ALL\n".join(parts)


def _bar(spark, d, **kw):
    src = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return chart_data(src, "bar", **kw).withColumn("value", rnd("value", 2))


register("chart_bar", _bar_sql())(lambda spark, d: _bar(spark, d))
register("chart_disabled", _bar_sql("WHERE l_returnflag NOT IN ('N')"))(lambda spark, d: _bar(spark, d, disabled=["N"]))
register("chart_ymin", _bar_sql(having="HAVING sum({m}) >= 1000000"))(lambda spark, d: _bar(spark, d, y_min=1_000_000))

register("chart_line", f"""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS label, 'value' AS series, 1 AS series_index,
       1 AS color_index, {sql_rnd("sum(value)", 2)} AS value
FROM events GROUP BY 1""")(
    lambda spark, d: chart_data(table(spark, d, "events").select("ts", "value"), "line", label="ts",
                                label_unit="day", label_format="yyyy-MM-dd").withColumn("value", rnd("value", 2)))

register("chart_pie", f"""
WITH g AS (SELECT o_orderpriority AS label, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT label, 'o_totalprice' AS series, 1 AS series_index,
       ((row_number() OVER (ORDER BY label NULLS LAST) - 1) % 3)::INTEGER AS color_index, {sql_rnd("v", 2)} AS value,
       round(v / (SELECT sum(v) FROM g) * 100)::BIGINT AS pct, v > 5 AS show_label
FROM g""")(
    lambda spark, d: chart_data(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), ["pie"])
    .withColumn("value", rnd("value", 2)))

# Series by value: (status, flag) without a pivot.
register("chart_series", f"""
SELECT l_returnflag AS label, l_linestatus AS series,
       (dense_rank() OVER (ORDER BY l_linestatus NULLS LAST) - 1)::INTEGER AS series_index,
       ((dense_rank() OVER (ORDER BY l_linestatus NULLS LAST) - 1) % 3)::INTEGER AS color_index, {sql_rnd("sum(l_quantity)", 2)} AS value
FROM lineitem GROUP BY 1, 2""")(
    lambda spark, d: chart_data(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), "bar", label="l_returnflag",
                                series="l_linestatus").withColumn("value", rnd("value", 2)))

# A line of every event at 400 pixels, a series an event type.
register("chart_line_pixels", f"""
WITH p AS (SELECT event_type AS series, epoch_us(ts)::DOUBLE AS x, value AS y FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
     s AS (SELECT min(x) AS low, max(x) AS high FROM p)
SELECT series, least(floor((x - low) / (high - low) * 400.0), 399)::INTEGER AS pixel, count(*) AS n, min(x)::BIGINT AS x_first, max(x)::BIGINT AS x_last,
       {sql_rnd("first(y ORDER BY x, y)")} AS y_first, {sql_rnd("last(y ORDER BY x, y)")} AS y_last, {sql_rnd("min(y)")} AS y_min, {sql_rnd("max(y)")} AS y_max
FROM p, s GROUP BY 1, 2""")(
    lambda spark, d: line_pixels(table(spark, d, "events"), "ts", "value", 400, series="event_type").select(
        "series", "pixel", "n", F.col("x_first").cast("bigint").alias("x_first"), F.col("x_last").cast("bigint").alias("x_last"),
        *[rnd(c).alias(c) for c in ("y_first", "y_last", "y_min", "y_max")]))
