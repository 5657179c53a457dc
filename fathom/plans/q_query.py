"""Contract queries for the ad-hoc query surface, user-code hooks and the text scan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import query as Q
from fathom.operators.query import asof_join
from fathom.operators.sample import sample_rows
from fathom.operators.scan import DENY_REASONS, scan_text
from fathom.operators.token_index import scan_tokens
from fathom.operators.udf import GroupFold, apply_batches, apply_groups, combine_groups
from fathom.plans.correlation import corr_matrix, rank_corr_matrix
from fathom.plans.frames import range_frame, row_frame
from fathom.plans.ordered import rank_by_key, window_by_key
from fathom.plans.overlaps import overlap_join
from fathom.plans.contract import register, rnd, sql_rnd, table
from fathom.session import reliable_checkpoint, shuffles_dropped

# ------------------------------------------------------------------ A1 SQL over named tables
_Q_SQL = """
SELECT o_orderpriority, count(*) AS order_count
FROM orders
WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority"""
register("query_sql", _Q_SQL)(
    lambda spark, d: Q.run_query(spark, {"orders": table(spark, d, "orders"),
                                         "lineitem": table(spark, d, "lineitem")}, _Q_SQL))

# ------------------------------------------------------------------ A3 top-k
register("query_top_k", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")(
    lambda spark, d: Q.top_k(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 10,
                             [F.desc("o_totalprice"), F.asc("o_orderkey")]))

# ------------------------------------------------------------------ A5 summary
_SUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _summary_sql() -> str:
    stats = [("rows", "count(*)"), ("null_count", "count(*) - count({c})"), ("unique_count", "count(DISTINCT {c})"),
             ("mean", "avg({c})"), ("std_dev", "stddev_samp({c})"), ("min", "min({c})"),
             ("p25", "quantile_cont({c}, 0.25)"), ("p50", "quantile_cont({c}, 0.5)"),
             ("p75", "quantile_cont({c}, 0.75)"), ("max", "max({c})")]
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, '{s}' AS statistic, {sql_rnd(e.format(c=c), 4)} AS value FROM lineitem"
        for c in _SUM_COLS for s, e in stats)


register("query_summary", _summary_sql())(
    lambda spark, d: Q.summary(table(spark, d, "lineitem").select(*_SUM_COLS)).withColumn("value", rnd("value", 4)))

# ------------------------------------------------------------------ projection / filter
register("query_filter_project", f"""
SELECT l_orderkey, l_linenumber, {sql_rnd("l_extendedprice * l_discount", 4)} AS revenue
FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
  AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag IN ('A', 'R')""")(
    lambda spark, d: table(spark, d, "lineitem")
    .where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("date")) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("date"))
           & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)
           & F.col("l_returnflag").isin("A", "R"))
    .select("l_orderkey", "l_linenumber", rnd(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("revenue")))

# ------------------------------------------------------------------ joins
register("query_join_inner", f"""
SELECT n_name, {sql_rnd("sum(l_extendedprice * (1 - l_discount))", 2)} AS revenue, count(*) AS line_count
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'BUILDING'
GROUP BY n_name""")(
    lambda spark, d: table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    .join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    .join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    .groupBy("n_name").agg(rnd(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
                           F.count(F.lit(1)).alias("line_count")))

register("query_join_outer", """
SELECT c_custkey, count(o_orderkey) AS urgent_orders
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey
GROUP BY c_custkey""")(
    lambda spark, d: table(spark, d, "customer")
    .join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"),
          F.col("c_custkey") == F.col("o_custkey"), "left")
    .groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent_orders")))

register("query_join_semi", """
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")(
    lambda spark, d: table(spark, d, "customer").select("c_custkey", "c_name")
    .join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"),
          "left_semi"))

register("query_join_anti", """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
                  AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01')""")(
    lambda spark, d: table(spark, d, "customer").select("c_custkey", "c_name")
    .join(table(spark, d, "orders").where(
        "o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'"),
        F.col("c_custkey") == F.col("o_custkey"), "left_anti"))

register("query_join_range", """
SELECT o_orderpriority, count(*) AS prompt_lines
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
 AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY
GROUP BY o_orderpriority""")(
    lambda spark, d: table(spark, d, "orders").join(
        table(spark, d, "lineitem"),
        (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate"))
        & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")))
    .groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("prompt_lines")))

_OPEN_SQL = """o AS (SELECT o_orderkey, o_orderpriority, o_orderdate AS opened, max(l_shipdate) AS closed
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 480000 GROUP BY ALL HAVING max(l_shipdate) >= o_orderdate)"""


def _open_orders(spark, d):
    """Dear orders from the day of the order to the last shipment: intervals of days to months."""
    orders = table(spark, d, "orders").where("o_totalprice > 480000").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").alias("opened"))
    return (orders.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_orderkey", "o_orderpriority", "opened").agg(F.max("l_shipdate").alias("closed")))


# No equality key at all: which dear urgent orders were open at the same time as which others.
register("query_join_overlap", f"""
WITH {_OPEN_SQL}
SELECT a.o_orderkey AS urgent_key, b.o_orderkey AS other_key, greatest(a.opened, b.opened) AS both_open
FROM o a JOIN o b ON a.opened <= b.closed AND b.opened <= a.closed
WHERE a.o_orderpriority = '1-URGENT' AND b.o_orderpriority <> '1-URGENT'""")(
    lambda spark, d: _open_together(_open_orders(spark, d)))


def _open_together(orders):
    spark = orders.sparkSession
    with shuffles_dropped(spark):
        # few orders of many lines: found once, read for the bounds of the bins and for either side
        orders = reliable_checkpoint(orders)
    on = ("opened", "closed")
    pairs = overlap_join(orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderpriority <> '1-URGENT'"), on, on, prefixes=("a_", "b_"),
                         tasks=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.select(F.col("a_o_orderkey").alias("urgent_key"), F.col("b_o_orderkey").alias("other_key"), F.greatest("a_opened", "b_opened").alias("both_open"))


# Points in intervals: events that fall into the fifteen minutes after a purchase of more than 95 % of the highest value.
register("query_join_point_in_interval", """
WITH p AS (SELECT event_id AS purchase, ts AS from_ts, ts + INTERVAL 15 MINUTES AS to_ts FROM events
           WHERE event_type = 'purchase' AND value > 0.95 * (SELECT max(value) FROM events WHERE event_type = 'purchase'))
SELECT purchase, event_id FROM p JOIN events ON ts >= from_ts AND ts < to_ts""")(
    lambda spark, d: _after_purchases(table(spark, d, "events")))


def _after_purchases(events):
    bought = events.where("event_type = 'purchase'")
    top = bought.agg(F.max("value")).head()[0]
    bought = bought.where(F.col("value") > 0.95 * F.lit(top)).select(F.col("event_id").alias("purchase"), F.col("ts").alias("from_ts"), F.expr("ts + INTERVAL 15 MINUTES").alias("to_ts"))
    # a point is the half-open interval of one microsecond
    points = events.select("event_id", "ts", F.expr("ts + INTERVAL 0.000001 SECOND").alias("next_ts"))
    return overlap_join(bought, points, ("from_ts", "to_ts"), ("ts", "next_ts"), closed=False).select("purchase", "event_id")


register("query_join_asof", """
SELECT e.event_id, p.value AS last_purchase_value
FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p
  ON e.user_id = p.user_id AND e.ts >= p.ts""")(
    lambda spark, d: Q.asof_join(
        table(spark, d, "events").select("event_id", "user_id", "ts"),
        table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", "value"),
        by=["user_id"], left_on="ts", right_on="ts", right_cols=["value"])
    .select("event_id", F.col("value").alias("last_purchase_value")))

# ------------------------------------------------------------------ aggregation
register("query_group_agg", f"""
SELECT l_returnflag, l_linestatus, {sql_rnd("sum(l_quantity)", 2)} AS sum_qty,
       {sql_rnd("sum(l_extendedprice)", 2)} AS sum_base_price,
       {sql_rnd("sum(l_extendedprice * (1 - l_discount))", 2)} AS sum_disc_price,
       {sql_rnd("sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))", 2)} AS sum_charge,
       {sql_rnd("avg(l_quantity)", 4)} AS avg_qty, {sql_rnd("avg(l_extendedprice)", 4)} AS avg_price,
       {sql_rnd("avg(l_discount)", 6)} AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'
GROUP BY l_returnflag, l_linestatus""")(
    lambda spark, d: table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    .groupBy("l_returnflag", "l_linestatus").agg(
        rnd(F.sum("l_quantity"), 2).alias("sum_qty"), rnd(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        rnd(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        rnd(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        rnd(F.avg("l_quantity"), 4).alias("avg_qty"), rnd(F.avg("l_extendedprice"), 4).alias("avg_price"),
        rnd(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order")))

register("query_count_distinct", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts,
       count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY l_returnflag""")(
    # One grouping of (flag, column, key) rows instead of three copies of every row: the distinct pairs combine map-side.
    lambda spark, d: table(spark, d, "lineitem").select("l_returnflag", F.posexplode(F.array("l_orderkey", "l_partkey", "l_suppkey")).alias("c", "k"))
    .distinct().groupBy("l_returnflag").agg(F.count_if((F.col("c") == 0) & F.col("k").isNotNull()).alias("orders"), F.count_if((F.col("c") == 1) & F.col("k").isNotNull()).alias("parts"),
                                            F.count_if((F.col("c") == 2) & F.col("k").isNotNull()).alias("suppliers")))

register("query_rollup", f"""
SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus)::BIGINT AS gid,
       {sql_rnd("sum(l_quantity)", 2)} AS sum_qty, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")(
    lambda spark, d: table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.grouping_id().cast("bigint").alias("gid"), rnd(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.count(F.lit(1)).alias("n")))

# ------------------------------------------------------------------ windows
register("query_rank", """
SELECT c_custkey, c_nationkey,
       rank() OVER w AS rnk, dense_rank() OVER w AS dense_rnk,
       row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS row_num
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)""")(
    # Ranks per nation over range slices (plans.ordered.rank_by_key): no nation-sized task.
    lambda spark, d: rank_by_key(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"),
                                 ["c_nationkey"], "c_acctbal", descending=True, tiebreak=["c_custkey"])
    .select("c_custkey", "c_nationkey", "rnk", "dense_rnk", "row_num"))


def _rolling(spark, d):
    # Row frames per user through range slices (plans.ordered): a user with a third of the
    # events is spread over many tasks instead of one window partition.
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    w = window_by_key(ev, ["user_id"], ["ts", "event_id"], "value", lags=2, leads=1, running_sum="running")
    frame = [F.col("value"), F.col("lag1"), F.col("lag2")]
    n = sum(F.when(c.isNotNull(), 1).otherwise(0) for c in frame)
    s = sum(F.coalesce(c, F.lit(0.0)) for c in frame)
    return w.select("event_id", "user_id", rnd("running", 4).alias("running_value"),
                    rnd(F.when(n > 0, s / n), 4).alias("avg3"),
                    F.col("lag1").alias("prev_value"), F.col("lead1").alias("next_value"))


register("query_rolling", f"""
SELECT event_id, user_id,
       {sql_rnd("sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 4)} AS running_value,
       {sql_rnd("avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", 4)} AS avg3,
       lag(value) OVER w AS prev_value, lead(value) OVER w AS next_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")(_rolling)

_FRAME_SQL = ", ".join(f"{a}(value) OVER w AS {o}" for a, o in (("min", "low"), ("max", "high"), ("count", "n"), ("first_value", "opened"), ("last_value", "closed")))

register("query_rolling_minmax", f"""
SELECT event_id, {_FRAME_SQL}
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 3 FOLLOWING)""")(
    lambda spark, d: row_frame(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"],
                               {"low": ("min", "value"), "high": ("max", "value"), "n": ("count", "value"), "opened": ("first", "value"), "closed": ("last", "value")}, 6, 3)
    .drop("user_id", "ts", "value"))

register("query_range_minmax", f"""
SELECT event_id, min(value) OVER w AS low, max(value) OVER w AS high, count(value) OVER w AS n, {sql_rnd("sum(value) OVER w", 2)} AS total
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND INTERVAL 90 MINUTES FOLLOWING)""")(
    lambda spark, d: range_frame(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts",
                                 {"low": ("min", "value"), "high": ("max", "value"), "n": ("count", "value"), "total": ("sum", "value")}, 6 * 3600, 90 * 60)
    .select("event_id", "low", "high", "n", rnd("total", 2).alias("total")))

# Without a key the whole table is one ordered run: the hardest case for a window, an ordinary one here.
register("query_running_extremes", """
SELECT o_orderkey, max(o_totalprice) OVER w AS dearest_so_far, min(o_totalprice) OVER w AS cheapest_so_far
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")(
    lambda spark, d: row_frame(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [], ["o_orderdate", "o_orderkey"],
                               {"dearest_so_far": ("max", "o_totalprice"), "cheapest_so_far": ("min", "o_totalprice")}, None, 0)
    .drop("o_orderdate", "o_totalprice"))

register("query_top_k_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, rank::INTEGER AS rank
FROM (SELECT o_custkey, o_orderkey, o_totalprice,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
      FROM orders) WHERE rank <= 3""")(
    lambda spark, d: Q.top_k_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"),
                                       ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3))

# ------------------------------------------------------------------ set operations
_Y95 = "o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'"
_Y96 = "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'"
register("query_set_ops", f"""
SELECT 'union' AS op, o_custkey FROM (SELECT o_custkey FROM orders WHERE {_Y95} UNION SELECT o_custkey FROM orders WHERE {_Y96})
UNION ALL
SELECT 'intersect', o_custkey FROM (SELECT o_custkey FROM orders WHERE {_Y95} INTERSECT SELECT o_custkey FROM orders WHERE {_Y96})
UNION ALL
SELECT 'except', o_custkey FROM (SELECT o_custkey FROM orders WHERE {_Y95} EXCEPT SELECT o_custkey FROM orders WHERE {_Y96})""")(
    lambda spark, d: (lambda a, b:
                      a.union(b).distinct().select(F.lit("union").alias("op"), "o_custkey")
                      .unionAll(a.intersect(b).select(F.lit("intersect").alias("op"), "o_custkey"))
                      .unionAll(a.subtract(b).select(F.lit("except").alias("op"), "o_custkey")))(
        table(spark, d, "orders").where(_Y95).select("o_custkey"),
        table(spark, d, "orders").where(_Y96).select("o_custkey")))

# ------------------------------------------------------------------ pivot / unpivot
register("query_pivot", f"""
SELECT l_returnflag, {sql_rnd("sum(l_quantity) FILTER (WHERE l_linestatus = 'F')", 2)} AS "F",
       {sql_rnd("sum(l_quantity) FILTER (WHERE l_linestatus = 'O')", 2)} AS "O",
       {sql_rnd("sum(l_quantity) FILTER (WHERE coalesce(l_linestatus NOT IN ('F', 'O'), true))", 2)} AS "other"
FROM lineitem GROUP BY l_returnflag""")(
    # Named columns for the values asked for, one for any other value: no job to list the values, none lost.
    lambda spark, d: table(spark, d, "lineitem").withColumn("status", F.when(F.col("l_linestatus").isin("F", "O"), F.col("l_linestatus")).otherwise("other"))
    .groupBy("l_returnflag").pivot("status", ["F", "O", "other"])
    .agg(F.sum("l_quantity")).select("l_returnflag", *[rnd(v, 2).alias(v) for v in ("F", "O", "other")]))

register("query_unpivot", """
SELECT c_custkey, 'c_acctbal' AS metric, c_acctbal AS value FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::DOUBLE FROM customer""")(
    lambda spark, d: table(spark, d, "customer").select(
        "c_custkey", F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"))
    .unpivot(["c_custkey"], ["c_acctbal", "c_nationkey"], "metric", "value"))

# ------------------------------------------------------------------ correlation matrix
_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]
register("query_corr", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {sql_rnd(f'corr({a}, {b})', 6)} AS corr FROM lineitem"
    for a, b in _PAIRS))(
    lambda spark, d: table(spark, d, "lineitem").agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in _PAIRS]).select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                    rnd(f"{a}__{b}", 6).alias("corr")) for a, b in _PAIRS]))))

# ------------------------------------------------------------------ arrays and maps
register("query_arrays", f"""
SELECT vec_id, len(embedding)::INTEGER AS dim,
       {sql_rnd("sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))", 5)} AS norm,
       {sql_rnd("list_max(embedding)", 5)} AS max_component
FROM embeddings""")(
    lambda spark, d: table(spark, d, "embeddings").select(
        "vec_id", F.size("embedding").alias("dim"),
        rnd(F.sqrt(F.aggregate("embedding", F.lit(0.0).cast("double"),
                               lambda acc, x: acc + x.cast("double") * x.cast("double"))), 5).alias("norm"),
        rnd(F.array_max("embedding"), 5).alias("max_component")))


def _maps(spark, d):
    per_type = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = per_type.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.size("m").alias("n_types"),
                    F.try_element_at("m", F.lit("click")).alias("clicks"),
                    F.try_element_at("m", F.lit("purchase")).alias("purchases"))


register("query_maps", """
SELECT user_id, count(DISTINCT event_type)::INTEGER AS n_types,
       CASE WHEN count(*) FILTER (WHERE event_type = 'click') > 0 THEN count(*) FILTER (WHERE event_type = 'click') END AS clicks,
       CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0
            THEN count(*) FILTER (WHERE event_type = 'purchase') END AS purchases
FROM events GROUP BY user_id""")(_maps)


# ------------------------------------------------------------------ U1 / U2 user code
def _revenue(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"l_orderkey": pdf["l_orderkey"], "l_linenumber": pdf["l_linenumber"],
                         "revenue": pdf["l_extendedprice"] * (1 - pdf["l_discount"])})


register("udf_map_batches", f"""
SELECT l_orderkey, l_linenumber, {sql_rnd("l_extendedprice * (1 - l_discount)", 4)} AS revenue FROM lineitem""")(
    lambda spark, d: apply_batches(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), _revenue,
        "l_orderkey long, l_linenumber int, revenue double").withColumn("revenue", rnd("revenue", 4)))


def _share(pdf: pd.DataFrame) -> pd.DataFrame:
    total = pdf.groupby("l_orderkey", dropna=False)["l_extendedprice"].transform("sum")
    return pd.DataFrame({"l_orderkey": pdf["l_orderkey"], "l_linenumber": pdf["l_linenumber"],
                         "share": pdf["l_extendedprice"] / total})


register("udf_group_apply", f"""
SELECT l_orderkey, l_linenumber, {sql_rnd("l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey)", 6)}
  AS share FROM lineitem""")(
    lambda spark, d: apply_groups(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], _share,
        "l_orderkey long, l_linenumber int, share double", many=True).withColumn("share", rnd("share", 6)))


def _regression() -> GroupFold:
    """A least-squares line as user code: sums of a part around its own means, merged pairwise."""
    def update(s, rows):
        x, y = rows["l_quantity"].to_numpy(float), rows["l_extendedprice"].to_numpy(float)
        mx, my = x.mean(), y.mean()
        return merge(s, (len(x), mx, my, ((x - mx) ** 2).sum(), ((x - mx) * (y - my)).sum(), float(y.max())))

    def merge(a, b):
        if not a[0] or not b[0]:
            return a if a[0] else b
        n, dx, dy = a[0] + b[0], b[1] - a[1], b[2] - a[2]
        return (n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + dx * dx * a[0] * b[0] / n, a[4] + b[4] + dx * dy * a[0] * b[0] / n, max(a[5], b[5]))

    def finish(s):
        slope = s[4] / s[3] if s[3] else None
        return {"n": int(s[0]), "slope": slope, "intercept": None if slope is None else s[2] - slope * s[1], "dearest": s[5]}

    return GroupFold(lambda: (0, 0.0, 0.0, 0.0, 0.0, float("-inf")), update, merge, finish)


register("udf_group_combine", f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, {sql_rnd("regr_slope(l_extendedprice, l_quantity)", 4)} AS slope,
       {sql_rnd("regr_intercept(l_extendedprice, l_quantity)", 3)} AS intercept, {sql_rnd("max(l_extendedprice)", 2)} AS dearest
FROM lineitem GROUP BY l_returnflag, l_linestatus""")(
    lambda spark, d: combine_groups(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"), ["l_returnflag", "l_linestatus"],
                                    _regression(), "n long, slope double, intercept double, dearest double")
    .withColumns({"slope": rnd("slope", 4), "intercept": rnd("intercept", 3), "dearest": rnd("dearest", 2)}))


# ------------------------------------------------------------------ G1 deny-list scan
def _scan_sql(src: str, id_col: str, text_col: str) -> str:
    values = ", ".join("('{}', '{}')".format(t.replace("'", "''"), r.replace("'", "''")) for t, r in DENY_REASONS.items())
    return f"""
WITH tokens(token, reason) AS (VALUES {values}),
split AS (SELECT {id_col} AS id, string_split({text_col}, chr(10)) AS parts FROM {src}),
lines AS (SELECT id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no FROM split)
SELECT id AS {id_col}, token, reason, line_no::BIGINT AS line_no,
       regexp_replace(line, '^[ \\t\\r\\f\\v]+|[ \\t\\r\\f\\v]+$', '', 'g') AS line
FROM lines JOIN tokens ON contains(line, token)"""


register("scan_text", _scan_sql("documents", "doc_id", "text"))(
    lambda spark, d: scan_text(table(spark, d, "documents"), "doc_id", "text"))
register("scan_text_pages", _scan_sql("pages", "page_id", "html"))(
    lambda spark, d: scan_text(table(spark, d, "pages"), "page_id", "html"))

# ------------------------------------------------------------------ full outer join, cube, range frame
_URG = "o_orderpriority = '1-URGENT'"
register("query_join_full", f"""
SELECT a.o_custkey AS cust_1995, b.o_custkey AS cust_1996
FROM (SELECT DISTINCT o_custkey FROM orders WHERE {_URG} AND {_Y95}) a
FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders WHERE {_URG} AND {_Y96}) b ON a.o_custkey = b.o_custkey""")(
    lambda spark, d: table(spark, d, "orders").where(f"{_URG} AND {_Y95}").select(F.col("o_custkey").alias("cust_1995"))
    .distinct().join(table(spark, d, "orders").where(f"{_URG} AND {_Y96}").select(F.col("o_custkey").alias("cust_1996"))
                     .distinct(), F.col("cust_1995") == F.col("cust_1996"), "full"))

register("query_cube", f"""
SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus)::BIGINT AS gid,
       {sql_rnd("sum(l_extendedprice)", 2)} AS revenue, count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")(
    lambda spark, d: table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping_id().cast("bigint").alias("gid"), rnd(F.sum("l_extendedprice"), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n")))


def _range_frame(spark, d):
    """Sum and count over the user's last hour (RANGE frame), skew-safe.

    Exact (decimal) running sums and counts per user come from range slices; each event then
    looks up, by two as-of joins, the running totals at its own time (peers included) and just
    before its time minus one hour; the frame is the difference.
    """
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("value").cast("decimal(38,10)").alias("dv"))
    pre = window_by_key(ev.withColumn("one", F.lit(1).cast("bigint")), ["user_id"], ["ts", "event_id"], "dv",
                        running_sums={"S": "dv", "C": "one"}).select("user_id", "ts", "event_id", "S", "C")
    left = ev.select("event_id", "user_id", "ts", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts_low"))
    upper = asof_join(left, pre.select("user_id", "ts", F.col("event_id").alias("_eid"), "S", "C"),
                      ["user_id"], "ts", "ts", ["S", "C"], right_tiebreak="_eid")
    both = asof_join(upper.withColumnRenamed("S", "S_up").withColumnRenamed("C", "C_up"),
                     pre.select("user_id", "ts", "S", "C"), ["user_id"], "ts_low", "ts", ["S", "C"], strict=True)
    return both.select(
        "event_id", "user_id",
        rnd((F.col("S_up") - F.coalesce("S", F.lit(0))).cast("double"), 4).alias("value_last_hour"),
        (F.col("C_up") - F.coalesce("C", F.lit(0))).cast("bigint").alias("events_last_hour"))


register("query_range_frame", f"""
SELECT event_id, user_id,
       {sql_rnd("sum(value) OVER w", 4)} AS value_last_hour, count(*) OVER w AS events_last_hour
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")(_range_frame)


# ------------------------------------------------------------------ NULL keys are keys of their own (but match nothing in a join)
def _null_users(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("user_id"), "ts", "value", "event_type")


_NULL_USERS_SQL = "(SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN user_id END AS user_id, ts, value, event_type FROM events)"

register("query_rank_null_key", f"""
SELECT event_id, user_id, rank() OVER w AS rnk, dense_rank() OVER w AS dense_rnk,
       row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS row_num
FROM {_NULL_USERS_SQL} AS e WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""")(
    lambda spark, d: rank_by_key(_null_users(spark, d).select("event_id", "user_id", "event_type"), ["user_id"], "event_type",
                                 tiebreak=["event_id"]).select("event_id", "user_id", "rnk", "dense_rnk", "row_num"))

register("query_rolling_null_key", f"""
SELECT event_id, user_id, {sql_rnd("sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 4)} AS running_value,
       lag(value) OVER w AS prev_value, lead(value) OVER w AS next_value
FROM {_NULL_USERS_SQL} AS e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")(
    lambda spark, d: window_by_key(_null_users(spark, d), ["user_id"], ["ts", "event_id"], "value", lags=1, leads=1, running_sum="running").select(
        "event_id", "user_id", rnd("running", 4).alias("running_value"), F.col("lag1").alias("prev_value"), F.col("lead1").alias("next_value")))

register("query_asof_null_key", f"""
WITH e AS {_NULL_USERS_SQL}, r AS (SELECT user_id, ts, event_id, value FROM e WHERE event_type = 'purchase')
SELECT e.event_id, (SELECT max_by(r.value, (r.ts, r.event_id)) FROM r WHERE r.user_id = e.user_id AND r.ts <= e.ts) AS last_purchase_value
FROM e WHERE e.event_type <> 'purchase'""")(
    lambda spark, d: Q.asof_join(
        _null_users(spark, d).where("event_type <> 'purchase'").select("event_id", "user_id", "ts"),
        _null_users(spark, d).where("event_type = 'purchase'").select("user_id", "ts", "value", F.col("event_id").alias("_eid")),
        ["user_id"], "ts", "ts", ["value"], right_tiebreak="_eid").select("event_id", F.col("value").alias("last_purchase_value")))

# ------------------------------------------------------------------ correlation matrices of any columns, rank correlation
_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber", "l_orderkey"]
_WIDE_PAIRS = [(a, b) for i, a in enumerate(_WIDE) for b in _WIDE[i + 1:]]
register("query_corr_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {sql_rnd(f'corr({a}, {b})', 6)} AS corr FROM lineitem"
    for a, b in _WIDE_PAIRS))(
    lambda spark, d: corr_matrix(table(spark, d, "lineitem"), _WIDE).withColumn("corr", rnd("corr", 6)))

_RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_RANK_SQL = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _RANKED)
register("query_corr_rank", f"WITH r AS (SELECT {_RANK_SQL} FROM lineitem)\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, {sql_rnd(f'corr({a}, {b})', 6)} AS rank_corr FROM r"
    for i, a in enumerate(_RANKED) for b in _RANKED[i + 1:]))(
    lambda spark, d: rank_corr_matrix(table(spark, d, "lineitem"), _RANKED).withColumn("rank_corr", rnd("rank_corr", 6)))

# ------------------------------------------------------------------ a sample of exactly n rows
register("query_sample_exact", """
SELECT event_id, user_id, value FROM events ORDER BY md5('7:' || event_id) LIMIT 500""")(
    lambda spark, d: sample_rows(table(spark, d, "events"), 500, ["event_id"], seed=7).select("event_id", "user_id", "value"))
# The same rows by the way of large samples.
register("query_sample_binned", """
SELECT event_id, user_id, value FROM events ORDER BY md5('7:' || event_id) LIMIT 500""")(
    lambda spark, d: sample_rows(table(spark, d, "events"), 500, ["event_id"], seed=7, top_rows=0).select("event_id", "user_id", "value"))

# ------------------------------------------------------------------ G1 long token lists: every host that a page links to
register("scan_tokens_pages", """
WITH tokens AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS token FROM pages),
     lines AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages),
     numbered AS (SELECT page_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM lines)
SELECT page_id, token, 'page host' AS reason, line_no, regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') AS line
FROM numbered JOIN tokens ON token <> '' AND contains(line, token)""")(
    lambda spark, d: scan_tokens(table(spark, d, "pages"), "page_id", "html", table(spark, d, "pages").select(
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("token"), F.lit("page host").alias("reason"))))
register("scan_tokens_words", """
WITH tokens AS (SELECT DISTINCT w AS token FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 9),
     lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
     numbered AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM lines)
SELECT doc_id, line_no, count(*) AS n_tokens, min(token) AS first_token
FROM numbered JOIN tokens ON contains(line, token) GROUP BY 1, 2""")(
    lambda spark, d: scan_tokens(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("token")).where(F.length("token") >= 9))
    .groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("token").alias("first_token")))

# ------------------------------------------------------------------ A5 summary of columns of any kind
register("query_describe", """
WITH o AS (SELECT o_orderpriority AS v FROM orders), c AS (SELECT v, count(*) AS n FROM o WHERE v IS NOT NULL GROUP BY v)
SELECT 'o_orderpriority' AS column_name, 'string' AS type, statistic, value FROM (
  SELECT 'rows' AS statistic, (SELECT count(*) FROM o)::VARCHAR AS value UNION ALL
  SELECT 'null_count', (SELECT count(*) FROM o WHERE v IS NULL)::VARCHAR UNION ALL
  SELECT 'unique_count', (SELECT count(*) FROM c)::VARCHAR UNION ALL
  SELECT 'top', (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) UNION ALL
  SELECT 'top_count', (SELECT max(n) FROM c)::VARCHAR UNION ALL
  SELECT 'max_length', (SELECT max(length(v)) FROM o)::VARCHAR)
UNION ALL
SELECT 'o_orderdate', 'date', statistic, value FROM (
  SELECT 'rows' AS statistic, count(*)::VARCHAR AS value FROM orders UNION ALL
  SELECT 'null_count', count(*) FILTER (WHERE o_orderdate IS NULL)::VARCHAR FROM orders UNION ALL
  SELECT 'unique_count', count(DISTINCT o_orderdate)::VARCHAR FROM orders UNION ALL
  SELECT 'first', strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders UNION ALL
  SELECT 'last', strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders)""")(
    lambda spark, d: Q.describe_columns(table(spark, d, "orders").select("o_orderpriority", "o_orderdate")))
