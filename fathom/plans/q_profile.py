"""Contract queries for the column profile (keys ``profile_*``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.profile import profile_tables, table_counts
from fathom.operators.profile_state import merge_states, profile_state, state_profile
from fathom.plans.contract import (ALL_TABLES, DIRTY_EVENTS_COLUMNS, DIRTY_EVENTS_SQL, TABLE_COLUMNS,
                                   dirty_events, register, rnd, sql_rnd, table)

def profiled(spark: SparkSession, sf_dir: str, names: list[str], *stats: str, exact: bool = True) -> DataFrame:
    """The named statistics of the named inputs ('events_dirty' = events with injected NULLs and copies)."""
    frames = {n: dirty_events(spark, sf_dir) if n == "events_dirty" else table(spark, sf_dir, n) for n in names}
    return profile_tables(frames, exact=exact, stats=stats)


def _cols(name: str) -> list[tuple[str, str]]:
    return DIRTY_EVENTS_COLUMNS if name == "events_dirty" else TABLE_COLUMNS[name]


def _src(name: str) -> str:
    return f"{DIRTY_EVENTS_SQL} AS src" if name == "events_dirty" else f"{name} AS src"


def _per_column(names: list[str], kinds: set[str], select: str, tail: str = "") -> str:
    """UNION ALL of one SELECT per column; ``{c}`` is the quoted column, ``{k}`` its kind."""
    parts = []
    for name in names:
        for col, kind in _cols(name):
            if kind not in kinds:
                continue
            body = select.format(c=f'"{col}"', k=kind, t=name, n=col, src=_src(name))
            parts.append(f"SELECT '{name}' AS table_name, '{col}' AS column_name, {body}"
                         + (" " + tail.format(c=f'"{col}"', src=_src(name)) if tail else f" FROM {_src(name)}"))
    return "\nUNION ALL\n".join(parts)


ALL_KINDS = {"num", "str", "ts"}

# ------------------------------------------------------------------ P1 counts
register("profile_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*)::BIGINT AS rows, "
    f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}')::BIGINT AS columns FROM {t}"
    for t in ALL_TABLES))(
    lambda spark, d: _union([table_counts(table(spark, d, t), t) for t in ALL_TABLES]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ------------------------------------------------------------------ P2, P7, P8 types
TYPE_TABLES = ["lineitem", "events", "orders", "embeddings"]
_TYPE_CASE = """CASE WHEN data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT','HUGEINT','FLOAT','DOUBLE')
            OR data_type LIKE 'DECIMAL%' THEN 'number'
          WHEN data_type = 'VARCHAR' THEN 'string'
          WHEN data_type IN ('DATE','TIMESTAMP','TIMESTAMP WITH TIME ZONE') THEN 'date'
          WHEN data_type = 'BOOLEAN' THEN 'boolean'
          WHEN data_type = 'INTERVAL' THEN 'duration'
          ELSE 'mixed' END"""
register("profile_types", f"""
SELECT table_name, column_name, (ordinal_position - 1)::INTEGER AS position, type,
       type = 'number' AS is_numeric, type = 'date' AS is_temporal
FROM (SELECT table_name, column_name, ordinal_position, {_TYPE_CASE} AS type
      FROM information_schema.columns
      WHERE table_name IN ({", ".join(f"'{t}'" for t in TYPE_TABLES)}))""")(
    lambda spark, d: profiled(spark, d, TYPE_TABLES, "schema").select(
        "table_name", "column_name", "position", "type", "is_numeric", "is_temporal"))

# ------------------------------------------------------------------ P4, P5 nulls
NULL_TABLES = ["lineitem", "events_dirty"]
register("profile_nulls", _per_column(
    NULL_TABLES, ALL_KINDS,
    "(count(*) - count({c}))::BIGINT AS null_count, "
    "round((count(*) - count({c}))::DOUBLE * 100.0 / count(*)::DOUBLE, 1) AS null_pct"))(
    lambda spark, d: profiled(spark, d, NULL_TABLES, "scalar").select("table_name", "column_name", "null_count", "null_pct"))

# ------------------------------------------------------------------ P6 unique
UNIQUE_TABLES = ["lineitem", "events_dirty", "orders"]
register("profile_unique", _per_column(UNIQUE_TABLES, ALL_KINDS, "count(DISTINCT {c})::BIGINT AS unique_count"))(
    lambda spark, d: profiled(spark, d, UNIQUE_TABLES, "values").select("table_name", "column_name", "unique_count"))

# ------------------------------------------------------------------ P9 flags
FLAG_TABLES = ["lineitem", "events_dirty", "orders", "customer"]
register("profile_flags", _per_column(
    FLAG_TABLES, ALL_KINDS,
    "('{k}' = 'str' AND count(DISTINCT {c}) < 20) AS is_categorical, '{k}' = 'num' AS is_numeric, "
    "'{k}' = 'ts' AS is_temporal"))(
    lambda spark, d: profiled(spark, d, FLAG_TABLES, "values").select(
        "table_name", "column_name", "is_categorical", "is_numeric", "is_temporal"))

# ------------------------------------------------------------------ P10, P11 numeric
NUM_TABLES = ["lineitem", "events_dirty", "customer"]
register("profile_numeric", _per_column(
    NUM_TABLES, {"num"},
    f"{sql_rnd('min({c})')} AS min, {sql_rnd('max({c})')} AS max, {sql_rnd('avg({c}::DOUBLE)')} AS mean, "
    f"{sql_rnd('stddev_samp({c}::DOUBLE)')} AS std_dev"))(
    lambda spark, d: profiled(spark, d, NUM_TABLES, "scalar").where("is_numeric").select(
        "table_name", "column_name", rnd("min").alias("min"), rnd("max").alias("max"),
        rnd("mean").alias("mean"), rnd("std_dev").alias("std_dev")))

# ------------------------------------------------------------------ P12 percentiles
PCT_TABLES = ["lineitem", "events_dirty", "orders", "customer"]
register("profile_percentiles", _per_column(
    PCT_TABLES, {"num"},
    f"{sql_rnd('quantile_cont({c}::DOUBLE, 0.25)')} AS p25, {sql_rnd('quantile_cont({c}::DOUBLE, 0.5)')} AS p50, "
    f"{sql_rnd('quantile_cont({c}::DOUBLE, 0.75)')} AS p75"))(
    lambda spark, d: profiled(spark, d, PCT_TABLES, "percentiles").where("is_numeric").select(
        "table_name", "column_name", rnd("p25").alias("p25"), rnd("p50").alias("p50"), rnd("p75").alias("p75")))

# ------------------------------------------------------------------ P18 skewness
register("profile_skewness", _per_column(NUM_TABLES, {"num"}, f"{sql_rnd('skewness({c}::DOUBLE)', 6)} AS skewness"))(
    lambda spark, d: profiled(spark, d, NUM_TABLES, "scalar").where("is_numeric").select(
        "table_name", "column_name", rnd("skewness", 6).alias("skewness")))

# ------------------------------------------------------------------ P13 strings
STR_TABLES = ["lineitem", "events", "documents", "conversations"]
register("profile_strings", _per_column(STR_TABLES, {"str"}, "max(length({c}))::BIGINT AS max_length"))(
    lambda spark, d: profiled(spark, d, STR_TABLES, "scalar").where("type = 'string'").select(
        "table_name", "column_name", "max_length"))

# ------------------------------------------------------------------ P3 examples
EX_TABLES = ["lineitem", "events_dirty"]
register("profile_examples", _per_column(
    EX_TABLES, ALL_KINDS,
    "rn::INTEGER AS rank, v AS value",
    "FROM (SELECT v, row_number() OVER (ORDER BY x NULLS LAST, v) AS rn FROM ("
    "SELECT DISTINCT {c}::VARCHAR AS v, TRY_CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL)) "
    "WHERE rn <= 3"))(
    lambda spark, d: profiled(spark, d, EX_TABLES, "values").select(
        "table_name", "column_name", F.posexplode("examples").alias("_p", "value")).select(
        "table_name", "column_name", (F.col("_p") + 1).cast("int").alias("rank"), "value"))

# ------------------------------------------------------------------ P14 distinct values
DV_TABLES = ["lineitem", "events", "orders", "customer"]
register("profile_distinct_values", _per_column(
    DV_TABLES, {"str"},
    "rn::INTEGER AS rank, v AS value",
    "FROM (SELECT v, row_number() OVER (ORDER BY v) AS rn FROM ("
    "SELECT DISTINCT {c}::VARCHAR AS v FROM {src} WHERE {c} IS NOT NULL)) WHERE rn <= 10"))(
    lambda spark, d: profiled(spark, d, DV_TABLES, "values").where("type = 'string'").select(
        "table_name", "column_name", F.posexplode("distinct_values").alias("_p", "value")).select(
        "table_name", "column_name", (F.col("_p") + 1).cast("int").alias("rank"), "value"))

# ------------------------------------------------------------------ P15 value counts
register("profile_value_counts", _per_column(
    DV_TABLES, {"str"},
    "rn::INTEGER AS rank, v AS value, cnt AS count",
    "FROM (SELECT v, cnt, row_number() OVER (ORDER BY cnt DESC, v) AS rn FROM ("
    "SELECT {c}::VARCHAR AS v, count(*)::BIGINT AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 1)) "
    "WHERE rn <= 5"))(
    lambda spark, d: profiled(spark, d, DV_TABLES, "values").where("type = 'string'").select(
        "table_name", "column_name", F.posexplode("value_counts").alias("_p", "_vc")).select(
        "table_name", "column_name", (F.col("_p") + 1).cast("int").alias("rank"),
        F.col("_vc.value").alias("value"), F.col("_vc.count").alias("count")))

# ------------------------------------------------------------------ P16, P17 dates
DATE_TABLES = ["lineitem", "events_dirty", "orders"]
register("profile_dates", _per_column(
    DATE_TABLES, {"ts"},
    "min({c}) AS min_date, max({c}) AS max_date, date_sub('second', min({c}), max({c}))::BIGINT AS time_span_seconds"))(
    lambda spark, d: profiled(spark, d, DATE_TABLES, "scalar").where("is_temporal").select(
        "table_name", "column_name", "min_date", "max_date", "time_span_seconds"))

# ------------------------------------------------------------------ P19-P23 warnings
WARN_TABLES = ["lineitem", "events_dirty", "customer"]


def _warnings_sql() -> str:
    parts = []
    for name in WARN_TABLES:
        for col, kind in _cols(name):
            c = f'"{col}"'
            stats = (f"(SELECT count(*) AS n, count({c}) AS nn, count(DISTINCT {c}) AS u"
                     + (f", max(abs({c}::DOUBLE)) AS maxabs, skewness({c}::DOUBLE) AS sk" if kind == "num" else "")
                     + f" FROM {_src(name)})")
            head = f"SELECT '{name}' AS table_name, '{col}' AS column_name"
            parts.append(f"{head}, printf('%d null values (%.1f%%)', n - nn, (n - nn) * 100.0 / n) AS warning "
                         f"FROM {stats} WHERE n - nn > 0")
            parts.append(f"{head}, CASE WHEN u = 1 THEN 'Single value column' "
                         f"ELSE printf('Low cardinality (only %d values)', u) END AS warning FROM {stats} WHERE u < 5")
            if kind == "num":
                parts.append(f"{head}, 'Large values - consider scaling' AS warning FROM {stats} WHERE maxabs > 1e6")
                parts.append(f"{head}, 'Highly skewed distribution' AS warning FROM {stats} WHERE sk > 2")
    return "\nUNION ALL\n".join(parts)


register("profile_warnings", _warnings_sql())(
    lambda spark, d: profiled(spark, d, WARN_TABLES, "scalar", "values").select(
        "table_name", "column_name", F.explode("warnings").alias("warning")))

# ------------------------------------------------------------------ P24 suggestions
SUG_TABLES = ["lineitem", "events"]
register("profile_suggestions", f"""
WITH ops(kind, rank, op) AS (VALUES
  ('number', 1, 'normalize'), ('number', 2, 'scale'), ('number', 3, 'log_transform'), ('number', 4, 'binning'),
  ('string', 1, 'one_hot_encode'), ('string', 2, 'label_encode'), ('string', 3, 'text_processing'),
  ('string', 4, 'string_cleaning'), ('string', 5, 'regex_extract'),
  ('date', 1, 'extract_year'), ('date', 2, 'extract_month'), ('date', 3, 'time_delta'),
  ('date', 4, 'day_of_week'), ('date', 5, 'time_binning'))
SELECT c.table_name, c.column_name, ops.rank::INTEGER AS rank, ops.op AS operation
FROM (SELECT table_name, column_name, {_TYPE_CASE} AS type FROM information_schema.columns
      WHERE table_name IN ({", ".join(f"'{t}'" for t in SUG_TABLES)})) c
JOIN ops ON ops.kind = c.type""")(
    lambda spark, d: profiled(spark, d, SUG_TABLES, "schema").select(
        "table_name", "column_name", F.posexplode("suggested_operations").alias("_p", "operation")).select(
        "table_name", "column_name", (F.col("_p") + 1).cast("int").alias("rank"), "operation"))


# ------------------------------------------------------------------ P26 several tables
def _many_sql() -> str:
    parts = []
    for name in ALL_TABLES:
        for col, kind in TABLE_COLUMNS[name]:
            c = f'"{col}"'
            typ = {"num": "number", "str": "string", "ts": "date", "arr": "mixed"}[kind]
            uniq = "NULL::BIGINT" if kind == "arr" else f"count(DISTINCT {c})::BIGINT"
            parts.append(f"SELECT '{name}' AS table_name, '{col}' AS column_name, '{typ}' AS type, "
                         f"count(*)::BIGINT AS rows, (count(*) - count({c}))::BIGINT AS null_count, "
                         f"{uniq} AS unique_count FROM {name}")
    return "\nUNION ALL\n".join(parts)


register("profile_many", _many_sql())(
    lambda spark, d: profiled(spark, d, ALL_TABLES, "scalar", "values").select(
        "table_name", "column_name", "type", "rows", "null_count", "unique_count"))


# ------------------------------------------------------------------ approximate mode, exact fields
register("profile_approx", _per_column(
    NULL_TABLES, ALL_KINDS,
    "count(*)::BIGINT AS rows, (count(*) - count({c}))::BIGINT AS null_count, "
    + f"{sql_rnd('min(TRY_CAST({c} AS DOUBLE))')} AS min, {sql_rnd('max(TRY_CAST({c} AS DOUBLE))')} AS max, "
    + f"{sql_rnd('avg(TRY_CAST({c} AS DOUBLE))')} AS mean"))(
    lambda spark, d: profiled(spark, d, NULL_TABLES, "scalar", exact=False).select(
        "table_name", "column_name", "rows", "null_count", rnd("min").alias("min"), rnd("max").alias("max"),
        rnd("mean").alias("mean")))


# Approximate mode on columns of any number of distinct values: the smallest values are exact, and so are the
# counts of the frequent ones (ties, which go by hash, are left out by asking for the largest count only).
APPROX_VALUE_TABLES = ["orders", "customer"]
register("profile_approx_values", "\nUNION ALL\n".join([
    _per_column(APPROX_VALUE_TABLES, {"str"}, "'smallest' AS what, rn::INTEGER AS rank, v AS value",
                "FROM (SELECT v, row_number() OVER (ORDER BY v) AS rn FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {src} WHERE {c} IS NOT NULL)) WHERE rn <= 10"),
    _per_column(APPROX_VALUE_TABLES, {"str"}, "'largest count' AS what, 1 AS rank, max(n)::VARCHAR AS value",
                "FROM (SELECT count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c})")]))(
    lambda spark, d: (lambda p: p.select("table_name", "column_name", F.lit("smallest").alias("what"), F.posexplode("distinct_values").alias("_p", "value"))
                      .select("table_name", "column_name", "what", (F.col("_p") + 1).cast("int").alias("rank"), "value")
                      .unionByName(p.select("table_name", "column_name", F.lit("largest count").alias("what"), F.lit(1).alias("rank"),
                                            F.col("value_counts")[0]["count"].cast("string").alias("value"))))(
        profiled(spark, d, APPROX_VALUE_TABLES, "values", exact=False).where("type = 'string'")))

# -0.0 and 0.0 are one value
register("profile_unique_zero", """
SELECT count(DISTINCT CASE WHEN value * (event_id % 3) = 0 THEN 0.0 ELSE value * (event_id % 3) END)::BIGINT AS unique_count FROM events""")(
    lambda spark, d: profile_tables({"z": table(spark, d, "events").select(
        (F.col("value") * (F.col("event_id") % 3) * F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(
            F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1.0))).alias("z"))}, stats=["values"]).select("unique_count"))


# ------------------------------------------------------------------ profiles that grow batch by batch
def _merged(spark: SparkSession, sf_dir: str, names: list[str], by: dict[str, str]) -> DataFrame:
    """Each table in three batches, a state each, merged as a tree: (first + second), then the third."""
    states = []
    for n in names:
        df = dirty_events(spark, sf_dir) if n == "events_dirty" else table(spark, sf_dir, n)
        states.append([profile_state(df.where(F.pmod(F.col(by[n]), F.lit(3)) == k), n) for k in range(3)])
    early = merge_states(_union([s for three in states for s in three[:2]]))
    return state_profile(early.unionByName(_union([three[2] for three in states])))


MERGED_TABLES = {"lineitem": "l_orderkey", "events_dirty": "event_id", "orders": "o_orderkey"}
register("profile_merged", _per_column(
    list(MERGED_TABLES), ALL_KINDS,
    "count(*)::BIGINT AS rows, (count(*) - count({c}))::BIGINT AS null_count, max(CASE WHEN '{k}' = 'str' THEN length({c}::VARCHAR) END)::BIGINT AS max_length, "
    + f"{sql_rnd('min(TRY_CAST({c} AS DOUBLE))')} AS min, {sql_rnd('max(TRY_CAST({c} AS DOUBLE))')} AS max, {sql_rnd('avg(TRY_CAST({c} AS DOUBLE))')} AS mean, "
    + f"{sql_rnd('stddev_samp(TRY_CAST({c} AS DOUBLE))')} AS std_dev, {sql_rnd('skewness(TRY_CAST({c} AS DOUBLE))', 6)} AS skewness, "
    + "CASE WHEN '{k}' = 'ts' THEN min({c})::VARCHAR::TIMESTAMP END AS min_date, CASE WHEN '{k}' = 'ts' THEN max({c})::VARCHAR::TIMESTAMP END AS max_date"))(
    lambda spark, d: _merged(spark, d, list(MERGED_TABLES), MERGED_TABLES).select(
        "table_name", "column_name", "rows", "null_count", "max_length", rnd("min").alias("min"), rnd("max").alias("max"), rnd("mean").alias("mean"),
        rnd("std_dev").alias("std_dev"), rnd("skewness", 6).alias("skewness"), "min_date", "max_date"))
register("profile_merged_values", _per_column(
    ["events_dirty"], {"str", "num"}, "rn::INTEGER AS rank, v AS value",
    "FROM (SELECT v, row_number() OVER (ORDER BY x NULLS LAST, v) AS rn FROM (SELECT DISTINCT {c}::VARCHAR AS v, TRY_CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL)) WHERE rn <= 3"))(
    lambda spark, d: _merged(spark, d, ["events_dirty"], MERGED_TABLES).where("type <> 'date'").select("table_name", "column_name", F.posexplode("examples").alias("_p", "value"))
    .select("table_name", "column_name", (F.col("_p") + 1).cast("int").alias("rank"), "value"))
