"""Cleaning operators: missing values, duplicates, outliers, type and date repair, nested data.

Statistics a row-wise rule needs (a mean, a percentile, an IQR) are *fitted* first as a
one-row aggregate over the whole column and then applied as literals in a projection - the
same fit/transform split Spark ML's Imputer and scalers use. The fitted row is bounded (one
row), so nothing grows on the driver, and the apply step is a narrow map that stays in
whole-stage codegen: no global window, no cross join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.stats import nan_to_null
from fathom.functions.types import is_floating
from fathom.plans.quantiles import column_quantiles, weighted_quantiles
from fathom.session import reliable_checkpoint


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# --------------------------------------------------------------------------- nulls
def drop_nulls(df: DataFrame, subset: list[str] | None = None, how: str = "any",
               thresh: int | None = None) -> DataFrame:
    """Remove rows with missing values (NULL, or NaN in float columns)."""
    return nan_to_null(df).na.drop(how=how, thresh=thresh, subset=subset)


def fit_fill_values(df: DataFrame, strategy: dict[str, object]) -> dict[str, object]:
    """Resolve 'mean' / 'median' / 'mode' strategies to literal fill values (one small job)."""
    df = nan_to_null(df)
    aggs, literal = [], {}
    for col, how in strategy.items():
        if how == "mean":
            aggs.append(F.avg(_c(col)).alias(col))
        elif how not in ("mode", "median"):
            literal[col] = how
    fitted = dict(literal)
    if aggs:
        row = df.agg(*aggs).first()
        fitted.update({c: row[c] for c in row.asDict()})
    for col, how in strategy.items():
        if how == "median":
            fitted[col] = column_quantiles(df, col, [0.5], ["m"]).first()["m"]
        elif how == "mode":
            # Most frequent value (smallest on ties): counted with a distributed groupBy, then a
            # top-1 that each task computes before one merge - no value map in a single task.
            top = (df.where(_c(col).isNotNull()).groupBy(_c(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
                   .orderBy(F.desc("_n"), F.asc("_v")).limit(1).collect())
            fitted[col] = top[0]["_v"] if top else None
    return fitted


def fill_nulls(df: DataFrame, strategy: dict[str, object]) -> DataFrame:
    """Fill missing values per column with a value or 'mean' / 'median' / 'mode'."""
    fitted = fit_fill_values(df, strategy)
    df = nan_to_null(df)
    out = []
    for f in df.schema.fields:
        if f.name in fitted and fitted[f.name] is not None:
            out.append(F.coalesce(_c(f.name), F.lit(fitted[f.name]).cast(f.dataType)).alias(f.name))
        else:
            out.append(_c(f.name))
    return df.select(*out)


# --------------------------------------------------------------------------- duplicates
def drop_duplicates(df: DataFrame, subset: list[str] | None = None,
                    order_by: list[Column] | None = None) -> DataFrame:
    """Remove duplicate rows; with ``subset`` and ``order_by`` the first row by that order survives
    (with a ``subset`` but no order, which row of a group survives is not defined).

    Full-row and subset dedup without an order are a ``groupBy`` with map-side combine. With an
    order it is ``row_number() = 1``, which Spark plans as a partial window-group limit before
    the shuffle, so a hot key sends at most one row per map task.
    """
    if not subset or not order_by:
        return df.dropDuplicates(subset) if subset else df.dropDuplicates()
    w = Window.partitionBy(*[_c(c) for c in subset]).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# --------------------------------------------------------------------------- outliers
def fit_bounds(df: DataFrame, col: str, method: str = "iqr", k: float | None = None,
               lower: float | None = None, upper: float | None = None, exact: bool = True) -> tuple:
    """Bounds (lo, hi) for an outlier rule: 'iqr' (k=1.5), 'zscore' (k=3) or 'percentile'."""
    if method == "iqr":
        k = 1.5 if k is None else k
        q = column_quantiles(df, col, [0.25, 0.75], ["q1", "q3"], exact=exact).first()
        if q is None or q["q1"] is None:
            return None, None
        iqr = q["q3"] - q["q1"]
        return q["q1"] - k * iqr, q["q3"] + k * iqr
    if method == "zscore":
        k = 3.0 if k is None else k
        x = _c(col).cast("double")
        s = nan_to_null(df.select(x.alias("_x"))).agg(F.avg("_x").alias("m"), F.stddev_samp("_x").alias("s")).first()
        if s["m"] is None or s["s"] is None:
            return None, None
        return s["m"] - k * s["s"], s["m"] + k * s["s"]
    if method == "percentile":
        probs, names = [], []
        if lower is not None:
            probs.append(lower), names.append("lo")
        if upper is not None:
            probs.append(upper), names.append("hi")
        q = column_quantiles(df, col, probs, names, exact=exact).first() if probs else None
        lo = q["lo"] if q is not None and lower is not None else None
        hi = q["hi"] if q is not None and upper is not None else None
        return lo, hi
    raise ValueError(f"unknown outlier method {method!r}")


def _value(df: DataFrame, col: str) -> Column:
    """The column with NaN read as missing, as the fitted statistics do."""
    x = _c(col)
    return F.when(~F.isnan(x), x) if is_floating(df.schema[col].dataType) else x


def _inside(x: Column, lo, hi) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (x >= F.lit(lo))
    if hi is not None:
        cond = cond & (x <= F.lit(hi))
    return cond


def flag_outliers(df: DataFrame, col: str, method: str = "iqr", k: float | None = None,
                  out: str | None = None, exact: bool = True) -> DataFrame:
    lo, hi = fit_bounds(df, col, method, k, exact=exact)
    x = _value(df, col)
    return df.withColumn(out or f"{col}_outlier", x.isNotNull() & ~_inside(x, lo, hi))


def drop_outliers(df: DataFrame, col: str, method: str = "iqr", k: float | None = None,
                  exact: bool = True) -> DataFrame:
    """Keep rows inside the bounds; rows with a missing value (NULL or NaN) are kept, they are not outliers."""
    lo, hi = fit_bounds(df, col, method, k, exact=exact)
    x = _value(df, col)
    return df.where(x.isNull() | _inside(x, lo, hi))


def cap_outliers(df: DataFrame, col: str, lower: float | None = None, upper: float | None = 0.99,
                 exact: bool = True) -> DataFrame:
    """Winsorise ``col`` at its ``lower``/``upper`` percentiles (default: cap at the 99th)."""
    lo, hi = fit_bounds(df, col, "percentile", lower=lower, upper=upper, exact=exact)
    return _apply_cap(df, col, lo, hi)


def _apply_cap(df: DataFrame, col: str, lo, hi) -> DataFrame:
    x = _value(df, col)
    capped = x
    if hi is not None:
        capped = F.least(capped, F.lit(hi))
    if lo is not None:
        capped = F.greatest(capped, F.lit(lo))
    dtype = df.schema[col].dataType
    if not isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        dtype = T.DoubleType()
    return df.withColumn(col, F.when(x.isNull(), x.cast(dtype)).otherwise(capped.cast(dtype)))


# --------------------------------------------------------------------------- repairs
NUMBER_TEXT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def to_number_expr(c: Column) -> Column:
    """Text to double: strip spaces and thousands commas; anything that is not a decimal number becomes NULL."""
    text = F.regexp_replace(c.cast("string"), r"[, \t]", "")
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def to_number(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, to_number_expr(_c(col)))


def to_date_expr(c: Column, formats: list[str]) -> Column:
    """First format (Spark datetime pattern) that parses; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats]).cast("date")


def to_date(df: DataFrame, col: str, formats: list[str], out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, to_date_expr(_c(col), formats))


# --------------------------------------------------------------------------- nested data
def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields become top-level columns named ``parent<sep>child`` (recursively)."""
    def walk(dt: T.DataType, path: list[str]) -> list[Column]:
        if isinstance(dt, T.StructType):
            cols = []
            for f in dt.fields:
                cols += walk(f.dataType, path + [f.name])
            return cols
        ref = F.col(".".join(f"`{p}`" for p in path))
        return [ref.alias(sep.join(path))]
    cols = []
    for f in df.schema.fields:
        cols += walk(f.dataType, [f.name])
    return df.select(*cols)


def explode_column(df: DataFrame, col: str, position: str | None = "pos", out: str | None = None) -> DataFrame:
    """One row per array element; NULL or empty arrays keep one row with NULL element."""
    others = [_c(c) for c in df.columns if c != col]
    if position:
        return df.select(*others, F.posexplode_outer(_c(col)).alias(position, out or col))
    return df.select(*others, F.explode_outer(_c(col)).alias(out or col))


def parse_json(df: DataFrame, col: str, schema: str | T.StructType, out: str | None = None) -> DataFrame:
    """Parse a JSON text column with a given schema (malformed text gives NULL fields)."""
    return df.withColumn(out or col, F.from_json(_c(col), schema, {"mode": "PERMISSIVE"}))


def merge_tables(tables: dict[str, DataFrame], source_col: str = "source") -> DataFrame:
    """Stack tables by column name; missing columns are NULL and ``source_col`` names the table."""
    parts = [df.withColumn(source_col, F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --------------------------------------------------------------------------- composite
@dataclass
class CleanRules:
    """Which steps ``clean`` runs, in the fixed order conversions -> fills -> nulls -> duplicates -> outliers."""
    to_numbers: list[str] = field(default_factory=list)
    to_dates: dict[str, list[str]] = field(default_factory=dict)     # col -> datetime patterns
    fills: dict[str, object] = field(default_factory=dict)           # col -> value | 'mean' | 'median' | 'mode'
    null_subset: list[str] | None = None        # columns that must not be missing (None: all)
    drop_null_rows: bool = True
    dedup: bool = True
    dedup_subset: list[str] | None = None
    outlier_cols: dict[str, str] = field(default_factory=dict)   # col -> 'cap' | 'iqr' | 'zscore'
    cap_upper: float | None = 0.99
    cap_lower: float | None = None
    exact: bool = True


def fit_many_bounds(df: DataFrame, outlier_cols: dict[str, str], upper: float | None = 0.99, lower: float | None = None, exact: bool = True) -> dict[str, tuple]:
    """Bounds (lo, hi) of several columns: one pass for the percentiles of all, one for means and deviations."""
    bounds: dict[str, tuple] = {}
    wanted = [c for c, how in outlier_cols.items() if how in ("cap", "iqr")]
    if unknown := {how for how in outlier_cols.values()} - {"cap", "iqr", "zscore"}:
        raise ValueError(f"unknown outlier rule {sorted(unknown)}")
    if wanted:
        probs = sorted({0.25, 0.75, *(p for p in (lower, upper) if p is not None)})
        names = [f"q{i}" for i in range(len(probs))]
        entries = [F.struct(F.lit(i).alias("k"), _value(df, c).cast("double").alias("x")) for i, c in enumerate(wanted)]
        long = df.select(F.inline(F.array(*entries))).where(F.col("x").isNotNull())
        if exact:
            values = long.groupBy("k", "x").agg(F.count(F.lit(1)).alias("w"))
            fitted = weighted_quantiles(values, "k", "x", "w", probs, names)
        else:
            q = long.groupBy("k").agg(F.percentile_approx("x", F.array(*map(F.lit, probs)), 10000).alias("q"))
            fitted = q.select("k", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
        found = {r["k"]: {p: r[n] for p, n in zip(probs, names)} for r in fitted.collect()}      # a row a column
        for i, c in enumerate(wanted):
            q = found.get(i)
            if q is None:
                bounds[c] = (None, None)
            elif outlier_cols[c] == "iqr":
                spread = q[0.75] - q[0.25]
                bounds[c] = (q[0.25] - 1.5 * spread, q[0.75] + 1.5 * spread)
            else:
                bounds[c] = (q[lower] if lower is not None else None, q[upper] if upper is not None else None)
    scored = [c for c, how in outlier_cols.items() if how == "zscore"]
    if scored:
        row = df.agg(*[f(_value(df, c).cast("double")) for c in scored for f in (F.avg, F.stddev_samp)]).first()
        for i, c in enumerate(scored):
            m, s = row[2 * i], row[2 * i + 1]
            bounds[c] = (None, None) if m is None or s is None else (m - 3.0 * s, m + 3.0 * s)
    return bounds


REPORT_SCHEMA = "step string, column string, rows_in long, rows_out long, affected long"


def clean(df: DataFrame, rules: CleanRules | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the cleaning steps and return ``(cleaned, report)``.

    This runs jobs: the input is read once (twice if a fill must be fitted), its converted, filled,
    complete and distinct rows are written to the checkpoint folder while the report's counts are observed,
    and the outlier bounds of all columns are fitted on that table together. What is returned reads the
    table (see :func:`fathom.session.scratch_scope` for its removal). ``report`` has one row per step:
    step, column, rows_in, rows_out, affected (rows removed, or values changed).
    """
    rules = rules or CleanRules()
    cur = nan_to_null(df)
    counts, steps = {"rows": F.count(F.lit(1))}, []
    marks = []
    for kind, cols in (("to_number", dict.fromkeys(rules.to_numbers)), ("to_date", rules.to_dates)):
        for col, formats in cols.items():
            made = to_number_expr(_c(col)) if kind == "to_number" else to_date_expr(_c(col), formats)
            mark = f"_converted_{len(marks)}"
            marks.append(mark)
            cur = cur.withColumn(mark, made.isNotNull()).withColumn(col, made)
            counts[mark] = F.count_if(mark)
            steps.append((kind, col, mark))
    fills = {c: v for c, v in fit_fill_values(cur.drop(*marks), rules.fills).items() if v is not None} if rules.fills else {}
    for i, col in enumerate(fills):
        counts[f"_filled_{i}"] = F.count_if(_c(col).isNull())
        steps.append(("fill_nulls", col, f"_filled_{i}"))
    subset = rules.null_subset or [c for c in cur.columns if c not in marks]
    complete = F.lit(True)
    for c in subset:
        complete = complete & (_c(c).isNotNull() | F.lit(c in fills))
    if rules.drop_null_rows:
        counts["complete"] = F.count_if(complete)
    observed = Observation()
    cur = cur.observe(observed, *[c.alias(n) for n, c in counts.items()]).drop(*marks)
    if fills:
        cur = cur.select(*[(F.coalesce(_c(f.name), F.lit(fills[f.name]).cast(f.dataType)).alias(f.name) if f.name in fills else _c(f.name)) for f in cur.schema.fields])
    if rules.drop_null_rows:
        cur = drop_nulls(cur, subset=rules.null_subset)
    if rules.dedup:
        cur = drop_duplicates(cur, subset=rules.dedup_subset)
    cur = reliable_checkpoint(cur)
    got = observed.get
    rows = got["rows"]
    report = [(kind, col, rows, rows, got[name]) for kind, col, name in steps]
    if rules.drop_null_rows:
        report.append(("drop_nulls", ",".join(rules.null_subset or []) or None, rows, got["complete"], rows - got["complete"]))
        rows = got["complete"]
    if rules.dedup:
        left = cur.count()      # from the written files' own row counts
        report.append(("drop_duplicates", ",".join(rules.dedup_subset or []) or None, rows, left, rows - left))
        rows = left
    if rules.outlier_cols:
        bounds = fit_many_bounds(cur, rules.outlier_cols, rules.cap_upper, rules.cap_lower, rules.exact)
        alive, sums, base = F.lit(True), [], cur
        for col, how in rules.outlier_cols.items():
            x = _value(base, col)
            outside = F.coalesce(x.isNotNull() & ~_inside(x, *bounds[col]), F.lit(False))
            sums.append(F.count_if(alive & outside))
            if how != "cap":
                alive = alive & ~outside
        hits = base.agg(*sums).first()      # one pass for all columns
        for k, (col, how) in enumerate(rules.outlier_cols.items()):
            gone = 0 if how == "cap" else hits[k]
            report.append((_cap_name(rules) if how == "cap" else f"drop_outliers_{how}", col, rows, rows - gone, hits[k]))
            rows -= gone
        cur = base.where(alive)
        for col, how in rules.outlier_cols.items():
            if how == "cap":
                cur = _apply_cap(cur, col, *bounds[col])
    return cur, df.sparkSession.createDataFrame(report, REPORT_SCHEMA)


def _cap_name(rules: CleanRules) -> str:
    return "cap_" + "_".join(f"p{p * 100:g}" for p in (rules.cap_lower, rules.cap_upper) if p is not None)


def cleaning_report_frame(df: DataFrame, rules: CleanRules | None = None) -> DataFrame:
    """The cleaning summary of :func:`clean`."""
    return clean(df, rules)[1]


def output_information(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """One row about a written table: path, format, size in bytes, files, rows and columns."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    summary = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target)
    about = [F.lit(path).alias("path"), F.lit(fmt).alias("format"), F.lit(int(summary.getLength())).cast("bigint").alias("size_bytes"),
             F.lit(int(summary.getFileCount())).cast("bigint").alias("files")]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(*about, "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def describe_output(df: DataFrame) -> DataFrame:
    """Output information: one row per column with its position, name, type and the row count."""
    n = df.agg(F.count(F.lit(1)).alias("_rows"))
    entries = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                        F.lit(f.dataType.simpleString()).alias("data_type"),
                        F.col("_rows").cast("bigint").alias("rows"))
               for i, f in enumerate(df.schema.fields)]
    return n.select(F.inline(F.array(*entries)))
