"""Chart-ready data: aggregate in Spark, hand a small long table to whoever draws it.

Output of :func:`chart_data` is long: (label, series, series_index, value) for bar and line
charts, plus (pct, show_label) for pie charts. ``series_index`` is the measure's column
position in the input, the position that picks its colour (``color_index = pos % 3``); the slices of
a pie are coloured by their own position, in label order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import types as vt
from fathom.plans import ranks

# Chart kinds, palette size (colours cycle by column position) and the value
# above which a pie slice shows its label.
CHART_KINDS = ("bar", "line", "pie")
PALETTE_SIZE = 3
PIE_LABEL_MIN = 5
AGGREGATES = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def chart_columns(df: DataFrame, kind: str, label: str | None = None,
                  measures: list[str] | None = None) -> tuple[str | None, list[tuple[int, str]]]:
    """Label = first string column; measures = every numeric column (pie: the first one)."""
    if kind not in CHART_KINDS:
        raise ValueError(f"unknown chart kind {kind!r}; choose one of {CHART_KINDS}")
    fields = df.schema.fields
    if label is None:
        label = next((f.name for f in fields if vt.is_string(f.dataType)), None)
    positions = {f.name: i for i, f in enumerate(fields)}
    if measures is None:
        measures = [f.name for f in fields if vt.is_numeric(f.dataType)]
    if kind == "pie":
        measures = measures[:1]
    return label, [(positions[m], m) for m in measures]


def chart_data(df: DataFrame, kind: str | list[str], label: str | None = None,
               measures: list[str] | None = None, agg: str = "sum", y_min: float | None = None,
               disabled: tuple | list = (), top: int | None = None, label_unit: str | None = None,
               label_format: str | None = None, series: str | None = None) -> DataFrame:
    """Aggregate ``measures`` by ``label`` for a bar, line or pie chart.

    ``kind`` may be a list, as chart requests give one; the first entry is used. ``disabled``
    labels are removed before aggregating; ``y_min`` drops aggregated values below it; ``top``
    keeps the ``top`` labels with the largest value of the first series (ties by label).
    ``label_unit`` truncates a temporal label (``date_trunc``) and ``label_format`` renders it.
    ``series`` names a column whose values are the series of the first measure (bar and line): a table that would
    otherwise have to be pivoted. Their positions, which pick the colours, are those of the values in order, NULL last.
    """
    if series is not None:
        return _chart_by_value(df, kind, label, measures, agg, y_min, disabled, top, label_unit, label_format, series)
    if isinstance(kind, (list, tuple)):
        if not kind:
            raise ValueError("no chart kind given")
        kind = kind[0]
    label, measures = chart_columns(df, kind, label, measures)
    if not measures:
        raise ValueError("chart needs at least one numeric column")
    fn = AGGREGATES[agg]
    lab = _c(label) if label else F.lit(None).cast("string")
    if label_unit:
        lab = F.date_trunc(label_unit, lab).cast("timestamp_ntz")
    if label_format:
        lab = F.date_format(lab, label_format)
    base = df.select(lab.alias("label"), *[_c(m).cast("double").alias(f"_m{pos}") for pos, m in measures])
    if disabled:
        base = base.where(~F.col("label").isin(list(disabled)) | F.col("label").isNull())
    grouped = base.groupBy("label").agg(*[fn(f"_m{pos}").cast("double").alias(f"_m{pos}") for pos, _ in measures])
    if top:
        # A top-k report: at most ``top`` labels survive (bounded), chosen by the first series.
        first = f"_m{measures[0][0]}"
        keep = grouped.orderBy(F.desc_nulls_last(first), F.asc("label")).limit(int(top)).select("label")
        grouped = grouped.join(F.broadcast(keep), grouped["label"].eqNullSafe(keep["label"]), "left_semi")
    long = grouped.select("label", F.inline(F.array(*[
        F.struct(F.lit(m).alias("series"), F.lit(pos).alias("series_index"),
                 F.lit(pos % PALETTE_SIZE).alias("color_index"), F.col(f"_m{pos}").alias("value"))
        for pos, m in measures])))
    if y_min is not None:
        long = long.where(F.col("value") >= F.lit(float(y_min)))
    if kind == "pie":
        # The slices are grouped once (a table); the total is one row, the position of a slice its rank by label.
        slices = ranks.sliced(long.withColumn("_all", F.lit(0)), ["_all"], [F.asc_nulls_last("label")])
        placed = ranks.with_running_weight(slices, ranks.slice_offsets(slices, ["_all"], None), ["_all"], [F.asc_nulls_last("label")], None)
        total = slices.agg(F.sum("value").alias("t")).first()["t"]
        pct = F.round(F.col("value") / F.lit(total) * 100).cast("bigint") if total else F.lit(None).cast("bigint")
        return placed.select("label", "series", "series_index", F.pmod(F.col("_rank_start"), F.lit(PALETTE_SIZE)).cast("int").alias("color_index"),
                             "value", pct.alias("pct"), (F.col("value") > PIE_LABEL_MIN).alias("show_label"))
    return long.orderBy("label", "series_index") if kind == "line" else long


def _chart_by_value(df, kind, label, measures, agg, y_min, disabled, top, label_unit, label_format, series) -> DataFrame:
    kind = kind[0] if isinstance(kind, (list, tuple)) and kind else kind
    if kind not in ("bar", "line"):
        raise ValueError("series by value are for bar and line charts")
    label = label or next((f.name for f in df.schema.fields if vt.is_string(f.dataType) and f.name != series), None)
    _, found = chart_columns(df, kind, label, measures)
    found = [f for f in found if f[1] != series]
    if not found:
        raise ValueError("chart needs at least one numeric column")
    pos, measure = found[0]
    lab = _c(label) if label else F.lit(None).cast("string")
    if label_unit:
        lab = F.date_trunc(label_unit, lab).cast("timestamp_ntz")
    if label_format:
        lab = F.date_format(lab, label_format)
    base = df.select(lab.alias("label"), _c(series).cast("string").alias("series"), _c(measure).cast("double").alias("m"))
    if disabled:
        base = base.where(~F.col("label").isin(list(disabled)) | F.col("label").isNull())
    if top:
        # A top-k report by the label's value over all series.
        keep = base.groupBy("label").agg(AGGREGATES[agg]("m").alias("t")).orderBy(F.desc_nulls_last("t"), F.asc("label")).limit(int(top)).select(F.col("label").alias("kept"))
        base = base.join(F.broadcast(keep), F.col("label").eqNullSafe(F.col("kept")), "left_semi")
    grouped = base.groupBy("label", "series").agg(AGGREGATES[agg]("m").cast("double").alias("value"))
    # One group of series names, numbered by value: ranked in range slices like any dictionary, however many there are.
    names = ranks.sliced(grouped.select("series").distinct().withColumn("_all", F.lit(0)), ["_all"], [F.asc_nulls_last("series")])
    placed = ranks.with_running_weight(names, ranks.slice_offsets(names, ["_all"], None), ["_all"], [F.asc_nulls_last("series")], None, broadcast_offsets=False)
    index = placed.select(F.col("series").alias("name"), F.col("_rank_start").cast("int").alias("series_index"))
    out = grouped.join(index, F.col("series").eqNullSafe(F.col("name"))).select(
        "label", "series", "series_index", F.pmod("series_index", F.lit(PALETTE_SIZE)).cast("int").alias("color_index"), "value")
    if y_min is not None:
        out = out.where(F.col("value") >= F.lit(float(y_min)))
    return out.orderBy("label", "series_index") if kind == "line" else out


def line_pixels(df: DataFrame, x: str, y: str, width: int, series: str | None = None, x_range: tuple[float, float] | None = None) -> DataFrame:
    """A line of any number of points at a fixed width: (series, pixel, n, x_first, x_last, y_first, y_last, y_min, y_max).

    Every pixel column keeps its first, last, lowest and highest value, which draw the same picture as all of its
    points; one map-side aggregate, at most ``width`` rows a series leave a task. ``x`` is a number or a time (then in
    microseconds since 1970); points whose x or y is missing (NULL or NaN) are left out, and of points at the same x the lowest y comes
    first. The columns divide ``x_range`` (by default the span of the data, one more aggregate); points outside it are left out.
    """
    if width < 1:
        raise ValueError("width must be at least one pixel")
    kind = {f.name: f.dataType for f in df.schema.fields}[x]
    xc = F.unix_micros(_c(x).cast("timestamp")).cast("double") if vt.is_temporal(kind) else _c(x).cast("double")
    base = df.select((_c(series).cast("string") if series else F.lit(y)).alias("series"), xc.alias("x"), _c(y).cast("double").alias("y"))
    base = base.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    low, high = x_range or base.agg(F.min("x"), F.max("x")).first()
    if low is None:
        low = high = 0.0
    low, high = float(low), float(high)
    place = F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * F.lit(float(width))).cast("int") if high > low else F.lit(0)
    point = F.struct("x", "y")
    # The last pixel column includes its right edge.
    return (base.where(F.col("x").between(low, high)).groupBy("series", F.least(place, F.lit(width - 1)).alias("pixel"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(point).alias("a"), F.max(point).alias("b"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
            .select("series", "pixel", "n", F.col("a.x").alias("x_first"), F.col("b.x").alias("x_last"),
                    F.col("a.y").alias("y_first"), F.col("b.y").alias("y_last"), "y_min", "y_max"))
