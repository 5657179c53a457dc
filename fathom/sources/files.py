"""File sources: CSV (with an optional leading ``sep=`` line), JSON layouts, named table sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_LAYOUTS = ("records", "columns", "index", "values")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Marks a quoted empty cell while it is read, so that it stays apart from an empty cell (NULL).
_EMPTY = "\u0001"
# What happens to a row with more or fewer cells than the header: an error, missing cells as NULL and
# surplus cells dropped, or the row's text in a column of its own.
ON_MALFORMED = ("fail", "null", "keep")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",",
             encoding: str = "UTF-8", header: bool = True, infer_schema: bool = True, multi_line: bool = False,
             sep_line: bool = False, on_malformed: str = "fail", corrupt_column: str = "_malformed") -> DataFrame:
    """CSV as RFC 4180 writes it: quotes are doubled inside quoted cells, an empty cell is NULL, "" is the empty text.

    Rows with the wrong number of cells raise when they are read; ``on_malformed="null"`` pads or cuts them
    and ``"keep"`` also adds ``corrupt_column`` with their text. Line breaks inside quotes need
    ``multi_line=True``, which reads each file in one task; without it files are split. Columns whose
    header is blank are left out. Type inference costs one extra pass; on large inputs pass ``schema``.

    ``sep_line=True`` is for spreadsheet exports: the first line of every file is ``sep=<c>``, the second its header.
    """
    if on_malformed not in ON_MALFORMED:
        raise ValueError(f"on_malformed must be one of {ON_MALFORMED}")
    opts = dict(header=str(header).lower(), sep=sep, encoding=encoding, multiLine=str(multi_line).lower(), quote='"', escape='"',
                nullValue="", emptyValue=_EMPTY, mode="FAILFAST" if on_malformed == "fail" else "PERMISSIVE")
    if sep_line:
        return _read_csv_after_hint(spark, path, schema, opts, infer_schema, on_malformed, corrupt_column)
    reader = spark.read.options(**opts)
    if schema is None and (on_malformed == "keep" or header):
        # the names come from the header, the types from one pass; then the rows are read with that schema
        schema = reader.option("mode", "PERMISSIVE").option("inferSchema", str(infer_schema).lower()).csv(path).schema
    fields = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fields if schema is not None else None
    reader = spark.read.options(**opts)
    if fields is None:
        return _finished(reader.option("inferSchema", str(infer_schema).lower()).csv(path), [])
    if on_malformed == "keep":
        fields = [*fields, T.StructField(corrupt_column, T.StringType())]
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    # the header is checked by name only where the names came from it
    df = reader.option("enforceSchema", "true").schema(T.StructType(fields)).csv(path)
    blank = [f.name for i, f in enumerate(fields) if header and f.name == f"_c{i}"]
    return _finished(df, blank)


def _finished(df: DataFrame, drop: list[str]) -> DataFrame:
    """Names stripped, blank columns dropped, the mark of a quoted empty cell turned into the empty text."""
    out = []
    for f in df.schema.fields:
        if f.name in drop or not f.name.strip():
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c == _EMPTY, F.lit("")).otherwise(c)
        out.append(c.alias(f.name.strip()))
    return df.select(*out)


# Candidate types tried, narrowest first, when inferring the columns of a hinted CSV.
INFER_ORDER = ("int", "bigint", "double", "boolean", "timestamp")


def _numbered(batches):
    """Lines with their place in the file: 0 and 1 for the first two, 2 for all others.

    The lines of a split come in order, and only the split that starts a file holds its first lines.
    """
    import pyarrow as pa
    seen: dict[str, int] = {}
    for b in batches:
        place = []
        for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            k = 2
            if start == 0:
                k = min(2, seen.get(name, 0))
                seen[name] = k + 1
            place.append(k)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place, pa.int32()), b.column(2)], ["file", "place", "value"])


def _read_csv_after_hint(spark: SparkSession, path: str, schema, opts: dict, infer: bool, on_malformed: str, corrupt_column: str) -> DataFrame:
    import csv as _csv
    lines = spark.read.option("encoding", opts["encoding"]).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    lines = lines.mapInArrow(_numbered, "file string, place int, value string")
    heads: dict[str, dict[int, str]] = {}
    for r in lines.where("place < 2").collect():        # two lines a file
        heads.setdefault(r["file"], {})[r["place"]] = r["value"]
    forms: dict[tuple, list[str]] = {}
    for name, head in sorted(heads.items()):
        hint = (head.get(0) or "").lstrip("\ufeff")
        if not hint.startswith("sep=") or 1 not in head:
            raise ValueError(f"{name} does not start with a sep= line and a header")
        delim = hint[4:5] or ","
        forms.setdefault((delim, tuple(n.strip() for n in next(_csv.reader([head[1]], delimiter=delim)))), []).append(name)
    out = None
    for (delim, names), files in forms.items():
        body = lines.where((F.col("place") == 2) & F.col("file").isin(files) & (F.trim("value") != ""))
        part = _parsed(body, names, schema, opts | {"sep": delim}, infer, on_malformed, corrupt_column)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no sep= file at {path}")
    return out


def _parsed(body: DataFrame, names: tuple, schema, opts: dict, infer: bool, on_malformed: str, corrupt_column: str) -> DataFrame:
    from_opts = {k: v for k, v in opts.items() if k in ("sep", "nullValue", "emptyValue", "quote", "escape")} | {"mode": opts["mode"]}
    fields = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fields if schema is not None else None
    kinds = [f.dataType.simpleString() for f in fields] if fields else ["string"] * len(names)
    text = ", ".join(f"`_c{i}` {k}" for i, k in enumerate(kinds))
    keep = on_malformed == "keep"
    if keep:
        text += f", `{corrupt_column}` string"
        from_opts["columnNameOfCorruptRecord"] = corrupt_column
    parsed = body.select(F.from_csv("value", text, from_opts).alias("_r")).select("_r.*")
    extra = [F.col(f"`{corrupt_column}`")] if keep else []
    if fields:
        return _finished(parsed.select(*[F.col(f"_c{i}").alias(f.name) for i, f in enumerate(fields)], *extra), [])
    if infer:
        # One aggregate over all rows: for each column and candidate type, does every value cast?
        checks = [F.count_if(F.col(f"_c{i}").isNotNull() & F.col(f"_c{i}").try_cast(t).isNull()).alias(f"{i}_{t}")
                  for i in range(len(names)) for t in INFER_ORDER]
        checks += [F.count(F.col(f"_c{i}")).alias(f"{i}_present") for i in range(len(names))]
        bad = parsed.agg(*checks).first().asDict()   # one bounded row
        chosen = ["string" if bad[f"{i}_present"] == 0 else next((t for t in INFER_ORDER if bad[f"{i}_{t}"] == 0), "string") for i in range(len(names))]
    else:
        chosen = ["string"] * len(names)
    cols = [(F.col(f"_c{i}") if t == "string" else F.col(f"_c{i}").try_cast(t)).alias(n) for i, (n, t) in enumerate(zip(names, chosen)) if n]
    return _finished(parsed.select(*cols, *extra), [])


def read_json(spark: SparkSession, path: str, orient: str = "records", schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """JSON in one of four layouts. Text that does not parse is an error, not a row of NULLs.

    ``records`` and ``values`` come as JSON lines (``lines=True``: an object or array per line, split over
    tasks; the layout to use at scale) or as one array per file (``lines=False``). ``columns``
    ``{col: {idx: v}}`` and ``index`` ``{idx: {col: v}}`` are single documents: helpers for small files,
    each read by one task. Files of a folder are read independently; rows come in no particular order.
    Without a ``schema`` (for the final columns) ``columns``, ``index`` and ``values`` give strings.
    """
    if orient not in JSON_LAYOUTS:
        raise ValueError(f"orient must be one of {JSON_LAYOUTS}")
    strict = {"mode": "FAILFAST"}
    st = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)) if schema is not None else None
    if orient == "records":
        reader = spark.read.options(multiLine=str(not lines).lower(), **strict)
        return (reader.schema(st) if st is not None else reader).json(path)
    whole = not (orient == "values" and lines)
    docs = spark.read.text(path, wholetext=whole).where(F.trim("value") != "")
    if orient == "values":
        if whole:
            rows = docs.select(F.explode(F.from_json("value", "array<array<string>>", strict)).alias("_row"))
        else:
            rows = docs.select(F.from_json("value", "array<string>", strict).alias("_row"))
        width = len(st.fields) if st is not None else rows.agg(F.max(F.size("_row"))).first()[0] or 0
        cells = [F.get("_row", F.lit(i)) for i in range(width)]
        return rows.select(*[(c.cast(st.fields[i].dataType).alias(st.fields[i].name) if st is not None else c.alias(str(i))) for i, c in enumerate(cells)])
    nested = F.from_json("value", "map<string,map<string,string>>", strict)
    outer = docs.select(F.col("_metadata.file_path").alias("_file"), F.explode(nested).alias("_k1", "_inner"))
    cells = outer.select("_file", "_k1", F.explode("_inner").alias("_k2", "_v"))
    col_key, idx_key = ("_k1", "_k2") if orient == "columns" else ("_k2", "_k1")
    names = [f.name for f in st.fields] if st is not None else [r[0] for r in cells.select(col_key).distinct().orderBy(col_key).collect()]
    out = cells.groupBy("_file", F.col(idx_key).alias("_idx")).pivot(col_key, names).agg(F.first("_v")).drop("_file", "_idx")
    return out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in st.fields]) if st is not None else out


def read_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet",
                **options) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Several named tables; a table that fails to load is skipped and reported in ``errors``."""
    tables, errors = {}, []
    for name, path in paths.items():
        try:
            if fmt == "csv":
                tables[name] = read_csv(spark, path, **options)
            elif fmt == "json":
                tables[name] = read_json(spark, path, **options)
            else:
                tables[name] = spark.read.format(fmt).options(**options).load(path)
        except Exception as exc:  # noqa: BLE001 - one bad table must not stop the others
            errors.append((name, str(exc)))
    return tables, errors
