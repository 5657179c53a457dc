"""Entry points named after the original tool's seven operations, as DataFrame functions.

| original tool              | here                                   |
|----------------------------|----------------------------------------|
| read metadata of a file    | ``read_metadata(spark, path)``         |
| clean and save a file      | ``clean_file(spark, path, out_dir)``   |
| run dataframe code         | ``run_code(spark, tables, sql_or_fn)`` |
| chart generation           | ``chart(df, kinds, ...)``              |
| read JSON                  | ``read_json_file(spark, path, orient)``|
| write a result to JSON     | ``to_json(df, path, orient)``          |
| read from SQL              | ``read_sql(spark, url, query=...)``    |
| write a result to SQL      | ``to_sql(df, url, table, if_exists)``  |
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from fathom.operators.chart import chart_data
from fathom.operators.clean import CleanRules, clean, output_information
from fathom.operators.profile import profile_tables
from fathom.operators.query import run_query
from fathom.sources.files import read_csv, read_json
from fathom.sources.jdbc import read_sql, write_sql
from fathom.sources.sinks import write_cleaned, write_json
from fathom.session import scratch_scope

__all__ = ["read_file", "file_information", "read_metadata", "clean_file", "run_code", "chart", "read_json_file", "to_json", "read_sql", "to_sql"]


# File endings by format; a compression ending may follow.
FORMATS = {".csv": "csv", ".txt": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".orc": "orc"}
COMPRESSIONS = (".gz", ".bz2", ".zst", ".xz")


def file_format(path: str) -> tuple[str, str]:
    """(format, ending) of a path by its ending; an ending that is not known is an error."""
    base = path.rstrip("/").lower()
    for c in COMPRESSIONS:
        base = base.removesuffix(c)
    ending = os.path.splitext(base)[1]
    if ending not in FORMATS:
        raise ValueError(f"{path}: unknown ending {ending!r}; use one of {tuple(FORMATS)} or read the file yourself")
    return FORMATS[ending], ending


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table from a CSV, JSON, Parquet or ORC path (file or folder), chosen by its ending."""
    fmt, ending = file_format(path)
    if fmt == "csv":
        if ending == ".tsv":
            options.setdefault("sep", "\t")
        return read_csv(spark, path, **options)
    if fmt == "json":
        return read_json(spark, path, **options)
    return getattr(spark.read.options(**options), fmt)(path)


def file_information(spark: SparkSession, path: str, **options) -> dict:
    """Format, size in bytes, number of files, and for CSV the encoding and delimiter used to read it."""
    fmt, ending = file_format(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    summary = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target)
    csv = fmt == "csv"
    return {"path": path, "format": fmt, "size_bytes": int(summary.getLength()), "files": int(summary.getFileCount()),
            "encoding": options.get("encoding", "UTF-8") if csv else None,
            "delimiter": options.get("sep", "\t" if ending == ".tsv" else ",") if csv else None}


def read_metadata(spark: SparkSession, path: str | dict[str, str], exact: bool = True, stats=None,
                  **options) -> tuple[DataFrame | None, list[dict], list[tuple[str, str]]]:
    """(profile, files, errors) of a file, or of several named files.

    ``profile`` has a row per table and column (None if no table could be read), ``files`` the
    information of each file read, ``errors`` (name, message) of each that was skipped.
    """
    paths = path if isinstance(path, dict) else {os.path.basename(path.rstrip("/")).split(".")[0] or "table": path}
    tables, files, errors = {}, [], []
    for name, one in paths.items():
        try:
            files.append({"table_name": name, **file_information(spark, one, **options)})
            tables[name] = read_file(spark, one, **options)
        except Exception as exc:  # noqa: BLE001 - one bad table must not stop the others; it is reported
            errors.append((name, str(exc)))
    files = [f for f in files if f["table_name"] in tables]
    return (profile_tables(tables, exact=exact, stats=stats) if tables else None), files, errors


def clean_file(spark: SparkSession, path: str, out_dir: str, rules: CleanRules | None = None, name: str | None = None, fmt: str | None = None,
               mode: str = "errorifexists", **options) -> dict:
    """Reads a file, cleans it and writes ``<out_dir>/<name>_cleaned.<fmt>``; the input stays as it is.

    Returns ``file`` (information about the input), ``report`` (a dict per cleaning step) and ``output`` (path, format, size_bytes, files, rows,
    columns of what was written). ``fmt`` is csv, parquet or orc, by default that of the input (parquet for JSON). Tables written on the way are removed.
    """
    info = file_information(spark, path, **options)
    fmt = fmt or (info["format"] if info["format"] != "json" else "parquet")
    if fmt not in ("csv", "parquet", "orc"):
        raise ValueError(f"cannot write {fmt!r}; use csv, parquet or orc")
    name = name or os.path.basename(path.rstrip("/")).split(".")[0] or "table"
    with scratch_scope(spark):
        cleaned, report = clean(read_file(spark, path, **options), rules)
        steps = [r.asDict() for r in report.collect()]      # a row a step
        out = write_cleaned(cleaned, out_dir, name, fmt, mode=mode)
        about = output_information(cleaned, out, fmt).first().asDict()
    return {"file": info, "report": steps, "output": about}


def run_code(spark: SparkSession, tables: dict[str, DataFrame], query) -> DataFrame:
    """SQL text or a callable over named tables (nothing is ``exec``-ed)."""
    return run_query(spark, tables, query)


def chart(df: DataFrame, kinds: str | list[str], **kwargs) -> DataFrame:
    return chart_data(df, kinds, **kwargs)


def read_json_file(spark: SparkSession, path: str, orient: str = "records", schema=None, lines: bool = True) -> DataFrame:
    return read_json(spark, path, orient=orient, schema=schema, lines=lines)


def to_json(df: DataFrame, path: str, orient: str = "records", mode: str = "errorifexists") -> str:
    write_json(df, path, orient=orient, mode=mode)
    return path


def to_sql(df: DataFrame, url: str, table: str, if_exists: str = "fail", **options) -> int:
    return write_sql(df, url, table, if_exists=if_exists, **options)
