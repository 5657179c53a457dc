"""Screen text files as they arrive: readStream -> scan_text -> parquet sink."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fathom.operators.scan import scan_text
from fathom.session import shared_root


def screen_text_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str, id_col: str,
                       text_col: str, sink_dir: str, fmt: str = "parquet", available_now: bool = False,
                       checkpoint: str | None = None, tokens=None) -> StreamingQuery:
    """Start a query writing every deny-list hit of new files under ``source_dir`` to ``sink_dir``.

    The scan is stateless, so the stream needs no watermark; progress is kept in a checkpoint
    under the session's shared checkpoint folder, so a restarted query resumes exactly once.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    hits = scan_text(stream, id_col, text_col, tokens)
    # A stable name (not Python's per-process hash) so that a restarted query finds its progress.
    digest = hashlib.sha1(f"{source_dir}\n{sink_dir}".encode()).hexdigest()[:16]
    location = checkpoint or f"{shared_root(spark).rstrip('/')}/fathom-stream-{digest}"
    writer = hits.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
