"""Text screening against long token lists: one multi-pattern automaton instead of a search per token.

``scan.scan_text`` compares each line with each token, which fits the short list it was made for. Here the list is sent
to the executors once, each task builds an Aho-Corasick automaton from it and reads every text once, whatever the
number of tokens. A list beyond ``BLOCK_CHARS`` is dealt into blocks, each with a pass of its own, so what is broadcast and built stays bounded.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators.scan import DEFAULT_REASON

# Characters of tokens and reasons in one automaton (some 30 times as many bytes in a worker).
BLOCK_CHARS = 8 << 20
LINE_SPACE = " \t\r\f\v"     # what scan_text strips from a line


def token_blocks(tokens: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """The tokens in blocks of at most ``block_chars`` characters, streamed to the driver one block at a time.

    NULL and empty tokens, and tokens with a line break, match no line and are left out; of a token given twice, the smallest reason stays.
    """
    reason = F.col("reason") if "reason" in tokens.columns else F.lit(None).cast("string")
    clean = (tokens.select("token", F.coalesce(reason, F.lit(DEFAULT_REASON)).alias("reason")).where((F.length("token") > 0) & ~F.contains("token", F.lit("\n")))
             .groupBy("token").agg(F.min("reason").alias("reason")))
    block, size = [], 0
    for r in clean.toLocalIterator():
        cost = len(r["token"]) + len(r["reason"])
        if block and size + cost > block_chars:
            yield block
            block, size = [], 0
        block.append((r["token"], r["reason"]))
        size += cost
    if block:
        yield block


def scan_tokens(df: DataFrame, id_col: str, text_col: str, tokens: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, token, reason, line_no, line) as :func:`scan.scan_text` gives, for a table (token[, reason]) of any length.

    Runs a job that reads ``tokens``; the texts are read once a block of tokens, without a shuffle.
    """
    ident, text = F.col("`" + id_col.replace("`", "``") + "`"), F.col("`" + text_col.replace("`", "``") + "`")
    source = df.select(ident.alias("_id"), text.cast("string").alias("_text")).where("_text IS NOT NULL")
    schema = T.StructType([source.schema["_id"], T.StructField("token", T.StringType()), T.StructField("reason", T.StringType()),
                           T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])
    sc = df.sparkSession.sparkContext
    out = None
    for block in token_blocks(tokens, block_chars):
        hits = source.mapInArrow(_scanner(sc.broadcast(block)), schema)
        out = hits if out is None else out.unionAll(hits)
    out = df.sparkSession.createDataFrame([], schema) if out is None else out
    return out.select(F.col("_id").alias(id_col), "token", "reason", "line_no", "line")


def _scanner(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        find = ahocorasick.Automaton()
        for k, (token, _) in enumerate(block.value):
            find.add_word(token, k)
        find.make_automaton()
        for batch in batches:
            at, token, reason, number, lines = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ends = None
                seen = set()
                for last, k in find.iter(text):
                    if ends is None:      # only texts with a hit are cut into lines
                        ends = [j for j, ch in enumerate(text) if ch == "\n"]
                    line = bisect_right(ends, last)
                    if (line, k) not in seen:
                        seen.add((line, k))
                for line, k in sorted(seen):
                    begin = ends[line - 1] + 1 if line else 0
                    stop = ends[line] if line < len(ends) else len(text)
                    at.append(i)
                    token.append(block.value[k][0])
                    reason.append(block.value[k][1])
                    number.append(line + 1)
                    lines.append(text[begin:stop].strip(LINE_SPACE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(token, pa.string()), pa.array(reason, pa.string()),
                 pa.array(number, pa.int64()), pa.array(lines, pa.string())], names=["_id", "token", "reason", "line_no", "line"])
    return run
