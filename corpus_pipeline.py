"""The corpus pipeline: toxicity, exact copies, near copies, benchmark passages, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet under the
shared checkpoint folder and the next stage reads that. All stages but the last return the columns of
``documents`` and drop rows; the last one repeats documents (``copy_no`` counts a document's copies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import decontam, exact_dedup, simhash, source_mix, toxicity
from fathom.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the ordinal severity model, fitted on the labelled documents, puts above its cut."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (the smallest doc_id)."""
    return simhash.drop_near(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with copy_no 1, 2, ..."""
    return source_mix.emit(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near),
          ("decontamination", drop_leaks), ("source_mix", mix_sources)]

# The toxicity model and the fingerprints have no SQL form: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
