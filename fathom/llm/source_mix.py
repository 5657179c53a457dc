"""Mix sources to target weights: every document floor(rate) times plus one hash-seeded Bernoulli copy.

Only DataFrame expressions: word counts are summed per source with map-side combine, the targets
are solved on the per-source table by rounds of one aggregate each, and a document's copies follow
from its own id and its source's rate, so a re-run or a lost task gives the same mix.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import join_counted, saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)     # the mix holds this share of all words
MOST = 2                   # a source is repeated at most this often
SEED = "mix"


def words(text: Column) -> Column:
    """Number of whitespace-separated words (ASCII whitespace only); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only (52 bits of a hash)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` (0, 1, ... by code point, null last) without sorting all sources in one task."""
    slices = saved(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("slice", F.spark_partition_id()))
    sizes = slices.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))      # a row per slice
    start = sizes.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy(F.col("source").asc_nulls_last()))
    return (slices.withColumn("inside", inside).join(start, "slice")
            .withColumn("rank", F.col("start") + F.col("inside") - 1).drop("slice", "inside", "start"))


def _weight(weights: tuple) -> Column:
    out = F.lit(weights[0])
    for k, w in enumerate(weights[1:], 1):
        out = F.when(F.pmod("rank", F.lit(len(weights))) == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """(source, n, source_size) -> plus ``target``: share of all words dealt by weight, at most ``most`` times a source's words.

    The excess of capped sources is dealt again by weight until no target is above its cap. Each
    round is one aggregate over the source table (two whole numbers reach the driver), and every
    round caps at least one more source. Whole-number arithmetic up to one final division.
    """
    table = saved(_ranked(sources).withColumn("weight", _weight(weights)))
    d = share.denominator
    total = (table.agg(F.sum("source_size")).head()[0] or 0) * share.numerator      # in units of 1/d
    rest, weight, capped = total, table.agg(F.sum("weight")).head()[0] or 1, -1
    big = lambda c: F.col(c).cast("decimal(38,0)")
    while True:
        over = big("source_size") * F.lit(most * d * weight) < big("weight") * F.lit(rest).cast("decimal(38,0)")
        count, held, free = table.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).head()
        if count == capped:
            break
        capped, rest, weight = count, total - most * d * (held or 0), free or 1
    fair = (big("weight") * F.lit(rest).cast("decimal(38,0)")).cast("double") / F.lit(float(d * weight))
    return table.select("source", "n", "source_size", F.when(over, F.col("source_size") * F.lit(float(most))).otherwise(fair).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: str = SEED,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= size * copies).

    Null sources are one source, ranked last. Null and empty texts have size 0; a source without
    words has target 0 and its documents no copies. Rows that repeat an id draw alike.
    """
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")))
    per_source = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))).alias("key")
    dim = saved(targets(per_source, weights, share, most).select(key, "n", "source_size", "target"))
    total = dim.agg(F.sum("n")).head()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("long")
    out = join_counted(rows.select("*", key), dim, ["key"], "n", total)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def emit(docs: DataFrame, copy: str = "copy_no", **options) -> DataFrame:
    """The mixed corpus itself: each document as often as ``mix`` says, with the running number of the copy.

    The rate of a source is all a document needs, so the texts are not shuffled by document:
    the per-source rates are joined to the rows, hot sources by broadcast.
    """
    doc_id, text, source = (options.get(k, k) for k in ("doc_id", "text", "source"))
    key = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source))).alias("__llm_source")
    rates = (mix(docs, **options).groupBy("source").agg(F.count(F.lit(1)).alias("__llm_n"), F.first("target").alias("t"), F.first("source_size").alias("s"))
             .select(F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))).alias("__llm_source"),
                     "__llm_n", F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(F.lit(0.0)).alias("__llm_rate")))
    rates = saved(rates)
    total = rates.agg(F.sum("__llm_n")).head()[0] or 0
    rate = F.col("__llm_rate")
    copies = F.floor(rate) + (draw(F.col(doc_id), options.get("seed", SEED)) < rate - F.floor(rate)).cast("long")
    out = join_counted(docs.select("*", key), rates, ["__llm_source"], "__llm_n", total).withColumn("__llm_copies", copies.cast("int"))
    return (out.where("__llm_copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__llm_copies"))).alias(copy)))
