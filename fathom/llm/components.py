"""Connected components of a link table by alternating large-star and small-star rounds.

Links never leave Spark; the driver sees one row count and checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import join_counted, saved


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of bigint nodes -> (node, label), label = smallest node that ``node`` reaches.

    Only nodes with a link to another node appear. Null or self links are ignored; an empty table gives
    an empty result. Each round replaces a node's links by links to its smallest neighbour; the number of rounds grows
    with the logarithm of the longest chain. The centre of a star holds as many links as its component has nodes: such nodes are
    counted map-side and joined by broadcast (``join_counted``), so their links are dealt with where they are read.
    """
    links = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = _state(links)
        if state == before or state[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = state
        # large star: every larger neighbour of u links to u's smallest neighbour (or u itself)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = saved(join_counted(both, least, ["a"], "n", 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .where("a <> b").distinct())
        # small star: u and its smaller neighbours link to the smallest of them
        floor = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_counted(large, floor, ["a"], "n", large.count()).select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        links = saved(small.where("a <> b").distinct())
