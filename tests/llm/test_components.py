import random

import pytest
from pyspark.sql import functions as F

from fathom.llm.components import components


def labels(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    return {r["node"]: r["label"] for r in components(df).collect()}


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_random_links_against_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(600)] + [(None, 3), (5, None), (7, 7), (1, 2), (2, 1)]
    assert labels(spark, links) == plain(links)
    assert labels(spark, []) == {}


@pytest.mark.parametrize("centre", [-1, 30_000, 10 ** 6])
def test_stars(spark, centre):
    """Centre below, among and above its leaves, and a chain that hangs on one of them."""
    links = [(centre, i) for i in range(0, 60_000, 2)] + [(i, i + 1) for i in range(70_001, 70_020)] + [(70_001, 58)]
    got = labels(spark, links)
    assert set(got.values()) == {min(centre, 0)} and len(got) == len({x for e in links for x in e})


def test_no_task_holds_a_star(spark):
    """The rows that a join by node would send to one task: the links of a star's centre are matched where they are read."""
    from fathom.llm.common import join_counted, saved
    links = saved(spark.range(0, 1_000_000).select(F.lit(-1).cast("long").alias("a"), F.col("id").alias("b")).repartition(40))
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = saved(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    met = join_counted(both, degree, ["a"], "n", 2_000_000).where("a = -1").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = [r["n"] for r in met.collect()]
    assert sum(rows) == 1_000_000 and max(rows) <= 0.2 * 1_000_000
