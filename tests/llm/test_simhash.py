import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import simhash as S
from fathom.llm.components import components


def _brute_fingerprint(spark, text, n=4):
    """Bit by bit, with Spark's own XXH64 (seed 42)."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [r[0] & ((1 << 64) - 1) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    out = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out - (1 << 64) if out >> 63 else out


@pytest.mark.parametrize("text", ["", "  \t", "One", "one TWO", "a b c d", "É Ünder a b c é É", "the cat sat on the mat and the cat sat on the hat " * 9, "x " * 70_000])
def test_fingerprint_is_the_majority_of_seeded_hashes(spark, text):
    if len(text) < 10_000:
        assert S.fingerprint(text) == _brute_fingerprint(spark, text)
    else:
        assert S.fingerprint(text) == S.fingerprint("x x x x")
    assert S.fingerprint(None) == 0


def _brute_components(fps, distance):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def _clustered(n, seed):
    rng, out = random.Random(seed), set()
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 60])):
            out.add(f - (1 << 64) if f >> 63 else f)
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                f ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("distance,crowd,blocks", [(4, 1 << 16, None), (4, 1 << 16, 7), (4, 5, None), (2, 8, 5), (3, 1 << 16, None)])
def test_links_connect_what_all_pairs_connect(spark, distance, crowd, blocks):
    fps = _clustered(400, distance + crowd)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = S.near_links(nodes, distance, crowd, blocks)
    for a, b in links.collect():
        assert bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2 * 64      # nodes of the table
    got = {r.node: r.label for r in components(links).collect()}
    assert {f: got.get(f, f) for f in fps} == _brute_components(fps, distance)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 90)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5), (None, 3), (2000, 1999)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(91)}, **{x: 1000 for x in range(1000, 1200)}, 2000: 1999, 1999: 1999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_and_what_stays(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word150 ", "other ")
    rows = [(7, base), (3, near), (9, base), (20, "something else entirely"), (21, None), (22, ""), (30, "\n"), (3, near), (40, "lone text here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own")).withColumn("component_id", F.lit(-1))
    groups = {(r.doc_id, r.component_id) for r in S.near_groups(docs).collect()}
    linked = bin((S.fingerprint(base) ^ S.fingerprint(near)) & ((1 << 64) - 1)).count("1") <= 4
    assert (9, 3 if linked else 7) in groups and {(21, 21), (22, 21), (30, 21), (20, 20)} <= groups
    out = S.drop_near(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in groups})


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_groups(none).count() == 0 and S.drop_near(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "quite another text of words")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in S.near_groups(rows).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
    assert S.drop_near(rows).count() == 2


def test_more_blocks_are_picked_as_the_table_grows():
    assert S.pick_blocks(10, 4) <= S.pick_blocks(10 ** 7, 4) <= S.pick_blocks(10 ** 10, 4)
    for b in (5, 6, 8):
        masks = S.block_masks(b, 4)
        rng = np.random.default_rng(b)
        for _ in range(50):
            diff = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            assert any(m & diff == 0 for m in masks)
