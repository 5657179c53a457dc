import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import exact_dedup as X
from fathom.llm import source_mix as M
from fathom.llm.common import join_counted, maybe_in

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 20000])
def test_binary_fuse_filter_has_no_false_negative_and_few_false_positives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    built = X.fuse_build(np.r_[keys, keys])
    assert X.fuse_probe(keys, *built).all() if n else True
    others = rng.integers(1 << 63, (1 << 64) - 1, 20000, dtype=np.uint64)
    assert X.fuse_probe(others, *built).mean() < 0.01
    if n >= 20000:
        assert len(built[3]) < 1.4 * n


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)


def test_exact_groups_against_a_dictionary(spark):
    rows = [(i, f"text {i % 40}", "s") for i in range(300)] + [(1000 + i, "same", "s") for i in range(200)]
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "x" * 300_000, "s"), (5003, "x" * 300_000, "s"), (None, "lonely", "s"), (None, "same", "s")]
    got = X.exact_groups(_rows(spark, rows), X.in_new_batch(F.col("doc_id"))).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    of = {i: groups[t or ""] for i, t, _ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            keep = max(x for x in of[r.doc_id] if x is not None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(of[r.doc_id]), r.doc_id == keep)
    assert sum(r.kept for r in got) == len(groups)


def test_rows_that_repeat_an_id_keep_one(spark):
    rows = [(1, "a", "s")] * 4 + [(1, "b", "s"), (2, "a", "t")]
    got = X.exact_groups(_rows(spark, rows), X.in_new_batch(F.col("doc_id"))).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, False)] * 4 + [(1, True), (2, True)]
    twice = _rows(spark, [(3, "z", "s")] * 3)
    assert sum(r.kept for r in X.exact_groups(twice, F.lit(None)).collect()) == 1
    assert X.drop_copies(twice).collect() == [(3, "z", None, "s", None)]


def test_drop_copies_keeps_columns_with_clashing_names(spark):
    docs = _rows(spark, [(1, "a", "s"), (2, "a", "s"), (3, None, "s"), (4, "", "s")])
    docs = docs.withColumn("digest", F.lit("own")).withColumn("kept", F.lit(7)).withColumn("n", F.col("doc_id"))
    out = X.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.digest, r.kept, r.n) for r in out.collect()) == [(2, "own", 7, 2), (4, "own", 7, 4)]


def test_a_stored_snapshot_serves_later_batches(spark, tmp_path):
    digest = lambda lo, hi: spark.range(lo, hi).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    X.freeze(digest(0, 5000).unionByName(digest(0, 100)), str(tmp_path / "snap"))
    written = {f: f.stat().st_mtime_ns for f in (tmp_path / "snap").rglob("*.parquet")}
    for lo, hi, n in ((4000, 6000, 1000), (9000, 9500, 0), (0, 0, 0), (0, 5000, 5000)):
        snapshot = X.Snapshot(spark, str(tmp_path / "snap"))        # opened again, nothing rebuilt
        batch = digest(lo, hi)
        assert {bytes(r[0]) for r in snapshot.holds(batch).collect()} == {bytes(r[0]) for r in batch.intersect(digest(0, 5000)).collect()}
        assert n <= snapshot.may_hold(batch).count() <= n + max(40, (hi - lo) // 50)
    assert written == {f: f.stat().st_mtime_ns for f in (tmp_path / "snap").rglob("*.parquet")}


def test_bitmap_lets_all_repeated_texts_through(spark):
    digest = F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest")
    members = spark.range(20000).select(digest, "id")
    got = {r.id for r in maybe_in(members, spark.range(300).select(digest), "digest").where("__llm_maybe").collect()}
    assert got >= set(range(300)) and len(got) < 400
    assert maybe_in(members, spark.range(0).select(digest), "digest").where("__llm_maybe").isEmpty()


def test_columns_with_odd_names(spark):
    docs = spark.createDataFrame([(1, "a", "u", 5, 6, 7), (2, "a", "v", 5, 6, 8)], ["doc_id", "text", "meta.url", "__llm_k1", "TEXT", "a`b"])
    out = X.drop_copies(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "a", "v", 5, 6, 8)]
    assert X.drop_copies(docs.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == 1


def test_empty_tables(spark):
    none = _rows(spark, [])
    assert X.exact_groups(none, X.in_new_batch(F.col("doc_id"))).count() == 0
    assert X.drop_copies(none).count() == 0
    assert M.mix(none).count() == 0
    assert M.emit(none).count() == 0


def test_join_counted_gives_the_plain_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    dim = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 2 = 0")
    got = sorted(map(tuple, join_counted(rows, dim, ["k"], "n", 3000).select("k", "id", "n").collect()), key=str)
    assert got == sorted(map(tuple, rows.join(dim, "k", "left").select("k", "id", "n").collect()), key=str)


def _water(sizes, weights=(5, 2, 1)):
    """Targets by giving the excess away again and again, in floating point."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    while len(out) < len(names):
        free = [s for s in names if s not in out]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            out |= share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
    return out


def test_mix_targets_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "B", "é", None, "zz", "hot", "hot", "hot"][i % 8]) for i in range(4000)]
    rows += [(9000, None, "a"), (9001, "", "empty"), (9002, "\t one two \n three\x0b", "zz"), (None, "x y", "a")]
    docs = _rows(spark, rows)
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    assert {r.doc_id: r.size for r in got}[9002] == 2 and {r.doc_id: r.size for r in got}[9000] == 0
    want, taken = _water(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert t == pytest.approx(want[s], rel=0.12), s
    assert sorted(map(str, M.mix(docs).collect())) == sorted(map(str, got))
    copies = {r.doc_id: r.copies for r in got}
    emitted = M.emit(docs.withColumn("copies", F.lit(1)))
    assert emitted.columns == [*docs.columns, "copies", "copy_no"]
    assert {r[0]: r[1] for r in emitted.groupBy("doc_id").count().collect()} == {d: c for d, c in copies.items() if c}


def test_mix_of_texts_without_words(spark):
    got = M.mix(_rows(spark, [(1, None, "a"), (2, "  ", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_ranks_over_many_sources(spark):
    sources = spark.range(500).select(F.concat(F.lit("s"), F.col("id")).alias("source")).union(spark.sql("select cast(null as string)"))
    got = {r.source: r["rank"] for r in M._ranked(sources).collect()}
    names = sorted((s for s in got if s is not None)) + [None]
    assert got == {s: k for k, s in enumerate(names)}
