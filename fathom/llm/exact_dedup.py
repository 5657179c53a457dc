"""Exact dedup: static binary-fuse filters over immutable snapshots screen the digests of a new batch.

1. Rows become (doc_id, SHA-256, second hash); equal rows are counted per digest with map-side
   combine, so a group of copies of any size is one row per task before the shuffle.
2. A snapshot never changes, so its distinct digests are frozen into 8-bit binary-fuse filters, one
   per digest bucket (the bucket count follows the number of digests, so one filter stays small). ``freeze``
   stores digests and filters in a folder; ``Snapshot`` opens it again for any number of later batches.
3. The distinct digests of the new batch are probed bucket by bucket. A negative is certainly new;
   its copies inside the batch are grouped separately. A positive joins the snapshot's exact bucket.
4. All groups of two or more rows are grouped once more by their bytes, so a group is never
   the work of a hash alone. Texts are combined where they are read, so copies in one task move as one
   text; a bitmap of fixed size over the repeated digests keeps nearly all other texts from moving.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import K1, K2, join_counted, keep_keyed, maybe_in, only, row_key, saved, ship
from fathom.session import scratch_path

DIGESTS_PER_BUCKET = 1 << 17
FILTER_SCHEMA = "bucket long, seed long, length long, segments long, slots binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64(seed)
    for shift, mul in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mul)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three slots per key, in three consecutive segments (the locality that makes the filter 'fuse')."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    inside = np.uint64(length - 1)
    return np.stack([first * np.uint64(length) + (h & inside),
                     (first + np.uint64(1)) * np.uint64(length) + ((h >> np.uint64(18)) & inside),
                     (first + np.uint64(2)) * np.uint64(length) + ((h >> np.uint64(36)) & inside)]).astype(np.int64)


def _mark(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, slots) of the distinct 64-bit ``keys``: about 9 bits a key, no false negative.

    Keys alone in a slot are peeled round by round; slots are then filled in the opposite order.
    A seed whose hypergraph does not peel is replaced by the next one.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    length = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, int(np.ceil(n * room / length)))
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        at = _slots(h, length, segments)
        size = (segments + 2) * length
        degree = np.bincount(at.ravel(), minlength=size)
        who = np.zeros(size, dtype=np.int64)      # xor of the keys in a slot: the key itself when it is alone
        for row in at:
            np.bitwise_xor.at(who, row, np.arange(n))
        alive, order, frontier = np.ones(n, bool), [], np.flatnonzero(degree == 1)
        while len(frontier):
            frontier = frontier[degree[frontier] == 1]
            key, first = np.unique(who[frontier], return_index=True)
            if not len(key):
                break
            order.append((key, frontier[first]))
            alive[key] = False
            gone = at[:, key].ravel()
            np.subtract.at(degree, gone, 1)
            np.bitwise_xor.at(who, gone, np.tile(key, 3))
            frontier = np.unique(gone[degree[gone] == 1])
        if alive.any():
            continue
        slots, mark = np.zeros(size, np.uint8), _mark(h)
        for key, slot in reversed(order):
            a = at[:, key]
            slots[slot] = mark[key] ^ slots[a[0]] ^ slots[a[1]] ^ slots[a[2]]
        return seed, length, segments, slots
    raise RuntimeError("no seed gave a binary-fuse filter")


def fuse_probe(keys: np.ndarray, seed: int, length: int, segments: int, slots: np.ndarray) -> np.ndarray:
    """True where a key may be in the filter (always for its own keys, for about 1 in 256 others)."""
    h = _mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 % (1 << 64))
    a = _slots(h, length, segments)
    return _mark(h) == (slots[a[0]] ^ slots[a[1]] ^ slots[a[2]])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, length, segments, slots = fuse_build(pdf["key"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "seed": [seed], "length": [length],
                         "segments": [segments], "slots": [slots.tobytes()]})


def _probe(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(batch) or not len(filters):
        return batch.iloc[:0][["digest"]]
    keys, f = batch["key"].to_numpy(np.int64).view(np.uint64), filters.iloc[0]
    hit = fuse_probe(keys, int(f["seed"]), int(f["length"]), int(f["segments"]), np.frombuffer(f["slots"], np.uint8))
    return batch.loc[hit, ["digest"]]


@dataclass
class Snapshot:
    """A frozen set of digests in a folder that driver and executors share: its distinct digests and a filter a bucket."""
    spark: SparkSession
    path: str

    @property
    def digests(self) -> DataFrame:
        return self.spark.read.schema("digest binary, key long, bucket long").parquet(f"{self.path}/digests")

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTER_SCHEMA).parquet(f"{self.path}/filters")

    @property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/size").head()["buckets"]

    def may_hold(self, digests: DataFrame) -> DataFrame:
        """The ``digest`` values (distinct) of a batch that the filters do not rule out: all that are in the snapshot, 1 in 256 others."""
        return (_bucketed(digests, self.buckets).groupBy("bucket").cogroup(self.filters.groupBy("bucket"))
                .applyInPandas(_probe, "digest binary"))

    def holds(self, digests: DataFrame) -> DataFrame:
        """The ``digest`` values (distinct) of a batch that are in the snapshot: those the filters let through, joined with the exact buckets."""
        return self.may_hold(digests).join(self.digests.select("digest"), "digest", "left_semi")


def freeze(digests: DataFrame, path: str | None = None, expected: int | None = None) -> Snapshot:
    """Store the distinct ``digest`` values and one filter per bucket under ``path`` (a scratch folder without one).

    The folder must not exist yet: a snapshot is never changed, a later one gets a folder of its own.
    """
    spark, path = digests.sparkSession, path or scratch_path(digests.sparkSession, "snapshot")
    distinct = digests.select("digest").distinct()
    buckets = max(1, -(-(distinct.count() if expected is None else expected) // DIGESTS_PER_BUCKET))
    _bucketed(distinct, buckets).write.parquet(f"{path}/digests")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/size")
    snapshot = Snapshot(spark, path)
    snapshot.digests.groupBy("bucket").applyInPandas(_build, FILTER_SCHEMA).write.parquet(f"{path}/filters")
    return snapshot


def _bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return digests.select("digest", key.alias("key"), F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(buckets)).alias("bucket"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def exact_groups(docs: DataFrame, is_new: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group equal texts of a snapshot (rows where ``is_new`` is not true) and a new batch.

    Returns one row per input row: doc_id, K1, K2 (identity), digest, keep_id, group_size, kept. Of equal texts the
    row with the largest doc_id stays (null ids are smallest); of rows that repeat an id too, one
    stays. Null counts as the empty text. An empty table gives an empty result. Only the two named columns are read,
    whatever the others are called; ``is_new`` speaks of them as doc_id and text.
    """
    docs = only(docs, doc_id, text).toDF("doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    rows = saved(docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), _digest(F.col("text")).alias("digest"),
                             F.xxhash64(body).alias("second"), F.coalesce(is_new, F.lit(False)).alias("new"))
                 .withColumn("uid", F.monotonically_increasing_id()))
    groups = saved(rows.groupBy("digest", "new").agg(F.count(F.lit(1)).alias("n")))
    total, old = groups.agg(F.sum("n"), F.count_if(~F.col("new"))).head()
    snapshot = freeze(groups.where("not new").select("digest"), expected=old)
    again = snapshot.holds(groups.where("new").select("digest"))
    repeated = saved(groups.where("n > 1").select("digest").unionByName(again).distinct())
    # byte check: the rows of repeated digests are grouped by their whole texts, combined where they are read
    members = docs.select(body.alias("body"), _digest(F.col("text")).alias("digest"))
    by_bytes = (maybe_in(members, repeated, "digest").where("__llm_maybe").groupBy("digest", "body").agg(F.count(F.lit(1)).alias("group_size"))
                .where("group_size > 1").select("digest", F.xxhash64("body").alias("second"), "group_size"))
    best = rows.groupBy("digest", "second").agg(F.max(F.struct("doc_id", "uid")).alias("best"))
    dim = saved(best.join(by_bytes, ["digest", "second"], "inner"))
    out = join_counted(rows, dim, ["digest", "second"], "group_size", total or 0)
    return out.select("doc_id", K1, K2, "digest",
                      F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      (F.col("best").isNull() | (F.col("best.uid") == F.col("uid"))).alias("kept"))


def in_new_batch(doc_id: Column) -> Column:
    """The split the query and the pipeline use: half of the rows are the snapshot, half arrive as the new batch."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2)) == 1


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its exact copies: of equal texts the row with the largest id stays, all columns as they were.

    Null counts as the empty text, null ids are smallest, of fully equal rows one stays; an empty table stays empty.
    Further columns may have any name.
    """
    groups = exact_groups(docs, in_new_batch(F.col("doc_id")), doc_id, text)
    keep = saved(groups.groupBy(K1, K2).agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept")).where("kept"))
    return keep_keyed(docs, keep, doc_id, text)


ship(__name__)
