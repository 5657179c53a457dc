"""SimHash near-dedup: 64-bit fingerprints of word shingles, pigeonhole blocks, Hamming check, components.

* Fingerprints are computed in Arrow batches, one text at a time, over the whole text.
* Equal fingerprints are one node (counted with map-side combine), whatever the number of copies.
* A fingerprint is cut into b blocks; two within d bits agree in at least b - d of them, so
  every choice of b - d blocks is one join key. b is picked from the number of fingerprints so that
  chance matches stay rare; every b finds exactly the same links.
* Rows of one key meet sorted in one partition. Fingerprints of a key are linked to the smallest of
  those they reach there (at most one link a row, not all pairs). A key over ``most_in_key``
  fingerprints is not brought together: its fingerprints meet on the vectors within d/2 bits of
  them instead (two fingerprints within d bits have such a vector in common).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import K1, K2, join_counted, keep_keyed, row_key, saved, ship
from fathom.llm.components import components

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
MOST_IN_KEY = 1 << 16
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one whole text; 0 if it has no word. Bit i is set if more than half the shingle hashes set it."""
    if text is None:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()     # bytes.split: ASCII whitespace only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, K1, K2, fp) per row."""
    def run(batches):
        for b in batches:
            fp = pa.array([fingerprint(x.as_py(), shingle) for x in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), fp], ["doc_id", K1, K2, "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_key(F.col(doc_id), F.col(text)), F.col(text).alias("body"))
    return source.mapInArrow(run, f"doc_id long, {K1} long, {K2} long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """The masks of all choices of ``blocks - distance`` of ``blocks`` near-equal bit blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(part[k] for k in choice) for choice in combinations(range(blocks), blocks - distance)]


def pick_blocks(n: int, distance: int) -> int:
    """The number of blocks with the least expected work: rows written, and chance partners compared, per fingerprint."""
    def work(b: int) -> float:
        keys = len(block_masks(b, distance))
        return keys * (200 + n / 2.0 ** (BITS * (b - distance) / b))
    return min(range(distance + 1, distance + 6), key=work)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _reach(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of one key the smallest one it reaches by steps of at most ``distance`` bits."""
    label, left = fps.copy(), np.arange(len(fps))
    while len(left):
        front, left, found = left[:1], left[1:], [left[:1]]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for f in front:
                near |= np.bitwise_count(fps[left] ^ fps[f]) <= distance
            front, left = left[near], left[~near]
            found.append(front)
        group = np.concatenate(found)
        label[group] = fps[group].view(np.int64).min().view(np.uint64)
    return label


def _links(key: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``key`` (rows sorted by key): small runs together, long ones one by one."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    short = np.repeat(size <= 32, size)
    for shift in range(1, int(min(32, size.max()))):
        same = (key[shift:] == key[:-shift]) & short[shift:]
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= distance]
        a.append(fps[i])
        b.append(fps[i + shift])
    for at, n in zip(starts[size > 32], size[size > 32]):
        run = fps[at:at + n]
        label = _reach(run, distance)
        a.append(run)
        b.append(label)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    keep = a != b
    return a[keep], b[keep]


def near_links(nodes: DataFrame, distance: int = DISTANCE, most_in_key: int = MOST_IN_KEY, blocks: int | None = None) -> DataFrame:
    """(fp) distinct -> (a, b) links whose components are those of all pairs within ``distance`` bits."""
    n = nodes.count()
    masks = block_masks(blocks or pick_blocks(n, distance), distance)
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.part", "fp")
    crowded = False
    if distance % 2 == 0:      # the midpoint links below need an even distance; an odd one keeps every key in one task
        hot = saved(rows.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_in_key))
        crowded = not hot.isEmpty()
    met = rows.join(hot, ["choice", "part"], "left_anti") if crowded else rows

    def run(batches):
        carry = None
        for b in batches:
            t = pa.Table.from_batches([b]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([b])])
            choice, part, fp = (t.column(c).to_numpy() for c in ("choice", "part", "fp"))
            if not len(fp):
                continue
            last = len(fp) - 1
            first = int(np.argmax((choice == choice[last]) & (part == part[last])))   # the last key may go on in the next batch
            carry = t.slice(first)
            if first:
                yield pack(choice[:first], part[:first], fp[:first])
        if carry is not None and carry.num_rows:
            yield pack(*(carry.column(c).to_numpy() for c in ("choice", "part", "fp")))

    def pack(choice, part, fp):
        key = np.cumsum(np.r_[0, (choice[1:] != choice[:-1]) | (part[1:] != part[:-1])])
        a, b = _links(key, fp.view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    links = met.repartition("choice", "part").sortWithinPartitions("choice", "part").mapInArrow(run, "a long, b long")
    if crowded:
        crowd = rows.join(hot, ["choice", "part"], "left_semi").select("fp").distinct()
        links = links.unionByName(_midpoint_links(crowd, distance))
    return links


def _midpoint_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links through the vectors within ``distance`` / 2 bits: linear in the number of fingerprints."""
    flips = [_signed(sum(1 << i for i in c)) for r in range(distance // 2 + 1) for c in combinations(range(BITS), r)]
    near = saved(nodes.select("fp", F.explode(F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: F.col("fp").bitwiseXOR(f))).alias("mid")))
    least = near.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return near.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
                most_in_key: int = MOST_IN_KEY) -> DataFrame:
    """One row per input row: doc_id, K1, K2, fp, label (smallest fingerprint of the component), component_id (smallest doc_id reachable by links within ``distance`` bits).

    Texts without words share fingerprint 0 and are linked like any others. Null ids are ignored
    as component ids unless a component has no other. Empty table: empty result.
    """
    rows = saved(fingerprints(docs, doc_id, text, shingle))
    nodes = saved(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    labels = components(near_links(nodes.select("fp"), distance, most_in_key)).select(F.col("node").alias("fp"), "label")
    named = saved(nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    dim = saved(named.join(ids, "label").select("fp", "n", "label", "component_id"))
    total = dim.agg(F.sum("n")).head()[0] or 0
    return join_counted(rows, dim, ["fp"], "n", total).select("doc_id", K1, K2, "fp", "label", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id (of equal ids, one of them)."""
    groups = near_groups(docs, doc_id, text, shingle, distance)
    chosen = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label", K1, K2)
              .agg(F.count(F.lit(1)).alias("n")))
    # an id may stand for several texts of a group: the smallest identity of them stays
    keep = saved(chosen.groupBy("label").agg(F.min(F.struct(K1, K2, "n")).alias("k")).select("k.*"))
    return keep_keyed(docs, keep, doc_id, text)


ship(__name__)
