"""Benchmark decontamination with a distributed positional inverted index.

1. Words of the test items are counted over the whole corpus (map-side sums).
2. Of each item the rarest terms are chosen so that every window holds ``RAREST`` of them. One pass over
   the corpus builds their postings: the index is sharded by document, one row a segment (at most
   ``SEGMENT_DOCS`` documents, about ``SEGMENT_WORDS`` words) with its postings (term, document, position) in term
   order, beside the documents' lengths. It is stored in the shared folder; building it moves no row.
3. Each segment meets the item offsets of its terms; position - offset is the diagonal of an
   occurrence. The offset-adjusted lists are intersected per (item, document): only where enough distinct
   offsets agree on a diagonal can a window occur.
4. Those diagonals are compared word by word while the segment's documents are at hand, so a phrase match is
   exact. Proximity matches are windows whose chosen terms all lie within ``slop`` positions of their places;
   words that the corpus lacks are never chosen, so such a window may hold some.

Test items are a stated query set. They are worked off in blocks of at most ``BLOCK_BYTES`` of text, so
what a task holds of them is bounded however large the benchmark is.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import K1, K2, row_key, saved, ship

WINDOW = 10
RAREST = 3
SLOP = 3
SEGMENT_DOCS = 512
SEGMENT_WORDS = 1 << 19
BLOCK_BYTES = 2 << 20
_WORD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32
              for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters (A-Z lower-cased) and of any non-ASCII characters; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_WORD).split()


def _blocks(items: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).head()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    return [items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k) for k in range(n)]


def _chosen(item: list[bytes], counts: dict, window: int, rarest: int, whole: bool = True) -> dict[int, list[int]]:
    """Window start -> offsets of its chosen terms, for the windows all of whose words occur in the corpus;
    if not ``whole``, for those with as many words that occur as are chosen.

    Offsets are taken from the rarest term up while a window that holds them still lacks some, so
    neighbouring windows share them and few postings are stored.
    """
    size = min(window, len(item))
    least = size if whole else min(rarest, size)
    starts = [s for s in range(len(item) - size + 1 if size else 0) if sum(counts.get(w, 0) > 0 for w in item[s:s + size]) >= least]
    lacks, taken = dict.fromkeys(starts, min(rarest, size)), []
    for q in sorted((q for q in range(len(item)) if counts.get(item[q])), key=lambda q: (counts[item[q]], q)):
        short = [s for s in range(max(0, q - size + 1), q + 1) if lacks.get(s)]
        if short:
            taken.append(q)
            for s in range(max(0, q - size + 1), q + 1):
                if s in lacks:
                    lacks[s] = max(0, lacks[s] - 1)
    return {s: sorted([q for q in taken if s <= q < s + size][:rarest]) for s in starts}


def _phrases(doc: list[bytes], item: list[bytes], diagonals: set[int], window: int) -> list[tuple[int, int]]:
    """Ranges of ``doc`` covered by windows of ``item`` along the given diagonals."""
    size, out = min(window, len(item)), []
    for d in diagonals:
        run = 0
        for q in range(max(0, -d), min(len(item), len(doc) - d)):
            run = run + 1 if doc[d + q] == item[q] else 0
            if run == size:
                out.append([d + q - size + 1, d + q + 1])
            elif run > size:
                out[-1][1] = d + q + 1
    return [tuple(r) for r in out]


def _near(pairs: list[tuple[int, int]], chosen: dict[int, list[int]], slop: int) -> bool:
    """True if some window has all its rarest offsets on diagonals at most ``slop`` apart."""
    at = defaultdict(set)
    for d, q in pairs:
        at[q].add(d)
    for offsets in chosen.values():
        if all(q in at for q in offsets):
            for low in set().union(*(at[q] for q in offsets)):
                if all(any(low <= d <= low + slop for d in at[q]) for q in offsets):
                    return True
    return False


def _intersect(term: np.ndarray, doc: np.ndarray, pos: np.ndarray, places: np.ndarray, need: np.ndarray, slop: int):
    """(item, doc, diagonal, offset) of the postings of a segment that may be part of a match.

    ``places``: (term, item, offset) by term; ``need``: distinct offsets a match of an item has at least. Kept
    are postings in a pair of neighbouring diagonal bands of width slop + 1 with so many distinct offsets.
    """
    low, high = np.searchsorted(places[:, 0], term, "left"), np.searchsorted(places[:, 0], term, "right")
    n = high - low
    post = np.repeat(np.arange(len(term)), n)
    place = np.arange(len(post)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    item, offset = places[place, 1], places[place, 2]
    pair, diag = item * SEGMENT_DOCS + doc[post], pos[post].astype(np.int64) - offset
    keep = np.zeros(len(post), bool)
    band = (diag + (1 << 31)) // (slop + 1)
    for shift in (0, 1):
        key = (pair << 32) + (band + shift) // 2      # bands 2k, 2k + 1 meet once, 2k - 1, 2k the other time
        order = np.lexsort((offset, key))
        k, o = key[order], offset[order]
        fresh = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
        group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
        enough = np.bincount(group, fresh)[group] >= need[item[order]]
        keep[order[enough]] = True
    return item[keep], doc[post][keep], diag[keep], offset[keep]


def _term_counts(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of a block of items occurs in the corpus (as many rows as the block has words)."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        seen = Counter()
        for b in batches:
            for body in b.column(0):
                seen.update(filter(held.value.__contains__, words(body.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    counted = docs.select(F.col(text).alias("body")).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r[0]): r[1] for r in counted.collect()}


def _block_matches(docs: DataFrame, block: DataFrame, doc_id: str, text: str, window: int, rarest: int, slop: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    items = [(r[0], w) for r in block.collect() if (w := words(r[1]))]       # at most BLOCK_BYTES and one item
    counts = _term_counts(docs, text, {w for _, item in items for w in item})
    chosen = [_chosen(item, counts, window, rarest, whole=False) | _chosen(item, counts, window, rarest) for _, item in items]
    terms: dict[bytes, int] = {}
    places = sorted((terms.setdefault(item[q], len(terms)), k, q) for k, (_, item) in enumerate(items) for q in {q for qs in chosen[k].values() for q in qs})
    need = [min(rarest, window, len(item)) for _, item in items]
    query = (terms, np.array(places, np.int64).reshape(-1, 3), np.array(need or [1], np.int64), items, chosen)
    index = build_index(docs, spark.sparkContext.broadcast(query), doc_id, text, window, slop)
    lengths = index.select(F.explode(F.arrays_zip("doc_id", "k1", "k2", "n_words")).alias("d"))
    lengths = lengths.select("d.doc_id", F.col("d.k1").alias(K1), F.col("d.k2").alias(K2), F.col("d.n_words").cast("long").alias("n_words"))
    return lengths, index.select(F.explode("matches").alias("m")).select("m.*")


_MATCH = pa.struct([(K1, pa.int64()), (K2, pa.int64()), ("ranges", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                    ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
_SEGMENT = ("k1 array<long>, k2 array<long>, doc_id array<long>, n_words array<int>, term array<int>, doc array<int>, pos array<int>, "
            f"matches array<struct<{K1}:long,{K2}:long,ranges:array<struct<s:long,e:long>>,items:array<string>,near:array<string>>>")


def build_index(docs: DataFrame, query, doc_id: str, text: str, window: int, slop: int) -> DataFrame:
    """The stored segments: per document k1, k2, doc_id, n_words; per posting term, doc (its place in the
    segment) and pos, by term; and the matches of the items in ``query`` (a broadcast of one block's terms,
    places, needs, words and chosen offsets)."""
    def segments(batches):
        held, size = [], 0
        for b in batches:
            for k1, k2, own, body in zip(*(b.column(c) for c in range(4))):
                doc = words(body.as_py())
                held.append((k1.as_py(), k2.as_py(), own.as_py(), doc))
                size += len(doc)
                if size >= SEGMENT_WORDS or len(held) >= SEGMENT_DOCS:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches):
        terms, places, need, items, chosen = query.value
        for held in segments(batches):
            term, doc, pos = [], [], []
            for i, (_, _, _, own) in enumerate(held):
                found = [(t, p) for p, t in enumerate(map(terms.get, own)) if t is not None]
                term += [t for t, _ in found]
                pos += [p for _, p in found]
                doc += [i] * len(found)
            order = np.argsort(np.array(term, np.int32), kind="stable")
            term, doc, pos = (np.array(x, np.int32)[order] for x in (term, doc, pos))
            met: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
            if len(term) and len(places):
                for item, own, d, q in zip(*(x.tolist() for x in _intersect(term, doc, pos, places, need, slop))):
                    met[own][item].add((d, q))
            matches = []
            for own, pairs in met.items():
                k1, k2, _, body = held[own]
                ranges, exact, near = [], set(), set()
                for k, seen in pairs.items():
                    agree = Counter(d for d, _ in seen)
                    if got := _phrases(body, items[k][1], {d for d, n in agree.items() if n >= need[k]}, window):
                        ranges += got
                        exact.add(items[k][0])
                    if _near(seen, chosen[k], slop):
                        near.add(items[k][0])
                if exact or near:
                    matches.append({K1: k1, K2: k2, "ranges": [{"s": s, "e": e} for s, e in ranges], "items": sorted(exact), "near": sorted(near)})
            own = [pa.array([[h[c] for h in held]], pa.list_(pa.int64())) for c in range(3)]
            posts = [pa.array([x], pa.list_(pa.int32())) for x in (term, doc, pos)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([[len(h[3]) for h in held]], pa.list_(pa.int32())), *posts, pa.array([matches], pa.list_(_MATCH))],
                                             ["k1", "k2", "doc_id", "n_words", "term", "doc", "pos", "matches"])

    source = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    return saved(source.mapInArrow(run, _SEGMENT))


def phrase_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, rarest: int = RAREST, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """(lengths, matches): n_words per input row, and per matching document its hit ranges, items and near items.

    lengths: doc_id, K1, K2, n_words. matches: K1, K2 (identity), n_hit, items and near_items (sorted
    distinct ids; a null id reads 'null'). Null texts have no words; an item without words has no window.
    Repeated rows count once each; an empty benchmark or corpus gives no match.
    """
    parts = [_block_matches(docs, b, doc_id, text, window, rarest, slop) for b in _blocks(items, item_id, item_text)]
    found = parts[0][1]
    for _, more in parts[1:]:
        found = found.unionByName(more)
    spots = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_set("ranges")), lambda r: F.sequence(r["s"], r["e"] - 1))))
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    matches = found.groupBy(K1, K2).agg(F.size(spots).cast("long").alias("n_hit"), ids("items").alias("items"), ids("near").alias("near_items"))
    return parts[0][0], matches


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, near_items, contaminated."""
    lengths, matches = phrase_matches(docs, items, **options)
    none = F.array().cast("array<string>")
    return lengths.join(matches, [K1, K2], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a whole window of a test item."""
    _, matches = phrase_matches(docs, items, doc_id, text, **options)
    hit = saved(matches.where("n_hit > 0").select(K1, K2))
    return docs.select("*", *row_key(F.col(doc_id), F.col(text))).join(hit, [K1, K2], "left_anti").select(*docs.columns)


ship(__name__)
