"""Remove every byte covered by a string of ``length`` bytes that also starts elsewhere in the corpus.

A string of ``length`` bytes starting at p has an anchor: the position of the smallest hashed gram among its
first ``width`` starts. The anchor depends on the string's bytes only, so equal strings have their anchors at
equal offsets, and the ``length - width + 1`` bytes from the anchor on are equal too: their hash is the key
under which strings that can be equal meet. Starts that share an anchor form one context (the bytes of
all their strings).

1. Anchors of all documents, one pass; a table of a few whole numbers per anchor.
2. Contexts are counted per (key, context hash) with map-side combine: a context that occurs twice is covered
   whole, and thousands of copies are one row. Keys with one context are done.
3. The contexts of the other keys are read from the documents and meet by key. Their parts left and right of
   the common bytes are cut to what any other context shares; equal remainders are counted again.
4. What still differs is written into one text a bucket, the common bytes as one symbol, and sorted by
   ``suffix_array`` (linear grouping construction): a start whose neighbour in suffix order shares
   ``width`` symbols is a repeated string.
5. Spans go back to their documents, where the bytes are removed.

A key with more than ``crowd`` contexts is not brought together in one task: its strings meet one by
one, on a 128-bit hash of the whole string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import K1, K2, join_counted, maybe_in, only, row_key, saved, ship

LENGTH = 400
CROWD = 1 << 16
BUCKET = 1 << 15          # symbols sorted together
CHUNK = 1 << 20           # bytes hashed together
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def widths(length: int) -> tuple[int, int]:
    """(anchor window, gram): powers of two with window + gram - 1 <= length."""
    width = 1 << max(0, int(np.log2(max(1, length * 0.65))))
    return width, 1 << min(4, int(np.log2(max(1, length - width + 1))))


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text`` (whole numbers >= 1) by linear grouping.

    Suffixes are grouped by Lyndon prefix. Groups are taken in descending order; when a group is taken
    its prefix is final, and each of its suffixes hands it on to the previous smaller suffix, whose own
    prefix grows by it: such suffixes move to a new group right above the one they were in, further up
    the more copies of the prefix they take. The sorted groups are then filled front to back: a
    suffix just placed settles the suffixes whose next smaller suffix it is.
    """
    s = text + [0]
    n = len(s)
    symbols = sorted(set(s))
    members: list[list[int]] = [[] for _ in symbols]
    first = {c: g for g, c in enumerate(symbols)}
    group = [first[c] for c in s]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    smaller, taken = [-1] * n, bytearray(n)
    order, g = [], len(symbols) - 1
    while g >= 0:
        own = sorted(i for i in members[g] if group[i] == g)
        members[g] = own
        order.append(g)
        heirs: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and (taken[p] or group[p] == g):
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                heirs[p] = heirs.get(p, 0) + 1
        for i in own:
            taken[i] = 1
        if heirs:
            copies: dict[int, list[int]] = {}
            for p, k in heirs.items():
                copies.setdefault(k, []).append(p)
            for k in sorted(copies, reverse=True):
                made: dict[int, int] = {}
                for p in copies[k]:
                    h = group[p]
                    if h not in made:
                        up = above[h]
                        made[h] = len(members)
                        below.append(h)
                        above.append(up)
                        above[h] = made[h]
                        if up >= 0:
                            below[up] = made[h]
                        members.append([])
                    group[p] = made[h]
                    members[made[h]].append(p)
        g = below[g]
    start, at = [0] * len(members), 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out, placed = [-1] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    start[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out[1:]


def shares(text: list[int], order: list[int], least: int) -> np.ndarray:
    """For each position: does a neighbour in suffix order share at least ``least`` symbols with it?"""
    n = len(text)
    t, sa = np.array(text, np.int64), np.array(order, np.int64)
    # equal windows are neighbours: compare a hash of the window, then the window itself
    out = np.zeros(n, bool)
    fits = sa + least <= n
    same = fits[1:] & fits[:-1]
    cand = np.flatnonzero(same)
    for k in range(0, least):
        if not len(cand):
            break
        cand = cand[t[sa[cand] + k] == t[sa[cand + 1] + k]]
    out[sa[cand]] = True
    out[sa[cand + 1]] = True
    return out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of all contexts of the texts data[starts:ends], as positions in ``data``."""
    width, gram = widths(length)
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD[0])
    size, k = 1, 1
    while size < gram:
        h = h[:-size] * np.uint64(_ODD[k]) + h[size:]
        size, k = 2 * size, k + 1
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[5])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    size = 1
    while size < width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    valid = np.zeros(len(low) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(valid[:-1]))
    at = (np.uint64(0xFFFFFFFF) - (low[p] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return at[edge], p[edge], p[np.r_[edge[1:] - 1, len(p) - 1]] if len(p) else p


def _anchor_rows(length: int):
    """K1, K2, text -> one row per context: its anchor and starts in the document, its key and its hash."""
    width, _ = widths(length)
    common = length - width + 1

    def chunks(batch):
        held, size = [], 0
        for i, x in enumerate(batch.column(2)):
            body = x.as_py()
            if body is not None and len(raw := body.encode("utf-8", "surrogatepass")) >= length:
                held.append((i, raw))
                size += len(raw)
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches):
        for b in batches:
            k1, k2 = (b.column(c).to_numpy() for c in (0, 1))
            for held in chunks(b):
                raw = b"".join(x for _, x in held)
                sizes = np.array([len(x) for _, x in held])
                ends = np.cumsum(sizes)
                a, first, last = anchors(np.frombuffer(raw, np.uint8), ends - sizes, ends, length)
                doc = np.searchsorted(ends, a, "right")
                key = [xxhash.xxh3_64_intdigest(raw[x:x + common]) for x in a.tolist()]
                whole = [xxhash.xxh64_intdigest(raw[f:e], h) for f, e, h in zip(first.tolist(), (last + length).tolist(), (a - first).tolist())]
                row, at = np.array([i for i, _ in held])[doc], (ends - sizes)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row], k2[row], np.array(key, np.uint64).view(np.int64), np.array(whole, np.uint64).view(np.int64),
                                                                        a - at, first - at, last - at)], [K1, K2, "key", "ctx", "a", "first", "last"])
    return run


_ROW = f"{K1} long, {K2} long, key long, ctx long, a long, first long, last long"


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _most_shared(parts: list[bytes]) -> list[int]:
    """For each string the longest beginning it shares with any other (neighbours in sorted order)."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    near = [_common(parts[a], parts[b]) for a, b in zip(order, order[1:])]
    out = [0] * len(parts)
    for k, i in enumerate(order):
        out[i] = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
    return out


class _Bucket:
    """Remainders of many keys, sorted together; gives (row, smallest, largest) offsets of repeated starts."""

    def __init__(self, length: int, width: int):
        self.length, self.width, self.common = length, width, length - width + 1
        self.clear()

    def clear(self):
        self.text: list[int] = []
        self.parts: list[tuple] = []
        self.keys = 0

    def add(self, members: list[tuple]) -> list[tuple]:
        """``members``: (row, left reversed, right, n) of one key. Returns what needs no sorting."""
        lefts, rights = _most_shared([m[1] for m in members]), _most_shared([m[2] for m in members])
        remain: dict[tuple, list] = {}
        for (row, left, right, n), shared_left, shared_right in zip(members, lefts, rights):
            high, low = shared_left, self.length - self.common - shared_right
            low = max(low, self.length - self.common - len(right))
            if low <= high:
                remain.setdefault((left[:high], right[:self.length - self.common - max(low, 0)]), []).append((row, n))
        done = []
        loose = [(k, rows) for k, rows in remain.items()]
        if len(loose) == 1 and len(loose[0][1]) == 1:
            return done
        self.keys += 1
        for (left, right), rows in loose:
            low, high = self.length - self.common - len(right), len(left)
            if len(rows) > 1 or rows[0][1] > 1:     # equal remainders repeat each other; they stay in the text as partners
                done += [(row, low, high) for row, n in rows if n == 1]
                rows = []
            if len(loose) > 1:
                at = len(self.text)
                self.text += [c + 2 for c in left[::-1]] + [257 + self.keys] + [c + 2 for c in right] + [1]
                self.parts.append((at, low, high, rows))
        return done

    def sort(self) -> list[tuple]:
        out = []
        if any(rows for *_, rows in self.parts):
            hit = shares(self.text, suffix_array(self.text), self.width)
            for at, low, high, rows in self.parts:
                if rows:
                    offsets = high - np.flatnonzero(hit[at:at + high - low + 1])
                    if len(offsets):
                        out.append((rows[0][0], int(offsets.min()), int(offsets.max())))
        self.clear()
        return out


def _resolve(length: int):
    """Rows of contexts sorted by key -> covered spans K1, K2, s, e."""
    width, _ = widths(length)

    def run(batches):
        bucket, key, members, at = _Bucket(length, width), None, [], {}
        spans: list[tuple] = []

        def emit(found):
            for row, low, high in found:
                k1, k2, a = at[row]
                spans.append((k1, k2, a - high, a - low + length))

        def close():
            if len(members) > 1:
                emit(bucket.add(members))
                if len(bucket.text) >= BUCKET:
                    emit(bucket.sort())
                    at.clear()

        serial = 0
        for b in batches:
            for k1, k2, k, a, n, left, right in zip(*(b.column(c).to_pylist() for c in range(7))):
                if k != key:
                    close()
                    key, members = k, []
                at[serial] = (k1, k2, a)
                members.append((serial, left, right, n))
                serial += 1
            if spans:
                yield pack(spans)
                spans.clear()
        close()
        emit(bucket.sort())
        if spans:
            yield pack(spans)

    def pack(spans):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*spans)], [K1, K2, "s", "e"])

    return run


def _cut(length: int):
    """Documents with their open contexts -> K1, K2, key, a, n, left (reversed), right."""
    width, _ = widths(length)
    common = length - width + 1

    def run(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for k1, k2, body, contexts in zip(*(b.column(c).to_pylist() for c in range(4))):
                raw = body.encode("utf-8", "surrogatepass")
                for c in contexts:
                    a = c["a"]
                    for o, x in zip(out, (k1, k2, c["key"], a, c["n"], raw[c["first"]:a][::-1], raw[a + common:c["last"] + length])):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64() if i < 5 else pa.binary()) for i, o in enumerate(out)], [K1, K2, "key", "a", "n", "left", "right"])
    return run


def _strings(length: int):
    """Contexts of crowded keys -> one row per string: key, offset, two hashes, K1, K2, p, n."""
    width, _ = widths(length)
    common = length - width + 1

    def run(batches):
        for b in batches:
            for k1, k2, key, a, n, left, right in zip(*(b.column(c).to_pylist() for c in range(7))):
                rows = []
                for d in range(length - common - len(right), len(left) + 1):
                    h = xxhash.xxh3_128_intdigest(b"%d:" % d + left[:d] + b"|" + right[:length - common - d])
                    rows.append((key, xxhash.xxh64_intdigest(h.to_bytes(16, "big"), key & 0xFFFFFFFF) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), k1, k2, a - d, n))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["key", "h1", "h2", K1, K2, "p", "n"])
    return run


def covered(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(K1, K2, spans): byte ranges (s, e) that strings occurring elsewhere cover; they may overlap. Only documents that have some."""
    source = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(text).alias("body"))
    rows = saved(source.mapInArrow(_anchor_rows(length), _ROW))
    contexts = saved(rows.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in (K1, K2, "a", "first", "last")]))
    total = contexts.agg(F.sum("n")).head()[0] or 0
    keys = saved(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    twice = contexts.where("n > 1").select("key", "ctx", "n")
    whole = join_counted(rows, twice, ["key", "ctx"], "n", total).where("n IS NOT NULL").select(K1, K2, F.col("first").alias("s"), (F.col("last") + length).alias("e"))
    open_ = contexts.join(keys, "key").groupBy(K1, K2).agg(F.collect_list(F.struct("key", "a", "first", "last", "n")).alias("contexts"))
    # rows that repeat an id and a text would give their contexts twice
    texts = source.join(open_, [K1, K2]).dropDuplicates([K1, K2]).select(K1, K2, "body", "contexts")
    parts = texts.mapInArrow(_cut(length), f"{K1} long, {K2} long, key long, a long, n long, left binary, right binary")
    crowded = keys.where(F.col("m") > crowd)
    if crowded.isEmpty():
        met = parts
    else:
        parts = saved(parts)
        met = parts.join(crowded.select("key"), "key", "left_anti").select(parts.columns)
        many = parts.join(crowded.select("key"), "key", "left_semi").select(parts.columns)
        strings = saved(many.mapInArrow(_strings(length), f"key long, h1 long, h2 long, {K1} long, {K2} long, p long, n long"))
        again = strings.groupBy("key", "h1", "h2").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).where("all > 1")
        hit = join_counted(strings.drop("n"), saved(again), ["key", "h1", "h2"], "k", strings.count()).where("all IS NOT NULL")
        whole = whole.unionByName(hit.select(K1, K2, F.col("p").alias("s"), (F.col("p") + length).alias("e")))
    sorted_ = met.repartition("key").sortWithinPartitions("key").mapInArrow(_resolve(length), f"{K1} long, {K2} long, s long, e long")
    return saved(whole.unionByName(sorted_).groupBy(K1, K2).agg(F.collect_set(F.struct("s", "e")).alias("spans")))


def merged(spans: list) -> list[list[int]]:
    """Maximal runs of the union of (s, e) ranges."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    Texts are UTF-8 bytes; null is empty. Every occurrence goes, the first too. Rows that repeat an id and a text
    are each other's repeats. Texts shorter than ``length`` keep all bytes. Ids may be of any type; further columns of
    any name are not read.
    """
    docs = only(docs, doc_id, text).toDF("doc_id", "text")
    spans = covered(docs, length, crowd=crowd).select(K1, K2, F.col("spans").alias("__llm_spans"))
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.col("text").alias("body"))
    # documents without spans are finished where they are read; only the others are moved to their spans
    rows = maybe_in(rows, spans, K1)
    met = rows.where("__llm_maybe").join(spans, [K1, K2], "left")
    rows = met.unionByName(rows.where("NOT __llm_maybe"), allowMissingColumns=True)

    def run(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for own, body, found in zip(*(b.column(c).to_pylist() for c in range(3))):
                raw = (body or "").encode("utf-8", "surrogatepass")
                gone, kept, at = merged(found), [], 0
                for s, e in gone:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                for o, x in zip(out, (own, len(raw), len(raw) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest())):
                    o.append(x)
            kinds = (*[pa.int64()] * 3, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, t) for o, t in zip(out[1:], kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.select("doc_id", "body", "__llm_spans").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


ship(__name__)
