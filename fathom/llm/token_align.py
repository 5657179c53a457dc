"""Cross-tokenizer alignment: byte-true groups and links between the tokens of two tokenizers.

A text's tokens are placed on its bytes; offsets where both tokenizers end a token cut them into groups. A
byte range of a document yields a *fragment*: an open prefix (tokens up to the first common end), closed
groups, an open suffix (tokens after the last common end). ``compose`` joins neighbouring fragments and is
associative, so a very long document is tokenised in ranges by many tasks and put together by a tree
of bounded steps. Ranges start where the tokenizer provably never joins the characters on both sides, each tokenizer at
its own places, so ids equal those of the whole text and what a range leaves open is closed by its neighbour.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import K1, K2, row_key, saved, ship

FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 1 << 15           # characters a range; longer documents are dealt out in ranges
FAN = 16                  # fragments composed by one step of the tree
HEAD = 1 << 18            # most frequent id pairs that every task holds (16 bytes each); the others are joined
# Fixed value: how the byte-level tokenizer cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Byte-level BPE from its JSON file; special tokens' strings are plain text."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, alphabet = spec["model"], byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        size = 1 + max(model["vocab"].values())
        self.bytes = [b""] * size
        for piece, k in model["vocab"].items():
            self.bytes[k] = bytes(alphabet[c] for c in piece) if piece not in special and all(c in alphabet for c in piece) else piece.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        base = min((model["vocab"][x + y] for x, y in merges), default=0)
        self.fast, self.slow, self.data = None, None, data
        if all(model["vocab"][x + y] == base + k for k, (x, y) in enumerate(merges)) and spec.get("normalizer") is None:
            import tiktoken      # the same merges in order of their ids, several times faster
            ranks = {b: k for k, b in enumerate(self.bytes) if k < base + len(merges)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as exc:      # its pattern matcher gives up on very long runs of white space
                if type(exc).__name__ != "PanicException":
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_str(self.data.decode())
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    @staticmethod
    def cut(text: str, low: int, at: int) -> int:
        """The last place in (low, at] where a space or line feed follows something else than white space; ``low`` if there is none."""
        while (at := max(text.rfind(" ", low + 1, at + 1), text.rfind("\n", low + 1, at + 1))) > low:
            if not text[at - 1].isspace():
                return at
            at -= 1
        return low

    def piece(self, text: str, low: int, high: int) -> list[int]:
        """Ids of the range [low, high) between two cuts of space + text."""
        return self.encode(" " * (low == 0) + text[low:high])


class PieceTokens:
    """SentencePiece BPE with byte fallback; it puts a space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        #: neighbouring characters of any piece: only these are ever joined
        self.inner = {p[k:k + 2].replace("▁", " ") for k_, p in enumerate(names) if not self.model.is_byte(k_) for k in range(len(p) - 1)}
        self.bare = not any("\n" in pair for pair in self.inner) and " \n" not in self.inner

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)

    def cut(self, text: str, low: int, at: int) -> int:
        """The last place in (low, at] between two characters that no piece holds side by side; ``low`` if there is none."""
        if not self.bare:
            return low
        while at > low and (text[at - 1:at + 1].replace("▁", " ") in self.inner):
            at -= 1
        return at

    def piece(self, text: str, low: int, high: int) -> list[int]:
        if low == 0:
            return self.encode(text[:high])
        # a line feed is never joined with anything: its tokens and those of the space put before it are taken off again
        head = self.model.encode("\n")
        return self.model.encode("\n" + text[low:high])[len(head):]


def _worker_cache() -> dict:
    """One dictionary a Python process (worker processes serve many tasks)."""
    return sys.modules.setdefault("_fathom_token_align", types.ModuleType("_fathom_token_align")).__dict__


class Pair:
    """Both tokenizers and what groups are written with; built once a process from the files' bytes."""

    def __init__(self, files: tuple[bytes, bytes]):
        self.a, self.b = ByteTokens(files[0]), PieceTokens(files[1])
        self.size_b = len(self.b.bytes)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        #: an id as it is written inside a group, and as the last of its side of a group
        self.written = [f"{k}{end}" for t, ends in ((self.a, ",|"), (self.b, ",;")) for end in ends for k in range(len(t.bytes))]

    @staticmethod
    def of(files: tuple[bytes, bytes]) -> Pair:
        cache, key = _worker_cache(), tuple(hashlib.sha256(f).digest() for f in files)
        if key not in cache:
            cache[key] = Pair(files)
        return cache[key]


def read_files(folder: str = FOLDER, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> tuple[bytes, bytes]:
    """Both vocabulary files' bytes (a few MB, whatever the corpus); read on the driver and broadcast."""
    out = []
    for name in (byte_file, piece_file):
        with open(f"{folder}/{name}", "rb") as f:
            out.append(f.read())
    return out[0], out[1]


# ---- fragments ----

EMPTY = np.zeros(0, np.int64)


@dataclass
class Tokens:
    """Neighbouring tokens of both sides with the byte offsets at which they end."""
    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([x, y]) for x, y in zip(self.parts(), other.parts())))

    def parts(self) -> tuple:
        return self.a, self.a_end, self.b, self.b_end

    def slice(self, i0, i1, j0, j1) -> Tokens:
        return Tokens(self.a[i0:i1], self.a_end[i0:i1], self.b[j0:j1], self.b_end[j0:j1])


NONE = Tokens(EMPTY, EMPTY, EMPTY, EMPTY)


@dataclass
class Closed:
    """What is kept of closed groups: their number, text, and links as distinct pair codes with their numbers."""
    n: int
    text: str
    pairs: np.ndarray
    times: np.ndarray

    def __add__(self, other: Closed) -> Closed:
        if not self.n or not other.n:
            return self if self.n else other
        pairs, at = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        times = np.bincount(at, np.concatenate([self.times, other.times]), len(pairs)).astype(np.int64)
        return Closed(self.n + other.n, f"{self.text};{other.text}", pairs, times)


NO_GROUPS = Closed(0, "", EMPTY, EMPTY)


@dataclass
class Fragment:
    whole: bool            # the tokens' bytes are the text's
    met: bool              # there is a common end; without one all tokens are in the prefix
    n_a: int
    n_b: int
    prefix: Tokens         # up to the first common end
    closed: Closed
    suffix: Tokens         # after the last common end


def _ends(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Common ends, and all ends once."""
    both = np.concatenate([t.a_end, t.b_end])
    both.sort(kind="stable")
    same = both[1:] == both[:-1]
    return both[1:][same], both[np.concatenate([[True], ~same])] if len(both) else both


def close(t: Tokens, pair: Pair) -> Closed:
    """Groups of tokens that end in a common end."""
    if not len(t.a):
        return NO_GROUPS
    common, ends = _ends(t)
    ga, gb = np.searchsorted(common, t.a_end), np.searchsorted(common, t.b_end)
    per_a, per_b = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
    order = np.empty(len(ga) + len(gb), np.int64)
    size_a = len(pair.a.bytes)
    order[np.arange(len(ga)) + (np.cumsum(per_b) - per_b)[ga]] = t.a + size_a * (t.a_end == common[ga])
    order[np.arange(len(gb)) + np.cumsum(per_a)[gb]] = 2 * size_a + t.b + pair.size_b * (t.b_end == common[gb])
    text = "".join(map(pair.written.__getitem__, order.tolist()))[:-1]
    # between two neighbouring ends lies one token of either side: one link
    links = t.a[np.searchsorted(t.a_end, ends)] * pair.size_b + t.b[np.searchsorted(t.b_end, ends)]
    pairs, times = np.unique(links, return_counts=True)
    return Closed(len(common), text, pairs, times)


def split(t: Tokens) -> tuple[Tokens, Tokens, Tokens, bool]:
    """Tokens up to the first common end, those up to the last one, the rest, and whether there is one."""
    common, _ = _ends(t)
    if not len(common):
        return t, NONE, NONE, False
    (i0, i1), (j0, j1) = (np.searchsorted(x, common[[0, -1]], side="right") for x in (t.a_end, t.b_end))
    return t.slice(0, i0, 0, j0), t.slice(i0, i1, j0, j1), t.slice(i1, None, j1, None), True


def fragment(t: Tokens, whole: bool, pair: Pair) -> Fragment:
    head, body, tail, met = split(t)
    return Fragment(whole, met, len(t.a), len(t.b), head, close(body, pair), tail)


def compose(x: Fragment, y: Fragment, pair: Pair) -> Fragment:
    """The fragment of two neighbouring ranges; associative, with the fragment of no tokens as its neutral element."""
    head, body, tail, met = split((x.suffix if x.met else x.prefix) + y.prefix)
    whole, n_a, n_b = x.whole and y.whole, x.n_a + y.n_a, x.n_b + y.n_b
    if x.met:
        # what starts after a common end is closed by the next one
        between = close(head + body, pair) if met else NO_GROUPS
        prefix, tail = x.prefix, tail if met else head
    else:
        between, prefix = close(body, pair), head
    suffix = y.suffix if y.met else tail
    return Fragment(whole, x.met or met, n_a, n_b, prefix, x.closed + between + y.closed if x.met else between + y.closed, suffix)


def range_tokens(text: str, ranges: tuple[int, int, int, int], at: tuple[int, int], pair: Pair) -> tuple[Tokens, bool]:
    """Tokens of one range of a text: characters [a0, a1) by A and [b0, b1) by B, which begin at the byte offsets ``at``."""
    sides, whole = [], True
    for tok, lengths, (low, high), start in zip((pair.a, pair.b), (pair.len_a, pair.len_b), (ranges[:2], ranges[2:]), at):
        ids = tok.piece(text, low, high) if high > low else []
        raw = (" " * (low == 0) + text[low:high]).encode() if high > low else b""
        whole &= b"".join(map(tok.bytes.__getitem__, ids)) == raw
        ids = np.array(ids, np.int64)
        sides += [ids, start + np.cumsum(lengths[ids])]
    return Tokens(*sides), whole


def finished(f: Fragment, pair: Pair) -> Closed | None:
    """All groups of a whole document (its start is a common end); None if a tokenizer did not give its bytes back."""
    return close(f.prefix, pair) + f.closed if f.whole and f.n_a else None


def cuts(text: str, pair: Pair, chunk: int):
    """Character places at which each tokenizer's ranges of a document begin, and its length: two lists of equal length."""
    nominal = range(chunk, len(text), chunk)
    out = []
    for tok in (pair.a, pair.b):
        places = [0]
        for at in nominal:
            low = max(places[-1], at - chunk)
            found = tok.cut(text, low, at)
            places.append(found if found > low else places[-1])      # no cut: the range joins the one before
        out.append([*places, len(text)])
    return out


# ---- the corpus ----

def _closed_columns(found: list) -> list:
    """Arrow columns n_groups, groups (hash of the text), pairs, times for a list of Closed or None."""
    return [pa.array([c.n if c else 0 for c in found], pa.int64()),
            pa.array([hashlib.sha256(c.text.encode()).hexdigest() if c else "" for c in found], pa.string()),
            _lists([c.pairs if c else EMPTY for c in found]), _lists([c.times if c else EMPTY for c in found])]


def _lists(arrays: list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([EMPTY, *arrays])))


RESULT = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
NAMES = ["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
OPEN = [f"{side}_{part}" for side in ("prefix", "suffix") for part in ("a", "a_end", "b", "b_end")]
FRAGMENT = f"{K1} long, {K2} long, k long, whole boolean, met boolean, n_a long, n_b long, n_groups long, closed string, pairs array<long>, times array<long>, " + ", ".join(f"{c} array<long>" for c in OPEN)


def _whole_documents(rows: DataFrame, held) -> DataFrame:
    """``rows`` (any columns, text last) with the results of texts that one task takes whole."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), RESULT])

    def run(batches):
        pair = Pair.of(held.value)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                found, n = [], []
                for x in b.column(b.num_columns - 1):
                    text = x.as_py()
                    closed = None
                    if text:
                        f = Fragment(*_one(text, pair))
                        closed = finished(f, pair)
                    found.append(closed)
                    n.append((f.n_a, f.n_b) if closed else (0, 0))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64()), *_closed_columns(found)],
                                                 [*b.schema.names[:-1], *NAMES])

    return rows.mapInArrow(run, schema)


def _one(text: str, pair: Pair) -> tuple:
    """A whole document as one fragment: all its groups are its prefix (the document's start closes them)."""
    t, whole = range_tokens(text, (0, len(text), 0, len(text)), (0, 0), pair)
    return whole, True, len(t.a), len(t.b), t if whole else NONE, NO_GROUPS, NONE


def _pack(key: list, f: Fragment) -> dict:
    return dict(zip([K1, K2, "k", "whole", "met", "n_a", "n_b", "n_groups", "closed", "pairs", "times", *OPEN],
                    [*key, f.whole, f.met, f.n_a, f.n_b, f.closed.n, f.closed.text, f.closed.pairs, f.closed.times, *f.prefix.parts(), *f.suffix.parts()]))


def _unpack(r: dict) -> Fragment:
    held = {c: np.array(r[c], np.int64) for c in ("pairs", "times", *OPEN)}
    return Fragment(r["whole"], r["met"], r["n_a"], r["n_b"], Tokens(*(held[c] for c in OPEN[:4])),
                    Closed(r["n_groups"], r["closed"], held["pairs"], held["times"]), Tokens(*(held[c] for c in OPEN[4:])))


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _fragment_schema() -> pa.Schema:
    lists = ["pairs", "times", *OPEN]
    return pa.schema([(K1, pa.int64()), (K2, pa.int64()), ("k", pa.int64()), ("whole", pa.bool_()), ("met", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                      ("n_groups", pa.int64()), ("closed", pa.string()), *((c, pa.list_(pa.int64())) for c in lists)])


def _long_documents(texts: DataFrame, held, chunk: int) -> DataFrame:
    """Results by (K1, K2) of documents longer than a range: ranges, their fragments, and a tree of ``FAN`` fragments a step."""
    spans = ["a0", "a1", "b0", "b1", "a_at", "b_at"]

    def deal(batches):
        pair = Pair.of(held.value)
        for b in batches:
            for k1, k2, x in zip(*b.columns):
                text = x.as_py()
                pa_, pb_ = cuts(text, pair, chunk)
                byte, done = [0, 0], [0, 0]
                for k in range(len(pa_) - 1):
                    low, high = min(pa_[k], pb_[k]), max(pa_[k + 1], pb_[k + 1])
                    for side, places in enumerate((pa_, pb_)):
                        byte[side] += len(text[done[side]:places[k]].encode()) + (done[side] == 0 < places[k])
                        done[side] = places[k]
                    row = [k1.as_py(), k2.as_py(), k, low, text[low:high], pa_[k], pa_[k + 1], pb_[k], pb_[k + 1], *byte]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], [K1, K2, "k", "low", "part", *spans])

    def fragments(batches):
        pair, schema = Pair.of(held.value), _fragment_schema()
        for b in batches:
            for r in b.to_pylist():
                low = r["low"]
                # a range that does not begin the document must not look as if it did
                text, shift = (r["part"], 0) if low == 0 else ("\n" + r["part"], low - 1)
                t, whole = range_tokens(text, tuple(r[c] - shift for c in spans[:4]), (r["a_at"], r["b_at"]), pair)
                yield from _arrow([_pack([r[K1], r[K2], r["k"]], fragment(t if whole else NONE, whole, pair))], schema).to_batches()

    def fold(rows: pa.Table) -> pa.Table:
        pair = Pair.of(held.value)
        parts = sorted(rows.to_pylist(), key=lambda r: r["k"])
        f = _unpack(parts[0])
        for r in parts[1:]:
            f = compose(f, _unpack(r), pair)
        return _arrow([_pack([parts[0][K1], parts[0][K2], parts[0]["k"] // FAN], f)], _fragment_schema())

    def finish(batches):
        pair = Pair.of(held.value)
        for b in batches:
            rows = b.to_pylist()
            found = [finished(_unpack(r), pair) for r in rows]
            n = [pa.array([r[c] if f else 0 for r, f in zip(rows, found)], pa.int64()) for c in ("n_a", "n_b")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *n, *_closed_columns(found)], [K1, K2, *NAMES])

    ranges = texts.mapInArrow(deal, f"{K1} long, {K2} long, k long, low long, part string, " + ", ".join(f"{c} long" for c in spans))
    level = saved(ranges.dropDuplicates([K1, K2, "k"]).mapInArrow(fragments, FRAGMENT))
    most = level.agg(F.max("k")).first()[0] or 0
    while most:
        level, most = level.groupBy(K1, K2, (F.col("k") / FAN).cast("long").alias("step")).applyInArrow(fold, FRAGMENT), most // FAN
    return level.mapInArrow(finish, f"{K1} long, {K2} long, {RESULT}")


def align(docs: DataFrame, files: tuple[bytes, bytes], columns: list, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """A saved table, a row per document: ``row`` (struct of ``columns``), K1, K2, n_a, n_b, n_groups, groups_sha256, pairs, times.

    pairs are the distinct codes (A id * size of B + B id) of the document's links, times how many links each has.
    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens (zeros, '').
    Repeated rows each get their row. ``columns`` are kept inside a struct, so their names clash with nothing.
    """
    held = docs.sparkSession.sparkContext.broadcast(files)
    body = F.col(f"`{text}`")
    rows = docs.select(F.struct(*columns).alias("row"), *row_key(F.col(f"`{doc_id}`").cast("string"), body), body.alias("body"))
    long = F.coalesce(F.length("body") > chunk, F.lit(False))
    short = _whole_documents(rows.where(~long), held)
    dealt = _long_documents(rows.where(long).select(K1, K2, "body"), held, chunk)
    return saved(short.unionByName(rows.where(long).select("row", K1, K2).join(dealt, [K1, K2])))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """A saved table of id pairs: pair, count (links of the corpus), best (no other A id has more links with its B id)."""
    counts = aligned.selectExpr("inline(arrays_zip(pairs, times))").groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    counts = saved(counts)
    most = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("most"))      # a row per B id: the vocabulary's size
    return saved(counts.withColumn("b", F.col("pair") % size_b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def _head(counts: DataFrame, head: int) -> tuple[tuple, float]:
    """Arrays (pair, count, best) of the most frequent pairs, at most ``head``, and the count class from which on they are taken."""
    step = F.floor(F.log2("count") * 8).cast("int")
    sizes = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}      # at most 8 * 64 classes
    total, least = 0, None
    for s in sorted(sizes, reverse=True):
        if total + sizes[s] > head:
            break
        total, least = total + sizes[s], s
    if least is None:
        return (EMPTY, EMPTY, np.zeros(0, bool)), float("inf")
    got = counts.where(step >= least).toArrow().sort_by("pair").combine_chunks()
    return (got["pair"].to_numpy(), got["count"].to_numpy(), got["best"].to_numpy()), least if total < sum(sizes.values()) else float("-inf")


def link_scores(aligned: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``row.*``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``aligned``.

    The ``head`` most frequent pairs are looked up in every task (their number is bounded); links of the other
    pairs, none of which can be hot, are joined with their counts.
    """
    frequent, least = _head(counts, head)
    held = aligned.sparkSession.sparkContext.broadcast(frequent)
    fields = aligned.select("row", K1, K2, "n_a", "n_b", "n_groups", "groups_sha256").schema.fields
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_links long, n_best long, count_sum long, rest array<long>, rest_times array<long>"])

    def run(batches):
        pair, count, best = held.value
        for b in batches:
            ends = b.column("pairs").offsets.to_numpy()
            codes, times = b.column("pairs").flatten().to_numpy(), b.column("times").flatten().to_numpy()
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(pair, codes), max(0, len(pair) - 1))
            known = pair[at] == codes if len(pair) else np.zeros(len(codes), bool)
            at, seen = at[known], times * known

            def per_row(values):
                total = np.concatenate([[0], np.cumsum(values)])
                return total[ends[1:]] - total[ends[:-1]]

            sums, bests = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
            sums[known], bests[known] = count[at] * seen[known], best[at] * seen[known]
            left = np.concatenate([[0], per_row(~known).cumsum()]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(v[~known])) for v in (codes, times)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(per_row(v).astype(np.int64)) for v in (times, bests, sums)), *rest],
                                             [*names, "n_links", "n_best", "count_sum", "rest", "rest_times"])

    scored = aligned.select(*names, "pairs", "times").mapInArrow(run, schema)
    if least > float("-inf"):
        scored = saved(scored)
        open_ = scored.where(F.size("rest") > 0).select(K1, K2, "rest", "rest_times").dropDuplicates([K1, K2])
        links = open_.selectExpr(K1, K2, "inline(arrays_zip(rest, rest_times))").withColumnRenamed("rest", "pair")
        more = links.join(counts, "pair").groupBy(K1, K2).agg(F.sum(F.col("rest_times") * F.col("count")).alias("more"),
                                                             F.sum(F.when(F.col("best"), F.col("rest_times")).otherwise(0)).alias("more_best"))
        scored = scored.join(more, [K1, K2], "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
                                                                  "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return scored.select("row.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def score_alignment(docs: DataFrame, columns: list, folder: str = FOLDER, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, head: int = HEAD) -> DataFrame:
    """Aligns every document, counts id pairs over the corpus, and scores each document's links by those counts."""
    files = read_files(folder)
    aligned = align(docs, files, columns, doc_id, text, chunk)
    return link_scores(aligned, pair_counts(aligned, Pair.of(files).size_b), head)


ship(__name__)
