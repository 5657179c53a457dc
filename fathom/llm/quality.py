"""Quality rules: plain text statistics, and hashed word and character n-gram logistic regression.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, in order of a hash of the id) and calibrated
on a held-back fifth with the labels' true shares, so ``p_good`` is a probability. Every document is scored over
its whole text in Arrow batches, against thresholds that are constants. All n-grams of a text are hashed by array
operations on its code points; features are shares of the text's n-grams, so length does not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ship

MIN_WORDS = 20            # fewer words fail
MAX_REPEATED = 30         # percent of words in repeated windows; more fail
WINDOW = 8                # words
KEEP = 0.5                # documents with a lower probability of being good are rejected
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000        # at most half of them good, half not
BITS = 16                 # 2 ** BITS buckets for words and word pairs, as many for characters, pairs and triples
SCALE = 20.0              # shares of n-grams are small numbers: a weight acts on SCALE x share
PENALTY = 1e-4            # L2
ROUNDS = 150
RATE = 0.5

_SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\t-\r]+")
_P = np.uint64(0x9E3779B97F4A7C15)           # odd: has an inverse mod 2 ** 64
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class QualityModel:
    weights: np.ndarray       # 2 ** (BITS + 1) weights and the intercept
    slope: float = 1.0        # calibration: p_good = sigmoid(slope * score + shift)
    shift: float = 0.0

    def probability(self, score):
        return 0.5 * (1.0 + np.tanh(0.5 * (self.slope * np.asarray(score, float) + self.shift)))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Parsed:
    """A text as arrays: code points, where its words start and end, a 64-bit hash of each word."""
    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def parse(text: str) -> Parsed:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    black = np.zeros(len(c) + 2, np.int8)
    black[1:-1] = (c != 32) & ((c < 9) | (c > 13))
    turn = np.diff(black)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * _powers(_P, len(c)), dtype=np.uint64)])
    return Parsed(c, starts, ends, (sums[ends] - sums[starts]) * _powers(_P_INVERSE, len(c) + 1)[starts])


def repeated_words(text: str, p: Parsed) -> int:
    """Words in windows of ``WINDOW`` words that the text holds at least twice.

    Windows are compared by hash; only if two hashes agree are the words themselves compared.
    """
    n = len(p.hashes) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * _MIX + p.hashes[k:k + n]
    h.sort()
    if not (h[1:] == h[:-1]).any():
        return 0
    ids: dict[str, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in _WORD.findall(text)], np.int64)
    size = 1
    while size < WINDOW:        # equal numbers for equal runs of 2, 4, 8 words
        _, at = np.unique(at[:-size] * np.int64(len(p.hashes)) + at[size:], return_inverse=True)
        size *= 2
    starts = np.flatnonzero(np.bincount(at)[at] > 1)
    edge = np.bincount(starts, minlength=len(p.hashes) + 1) - np.bincount(starts + WINDOW, minlength=len(p.hashes) + 1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return n


def statistics(text: str, p: Parsed) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return len(p.starts), int((p.ends - p.starts).sum()), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(text, p)


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def buckets(p: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words and word pairs, and of its characters, pairs and triples; one per occurrence."""
    top = np.uint64(64 - BITS)
    words = np.concatenate([p.hashes, p.hashes[:-1] * _MIX + p.hashes[1:]]) if len(p.hashes) else p.hashes
    c, grams = p.points, []
    for order in (1, 2, 3):
        h = np.full(max(0, len(c) - order + 1), order, np.uint64)
        for k in range(order):
            h = h * np.uint64(0x100000001B3) + c[k:k + len(h)]
        grams.append(h)
    grams = np.concatenate(grams)
    return ((words * _MIX) >> top).astype(np.int64), ((grams * _P) >> top).astype(np.int64) + (1 << BITS)


def raw_score(p: Parsed, weights: np.ndarray) -> float:
    words, grams = buckets(p)
    return float(weights[-1] + sum(SCALE * weights[x].mean() for x in (words, grams) if len(x)))


def _sparse(p: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their values."""
    at, value = [], []
    for x in buckets(p):
        if len(x):
            k, n = np.unique(x, return_counts=True)
            at.append(k)
            value.append(SCALE * n / len(x))
    return (np.concatenate(at), np.concatenate(value)) if at else (np.zeros(0, np.int64), np.zeros(0))


def fit_logistic(rows: list, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights by full-batch gradient steps with a rate per weight (AdaGrad). ``rows``: (buckets, values); ``share``: weight of each row."""
    size = (1 << (BITS + 1)) + 1
    at = np.concatenate([np.r_[r[0], size - 1] for r in rows]).astype(np.int64)
    value = np.concatenate([np.r_[r[1], 1.0] for r in rows])
    lengths = np.array([len(r[0]) + 1 for r in rows])
    first, row = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(rows)), lengths)
    w, seen = np.zeros(size), np.full(size, 1e-12)
    for _ in range(ROUNDS):
        score = np.add.reduceat(w[at] * value, first)
        slope = share * (0.5 * (1.0 + np.tanh(0.5 * score)) - y)
        g = np.bincount(at, value * slope[row], size) + PENALTY * w
        seen += g * g
        w -= RATE * g / np.sqrt(seen)
    return w


def calibrate(score: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid with the least weighted log loss on held-back rows (smoothed targets, Newton steps)."""
    good, bad = share[y == 1].sum(), share[y == 0].sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y == 1, 1 - 1 / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    x, ab = np.stack([score, np.ones(len(score))], axis=1), np.array([1.0, 0.0])

    def loss(v):
        s = x @ v
        return float((share * (np.logaddexp(0, s) - target * s)).sum() + 1e-9 * (v @ v))

    for _ in range(60):
        p = 0.5 * (1.0 + np.tanh(0.5 * (x @ ab)))
        g = x.T @ (share * (p - target)) + 2e-9 * ab
        step = np.linalg.solve(x.T @ (x * (share * p * (1 - p))[:, None]) + 1e-9 * np.eye(2), g)
        size = 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
    return float(ab[0]), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """Fit on a bounded sample of the labelled documents; None if the labels do not hold both classes.

    Labels are 0 (bad) and above (good). Rows without an id, a label or a text teach nothing; a label repeated for an id counts as
    its largest value, and of texts that share an id the smallest teaches.
    """
    known = (labels.select(F.col(f"`{label_id}`").cast("string").alias("id"), (F.col(f"`{label}`") > 0).cast("int").alias("y"))
             .where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(total) < 2:
        return None
    pick, half = [F.xxhash64("id", F.lit(11)), F.col("id")], sample_rows // 2
    sample = known.where("y = 1").orderBy(*pick).limit(half).unionByName(known.where("y = 0").orderBy(*pick).limit(half))
    texts = (docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("body")).where("body IS NOT NULL")
             .join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("body").alias("body")))      # sample_rows ids at most

    def run(batches):
        for b in batches:
            made = [_sparse(parse(x.as_py())) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                                              pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))], ["id", "y", "at", "value"])

    got = texts.mapInArrow(run, "id string, y int, at array<int>, value array<float>").toArrow().sort_by("id").combine_chunks()
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    rows = [(at.values.to_numpy(), value.values.to_numpy()) for at, value in zip(got["at"], got["value"])]
    held = np.zeros(len(y), bool)
    for k in (0, 1):        # every fifth row of either class is held back
        held[np.flatnonzero(y == k)[4::5]] = True
    share = np.array([total[k] / sum(total.values()) / (y == k).sum() for k in (0, 1)])[y]
    w = fit_logistic([r for r, h in zip(rows, held) if not h], y[~held], share[~held] / share[~held].sum())
    scores = np.array([w[-1] + (w[r[0]] * r[1]).sum() for r, h in zip(rows, held) if h])
    return QualityModel(w, *calibrate(scores, y[held], share[held] / max(share[held].sum(), 1e-300)))


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"]


def judge(docs: DataFrame, model: QualityModel | None, columns: list, text: str = "text", keep: float = KEEP) -> DataFrame:
    """``columns`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, p_good, kept.

    kept is false where the base rules fail or p_good is below ``keep``. Null and empty texts have no words and fail;
    without a model p_good is null and the base rules decide. Repeated rows each get their row; ``columns`` are picked by
    the caller, so further columns of ``docs`` can have any name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)      # 2 ** (BITS + 1) + 1 weights
    source = docs.select(*columns, F.col(f"`{text}`").alias("__llm_text"))
    fields = source.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} long" for c in RESULT[:5]), "base_failed boolean, p_good double, kept boolean"])

    def run(batches):
        m = held.value
        for b in batches:
            out = []
            for x in b.column(b.num_columns - 1):
                body = x.as_py() or ""
                p = parse(body)
                stats = statistics(body, p)
                failed = fails(stats[0], stats[4])
                good = None if m is None or not stats[0] else float(m.probability(raw_score(p, m.weights)))
                out.append((*stats, failed, good, not failed and (good is None or good >= keep)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], [*b.schema.names[:-1], *RESULT])

    return source.mapInArrow(run, schema)


ship(__name__)
