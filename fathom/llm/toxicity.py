"""Toxicity: cumulative-link (proportional odds) regression on sparse word features.

P(grade >= k) = sigmoid(w.x - t_k): one weight vector shared by ordered thresholds t_1 < t_2 < ...
Features are the distinct words of a text and their beginnings. The model is fitted on a bounded
sample of labelled rows (``SAMPLE_ROWS``, in order of a hash of the id); every document is scored over its
whole text. The output is the expected severity, sum over k of P(grade >= k).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ship

SAMPLE_ROWS = 3000        # at most half of them flagged, half not
BEGINNINGS = (3, 4, 5)    # characters of a word's beginning that count as a feature
MIN_ROWS = 3              # a feature must occur in so many graded rows of the sample
MIN_SHARE = 0.01          # and in so large a share of them
LIFT = 5.0                # and in a share of them at least so many times that among the clean rows
MAX_FEATURES = 300        # the size of the model: the features that tell the classes apart best
PENALTY = 3.0             # L2
ROUNDS = 15
FALSE_ALARM = 5.0         # cost of rejecting a clean sample row, in missed flagged rows, when the cut is placed
GRADES = 2                # grades of flagged rows when the labels are only a flag
_WORD = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalpha()})


@dataclass
class SeverityModel:
    weights: dict
    thresholds: list
    cut: float = 0.5          # a document is rejected if P(grade >= 1) is at least this

    def known(self, word: str) -> tuple:
        """The features of a word that carry weight."""
        return tuple(f for f in features(word) if f in self.weights)

    def score(self, row: set, known=None) -> float:
        """w.x of a text's distinct words; a feature counts once."""
        return sum(self.weights[f] for f in {f for w in row for f in (known or self.known)(w)})


def words(text: str | None) -> set[str]:
    """Distinct lower-cased words (runs of characters other than ASCII non-letters); null has none."""
    return set() if text is None else set(text.lower().translate(_WORD).split())


def features(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, float)))


def severity_grades(rows: list, flags: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades 0..grades from a 0/1 flag: flagged rows are split evenly by their share of words that only flagged rows use."""
    bad: dict[str, int] = {}
    good: dict[str, int] = {}
    for row, flag in zip(rows, flags):
        seen = bad if flag else good
        for w in row:
            seen[w] = seen.get(w, 0) + 1
    n_bad, n_good = max(1, int(flags.sum())), max(1, int((flags == 0).sum()))
    owned = {w for w, k in bad.items() if k >= MIN_ROWS and (k + 0.5) / n_bad > 20 * (good.get(w, 0) + 0.5) / n_good}
    share = np.array([sum(w in owned for w in row) / max(1, len(row)) for row in rows])
    cuts = np.quantile(share[flags == 1], np.arange(1, grades) / grades) if flags.any() else []
    return np.where(flags == 1, 1 + np.searchsorted(cuts, share, side="left"), 0)


def fit_ordinal(rows: list, grades: np.ndarray) -> SeverityModel:
    """Penalised Newton steps on the shared weights, each followed by gradient steps on the ordered thresholds.

    With a = x.w - t_y and b = x.w - t_(y+1), -log(sigmoid(a) - sigmoid(b)) has slope sigmoid(a) + sigmoid(b) - 1
    and curvature sigmoid'(a) + sigmoid'(b) in x.w.
    """
    top = int(grades.max()) if len(grades) else 0
    if not top or not (grades == 0).any():
        return SeverityModel({}, [0.0 if top else 30.0])
    df: tuple = ({}, {})
    for row, g in zip(rows, grades):
        held = df[min(g, 1)]
        for f in {f for w in row for f in features(w)}:
            held[f] = held.get(f, 0) + 1
    n_bad, n_good = int((grades > 0).sum()), int((grades == 0).sum())
    telling = [f for f, k in df[1].items() if k >= max(MIN_ROWS, MIN_SHARE * n_bad) and k / n_bad >= LIFT * (df[0].get(f, 0) + 1) / n_good]
    def gain(f: str) -> float:      # log-likelihood ratio of the feature's rate among graded and clean rows
        k, m = df[1][f], df[0].get(f, 0)
        both = (k + m) / (n_bad + n_good)
        return k * np.log(k / n_bad / both) + (m * np.log(m / n_good / both) if m else 0.0)

    telling = sorted(sorted(telling, key=lambda f: (-gain(f), f))[:MAX_FEATURES])
    code = {f: k for k, f in enumerate(telling)}
    n, y = len(rows), grades.astype(int)
    x = np.zeros((n, len(code)))
    for i, row in enumerate(rows):
        x[i, [code[f] for w in row for f in features(w) if f in code]] = 1.0
    cum = np.clip([(y >= k).mean() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    w, t, i = np.zeros(len(code)), -np.log(cum / (1 - cum)), np.arange(n)

    def above(s):       # P(grade >= k), k = 0 .. top + 1
        return np.concatenate([np.ones((1, n)), _sigmoid(s - t[:, None]), np.zeros((1, n))])

    for _ in range(ROUNDS):
        s = x @ w
        for _ in range(30):
            q = above(s)
            p = np.maximum(q[y, i] - q[y + 1, i], 1e-9)
            lower, upper = q[y, i] * (1 - q[y, i]) / p, q[y + 1, i] * (1 - q[y + 1, i]) / p
            t = np.maximum.accumulate(t - np.array([(lower[y == k].sum() - upper[y == k - 1].sum()) / n for k in range(1, top + 1)]))
        q = above(s)
        a, b = q[y, i], q[y + 1, i]
        slope = x.T @ (a + b - 1) + PENALTY * w
        bend = (x * (a * (1 - a) + b * (1 - b))[:, None]).T @ x + PENALTY * np.eye(len(code))
        w = w - np.clip(np.linalg.solve(bend, slope), -2.0, 2.0)
    return SeverityModel({f: float(w[k]) for f, k in code.items() if w[k]}, [float(x) for x in t], place_cut(_sigmoid(x @ w - t[0]), y > 0))


def place_cut(p: np.ndarray, flagged: np.ndarray) -> float:
    """The cut on P(grade >= 1) with the least cost on the sample, a quarter into the gap it falls into (from the clean side)."""
    order = np.argsort(p, kind="stable")
    p, flagged = p[order], flagged[order]
    missed = np.r_[0, np.cumsum(flagged)]
    alarms = (~flagged).sum() - np.r_[0, np.cumsum(~flagged)]
    edges = np.r_[0.0, 0.75 * p[:-1] + 0.25 * p[1:], 1.0]
    cost = missed + FALSE_ALARM * alarms
    cost[1:-1][p[1:] == p[:-1]] = np.inf        # no cut between equal scores
    return float(edges[len(cost) - 1 - np.argmin(cost[::-1])])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", flag: str = "toxic",
        grade: str | None = None, sample_rows: int = SAMPLE_ROWS) -> SeverityModel:
    """Fit on a bounded sample of the labelled documents. ``grade`` names a column of ordered grades; without it they follow from ``flag``.

    Rows without a label or an id teach nothing. A label repeated for an id counts as its largest
    value. Without flagged rows nothing is toxic.
    """
    value = F.col(grade or flag).cast("int")
    known = (labels.select(F.col(label_id).cast("long").alias("id"), value.alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
             .groupBy("id").agg(F.max("y").alias("y")))
    pick = [F.xxhash64("id", F.lit(5)), F.col("id")]
    half = sample_rows // 2
    sample = known.where("y > 0").orderBy(*pick).limit(half).unionByName(known.where("y <= 0").orderBy(*pick).limit(half))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(words(x.as_py())) for x in b.column(2)], pa.list_(pa.string()))], ["id", "y", "words"])

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body")).join(F.broadcast(sample), "id")    # sample_rows ids at most
    got = texts.select("id", "y", "body").mapInArrow(run, "id long, y int, words array<string>").toArrow().sort_by("id").combine_chunks()
    # one copy of each word for the whole sample
    lists = got["words"].combine_chunks()
    coded, ends = lists.flatten().dictionary_encode(), np.cumsum(np.array([len(x) for x in lists], np.int64))
    names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    rows = [tuple(names[k] for k in part) for part in np.split(at, ends[:-1])] if len(ends) else []
    y = np.maximum(got["y"].to_numpy().astype(int), 0)
    return fit_ordinal(rows, y if grade else severity_grades(rows, y))


def severity(text: Column, model: SeverityModel) -> Column:
    """struct(p_toxic, severity, grade) of a whole text. Null and empty texts score like texts without known words, grade 0."""
    thresholds = np.array(model.thresholds)
    memo: dict[str, tuple] = {}

    def known(word: str) -> tuple:
        got = memo.get(word)
        if got is None:
            if len(memo) > 1_000_000:
                memo.clear()
            got = memo[word] = model.known(word)
        return got

    def run(bodies: pd.Series) -> pd.DataFrame:
        s = np.array([model.score(words(body), known) for body in bodies], float)
        above = _sigmoid(s[:, None] - thresholds[None, :])
        empty = np.array([not b for b in bodies], bool)
        above[empty] = 0.0      # nothing in them to reject
        return pd.DataFrame({"p_toxic": above[:, 0], "severity": above.sum(axis=1),
                             "grade": np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1).argmax(axis=1)})

    return F.pandas_udf(run, "p_toxic double, severity double, grade int")(text)


def score(docs: DataFrame, model: SeverityModel, columns: list, text: str = "text") -> DataFrame:
    """``columns`` plus p_toxic, severity (expected grade), grade (most likely) and rejected."""
    rows = docs.select(*columns, severity(F.col(text), model).alias("__llm_s"))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns[:-1]], "__llm_s.*").withColumn("rejected", F.col("p_toxic") >= F.lit(model.cut))


def drop_toxic(docs: DataFrame, model: SeverityModel, text: str = "text") -> DataFrame:
    """``docs`` without the documents the model rejects."""
    return docs.where(severity(F.col(text), model)["p_toxic"] < F.lit(model.cut))


ship(__name__)
