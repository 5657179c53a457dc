"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every learnable document in one distributed pass. The weights
are trained on a bounded, hash-ordered sample (``SAMPLE_ROWS`` rows over all languages) by
follow-the-regularised-leader with L1 and L2 penalties; a fifth of the sample is held back to
fit one temperature, so scores are calibrated. Prediction reads whole texts in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import ship

DIMENSIONS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 2000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
UNKNOWN = "und"


@dataclass
class LanguageModel:
    classes: list
    weights: np.ndarray       # (classes, DIMENSIONS + 1), the last column is the intercept
    idf: np.ndarray
    temperature: float


def grams(text: str) -> np.ndarray:
    """Hashed character n-grams of a whole text; everything below 'A' and ASCII punctuation reads as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where((c < 97) | ((c > 122) & (c < 128)), np.uint64(32), c)
    c = np.concatenate([[np.uint64(32)], c[(c != 32) | np.r_[True, c[1:] != 32]], [np.uint64(32)]])
    out, h = [], np.zeros(len(c), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        h = h[:len(c) - order + 1] * np.uint64(0x100000001B3) + c[order - 1:]
        if order in ORDERS:
            mixed = (h ^ np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(grams(text), minlength=DIMENSIONS)
    at = np.flatnonzero(n)
    return at, n[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(n)) * idf[at]
    return v / np.sqrt(v @ v)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How many documents with a letter hold each n-gram bucket, and how many there are."""
    def run(batches):
        df, total = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            for x in b.column(0):
                if has_letter(body := x.as_py()):
                    df[np.unique(grams(body)) if len(body) < 2000 else counts(body)[0]] += 1
                    total += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], total])], ["at", "n"])

    found = docs.select(F.col(text).alias("body")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    df, total = np.zeros(DIMENSIONS), 0
    for at, n in found.collect():          # at most DIMENSIONS + 1 rows
        if at < 0:
            total = n
        else:
            df[at] = n
    return df, total


def _scores(w: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    return w[:, at] @ v + w[:, -1]


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def ftrl(rows: list, classes: int) -> np.ndarray:
    """FTRL-proximal with elastic net; ``rows``: (positions, values, class). Order of rows is the order of updates."""
    z, n = np.zeros((classes, DIMENSIONS + 1)), np.zeros((classes, DIMENSIONS + 1))

    def weights(at):
        zi, rate = z[:, at], (BETA + np.sqrt(n[:, at])) / ALPHA
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / (rate + L2))

    for _ in range(EPOCHS):
        for at, v, y in rows:
            at, v = np.r_[at, DIMENSIONS], np.r_[v, 1.0]
            w = weights(at)
            p = _softmax(w @ v)
            p[y] -= 1.0
            g = np.outer(p, v)
            step = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - step * w
            n[:, at] += g * g
    return weights(np.arange(DIMENSIONS + 1))


def _temperature(w: np.ndarray, rows: list) -> float:
    """The divisor of the scores with the least log loss on held-back rows (1 if there are none)."""
    if not rows:
        return 1.0
    scored = [(_scores(w, at, v), y) for at, v, y in rows]
    return min(np.geomspace(0.02, 10, 80), key=lambda t: -sum(np.log(max(_softmax(s / t)[y], 1e-12)) for s, y in scored))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Learn from rows with a language and a letter; None if there are none.

    The sample is the distinct texts of a language with the smallest hashes. The count of a language's
    distinct texts sets a hash below which about twice its quota lie, so only those texts are moved and sorted.
    """
    rows = docs.select(F.col(text).alias("body"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text), F.lit(3)).alias("pick")).where("lang IS NOT NULL AND body IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count_distinct("pick")).collect()}      # the languages: a value each
    classes = sorted(sizes)
    if not classes:
        return None
    df, total = document_frequencies(rows.select("body"), "body")
    if not total:
        return None
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    quota = max(20, sample_rows // len(classes))
    below = F.create_map(*[F.lit(x) for c in classes for x in (c, int(min(1.0, (2.0 * quota + 40) / sizes[c]) * (2.0 ** 64 - 2 ** 12)) - 2 ** 63)])
    low = rows.where((F.col("pick") <= F.element_at(below, F.col("lang")))).groupBy("lang", "pick").agg(F.first("body").alias("body"))
    sample = low.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("pick"))).where(F.col("k") <= quota)

    def run(batches):
        for b in batches:
            out = [(p, y, counts(x)) for x, y, p in zip(*(b.column(c).to_pylist() for c in range(3))) if has_letter(x)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()),
                                              pa.array([o[2][0].astype(np.int32) for o in out], pa.list_(pa.int32())),
                                              pa.array([o[2][1].astype(np.int32) for o in out], pa.list_(pa.int32()))], ["pick", "lang", "at", "n"])

    taken = sample.select("body", "lang", "pick").mapInArrow(run, "pick long, lang string, at array<int>, n array<int>").toPandas()   # at most sample_rows
    taken = taken.sort_values(["pick", "lang"], kind="stable")
    code = {c: k for k, c in enumerate(classes)}
    made = []
    for y, at, n in zip(taken["lang"], taken["at"], taken["n"]):
        at = np.asarray(at, np.int64)
        made.append((at, vector(at, np.asarray(n, float), idf), code[y]))
    held, learn = made[::5], [m for k, m in enumerate(made) if k % 5]
    w = ftrl(learn or made, len(classes))
    return LanguageModel(classes, w.astype(np.float32), idf.astype(np.float32), float(_temperature(w, held if learn else [])))


def predict(docs: DataFrame, model: LanguageModel | None, columns: list, text: str = "text") -> DataFrame:
    """``columns`` plus lang_pred and score. Null texts and texts without a letter: 'und' with score 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*columns, F.col(text).alias("__llm_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches):
        m = held.value
        for b in batches:
            lang, score = [], []
            for x in b.column(b.num_columns - 1):
                body = x.as_py()
                if m is None or not has_letter(body):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, n = counts(body)
                p = _softmax(_scores(m.weights, at, vector(at, n, m.idf)).astype(float) / m.temperature)
                k = int(p.argmax())
                lang.append(m.classes[k])
                score.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             [*b.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3 (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


ship(__name__)
