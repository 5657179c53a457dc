"""Quality rules: base statistics against plain Python, the model against a plain gradient, verdicts on held-out labels."""

import math
import random
import re
from collections import Counter

import numpy as np

from fathom.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    hit = {k + j for k, w in enumerate(windows) if w in twice for j in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def random_text(rng):
    vocabulary = ["a", "b", "the", "x|y", "#1", "é", "日本", "🙂", "\x85", "\xa0", "<b>", "100%"]
    out = [rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c"]) for _ in range(rng.randrange(0, 90))]
    if rng.random() < 0.5:
        out = out[:30] * rng.randrange(1, 4) + out
    return "".join(out)


ODD = [None, "", " ", "\n\n", "word", "a " * 7, "a " * 8, "a " * 9, "a " * 40, "l\nl\n l\nl", "\x00", "x" * 300_000, "one two three\n" * 40, "w%d " * 30]


def test_statistics():
    rng = random.Random(2)
    for text in [*ODD, *(random_text(rng) for _ in range(400))]:
        body = text or ""
        stats = Q.statistics(body, Q.parse(body))
        assert (*stats, Q.fails(stats[0], stats[4])) == plain(text), text


def test_hashes_of_equal_words_agree_anywhere():
    p = Q.parse("ab abc ab\tabc bca  ab 日本 x日本")
    h = p.hashes.tolist()
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h)) == 5


def test_fit_follows_the_gradient():
    """The fitted weights are near the least weighted loss: its plain gradient is small, and far smaller than at the start."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for k in range(60):
        at = np.sort(rng.choice(200, 12, replace=False))
        rows.append((at, rng.random(12)))
        y.append(int((at < 80).sum() > 5))
    y, share = np.array(y), np.full(60, 1 / 60)

    def gradient(w):
        g = {k: Q.PENALTY * w[k] for k in range(200)}
        for (at, value), t, s in zip(rows, y, share):
            z = w[-1] + sum(w[a] * v for a, v in zip(at, value))
            for a, v in zip(at, value):
                g[a] += s * (1 / (1 + math.exp(-z)) - t) * v
        return math.sqrt(sum(x * x for x in g.values()))

    w = Q.fit_logistic(rows, y, share)
    assert gradient(w) < 0.25 * gradient(np.zeros_like(w))
    scores = np.array([w[-1] + (w[a] * v).sum() for a, v in rows])
    assert ((scores > 0) == y).mean() > 0.9


def test_calibration_gives_probabilities():
    rng = np.random.default_rng(4)
    score = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * score - 1.2)))).astype(int)
    slope, shift = Q.calibrate(score, y, np.full(4000, 1 / 4000))
    assert abs(slope - 0.7) < 0.1 and abs(shift + 1.2) < 0.15
    assert Q.calibrate(score, np.ones(4000, int), np.full(4000, 1 / 4000)) == (1.0, 0.0)


def test_judge_odd_rows(spark):
    rows = list(enumerate([*ODD, ODD[8]])) + [(None, ODD[12]), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, n_words int, `p.q` string").repartition(4)
    got = sorted((str(r.doc_id), *tuple(r)[1:7], r.kept) for r in Q.judge(df, None, ["doc_id"]).collect())
    assert got == sorted((str(i), *plain(t), not plain(t)[-1]) for i, t in rows)
    # labels of one class, or none, teach nothing
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert Q.fit(df, labels) is None and Q.fit(df, labels.limit(0)) is None
    assert Q.judge(df.limit(0), None, ["doc_id"]).collect() == []


def test_many_texts_of_one_labelled_id_teach_once(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k} of words") for k in range(300)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 0), (7, 0)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    assert model is not None and np.isfinite(model.weights).all()


def test_query_base_columns_and_held_out_verdicts(spark):
    from fathom.llm.queries import op12_quality
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in op12_quality(spark, sf).collect()}
    want = {r.doc_id: plain(r.text) for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == w
        assert not (r.kept and r.base_failed)


def test_held_out_accuracy(spark):
    """Fitted on two thirds of check-size labels' ids, judged on the rest: of rows that pass the base rules."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(docs, labels.where("doc_id % 3 <> 1"))
    rows = Q.judge(docs.join(labels.where("doc_id % 3 = 1"), "doc_id"), model, ["quality"]).where("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    print("kept of good", sum(r.kept for r in good) / len(good), len(good), "rejected of bad", sum(not r.kept for r in bad) / len(bad), len(bad))
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)
