import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom.llm import decontam as D


def brute(docs, items, window=10):
    windows = [(i, tuple(w[s:s + min(window, len(w))])) for i, t in items for w in [D.words(t)] if w for s in range(len(w) - min(window, len(w)) + 1)]
    out = []
    for d, t in docs:
        w, hit, met = D.words(t), set(), set()
        for i, win in windows:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p:p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    met.add("null" if i is None else str(i))
        out.append((d, len(w), len(hit), sorted(met), bool(hit)))
    return sorted(out, key=str)


def _frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string")


def _check(spark, docs, items, **options):
    frame = _frame(spark, docs, "doc_id").repartition(3).withColumn("term", F.lit("own")).withColumn("pos", F.lit(1))
    got = D.contamination(frame, _frame(spark, items, "item_id").withColumn("doc_id", F.lit(3)), **options).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, options.get("window", 10))


def test_words_are_ascii_letters_digits_and_everything_else_non_ascii():
    assert D.words("Äpfel, THE-cat’s 12ab_x\x00y É") == ["Äpfel".encode(), b"the", "cat’s".encode(), b"12ab", b"x", b"y", "É".encode()]
    assert D.words(None) == D.words("") == D.words(" .,;_-@[]{}~\x7f") == []


@pytest.mark.parametrize("window,vocabulary,block", [(10, 400, 1 << 20), (4, 12, 1 << 20), (3, 2, 1 << 20), (4, 30, 60)])
def test_against_every_window(spark, monkeypatch, window, vocabulary, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rng = random.Random(window + vocabulary)
    some = lambda n: " ".join(f"w{int(rng.paretovariate(0.4)) % vocabulary}" for _ in range(n))
    items = [(i, some(rng.randint(1, 4 * window))) for i in range(12)] + [(100, None), (101, " . "), (7, some(2 * window)), (None, some(window))]
    docs = [(0, None), (1, ""), (None, items[0][1])]
    for i in range(2, 60):
        parts = [some(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - window))
            parts += [rng.choice([str.upper, str, str.title])(" , ".join(w[a:a + rng.choice([window - 1, window, window + 3, 99])])), some(rng.randint(0, 8))]
        docs.append((i, " ".join(parts)))
    docs += [docs[5]] * 3 + [(300, docs[6][1])]
    _check(spark, docs, items, window=window)


def test_very_long_document_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(25))
    filler = "filler words of no interest " * 40_000
    _check(spark, [(1, filler + item + " " + filler), (2, filler)], [(1, item)])
    assert D.contamination(_frame(spark, [], "doc_id"), _frame(spark, [(1, item)], "item_id")).count() == 0
    got = D.contamination(_frame(spark, [(1, item)], "doc_id"), _frame(spark, [], "item_id")).collect()
    assert [(r.n_words, r.n_hit, r.items) for r in got] == [(25, 0, [])]


def test_proximity_finds_a_phrase_with_a_word_put_in(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, "so alpha beta gamma inserted delta epsilon zeta eta theta iota kappa it goes"), (2, "kappa here and alpha " + "x " * 30 + "there delta zeta")]
    got = {r.doc_id: (r.n_hit, r.near_items) for r in D.contamination(_frame(spark, docs, "doc_id"), _frame(spark, [(5, item)], "item_id")).collect()}
    assert got == {1: (0, ["5"]), 2: (0, [])}


def test_proximity_finds_a_window_with_a_word_that_the_corpus_lacks(spark):
    item = "alpha beta gamma delta answer epsilon zeta eta theta iota"
    docs = [(1, "so alpha beta gamma delta reply epsilon zeta eta theta iota it goes"), (2, "alpha " + "x " * 30 + "delta zeta"), (3, item.replace("answer", "")), (4, "iota of theta")]
    for items, near in (([(5, item)], ["5"]), ([(5, "none of these words occurs but alpha and beta here")], [])):
        got = {r.doc_id: (r.n_hit, r.near_items) for r in D.contamination(_frame(spark, docs, "doc_id"), _frame(spark, items, "item_id")).collect()}
        assert got == {1: (0, near), 2: (0, []), 3: (0, near), 4: (0, [])}


def test_chosen_offsets_cover_every_window():
    rng = random.Random(9)
    for _ in range(50):
        item = [b"w%d" % rng.randint(0, 9) for _ in range(rng.randint(1, 40))]
        counts = Counter({b"w%d" % i: rng.randint(0, 5) for i in range(10)})
        chosen = D._chosen(item, counts, 10, 3)
        size = min(10, len(item))
        assert set(chosen) == {s for s in range(len(item) - size + 1) if all(counts[w] for w in item[s:s + size])}
        assert all(len(q) == min(3, size) and s <= min(q) and max(q) < s + size for s, q in chosen.items())


def test_drop_keeps_columns_and_clean_documents(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = _frame(spark, [(1, item), (2, "clean"), (3, None), (4, "x " + item.upper() + " y")], "doc_id").withColumn("items", F.lit("own")).withColumn("n_hit", F.lit(9))
    out = D.drop_contaminated(docs, _frame(spark, [(1, item)], "item_id"))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
