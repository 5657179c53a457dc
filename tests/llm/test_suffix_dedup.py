import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import suffix_dedup as S


@pytest.mark.parametrize("alphabet", [1, 2, 3, 26])
def test_suffix_array_sorts_all_suffixes(alphabet):
    rng = random.Random(alphabet)
    for _ in range(300):
        t = [rng.randint(1, alphabet) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.3:
            t = (t * 4)[:70]
        assert S.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array_of_long_runs():
    for t in ([5] * 5000, [1, 2] * 2500, [2, 1] * 2500, list(range(1, 3000)), list(range(3000, 0, -1))):
        sa = S.suffix_array(t)
        assert sorted(sa) == list(range(len(t)))
        assert all(t[a:a + 60] <= t[b:b + 60] for a, b in zip(sa, sa[1:]))


def test_equal_strings_have_equal_anchor_offsets():
    rng = random.Random(2)
    length = 40
    shared = bytes(rng.randrange(256) for _ in range(120))
    texts = [bytes(rng.randrange(256) for _ in range(rng.randrange(200))) + shared + bytes(rng.randrange(256) for _ in range(50)) for _ in range(4)]
    raw, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    a, first, last = S.anchors(np.frombuffer(raw, np.uint8), ends - [len(t) for t in texts], ends, length)
    offset = {p: x - p for x, f, z in zip(a, first, last) for p in range(f, z + 1)}
    seen = {}
    for p, d in offset.items():
        assert seen.setdefault(raw[p:p + length], d) == d
    assert set(offset) == {p for t, e in zip(texts, ends) for p in range(e - len(t), e - length + 1)}


def brute(rows, length):
    seen = Counter(r[p:p + length] for _, t in rows for r in [(t or "").encode()] for p in range(len(r) - length + 1))
    out = []
    for d, t in rows:
        r = (t or "").encode()
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, x in zip(r, gone) if not x)
        runs = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((d, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _check(spark, rows, length, crowd=S.CROWD):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("spans", F.lit("own")).withColumn("key", F.lit(1))
    got = S.remove_repeats(docs, length, crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


@pytest.mark.parametrize("length,alphabet,crowd", [(12, "ab", S.CROWD), (12, "abcdefgh", S.CROWD), (12, "abcdefgh", 3), (40, "abcdefghijklmnop", 2)])
def test_against_every_string(spark, length, alphabet, crowd):
    rng = random.Random(length + crowd)
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(length // 2, 3 * length))) for _ in range(10)]
    rows = [(0, None), (1, ""), (2, "a" * 5 * length), (None, passages[0]), (3, "é" * 3 * length)]
    for i in range(4, 130):
        t = "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 2 * length))) for _ in range(rng.randint(0, 6)))
        rows.append((i, t[:9] + "é" + t[9:] if rng.random() < 0.1 else t))
    rows += [(500 + i, rows[9][1]) for i in range(5)] + [rows[11]] * 3       # copies, and rows that repeat an id and a text
    _check(spark, rows, length, crowd)


def test_a_passage_that_very_many_documents_share(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = word(900)
    rows = [(i, word(rng.randint(0, 500)) + shared[rng.choice([0, 0, 300]):] + word(rng.randint(0, 500))) for i in range(150)]
    _check(spark, rows, 400)
    _check(spark, rows, 400, crowd=20)


def test_no_documents_and_no_repeats(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    _check(spark, [(1, "abc" * 50 + str(list(range(300)))), (2, None)], 400)


def test_ids_of_any_type_and_columns_of_any_name(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(500))
    rows = [("a", text, 1, 2, 3), ("b", "x" + text, 1, 2, 3), (None, "short", 1, 2, 3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "meta.url", "__llm_k1", "TEXT"])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(docs).collect()}
    assert got == {"a": (500, 500, 1), "b": (501, 500, 1), None: (5, 0, 0)}
