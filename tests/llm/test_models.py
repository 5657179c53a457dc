"""Toxicity, language id, personal data and URL rules."""
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import langid as L
from fathom.llm import pii as P
from fathom.llm import toxicity as T
from fathom.llm import url_rules as U

SMALL = "/root/testdata/sf0.01"


# ---- toxicity

def test_ordinal_fit_recovers_order_and_shares_weights():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(900):
        k = int(rng.integers(0, 4))
        rows.append({f"n{int(x)}" for x in rng.integers(0, 500, 30)} | {f"bad{int(x)}" for x in rng.choice(12, 3 * k, replace=False)})
        grades.append(k)
    m = T.fit_ordinal(rows, np.array(grades))
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 3
    expected = [T._sigmoid(m.score(r) - np.array(m.thresholds)).sum() for r in rows]
    means = [np.mean([e for e, g in zip(expected, grades) if g == k]) for k in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    assert all(w in m.weights for w in ("bad0", "bad5"))


def test_grades_follow_the_share_of_flagged_words():
    rows = [{"a", "b"}] * 40 + [{"a", "x"}] * 6 + [{"x", "y"}] * 6
    g = T.severity_grades(rows, np.array([0] * 40 + [1] * 12))
    assert set(g[:40]) == {0} and set(g[40:]) == {1, 2} and max(g[40:46]) < min(g[46:])


def test_cut_lies_in_the_gap():
    assert T.place_cut(np.array([0.1, 0.2, 0.6, 0.9]), np.array([False, False, True, True])) == pytest.approx(0.3)
    assert T.place_cut(np.array([0.3, 0.3]), np.array([False, True])) in (0.0, 1.0)
    assert T.place_cut(np.array([0.1]), np.array([False])) == 1.0


def _toxic_tables(spark):
    rows = [(i, f"plain words number{i % 17} of text {('idiot', 'scum', 'idiot scum')[i % 3] if i % 5 == 0 else ''}") for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "word " * 100_000), (1003, "an unlabelled scum here"), (None, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(3, None), (None, 1), (5, 0), (99999, 1)], "doc_id long, toxic int")
    return docs, labels


def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs, labels = _toxic_tables(spark)
    m = T.fit(docs, labels)
    got = {r.doc_id: r for r in T.score(docs.withColumn("grade0", F.lit(1)), m, ["doc_id", "grade0"]).collect()}
    assert {i for i, r in got.items() if r.rejected} == {*range(0, 400, 5), 1003, None}
    assert got[1000].severity == got[1001].severity == 0.0 and got[1002].grade == 0
    out = T.drop_toxic(docs.withColumn("severity", F.lit("own")), m)
    assert out.columns == ["doc_id", "text", "severity"] and out.count() == 405 - 82


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = _toxic_tables(spark)
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert T.drop_toxic(docs, T.fit(docs, none)).count() == 405
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels), ["doc_id"]).count() == 0


# ---- language id

def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    m = L.fit(docs.where(L.fold(F.col("doc_id")) != 1))
    assert 0 < np.count_nonzero(m.weights) < m.weights.size
    held = L.predict(docs.where(L.fold(F.col("doc_id")) == 1), m, ["lang"]).toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert held["score"].between(0, 1).all() and held["score"].mean() > 0.9
    again = L.fit(docs.where(L.fold(F.col("doc_id")) != 1).repartition(7))
    assert np.array_equal(m.weights, again.weights) and m.temperature == again.temperature


def test_language_of_odd_texts(spark):
    rows = [(i, ("the cat and dog " if i % 2 else "der hund und katze ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(200)]
    m = L.fit(spark.createDataFrame(rows + [(900, None, "fr"), (901, "text", None), (902, "12 34", "xx")], "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 3"), (4, "the dog " * 50_000), (5, "katze"), (None, "the")], "doc_id long, text string").withColumn("lang_pred0", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(odd, m, ["doc_id", "lang_pred0"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "de" and got[None][0] == "en"
    assert L.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert [r.lang_pred for r in L.predict(odd, None, ["doc_id"]).collect()] == ["und"] * 6


def test_a_text_with_many_copies_is_learned_once(spark):
    rows = [("the cat", "en")] * 3000 + [(f"der hund {i}", "de") for i in range(30)] + [(f"the dog {i}", "en") for i in range(30)]
    assert L.fit(spark.createDataFrame(rows, "text string, lang string"), sample_rows=100).classes == ["de", "en"]


def test_a_language_made_mostly_of_copies_fills_its_quota(spark):
    tails = ["".join(chr(97 + (i * p) % 26) for p in (3, 5, 7)) for i in range(60)]
    rows = [(f"the cat and dog {t}", "en") for t in tails for _ in range(400)] + [(f"der hund und katze {t}", "de") for t in tails]
    m = L.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4), sample_rows=100)
    got = L.predict(spark.createDataFrame([("the dog and cat",), ("katze und hund",)], "text string"), m, ["text"]).collect()
    assert {r.text: r.lang_pred for r in got} == {"the dog and cat": "en", "katze und hund": "de"}


# ---- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = ["a@b.c_d@e.f x@y.com-foo@bar.com, 4111 1111 1111 1111 +1 (743) 555-3824 1.2.3.4.5.6.7.8 999.1.1.1 12-34 5", None, "",
       "x" * 30_000 + " 1 " + "2" * 20_000 + "@" + "a." * 10_000 + "b", "😀 a@b.co 4111-1111-1111-1111-1 é+49 (0) 30 1234567", "a@b.co4111 1111 1111 1111",
       "\ue000 5\ue0006 4111 1111 1111 1111\n1", "+1 22 +333 4444 5555 +", "1.2.3.4.256.1.1.1 0001.002.3.0", "@ a@ @b.c a@b a@b. 1-2-3--4  5"]


def test_base_spans_against_a_plain_search(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(ODD)] + [(None, ODD[0]), (7 * 10 ** 6, ODD[0]), (7 * 10 ** 6, ODD[0])], docs.schema))
    got = P.label(docs.withColumn("kind", F.lit("own")).withColumn("spans", F.lit(1))).collect()
    want = [(r.doc_id, brute_spans(r.text)) for r in docs.collect()]
    assert sorted([(r.doc_id, list(r.base)) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        assert set(r.base) <= set(r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in r.base) for k in BASE]


def test_added_spans_touch_no_base_span(spark):
    rows = [(i, f"please call 743-555-38{i:02d} or write to john [at] mail [dot] com, 4111 1111 1111 1111 me{i}@mail.com ip 10.0.0.{i}") for i in range(60)]
    got = P.label(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(len(r.spans) > len(r.base) for r in got)
    for r in got:
        ranges = sorted(tuple(map(int, s.split(":")[1:])) for s in r.spans)
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    assert P.label(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [list(r.spans) for r in P.label(spark.createDataFrame([(1, "none here"), (1, None)], "doc_id long, text string")).collect()] == [[], []]


def test_em_tells_a_good_labeler_from_a_coin():
    rng = np.random.default_rng(1)
    patterns = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        votes = tuple(int((1 if truth else -1) * (1 if rng.random() < a else -1)) for a in (0.95, 0.9, 0.55, 0.85))
        patterns[(0, votes)] = patterns.get((0, votes), 0) + 1
    right, _ = P.reliabilities([(k, v, n) for (k, v), n in patterns.items()])
    assert right[0] > 0.9 and right[2] < 0.62 and right[0] > right[3] > right[2]


# ---- URL rules

def brute_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in U.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


URLS = ["http://EXAMPLE.org/es/x", "https://a.b.example.org/en/1", "ftp://example.org/en/2?x#y", "http://org/", "http://borg/", "http://x.org", "http://x.org?q=/", "http://a.com/fr/", "http://a.com/fr",
        "http://a.com/de/9.html", "no scheme org/", "", None, "://x.org/", "http://É.COM/fr/ü", "http:///org/", "http://a.com/de/\nx", "a://b://c.org/d", "http://x.org/" + "a/" * 50_000]


def test_given_rules_against_plain_python(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)] + [(None, URLS[0])], "page_id long, url string").withColumn("host", F.lit("own")).withColumn("tokens", F.lit(2))
    got = U.judge(pages).collect()
    assert len(got) == 2 * len(URLS) + 1
    for r in got:
        host, path, best = brute_rule(URLS[(r.page_id or 0) % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert U.judge(pages.limit(0)).count() == 0


def test_mined_rules_carry_the_labels_over(spark):
    rows = [(i, f"http://h{i % 9}.example.{'com' if i % 2 else 'net'}/{'de' if i % 3 else 'en'}/{i}") for i in range(600)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=(("block", "com/de/"), ("allow", "com/en/"))).collect()
    for r in got:
        assert r.verdict == ("block" if r.page_id % 3 else "allow"), r
    assert all(r.mined for r in got if r.rule is None)


def test_rules_are_pruned_and_matched_by_their_tokens(spark):
    rows = [(["a", "b", f"x{i % 40}"], "block") for i in range(200)] + [(["a", "c", f"x{i % 40}"], "allow") for i in range(200)]
    rules = U.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.1)
    assert {(v, t) for v, t, _, _ in rules} == {("block", ("b",)), ("allow", ("c",))}
    got = spark.createDataFrame([(["b", "z"],), (["c", "b"],), (["a"],), ([],)], "t array<string>").select(U.mined_rule(F.col("t"), rules)["verdict"]).collect()
    assert [r[0] for r in got] in (["block", "allow", None, None], ["block", "block", None, None])


def test_rules_rest_on_every_token_of_a_long_url(spark):
    rows = []
    for i in range(400):
        own = [t for t, there in (("p", i % 4 in (0, 1)), ("q", i % 4 in (0, 2))) if there]
        block = i % 4 in (0, 3)
        rows.append(([f"s{k}" for k in range(8) if block or i // 4 % 8 != k] + own, "block" if block else "allow"))
    rules = U.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.1)
    assert ("block", {"p", "q"}) in [(v, set(t)) for v, t, _, _ in rules]
    for verdict, needs, confidence, support in rules:
        met = [v for t, v in rows if set(needs) <= set(t)]
        assert (confidence, support) == pytest.approx((met.count(verdict) / len(met), met.count(verdict) / 400))


def test_a_template_of_many_shared_words_is_mined_as_one_token(spark):
    words = [f"path:w{i}" for i in range(30)]
    rows = [(words + [f"path:x{i}"], "block") for i in range(40)] + [([f"path:y{i % 4}"], "allow") for i in range(40)]
    started = time.monotonic()
    rules = U.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.1)
    assert time.monotonic() - started < 60
    assert ("block", (min(words),), 1.0, 0.5) in [tuple(r) for r in rules] and len(rules) == 5
    pages = [(["path:w17", "path:new"],), (["path:y2"],), (["path:z"],), ([],)]
    got = spark.createDataFrame(pages, "t array<string>").select(U.mined_rule(F.col("t"), rules)["verdict"]).collect()
    assert [r[0] for r in got] == ["block", "allow", None, None]
