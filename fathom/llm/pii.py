"""Personal data by weak supervision: patterns, word lists and context vote, EM weighs the votes, a classifier decides.

Only DataFrame expressions touch the texts. Every match of the base patterns, valid or not, and of
some looser patterns is a candidate span. Four labelers vote on each: the pattern's own check, a word
list (top-level domains, address ranges, issuer and country prefixes), the words before it, and its
edges. The table of vote patterns (a few thousand rows at most, whatever the corpus) goes to the driver:
expectation-maximisation estimates how reliable each labeler is, and a logistic regression on votes and
shape, fitted to the resulting probabilities, is the final span classifier. Base spans always stay;
other candidates are added if the classifier accepts them and they touch no base span.

Patterns are written so that a regex engine needs linear time and no recursion on long runs:
possessive repeats, starts only where a run starts (or where the last match ended, \\G), and card
separators replaced by one private-use character first.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import K1, K2, row_key, saved

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_SEP = "\ue000"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{_SEP}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{{1,63}}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "ch", "at", "us", "ca")
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write to|reach|correo|courriel|kontakt)\W*\S{0,12}\W*$",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|logged in|from)\W*\S{0,12}\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|payment|tarjeta|carte|karte)\W*\S{0,12}\W*$",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|whatsapp|tel[eé]fono|t[eé]l[eé]phone|telefon)\W*\S{0,12}\W*$",
}
AGAINST = r"(?i)(?:version|isbn|token|sha|hash|sku|order|invoice|serial|section)\W*\S{0,6}\W*$"
VOTES = ("v_rule", "v_list", "v_context", "v_edge")
ACCEPT = 0.8


def _matches(text: Column, prepared: Column, pattern: str, kind: str, loose: bool) -> Column:
    """All matches of a pattern as structs; ``gap`` is the number of characters since the match before."""
    found = F.regexp_extract_all(prepared, F.lit(pattern), F.lit(0))
    parts = F.split(prepared, pattern, -1)
    return F.transform(found, lambda m, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(loose).alias("loose"), i.alias("i"), F.char_length(F.get(parts, i)).alias("gap"), F.char_length(m).alias("size"),
        m.alias("value"), F.substring(F.get(parts, i), -30, 30).alias("before"), F.substring(F.get(parts, i + 1), 1, 1).alias("after")))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the weighted digit sum is a multiple of ten."""
    marks = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    doubled = lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
    return F.aggregate(F.transform(marks, lambda x, i: doubled(x.cast("int"), i)), F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets_fit(value: Column) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.forall(octets, lambda x: F.coalesce((F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255), F.lit(False)))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All candidate spans: K1, K2, kind, base, start, end, votes and shape. Rows that repeat an id and a text give them once."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*row_key(F.col(doc_id), F.col(text)), body.alias("body"), F.monotonically_increasing_id().alias("uid"))
    body = F.col("body")
    marked = F.regexp_replace(F.translate(body, _SEP, "x"), r"(?<=[0-9])[\x20-](?=[0-9])", _SEP)
    digit = body.rlike("[0-9]")
    lists = [F.when(F.contains(body, F.lit("@")), _matches(body, body, EMAIL, "email", False)),
             F.when(digit & F.contains(body, F.lit(".")), _matches(body, body, IP, "ip", False)),
             F.when(digit, _matches(body, marked, CARD, "card", False)),
             F.when(F.contains(body, F.lit("+")), _matches(body, body, PHONE, "phone", False)),
             F.when(F.contains(F.lower(body), F.lit("dot")) | F.contains(F.lower(body), F.lit("at]")) | F.contains(F.lower(body), F.lit("at)")),
                    _matches(body, body, LOOSE["email"], "email", True)),
             F.when(F.contains(body, F.lit(":")), _matches(body, body, LOOSE["ip"], "ip", True)),
             F.when(digit, _matches(body, body, LOOSE["phone"], "phone", True))]
    spans = rows.select(K1, K2, "uid", F.explode(F.concat(*[F.coalesce(x, F.array().cast(_LIST)) for x in lists])).alias("m")).select(K1, K2, "uid", "m.*")
    along = Window.partitionBy("uid", "kind", "loose").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = (spans.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size"))
             .withColumn("digits", _digits(F.col("value"))))
    kind, value, digits, n = F.col("kind"), F.col("value"), F.col("digits"), F.length("digits")
    is_kind = [kind == k for k in range(len(KINDS))]
    fits = (F.when(is_kind[0], F.lit(True)).when(is_kind[1], _octets_fit(value)).when(is_kind[2], n.between(16, 19) & luhn(digits))
            .otherwise(n.between(8, 15)))
    spans = spans.withColumn("base", ~F.col("loose") & fits)
    # short digit runs that no labeler could take for a card are not candidates
    spans = spans.where(F.col("base") | F.when(is_kind[2], n.between(13, 19)).when(is_kind[3], n >= 7).otherwise(True))
    listed = (F.when(is_kind[0], F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_LEVEL))
              .when(is_kind[1], F.regexp_extract(value, "^([0-9]{1,3})", 1).try_cast("int").between(1, 223) | F.contains(value, F.lit(":")))
              .when(is_kind[2], digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"))
              .otherwise(F.when(F.startswith(value, F.lit("+")), digits.rlike("^(?:1[2-9]|[2-9])")).otherwise(digits.rlike("^[2-9][0-9]{2}[2-9]"))))
    context = reduce(lambda c, k: F.when(is_kind[k] & F.col("before").rlike(CONTEXT[KINDS[k]]), F.lit(1)).otherwise(c), range(4), F.when(F.col("before").rlike(AGAINST), -1).otherwise(0))
    vote = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    return spans.select(
        K1, K2, "kind", "base", "start", "end", F.when(F.col("base"), 1).when(F.col("loose"), 0).otherwise(-1).alias("v_rule"),
        vote(F.coalesce(listed, F.lit(False))).alias("v_list"), context.alias("v_context"),
        vote(~(F.col("before").rlike("[0-9A-Za-z]$") | F.col("after").rlike("^[0-9A-Za-z]"))).alias("v_edge"),
        F.least(F.floor(n / 4), F.lit(5)).cast("int").alias("s_digits"), value.rlike(f"[\\x20()-]|{_SEP}").cast("int").alias("s_split")).distinct()


_LIST = "array<struct<kind:int,loose:boolean,i:int,gap:int,size:int,value:string,before:string,after:string>>"


def reliabilities(patterns: list, rounds: int = 30) -> tuple[dict, list]:
    """EM over (kind, votes, n): per labeler the chance that a vote is right, and for each pattern P(personal data)."""
    right = {v: 0.8 for v in range(len(VOTES))}
    prior: dict = defaultdict(lambda: 0.5)
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (kind, votes, _) in enumerate(patterns):
            yes, no = prior[kind], 1 - prior[kind]
            for v, x in enumerate(votes):
                if x:
                    yes *= right[v] if x > 0 else 1 - right[v]
                    no *= 1 - right[v] if x > 0 else right[v]
            post[i] = yes / (yes + no)
        for v in right:
            hit = all_ = 1.0
            hit = 0.8
            for p, (_, votes, n) in zip(post, patterns):
                if votes[v]:
                    all_ += n
                    hit += n * (p if votes[v] > 0 else 1 - p)
            right[v] = min(0.99, max(0.51, hit / all_))
        for kind in {p[0] for p in patterns}:
            own = [(p, n) for p, (k, _, n) in zip(post, patterns) if k == kind]
            prior[kind] = min(0.95, max(0.05, sum(p * n for p, n in own) / sum(n for _, n in own)))
    return right, post


def _shape(kind: int, votes: tuple, digits: int, split: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(4)), *(float(v) for v in votes), *(float(digits == d) for d in range(6)), float(split)]


def fit_classifier(rows: list) -> list[float]:
    """Logistic regression on (kind, votes, s_digits, s_split, n) rows with the EM probabilities as soft labels."""
    if not rows:
        return []
    _, post = reliabilities([(r[0], r[1], r[4]) for r in rows])
    x, p, n = np.array([_shape(*r[:4]) for r in rows]), np.array(post), np.array([r[4] for r in rows], float)
    n, w = n / n.sum(), np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-x @ w))
        bend = (x * (n * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(bend, x.T @ (n * (q - p)) + 1e-3 * w)
    return [float(v) for v in w]


def _score(weights: list[float]) -> Column:
    terms = [F.lit(1.0), *((F.col("kind") == k).cast("double") for k in range(4)), *(F.col(v).cast("double") for v in VOTES),
             *((F.col("s_digits") == d).cast("double") for d in range(6)), F.col("s_split").cast("double")]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum((t * F.lit(w) for t, w in zip(terms, weights)), F.lit(0.0))))


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans K1, K2, kind (0 email, 1 ip, 2 card, 3 phone), base, start, end (code points, end exclusive), p."""
    spans = saved(candidates(docs, doc_id, text))
    patterns = spans.groupBy("kind", *VOTES, "s_digits", "s_split").agg(F.count(F.lit(1)).alias("n")).collect()     # 4 * 3^4 * 6 * 2 rows at most
    weights = fit_classifier(sorted((r[0], (r[1], r[2], r[3], r[4]), r[5], r[6], r[7]) for r in patterns))
    p = _score(weights) if weights else F.lit(0.0)
    doc = Window.partitionBy(K1, K2)
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    before = F.max(base_end).over(doc.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(base_start).over(doc.orderBy("start", "end").rowsBetween(1, Window.unboundedFollowing))
    clear = F.coalesce(F.col("b_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("b_start") >= F.col("end"), F.lit(True))
    return (spans.withColumn("p", p).withColumn("b_end", before).withColumn("b_start", after)
            .where(F.col("base") | ((F.col("p") >= ACCEPT) & clear)).select(K1, K2, "kind", "base", "start", "end", "p"))


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_<kind> (base spans), base and spans (arrays of 'kind:start:end' by kind, then start).

    Null counts as the empty text. Added spans do not change the counts.
    """
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    told = F.struct("kind", "start", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("t"))
    per_doc = find_spans(docs, doc_id, text).groupBy(K1, K2).agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.when(F.col("base"), told))).alias("base"), F.array_sort(F.collect_list(told)).alias("spans"))
    none = F.array().cast("array<string>")
    return (docs.select(F.col(doc_id).alias("doc_id"), *row_key(F.col(doc_id), F.col(text))).join(per_doc, [K1, K2], "left")
            .select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
                    F.coalesce("base.t", none).alias("base"), F.coalesce("spans.t", none).alias("spans")))
