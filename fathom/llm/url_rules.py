"""URL filter: given host/path rules first, association rules mined from the URLs those rules label otherwise.

Only DataFrame expressions (and Spark's FP-growth). A URL is a set of tokens. Distinct URLs on which a
given rule fires are the labelled transactions; FP-growth mines token combinations that go with
'allow' or 'block'. Rules below a confidence or support, and rules that a shorter one makes redundant, are
pruned. What is left sits in an inverted index (rarest token of a rule -> rules) that is a constant of
the plan: a URL looks up its own tokens and no row is moved.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ascii_lower, saved

# (verdict, rule): the rule is a host and the beginning of a path
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEFAULT = "allow"
MIN_SUPPORT = 0.002
MIN_ROWS = 8            # no rule rests on fewer labelled URLs
MIN_CONFIDENCE = 0.85
LABEL = "="             # marks the label item of a transaction; no token starts with it


def _rest(url: Column) -> Column:
    """What follows the first '://' ('' without one)."""
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; null or no '://': empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule whose host is the URL's or a parent of it and whose path starts the URL's; null if none."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels, path words (digits read as #), ending, parameter names, scheme."""
    named = lambda mark, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(mark), w))
    spoken = F.regexp_replace(F.lower(path), "[0-9]+", "#")
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    return F.array_distinct(F.concat(
        named("host:", F.split(host, r"\.")), named("path:", F.split(F.regexp_replace(spoken, r"\.[^./]*$", ""), r"[/_-]")),
        named("ending:", F.array(F.regexp_extract(spoken, r"\.([^./]*)$", 1))),
        named("parameter:", F.transform(F.split(query, "&"), lambda q: F.regexp_extract(F.lower(q), "^([^=]*)", 1))),
        named("scheme:", F.array(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^([a-z][a-z0-9+.-]*)://", 1)))))


class Rules(list):
    """Mined rules, and ``twins``: token -> the token that stands for it in rules (tokens that always occur together)."""
    twins: dict[str, str] = {}


def _twins(baskets: DataFrame) -> dict[str, str]:
    """token -> the first of the tokens that stand in exactly the same transactions, for every token that has such a twin.

    The transactions of a token are compared by their number and two sums of hashes; one row a token above the support.
    """
    rows = baskets.select(F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(5), "tokens").alias("g"), F.explode("known").alias("token"))
    same = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g"))
    groups = same.groupBy("n", "h", "g").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where(F.size("tokens") > 1)
    return {t: r.tokens[0] for r in groups.select("tokens").collect() for t in r.tokens[1:]}


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> Rules:
    """(verdict, tokens, confidence, support) rules from (tokens, verdict) transactions, pruned, in order of preference.

    Tokens below the support cannot be in a frequent set, so those above it (at most tokens a URL /
    support of them) are all that reaches the driver. Transactions keep every token above the support, so
    supports and confidences are those of whole URLs. Tokens that always stand together (the words of a shared
    template) are mined as one, or every subset of the template would be a rule; a URL with any of them has that one.
    """
    labelled = saved(labelled.select("tokens", "verdict"))
    share = {r[0]: r[1] for r in labelled.groupBy("verdict").count().collect()}      # one row a verdict
    total = sum(share.values())
    if len(share) < 2:
        return Rules()
    min_support = min(1.0, max(min_support, MIN_ROWS / total))
    rarity = {r[0]: r[1] for r in labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_support * total).collect()}
    if not rarity:
        return Rules()
    frequent = F.create_map(*[F.lit(x) for t in sorted(rarity) for x in (t, True)])
    known = F.filter(F.col("tokens"), lambda t: F.element_at(frequent, t).isNotNull())
    twins = _twins(labelled.select("tokens", known.alias("known")))
    mined = F.filter(known, lambda t: F.element_at(_constant(twins), t).isNull()) if twins else known
    baskets = labelled.select(F.array_append(mined, F.concat(F.lit(LABEL), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = (model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit(LABEL)) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit(LABEL))))
             .select(F.substr(F.col("consequent")[0], F.lit(len(LABEL) + 1)), F.array_sort("antecedent"), "confidence", "support").collect())
    rules: list[tuple] = []
    for verdict, items, confidence, support in sorted(found, key=lambda r: (len(r[1]), -r[2], -r[3], r[1])):
        if not any(v == verdict and c >= confidence - 1e-9 and set(t) <= set(items) for v, t, c, _ in rules):
            rules.append((verdict, tuple(items), confidence, support))
    out = Rules(sorted([(v, tuple(sorted(t, key=lambda x: (rarity[x], x))), c, s) for v, t, c, s in rules], key=lambda r: (-r[2], -r[3], r[1])))
    out.twins = twins
    return out


def _constant(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for t in sorted(pairs) for x in (t, pairs[t])])


def mined_rule(tokens: Column, rules: list[tuple]) -> Column:
    """struct(preference, verdict, rule, confidence) of the preferred mined rule all of whose tokens the URL has; null if none."""
    kind = "struct<preference:int,verdict:string,needs:array<string>,confidence:double>"
    if not rules:
        return F.lit(None).cast(kind)
    twins = getattr(rules, "twins", {})
    if twins:
        tokens = F.array_distinct(F.transform(tokens, lambda t: F.coalesce(F.element_at(_constant(twins), t), t)))
    index: dict[str, list] = {}
    for k, (verdict, needs, confidence, _) in enumerate(rules):
        index.setdefault(needs[0], []).append(F.struct(F.lit(k).alias("preference"), F.lit(verdict).alias("verdict"),
                                                       F.array(*map(F.lit, needs)).alias("needs"), F.lit(float(confidence)).alias("confidence")))
    postings = F.create_map(*[x for t, entries in index.items() for x in (F.lit(t), F.array(*entries))])
    met = F.flatten(F.transform(F.filter(tokens, lambda t: F.element_at(postings, t).isNotNull()), lambda t: F.element_at(postings, t)))
    return F.array_min(F.filter(met, lambda r: F.size(F.array_except(r["needs"], tokens)) == 0))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, default: str = DEFAULT, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined (tokens of the mined rule used) and confidence.

    A null URL or one without '://' has empty host and path and no tokens, so it gets the default verdict.
    Repeated URLs are one transaction when mining and one row each in the result.
    """
    u = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), u.alias("u"), host(u).alias("host"), path(u).alias("path"))
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("u"), F.col("host"), F.col("path")))
    learned = mine(rows.where("given IS NOT NULL").select("u", "tokens", F.col("given.verdict").alias("verdict")).dropDuplicates(["u"]), **options)
    rows = rows.withColumn("mined", F.when(F.col("given").isNull(), mined_rule(F.col("tokens"), learned)))
    return rows.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "mined.verdict", F.lit(default)).alias("verdict"),
                       F.array_join("mined.needs", " ").alias("mined"), F.col("mined.confidence").alias("confidence"))
