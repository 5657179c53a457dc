"""The registered queries of the operators, each over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontam, exact_dedup, langid, line_dedup, pii, quality, simhash, source_mix, suffix_dedup, token_align, toxicity, url_rules, whitening
from fathom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op2_exact_dedup(spark, sf_dir):
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), exact_dedup.in_new_batch(F.col("doc_id")))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op4_source_mix", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
-- in the order in which sources reach their caps: what is left, and the weight left, when all before are capped
c AS (SELECT *, row_number() OVER (ORDER BY s / w, rk) AS pos FROM w),
l AS (SELECT *, 3 * sum(s) OVER () - coalesce(4 * sum(s) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS free
      FROM c WINDOW b AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT min(pos) AS pos, arg_min(rest, pos) AS rest, arg_min(free, pos) AS free FROM l WHERE 4 * s * free >= w * rest),
t AS (SELECT source, s, CASE WHEN l.pos < e.pos THEN 2.0::DOUBLE * s::DOUBLE ELSE (w * e.rest)::DOUBLE / (2 * e.free)::DOUBLE END AS target FROM l, e),
r AS (SELECT d.doc_id, d.source, d.size, t.s, t.target, CASE WHEN t.s > 0 THEN t.target / t.s::DOUBLE ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN
       ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""")
def op4_source_mix(spark, sf_dir):
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op5_simhash")
def op5_simhash(spark, sf_dir):
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@register("op8_decontam", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS phrase FROM iw),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS s, w FROM d, sizes WHERE len(w) >= size),
m AS (SELECT dw.doc_id, dw.s, dw.size, win.item_id FROM dw JOIN win ON win.size = dw.size AND win.phrase = array_to_string(dw.w[dw.s:dw.s + dw.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op8_decontam(spark, sf_dir):
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


@register("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


@register("op10_langid")
def op10_langid(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    model = langid.fit(docs.where(langid.fold(F.col("doc_id")) != 1))
    return langid.predict(docs, model, ["doc_id", held_out.alias("held_out")])


@register("op9_pii")
def op9_pii(spark, sf_dir):
    rows = pii.label(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
                       F.array_join("spans", ",").alias("spans"))


@register("op3_url_rules")
def op3_url_rules(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"))


@register("op7_line_dedup")
def op7_line_dedup(spark, sf_dir):
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@register("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op13_whitening")
def op13_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model, ["vec_id"], error=whitening.identity_error(vectors, model))
    # a deviation beyond 64 bits has no long: null
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@register("op11_token_align")
def op11_token_align(spark, sf_dir):
    rows = token_align.score_alignment(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@register("op12_quality")
def op12_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return rows.drop("p_good")
