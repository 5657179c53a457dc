import random

from pyspark.sql import functions as F

from fathom.operators.scan import scan_text
from fathom.operators.token_index import scan_tokens, token_blocks


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, tokens):
    return spark.createDataFrame([(t,) for t in tokens], "token string")


def test_same_hits_as_the_literal_list(spark):
    rng = random.Random(3)
    texts = ["\n".join(" " * rng.randrange(2) + "".join(rng.choice("ab.é(") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))) for _ in range(200)]
    texts += [None, "", "\n\n", "\n ab.", "ab.\r\nba("]
    tokens = sorted({"".join(rng.choice("ab.é(") for _ in range(rng.randrange(1, 6))) for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(texts)), "`i.d` long, `te.xt` string").repartition(4)
    want = rows(scan_text(df, "i.d", "te.xt", tokens))
    assert len(want) > 1000
    assert rows(scan_tokens(df, "i.d", "te.xt", table(spark, tokens + [None, "", "a\nb"] + tokens[:20]))) == want
    # Dealt into many blocks: the same hits.
    assert rows(scan_tokens(df, "i.d", "te.xt", table(spark, tokens), block_chars=3000)) == want


def test_a_hundred_thousand_tokens(spark):
    tokens = spark.range(100_000).select(F.concat(F.lit("tok"), F.col("id").cast("string"), F.lit(";")).alias("token"))
    df = spark.range(0, 100_000, 500).select("id", F.concat(F.lit("x\n a tok"), F.col("id").cast("string"), F.lit("; "), F.repeat(F.lit("tok1 "), 50)).alias("text"))
    hits = scan_tokens(df, "id", "text", tokens)
    assert rows(hits.select("id", "token", "line_no")) == [(i, f"tok{i};", 2) for i in range(0, 100_000, 500)]
    assert len(hits._jdf.queryExecution().toString()) < 20_000      # the list is not in the plan


def test_no_tokens_and_no_texts(spark):
    df = spark.createDataFrame([(1, "abc")], "id int, text string")
    assert rows(scan_tokens(df, "id", "text", table(spark, [None, ""]).where("token IS NULL OR token = ''"))) == []
    assert rows(scan_tokens(df.where("id > 1"), "id", "text", table(spark, ["a"]))) == []
    assert [len(b) for b in token_blocks(table(spark, ["aa", "bb", "cc"]), 1)] == [1, 1, 1]
