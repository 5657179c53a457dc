import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom import session
from fathom.llm import line_dedup as L
from fathom.session import scratch_scope


def similar_pairs(texts):
    """All pairs of different texts with edit similarity of at least 0.8, by nothing else."""
    texts = sorted(set(texts))
    # DuckDB counts bytes: every other letter becomes an ASCII character that lower-case lines do not hold
    other = sorted({c for t in texts for c in t if ord(c) > 127})
    code = str.maketrans(dict(zip(other, "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~", strict=False)))
    assert len(other) < 50
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(range(len(x))) AS k, unnest(x) AS x FROM (SELECT ?::VARCHAR[] AS x)", [[t.translate(code) for t in texts]])
    found = con.execute("""SELECT a.k, b.k FROM t a JOIN t b ON a.k < b.k AND least(length(a.x), length(b.x)) >= 0.8 * greatest(length(a.x), length(b.x)) - 1
                           WHERE levenshtein(a.x, b.x) <= floor(0.2 * greatest(length(a.x), length(b.x)) + 1e-9)""").fetchall()
    return [(texts[a], texts[b]) for a, b in found]


def linked_pairs(spark, texts, **options):
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(set(texts)))], "id long, norm string").withColumn("size", F.char_length("norm")).repartition(4)
    name = dict(enumerate(sorted(set(texts))))
    return {(name[r.a], name[r.b]) for r in L.near_lines(nodes, **options).collect()}


def components(texts, pairs):
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t
    for a, b in pairs:
        parent[find(a)] = find(b)
    return {t: find(t) for t in texts}


def brute(spark, docs, **options):
    """Kept text per row from the links of the normalised lines (test_links holds those against the edit distance alone)."""
    norm = {r.line: r.n for r in spark.createDataFrame([(x,) for _, t in docs if t is not None for x in t.split("\n")], "line string").distinct()
            .select("line", L.folded(F.col("line")).alias("n")).collect()}
    texts = {n for n in norm.values() if n}
    links = linked_pairs(spark, texts, **options)
    assert links <= set(similar_pairs(texts))
    group, first = components(texts, links), {}
    for has, d, t in sorted({(d is not None, d or 0, t) for d, t in docs if t is not None}):
        for k, line in enumerate(t.split("\n")):
            if norm[line]:
                first.setdefault(group[norm[line]], (d, t, k))
    out = []
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if not norm[x] or first[group[norm[x]]] == (d or 0, t, k)]
        out.append((d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def _docs(rng):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    stock = [line(rng.randint(1, 60)) for _ in range(25)]

    def changed(t):
        w = t.split(" ")
        w[rng.randrange(len(w))] = rng.choice(words)
        return rng.choice([t.upper(), t + " !", f"{t} {rng.randint(0, 999)}", f"{t}, {rng.choice(words)}", " ".join(w), f"  {t}."])
    docs = [(0, None), (1, ""), (2, "\n\n--\n"), (3, stock[0]), (None, stock[1] + "\nown line")]
    for i in range(4, 60):
        docs.append((i, "\n".join(rng.choice([rng.choice(stock), changed(rng.choice(stock)), line(rng.randint(1, 30)), "", "***"]) for _ in range(rng.randint(0, 9)))))
    return docs + [docs[9]] * 2


@pytest.mark.parametrize("crowd", [L.CROWD])
def test_against_plain_grouping_of_lines(spark, crowd):
    docs = _docs(random.Random(3))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit("own")).withColumn("__llm_k1", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(3)
    got = L.dedup_lines(frame, crowd=crowd).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(spark, docs, crowd=crowd)


def _real_lines(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    rows = docs.select(F.explode(F.split("text", "\n")).alias("x")).select(L.folded(F.col("x")).alias("n")).where("n <> ''").distinct()
    return [r.n for r in rows.orderBy(F.xxhash64("n")).limit(n).collect()]


@pytest.mark.parametrize("crowd", [L.CROWD])
def test_links_reach_most_lines_that_are_similar_by_edit_distance_alone(spark, crowd):
    """Real lines with 2 to 10 percent of their words replaced, left out or put in, held against the edit distance and nothing else."""
    rng, lines = random.Random(11), [t for t in _real_lines(spark, 400) if len(t) < 700]
    vocabulary = sorted({w for t in lines for w in t.split(" ")})
    texts = list(lines)
    for t in lines:
        w = t.split(" ")
        for _ in range(max(1, round(len(w) * rng.uniform(0.02, 0.1)))):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[at], rng.choice(vocabulary)]])
        texts.append(" ".join(w) or "x")
    true, got = set(similar_pairs(texts)), linked_pairs(spark, texts, crowd=crowd)
    assert got <= true
    long = {p for p in true if len(p[0].split(" ")) >= 16}
    print(f"recall {len(got) / len(true):.3f} of {len(true)}, of lines of 16 words and more {len(got & long) / len(long):.3f} of {len(long)}")
    assert len(got & long) >= 0.93 * len(long) and len(got) >= 0.85 * len(true)


def test_a_crowd_of_near_copies_costs_no_pairs_of_all(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
    texts = [" ".join(words[:k % 60] + [f"x{k}"] + words[k % 60 + 1:]) for k in range(400)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "id long, norm string").withColumn("size", F.char_length("norm")).repartition(4)
    assert L.candidates(nodes, crowd=32).count() < 400 * 399 / 4


def test_crowds_lose_no_link(spark):
    """Blocks of over two lines are crowds here: the links, and the groups, are those of comparing every pair of every block."""
    rng = random.Random(6)
    stock = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(25)) for _ in range(5)]
    texts = set(stock)
    for k in range(60):
        w = rng.choice(stock).split(" ")
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"z{k}"
        texts.add(" ".join(w))
    every = linked_pairs(spark, texts)
    assert linked_pairs(spark, texts, crowd=2) == every
    same = lambda pairs: {frozenset(t for t, g in components(texts, pairs).items() if g == h) for h in components(texts, pairs).values()}
    assert same(linked_pairs(spark, texts, crowd=2, spanning=True)) == same(every)


@pytest.mark.parametrize("part", [3, L.PART])
@pytest.mark.parametrize("grouped", [True, False])
def test_pairs_of_crowds_are_all_pairs_in_different_groups(spark, part, grouped):
    rng = random.Random(9)
    size, fp = [rng.randint(1, 12) for _ in range(40)], [rng.getrandbits(8) << 40 for _ in range(40)]
    keys = [(k, i) for k in range(3) for i in range(40) if k == 0 or rng.random() < 0.4]
    label = {i: (0 if i < 20 else 20 + i % 3) if grouped and i % 7 else i for i in range(40)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    labels = frame([(i, g) for i, g in label.items() if i % 7], "node long, label long") if grouped else None
    crowded = frame([(k, i, size[i]) for k, i in keys] + [(9, i, size[i]) for i in range(1, 20) if grouped and i % 7], "key long, id long, size int")
    got = L.crowd_pairs(crowded, frame(list(enumerate(fp)), "id long, fp long"), labels, 3, 0.8, part).collect()
    want = {(i, j) for k, i in keys for m, j in keys if k == m and i < j and label[i] != label[j] and (fp[i] ^ fp[j]).bit_count() <= 3
            and min(size[i], size[j]) >= int(0.8 * max(size[i], size[j]) - 1e-9)}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_tables_on_the_way_do_not_stay(spark):
    """The normalised lines and their blocks are the largest tables on the way: they go as soon as nothing reads them."""
    with scratch_scope(spark):
        rows = L.occurrences_to_drop(spark.createDataFrame([(1, "one line of some words\nother"), (2, "One line of some words!")], "doc_id long, text string"))
        left = [set(spark.read.parquet(p).columns) for p in session._SCOPES[-1] if os.path.exists(p.removeprefix("file:"))]
        assert left and not any("norm" in c and "line_no" in c or c == {"id", "size", "key"} for c in left)
        assert [r.drop for r in rows.collect()] == [[0]]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_blocks_are_the_runs_of_features_with_equal_leading_bits(spark):
    """Lines of any length, also of thousands of blocks; worked out without a lambda for each feature."""
    rng = random.Random(12)
    sizes = [*range(1, 40), 97, 300, 615, 700, 767, 768, 769, 1536, 4000, 9000]
    feats = [sorted(rng.getrandbits(64) - (1 << 63) for _ in range(n)) for n in sizes]
    feats += [sorted({*f[:-1], rng.getrandbits(64) - (1 << 63)}) for f in feats] + [[-(1 << 63), -5, 0, 1 << 62, (1 << 63) - 1], []]
    frame = spark.createDataFrame([(i, len(f), f) for i, f in enumerate(feats)], "id long, size int, f array<long>").repartition(3)
    frame = frame.withColumn("f", F.transform("f", lambda x: x))
    got, want = {}, {}
    for r in L.blocks(frame).collect():
        got.setdefault(r.key, []).append(r.id)
    for i, f in enumerate(feats):
        ask = lambda n: max(0, (min(n / L.PER_BLOCK, L.MOST_BLOCKS)).__floor__().bit_length() - 1)
        for b in {ask(len(f)), ask(len(f) * 1.25)}:
            runs = {}
            for x in f:
                runs.setdefault((x + (1 << 63)) >> (64 - b), []).append(x)
            for run in runs.values():
                if len(run) > 1 or b <= 1:
                    want.setdefault((b, tuple(run)), []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and any(len(v) > 1 for v in want.values())
    assert "lambda" not in L.blocks(frame.drop("f").withColumn("f", F.array(F.lit(1).cast("long"))))._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_dealt_out_before_they_are_compared(spark):
    """Spark moves a plain condition in front of the exchange, where a task or two hold all pairs."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = L._compared(frame([(1, 2), (1, 3)], "a long, b long"), frame([(1, "one long line"), (2, "one long lime"), (3, "other")], "id long, norm string"), 0.8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein") < plan.index("RepartitionByExpression") and plan.count("levenshtein(ta") == plan[:plan.index("RepartitionByExpression")].count("levenshtein(ta")
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


def test_fingerprints_bit_by_bit(spark):
    rng = random.Random(8)
    rows = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.choice([1, 3, 15, 16, 50, 700]))) for _ in range(60)] + [" ".join(f"t{i}" for i in range(3000))]
    got = spark.createDataFrame([(t,) for t in rows], "norm string").select(L.features(F.col("norm")).alias("f"), L.simhash(L.features(F.col("norm"))).alias("fp")).collect()
    for r in got:
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.f) > len(r.f))
        assert r.fp & ((1 << 64) - 1) == want


def test_similar_agrees_with_the_plain_distance_at_every_band(spark):
    rng, rows = random.Random(5), []
    for n in (1, 5, 40, 300, 1500, 4000):
        for share in (0.0, 0.05, 0.19, 0.2, 0.21, 0.5):
            a = [rng.choice("abcd ") for _ in range(n)]
            b = list(a)
            for k in rng.sample(range(n), int(share * n)):
                b[k] = "z"
            rows.append(("".join(a), "".join(b), int(share * n)))
    got = spark.createDataFrame(rows, "a string, b string, d int").select("a", "d", L.similar(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        if r.d * 5 <= len(r.a) or r.d * 4 > len(r.a):      # replaced letters bound the distance from above
            assert r.s == (r.d * 5 <= len(r.a)), (len(r.a), r.d)


def test_a_line_that_a_third_of_all_documents_share_and_a_long_line(spark):
    long = " ".join(f"word{i}" for i in range(12_000))
    rows = [(i, f"shared   LINE number {i}\nunique {chr(97 + i % 26) * 7} {'xyz'[i % 3] * 9} {i % 26 * 'q'}o") for i in range(300)] + [(900, long), (901, long.replace("word77 ", "other "))]
    got = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text.startswith("shared") and sum("shared" in r.text for r in got.values()) == 1
    assert got[900].n_dropped == 0 and got[901].text == ""


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.text for r in L.dedup_lines(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")).orderBy("doc_id").collect()] == [None, ".."]


def test_normal_form(spark):
    texts = {"Ünder 12.5%, ok!": "ünder 12 5 ok", " \t": "", "a--b": "a b", "№ 7": "№ 7"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.normal(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == texts


def test_numbers_and_unicode_punctuation_do_not_tell_lines_apart(spark):
    texts = {"Ünder 12.5%, ok!": "ünder 0 0 ok", "№ 7": "0", "“a”\u00a0— b…": "a b", "a1b22": "a0b0", "٣ x": "0 x", "—…": "", "a\u00a0 – \u00a0b": "a b"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.folded(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == texts
    rows = [(1, "Page 1 of 20"), (2, "Page 17 of 20"), (3, "It’s “free” – now…"), (4, "It's \"free\" - now..."), (5, "Printed\u00a0on 2024-01-02"), (6, "printed on 1999-12-31"), (7, "—…"), (8, "—…")]
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.n_dropped} == {2, 4, 6}


def test_word_by_word_is_never_below_the_distance(spark):
    rng, rows = random.Random(1), [("a", "a"), ("a b", "b"), ("b", "a b"), ("x" * 70 + " a", "y" * 70 + " a")]
    for _ in range(600):
        w = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))]
        v = list(w)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(v) + 1)
            v[at:at + rng.randint(0, 2)] = [rng.choice(["a", "bcb", "cc"]) for _ in range(rng.randint(0, 2))]
        rows.append((" ".join(w), " ".join(v) or "q"))
    got = spark.createDataFrame(rows, "a string, b string").select(F.levenshtein("a", "b").alias("d"), L._by_words(F.col("a"), F.col("b")).alias("w")).collect()
    assert all(r.w >= r.d for r in got) and sum(r.w == r.d for r in got) > 0.7 * len(got)


def test_ends_that_differ_are_proof_of_the_distance(spark):
    """Unlike lines that share a passage are told apart by their ends; no pair within the distance is."""
    rng, rows = random.Random(21), []
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(400):
        a = text(rng.randint(0, 90))
        b = list(a)
        for _ in range(rng.randint(0, 1 + len(a) // 3)):
            at = rng.choice([0, len(b), rng.randrange(len(b) + 1)])
            b[at:at + rng.randint(0, 3)] = text(rng.randint(0, 3))
        rows.append((a, "".join(b), False))
    for _ in range(20):
        shared = text(60)
        rows += [(text(120) + shared, text(110) + shared, True), (shared + text(120), shared + text(125), True), (text(80) + shared, text(80) + shared + text(9), True)]
    frame = spark.createDataFrame(rows, "a string, b string, unlike boolean").withColumn("d", F.levenshtein("a", "b"))
    frame = frame.withColumn("most", F.floor(F.greatest(F.char_length("a"), F.char_length("b")) * F.lit(1.0 - L.SIMILARITY) + F.lit(1e-9)).cast("int"))
    got = frame.select("*", L._ends_differ(F.col("a"), F.col("b"), F.col("most")).alias("ends"), L.similar(F.col("a"), F.col("b")).alias("s"), L.similar(F.col("a"), F.col("b"), ends_first=True).alias("t")).collect()
    assert all(r.d > r.most for r in got if r.ends) and all(r.s == r.t == (r.d <= r.most) for r in got)
    assert all(r.ends for r in got if r.unlike) and sum(r.s for r in got) > 100


def test_spanning_links_connect_the_same_lines(spark):
    rng = random.Random(4)
    stock = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(25)) for _ in range(8)]
    texts = set(stock)
    for k in range(120):
        w = rng.choice(stock).split(" ")
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"z{k}"
        texts.add(" ".join(w))
    every, some = linked_pairs(spark, texts), linked_pairs(spark, texts, spanning=True)
    assert some <= every and len(some) < len(every)
    same = lambda pairs: {frozenset(t for t, g in components(texts, pairs).items() if g == h) for h in components(texts, pairs).values()}
    assert same(every) == same(some)


def test_lines_that_share_a_block_of_one_feature_only_are_compared(spark):
    """Links are those of all pairs that have any block in common, however few features it holds, found in plain Python."""
    rng, texts = random.Random(31), set()
    for k in range(300):
        w = [f"{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}{rng.randrange(10 ** 4)}" for _ in range(rng.choice([12, 15, 17, 25, 40]))]
        v = list(w)
        for at in rng.sample(range(len(v)), len(v) // 6):
            v[at] = v[at][:-1] + "x"
        texts |= {" ".join(w), " ".join(v)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.features(F.col("t")).alias("f"), L.simhash(L.features(F.col("t"))).alias("fp")).collect()
    lines, more = {r.t: (r.f, r.fp) for r in rows}, {}

    def runs(f):
        ask = lambda n: max(0, int(n / L.PER_BLOCK).bit_length() - 1)
        for b in {ask(len(f)), ask(len(f) * 1.25)}:
            by = {}
            for x in f:
                by.setdefault((x + (1 << 63)) >> (64 - b), []).append(x)
            yield from ((b, *r) for r in by.values())
    for a, b in similar_pairs(texts):
        if ((lines[a][1] ^ lines[b][1]) & ((1 << 64) - 1)).bit_count() <= L.DISTANCE:
            common = set(runs(lines[a][0])) & set(runs(lines[b][0]))
            if common:
                more[a, b] = all(len(r) == 2 and r[0] > 1 for r in common)
    assert sum(more.values()) >= 3
    assert linked_pairs(spark, texts) == set(more)


def test_fingerprints_from_sums_are_those_of_each_line(spark):
    rng = random.Random(13)
    feats = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 40, 255, 256, 70_000)] + [[-1] * 70_001, [-(1 << 63)] * 3, [0, -1], [1 << 62]]
    frame = spark.createDataFrame(list(enumerate(feats)), "id long, f array<long>").repartition(3)
    want = {r.id: r.fp for r in frame.select("id", L.simhash(F.col("f")).alias("fp")).collect()}
    assert {r.id: r.fp for r in L.fingerprints(frame).collect()} == want
