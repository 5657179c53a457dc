"""Token alignment: fragments against whole texts, the query against plain Python over every document."""

import hashlib
import random
from collections import Counter

import pytest

from fathom.llm import token_align as T

FILES = T.read_files()
PAIR = T.Pair.of(FILES)


def reference_ids(text):
    from tokenizers import Tokenizer
    if "t" not in _tok:
        _tok["t"] = Tokenizer.from_str(FILES[0].decode())
        _tok["t"].encode_special_tokens = True
    return _tok["t"].encode(" " + text, add_special_tokens=False).ids, PAIR.b.model.encode(text)


_tok: dict = {}


def plain(text):
    """(n_a, n_b, groups text, links) of one text by walking both token lists byte by byte."""
    if not text:
        return 0, 0, "", []
    a, b = reference_ids(text)
    raw = (" " + text).encode()
    if any(b"".join(t.bytes[k] for k in ids) != raw for t, ids in ((PAIR.a, a), (PAIR.b, b))):
        return 0, 0, "", []
    spans = []
    for t, ids in ((PAIR.a, a), (PAIR.b, b)):
        at, out = 0, []
        for k in ids:
            out.append((at, at := at + len(t.bytes[k]), k))
        spans.append(out)
    common = {s[1] for s in spans[0]} & {s[1] for s in spans[1]}
    groups, i, j = [], 0, 0
    for end in sorted(common):
        sides = []
        for out, start in ((spans[0], i), (spans[1], j)):
            stop = start
            while stop < len(out) and out[stop][1] <= end:
                stop += 1
            sides.append((start, stop))
        (i0, i), (j0, j) = sides
        groups.append((spans[0][i0:i], spans[1][j0:j]))
    links = [(x[2], y[2]) for g in groups for x in g[0] for y in g[1] if x[0] < y[1] and y[0] < x[1]]
    return len(a), len(b), ";".join(",".join(str(x[2]) for x in g[0]) + "|" + ",".join(str(y[2]) for y in g[1]) for g in groups), links


def brute(rows):
    """Result rows of (doc_id, text) pairs, sorted."""
    done = [(i, *plain(t)) for i, t in rows]
    count = Counter(link for d in done for link in d[4])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted((str(i), na, nb, g.count(";") + bool(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
                   hashlib.sha256(g.encode()).hexdigest() if g else "") for i, na, nb, g, links in done)


def plain_rows(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


ODD = ["", "a", " ", "   x  y ", "\n\nx\n", "<|endoftext|> <s> </s> <0x0A> <unk>", "a▁b", "tab\there\r\nline", "naïve façade — 日本語テキスト", "🙂🙃 é", "\x00\x01", "﻿bom",
       "don't we'll I'M", "x" * 500, "日本語" * 300, "a  b   c    d " * 60, "١٢٣ 12 ½", "  \x85\xa0 z", "end ", "ab" * 400 + " " + "\n" * 40 + "q"]


def random_text(rng):
    alphabet = ["the", "ing", " ", " ", "  ", "\n", "é", "日", "本", "🙂", "'s", "1", "23", ".", "!!", "Ab", "x▁" if rng.random() < 0.05 else "x", "\t", "qu", "zz"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400)))


def test_byte_merges_agree_with_the_reference_library():
    rng = random.Random(5)
    assert PAIR.a.fast is not None and PAIR.b.bare
    for text in [*ODD, *(random_text(rng) for _ in range(300)), " " * 60_000 + "x"]:
        assert PAIR.a.encode(" " + text) == reference_ids(text)[0]


@pytest.mark.parametrize("chunk", [3, 16, 64])
def test_ranges_compose_to_the_whole_text_in_any_order(chunk):
    rng = random.Random(chunk)
    opened = 0
    for text in [*ODD, *(random_text(rng) for _ in range(120))]:
        if not text:
            continue
        pa_, pb_ = T.cuts(text, PAIR, chunk)
        parts = []
        for k in range(len(pa_) - 1):
            at = [len((" " + text[:p[k]]).encode()) if p[k] else 0 for p in (pa_, pb_)]
            t, whole = T.range_tokens(text, (pa_[k], pa_[k + 1], pb_[k], pb_[k + 1]), tuple(at), PAIR)
            parts.append(T.fragment(t if whole else T.NONE, whole, PAIR))
            opened += len(parts[-1].prefix.a) + len(parts[-1].suffix.b) > 2

        def joined(fs):       # a random bracketing
            if len(fs) == 1:
                return fs[0]
            at = rng.randrange(1, len(fs))
            return T.compose(joined(fs[:at]), joined(fs[at:]), PAIR)

        got, (na, nb, groups, links) = T.finished(joined(parts), PAIR), plain(text)
        if not groups:
            assert got is None
            continue
        f = joined(parts)
        assert (f.n_a, f.n_b, got.text, got.n) == (na, nb, groups, groups.count(";") + 1)
        assert Counter({(p // PAIR.size_b, p % PAIR.size_b): n for p, n in zip(got.pairs.tolist(), got.times.tolist())}) == Counter(links)
    assert opened


@pytest.mark.parametrize("chunk,head", [(1 << 15, 1 << 18), (50, 10), (7, 0)])
def test_rows(spark, chunk, head):
    rng = random.Random(1)
    rows = [(k, t) for k, t in enumerate([*ODD, None, *(random_text(rng) for _ in range(30))])]
    rows += [rows[18], rows[18], (None, rows[14][1]), (200, rows[19][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, `pairs.x` string").repartition(5)
    got = T.score_alignment(df, ["doc_id"], chunk=chunk, head=head)
    assert plain_rows(got) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.score_alignment(df, ["doc_id"]).collect() == []


def test_query_whole_table(spark):
    from fathom.llm.queries import op11_token_align
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert plain_rows(op11_token_align(spark, sf)) == brute(rows)
