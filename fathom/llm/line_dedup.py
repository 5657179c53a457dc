"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence a group.

Only DataFrame expressions. A line's features are the pairs of neighbouring words (single words in short lines), a set of
64-bit hashes. They give two things: the line's 64-bit SimHash, and its *blocks*: the features are dealt by their leading bits into
a power of two of blocks, about ``PER_BLOCK`` each; a block that got one feature counts like any other. A changed word touches at most four
features, so by the pigeonhole principle lines with few changes keep some block whole, and two lines are compared if they
share a block. (Blocks cut from the 64 bits of the fingerprint themselves cannot do this: lines with one word in ten changed
differ in 9 bits on average, and blocks that allow for that are a few bits long and shared by nearly all lines.) Compared lines link
if their fingerprints differ in at most ``DISTANCE`` bits and their edit similarity is at least ``SIMILARITY``; linked groups
are connected components, and of each group the first occurrence (smallest document id, then line number) stays. Equal normalised
lines are one node with a count, however common.

A block with at most ``CROWD`` lines is joined pair by pair. The lines of a larger one (a crowd of near-identical lines, or words that
many lines share) are compared with its first line; then, once the links found so far have formed groups, all its pairs in different
groups are tried, by length and fingerprint where they meet and by edit similarity if these allow it. Only lines outside the
block's largest group start such pairs, and a block is dealt into parts that meet two at a time, so none is brought together whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import K1, K2, join_counted, maybe_in, only, row_key, saved
from fathom.llm.components import components
from fathom.session import release, shuffles_dropped

DISTANCE = 20
SIMILARITY = 0.8
CROWD = 256
PART = 3500               # lines of a part of a crowd; Spark keeps up to 4096 rows of a key in memory as they are
PER_BLOCK = 3             # features a block holds on average (rounded to a power of two of blocks)
SHORT_WORDS = 16          # lines with fewer words have single words as features
MOST_BLOCKS = 1 << 20
FINE = 7                  # bits of blocks whose starts are looked for at once
SLICES = 24               # bits of a counter: features of a line
END = 0.3                 # share of a line whose distance may tell that the whole is not similar
WORD = 64                 # longer words that differ count as changed from end to end


def normal(line: Column) -> Column:
    """Lower case, every run of ASCII punctuation, control characters and space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def folded(line: Column) -> Column:
    """The form in which lines are compared: ``normal``, and any other run without a letter or digit is one space too, and every number reads as 0."""
    plain = normal(line)
    other = F.regexp_replace(F.trim(F.regexp_replace(plain, r" *[^\p{L}\p{Nd} ][^\p{L}\p{Nd}]*", " ")), r"\p{Nd}+", "0")
    return F.when(F.octet_length(plain) == F.char_length(plain), F.regexp_replace(plain, "[0-9]+", "0")).otherwise(other)      # ASCII: all else is gone


def features(norm: Column) -> Column:
    """Sorted distinct hashes of the pairs of neighbouring words, or of the words of a short line; what repeats counts again.

    A pair that occurs more than 1, 2, 4, 8, ... times has a feature for each of these, so lines of few different words
    (numbers read as 0) that differ in little share most features too.
    Here and below a lambda refers to its own arguments only: anything else in it would be worked out again for every element.
    """
    def every(w: Column) -> Column:
        n = F.size(w) - 1
        pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.sort_array(F.when(F.size(w) < SHORT_WORDS, F.transform(w, lambda a: F.xxhash64(a))).otherwise(pairs))

    def again(s: Column, j: Column) -> Column:
        """Elements of a sorted array that stand again ``j`` places on."""
        n = F.greatest(F.size(s) - j, F.lit(0))
        return F.filter(F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, j + 1, n), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())

    def times(r: Column) -> Column:
        """A run of n in ``r`` stands for n + 1 equal elements."""
        powers = F.sequence(F.lit(0), F.floor(F.log2(F.size(r).cast("double"))).cast("int"))
        return F.flatten(F.transform(powers, lambda j: F.transform(F.array_distinct(again(r, F.pow(F.lit(2), j).cast("int") - 1)), lambda x: F.xxhash64(x, j))))
    both = lambda s, r: F.when(F.size(r) == 0, s).otherwise(F.sort_array(F.array_distinct(F.concat(s, times(r)))))
    repeats = lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), F.array().cast("array<bigint>")).otherwise(again(s, F.lit(1)))
    with_runs = F.transform(F.transform(F.array(F.split(norm, " ")), every), lambda s: F.struct(s.alias("s"), repeats(s).alias("r")))
    return F.transform(with_runs, lambda x: both(x["s"], x["r"]))[0]


def blocks(rows: DataFrame, ones: bool = False) -> DataFrame:
    """(id, size, key) of the blocks of lines (id, size, f: their features), for the number of blocks that a line's features ask for and for that
    of a line a quarter longer (if it differs), so that lines of similar length have one number in common. ``ones``: blocks of one feature
    too; without it they are given only where there are at most two blocks.

    The features are sorted, so a block is a run of them: the smallest values of the blocks are sorted in among them and show where each run starts
    and ends. No step goes through the features one by one in a lambda, which Spark would interpret. Lines of over ``2 ** FINE`` blocks are
    cut by their leading bits first, so that a start is looked for among a few hundred features.
    """
    def bits(n: Column) -> Column:
        return F.greatest(F.floor(F.log2(F.least(n / PER_BLOCK, F.lit(float(MOST_BLOCKS))))), F.lit(0)).cast("int")

    def power(e: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), e)

    least, zero, most = F.lit(-(1 << 63)).cast("long"), F.lit(0).cast("long"), F.lit((1 << 63) - 1).cast("long")

    def starts(b: Column) -> Column:
        """Smallest value of each of 2 ** b blocks. A sequence may not be longer than the largest long: negative values, then the others."""
        width = power(F.lit(64) - F.greatest(b, F.lit(2)))
        return F.when(b == 0, F.array(least)).when(b == 1, F.array(least, zero)).otherwise(F.concat(F.sequence(least, F.lit(-1).cast("long"), width), F.sequence(zero, most, width)))

    def runs(of: DataFrame, *kept: str) -> DataFrame:
        """A row per element of ``starts``: where in ``s``, the sorted features and starts, its run begins (``at``), and its length (``n``)."""
        each = of.select(*kept, "s", "starts", F.posexplode("starts").alias("i", "start"))
        after = F.when(F.col("i") + 1 < F.size("starts"), F.array_position("s", F.get("starts", F.col("i") + 1))).otherwise(F.size("s") + 1)
        found = each.select(*kept, "s", "start", F.array_position("s", F.col("start")).cast("int").alias("at"), after.cast("int").alias("after"))
        return found.select(*kept, "s", "start", (F.col("at") + 1).alias("at"), (F.col("after") - F.col("at") - 1).alias("n"))

    n = F.size("f").cast("double")
    own, next_ = bits(n), bits(n * 1.25)
    rows = rows.select("id", "size", "f", F.explode(F.when(own == next_, F.array(own)).otherwise(F.array(own, next_))).alias("b"))
    rows = rows.select("id", "size", "f", "b", F.when(F.col("b") <= FINE, 0).otherwise(F.greatest(F.col("b") - FINE, F.lit(2))).alias("lead"))
    short, width = F.col("lead") == 0, power(F.lit(64) - F.col("b"))
    rows = rows.select("id", "size", "b", "lead", "f", starts(F.col("lead")).alias("starts"))
    rows = runs(rows.select("id", "size", "b", "lead", "starts", F.when(short, F.concat("starts", "f")).otherwise(F.sort_array(F.concat("f", "starts"))).alias("s")), "id", "size", "b", "lead")
    rows = rows.where("n > 0").select("id", "size", "b", "lead", "start", F.slice("s", F.col("at"), F.col("n")).alias("f"))
    rows = rows.select("id", "size", "b", "f", F.when(short, starts(F.col("b"))).otherwise(
        F.sequence("start", F.col("start") + (power(F.lit(64) - F.col("lead")) - width), width)).alias("starts"))
    rows = runs(rows.select("id", "size", "b", "starts", F.sort_array(F.concat("f", "starts")).alias("s")), "id", "size", "b")
    return rows.where("n >= 1" if ones else "n >= 2 OR (n = 1 AND b <= 1)").select("id", "size", F.xxhash64("b", F.slice("s", F.col("at"), F.col("n"))).alias("key"))


def simhash(feats: Column) -> Column:
    """64-bit fingerprint: a bit is set if more than half of the features set it."""
    return F.when(F.size(feats) < 256, _majority(feats, 8)).otherwise(_majority(feats, SLICES))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(id, fp) of lines (id, f: their features): ``simhash`` of each, from sums and without a lambda. Two bits' counters share a long."""
    halves = (1 << 32) | 1
    sums = [F.sum(F.shiftright("h", j).bitwiseAND(halves)).alias(f"s{j}") for j in range(32)]
    counted = rows.select("id", F.explode("f").alias("h")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), *sums)

    def bit(i: int) -> Column:
        held = F.col(f"s{i % 32}")
        set_in = F.shiftright(held, 32) if i >= 32 else held.bitwiseAND((1 << 32) - 1)
        return F.when(set_in * 2 > F.col("n"), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
    return counted.select("id", reduce(Column.bitwiseOR, [bit(i) for i in range(64)]).alias("fp"))


def _majority(feats: Column, slices: int) -> Column:
    """The 64 counters are kept bit by bit: slice j holds bit j of all of them, so adding a feature is a carry through the
    slices, and comparing all counters with half of the features is a walk over the slices from the top."""
    def add(acc: Column, f: Column) -> Column:
        out, carry = [], f
        for j in range(slices):
            held = acc[f"c{j}"]
            out.append(held.bitwiseXOR(carry).alias(f"c{j}"))
            carry = held.bitwiseAND(carry)
        return F.struct((acc["n"] + 1).alias("n"), *out)

    def over(acc: Column) -> Column:
        more, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        half = F.call_function("shiftright", acc["n"], F.lit(1))
        for j in reversed(range(slices)):
            bit = F.when(half.bitwiseAND(1 << j) != 0, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))
            held = acc[f"c{j}"]
            more = more.bitwiseOR(equal.bitwiseAND(held).bitwiseAND(F.bitwise_not(bit)))
            equal = equal.bitwiseAND(F.bitwise_not(held.bitwiseXOR(bit)))
        return more

    zero = F.struct(F.lit(0).alias("n"), *[F.lit(0).cast("long").alias(f"c{j}") for j in range(slices)])
    return F.aggregate(feats, zero, add, over)


def _by_words(a: Column, b: Column) -> Column:
    """No less than the edit distance: the words of the shorter line stand against those of the longer one, which has one gap.

    Words before the gap meet at equal places from the front, words after it at equal places from the back; the gap is where that needs
    least. Lines with words replaced, and words put in or left out at one place, get nearly their distance.
    """
    longer = lambda x, y: F.greatest(F.char_length(x), F.char_length(y))
    need = lambda x, y: F.when(x == y, 0).when(longer(x, y) <= WORD, F.levenshtein(x, y)).otherwise(longer(x, y))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    # what is used at several places is bound to the argument of a lambda: a condition works it out again at each place otherwise
    bound = lambda of, then: F.transform(F.array(F.struct(*[c.alias(k) for k, c in of.items()])), then)[0]

    def ordered(w: Column) -> Column:
        swap = F.size(w["a"]) > F.size(w["b"])
        return bound({"few": F.when(swap, w["b"]).otherwise(w["a"]), "many": F.when(swap, w["a"]).otherwise(w["b"])}, aligned)

    def aligned(w: Column) -> Column:
        n, gap = F.size(w["few"]), F.size(w["many"]) - F.size(w["few"])
        back = F.zip_with(w["few"], F.slice(w["many"], gap + 1, n), need)
        with_gap = bound({"back": back, "front": F.zip_with(w["few"], F.slice(w["many"], F.lit(1), n), need),
                          "lengths": F.transform(w["many"], lambda x: F.char_length(x)), "n": n, "gap": gap}, gapped)
        return F.when(gap == 0, total(back)).otherwise(with_gap)

    def gapped(w: Column) -> Column:
        n, gap = w["n"], w["gap"]
        ahead = F.zip_with(F.slice(w["lengths"], gap + 1, n), F.slice(w["lengths"], F.lit(1), n), lambda x, y: x - y)
        moved = F.zip_with(F.zip_with(w["front"], w["back"], lambda x, y: x - y), ahead, lambda x, y: x + y)       # what one word more before the gap changes
        lowest = F.aggregate(moved, F.struct(F.lit(0).alias("s"), F.lit(0).alias("low")),
                             lambda st, x: F.struct((st["s"] + x).alias("s"), F.least(st["low"], st["s"] + x).alias("low")), lambda st: st["low"])
        return total(w["back"]) + total(F.slice(w["lengths"], F.lit(1), gap)) + gap + lowest
    return bound({"a": F.split(a, " "), "b": F.split(b, " ")}, ordered)


def _ends_differ(a: Column, b: Column, most: Column) -> Column:
    """The beginnings or the ends of the lines prove an edit distance of more than ``most``.

    Let b be longer by d. An alignment takes the first p characters of a to the first p + s of b, and the rest costs at least abs(d - s);
    so p characters of a and p + d of b are no further apart than the whole lines, and the same holds from the back. ``END`` of the line is enough
    for ends that have nothing in common, at a quarter of the work of comparing the whole.
    """
    na, nb = F.char_length(a), F.char_length(b)
    p = F.floor(F.least(na, nb) * F.lit(END)).cast("int")
    pa, pb = p + F.greatest(na - nb, F.lit(0)), p + F.greatest(nb - na, F.lit(0))
    front = F.call_function("levenshtein", F.substr(a, F.lit(1), pa), F.substr(b, F.lit(1), pb), most)
    back = F.call_function("levenshtein", F.substr(a, na - pa + 1, pa), F.substr(b, nb - pb + 1, pb), most)
    return (front < 0) | (back < 0)


def similar(a: Column, b: Column, least: float = SIMILARITY, ends_first: bool = False) -> Column:
    """Edit similarity 1 - distance / longer length is at least ``least``. ``ends_first``: few of the pairs are expected to be; the result is the same.

    Spark's distance takes time in the product of the lengths. Ways to align the lines piece by piece need less and give no less than
    the distance, and the ends of the lines give no more, so they are tried first: word by word, the ends, then pieces at equal places
    where these need less than the whole. Lines that these leave open are compared whole.
    """
    longer = F.greatest(F.char_length(a), F.char_length(b))
    most = F.floor(longer * F.lit(1.0 - least) + F.lit(1e-9)).cast("int")
    out = F.call_function("levenshtein", a, b, most) >= 0
    for size in (2048, 256):
        places = F.sequence(F.lit(0), F.floor(F.greatest(longer - 1, F.lit(0)) / size).cast("int"))
        pieces = F.aggregate(places, F.lit(0), lambda n, i: n + F.levenshtein(F.substr(a, i * size + 1, F.lit(size)), F.substr(b, i * size + 1, F.lit(size))))
        out = F.when((longer > 4 * size) & (pieces <= most), F.lit(True)).otherwise(out)
    proofs = [(_by_words(a, b) <= most, True), (_ends_differ(a, b, most), False)]
    for proof, result in proofs if ends_first else reversed(proofs):
        out = F.when(proof, F.lit(result)).otherwise(out)
    return out


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Non-blank lines of all documents: K1, K2, doc_id, line_no, norm, l1, l2 (hash of the normalised line).

    Written once, so that each line is normalised once. A text is hashed below the explode, once and not once a line."""
    docs = only(docs, doc_id, text).toDF("doc_id", "text")
    docs = docs.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", F.split("text", "\n", -1).alias("lines"))
    rows = docs.select(K1, K2, "doc_id", F.posexplode("lines").alias("line_no", "line")).select(K1, K2, "doc_id", "line_no", folded(F.col("line")).alias("norm"))
    return saved(rows.select("*", F.xxhash64("norm").alias("l1"), F.xxhash64(F.lit(9), "norm").alias("l2")), "zstd").where("norm <> ''")


def _alike(a: str, b: str, similarity: float) -> Column:
    """Lengths that allow the similarity."""
    return F.least(f"{a}.size", f"{b}.size") >= F.floor(F.greatest(f"{a}.size", f"{b}.size") * F.lit(similarity) - F.lit(1e-9))


def _bits() -> Column:
    """Bits in which the fingerprints of x and y differ."""
    return F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))


def _may_link(similarity: float, distance: int | None) -> Column:
    """Lengths, and with ``distance`` fingerprints too, allow a link of x and y."""
    return _alike("x", "y", similarity) if distance is None else _alike("x", "y", similarity) & (_bits() <= distance)


def _pairs(rows: DataFrame, key: str, similarity: float, distance: int | None = None) -> DataFrame:
    """Pairs a < b of ids that share ``key`` and may be similar by their lengths; with ``distance`` by their ``fp`` too, and with ``bits``."""
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.id") < F.col("y.id")) & _may_link(similarity, distance))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), *[] if distance is None else [_bits().alias("bits")])


def _with_first(rows: DataFrame, key: str, similarity: float, distance: int | None = None) -> DataFrame:
    """Pairs of each id with the smallest id that shares ``key``: as many as rows."""
    first = rows.groupBy(key).agg(F.min(F.struct("id", *[c for c in ("size", "fp") if c in rows.columns])).alias("r")).select(key, "r.*")
    met = rows.alias("x").join(first.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.id") > F.col("y.id")) & _may_link(similarity, distance))
    return met.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), *[] if distance is None else [_bits().alias("bits")])


def _shared_blocks(nodes: DataFrame) -> DataFrame:
    """(key, id, size, n) of blocks that n > 1 of the nodes (id, norm, size) have."""
    # features in a projection of their own: used at several places of one expression they would be worked out at each
    cut = nodes.select("id", "size", features(F.col("norm")).alias("f"))
    keyed = saved(blocks(cut, ones=True))
    shared = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = saved(maybe_in(keyed, shared, "key").where("__llm_maybe").drop("__llm_maybe").join(shared, "key"))
    release(keyed)
    return rows


def _first_pairs(rows: DataFrame, similarity: float, crowd: int, distance: int | None = None) -> DataFrame:
    pairs = _pairs(rows.where(F.col("n") <= crowd), "key", similarity, distance)
    return pairs.unionByName(_with_first(rows.where(F.col("n") > crowd), "key", similarity, distance)).distinct()


def candidates(nodes: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of nodes (id, norm, size) to compare first: those that share a block, in crowds those with its first line.
    The other pairs of crowds are those of ``crowd_pairs``."""
    return _first_pairs(_shared_blocks(nodes), similarity, crowd)


def crowd_pairs(crowded: DataFrame, prints: DataFrame, labels: DataFrame | None = None, distance: int = DISTANCE, similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """All pairs (a, b) of different groups that share a block of ``crowded`` (key, id, size) and whose lengths and fingerprints allow a link.

    ``prints`` is (id, fp), ``labels`` (node, label) the groups; without it every line is one. In a block the lines outside its largest group
    meet all lines, in parts of about ``part`` lines: the work is the product of the two numbers, a task has two parts of them.
    """
    rows = crowded.select("key", "id", "size").join(prints, "id")
    rows = rows.withColumn("label", F.col("id")) if labels is None else rows.join(labels.toDF("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    rows = saved(rows)
    groups = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    held = groups.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).where("top.n < n")
    parts = lambda n: F.ceil(n / F.lit(part)).cast("int")
    held = saved(held.select("key", "n", F.col("top.label").alias("top"), parts(F.col("n") - F.col("top.n")).alias("xs"), parts(F.col("n")).alias("ys")))
    total = held.agg(F.sum("n")).head()[0] or 0
    rows = saved(join_counted(rows, held, ["key"], "n", total).where("top IS NOT NULL").drop("n"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n)).cast("int")
    x = rows.where("label <> top").select("key", "id", "size", "fp", "label", dealt("xs").alias("i"), every("ys").alias("j")).alias("x")
    y = rows.select("key", "id", "size", "fp", "label", "top", dealt("ys").alias("j"), every("xs").alias("i")).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "i", "j")]
    once = (F.col("y.label") == F.col("y.top")) | (F.col("x.id") > F.col("y.id"))
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    met = x.join(y, same[0] & same[1] & same[2] & (F.col("x.label") != F.col("y.label")) & once & _alike("x", "y", similarity) & near)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _compared(pairs: DataFrame, words: DataFrame, similarity: float, ends_first: bool = False) -> DataFrame:
    """The pairs (a, b) whose lines, of ``words`` (id, norm), are similar."""
    met = pairs.join(words.toDF("a", "ta"), "a").join(words.toDF("b", "tb"), "b")
    # a pair is few bytes and much work: without a fixed number adaptive execution would put them in a task or two. The row's number
    # keeps the comparing behind the exchange: the optimizer would move it in front, to the few tasks of the join
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b").withColumn("row", F.monotonically_increasing_id())
    return met.where((F.col("row") >= 0) & similar(F.col("ta"), F.col("tb"), similarity, ends_first)).select("a", "b")


def near_lines(nodes: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY, crowd: int = CROWD, spanning: bool = False) -> DataFrame:
    """Links (a, b) between nodes (id, norm, size). Fingerprints are made for lines that share a block, and tried where the lines of a block meet.

    ``spanning``: links between lines that other links already connect may be left out. Each line is compared with the candidate of
    the nearest fingerprint first; then only pairs that this leaves in different groups are compared, those of crowds last. The components are the same.
    """
    rows = _shared_blocks(nodes)

    def of_ids(ids: DataFrame) -> DataFrame:
        return maybe_in(nodes, ids, "id").where("__llm_maybe").join(ids, "id", "left_semi").select("id", "norm")
    cut = of_ids(saved(rows.select("id").distinct())).select("id", features(F.col("norm")).alias("f"))
    prints = saved(fingerprints(cut))
    marked = saved(rows.join(prints, "id"))
    release(rows)
    near = saved(_first_pairs(marked, similarity, crowd, distance))
    crowded = saved(marked.where(F.col("n") > crowd).select("key", "id", "size"))
    release(marked)
    ids = [near.select(F.col("a").alias("id")), near.select(F.col("b").alias("id")), crowded.select("id")]
    words = saved(of_ids(saved(ids[0].unionByName(ids[1]).unionByName(ids[2]).distinct())), "zstd")

    def links(of: DataFrame, ends_first: bool = False) -> DataFrame:
        return saved(_compared(of, words, similarity, ends_first))
    crowds = not crowded.isEmpty()
    if not spanning:
        near = near.select("a", "b")
        found = links(near.unionByName(crowd_pairs(crowded, prints, None, distance, similarity)).distinct() if crowds else near)
    else:
        first = links(near.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("m")).select("m.a", "b"))
        labels = components(first)
        apart = near.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
        found = first.unionByName(links(apart.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"), ends_first=True))
        if crowds:
            found = found.unionByName(links(saved(crowd_pairs(crowded, prints, components(found), distance, similarity)), ends_first=True))
    release(crowded)
    return found


def occurrences_to_drop(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, similarity: float = SIMILARITY,
                        crowd: int = CROWD) -> DataFrame:
    """(K1, K2, drop: line numbers) of documents that lose lines."""
    with shuffles_dropped(docs.sparkSession):
        lines = _lines(docs, doc_id, text)
        seen = saved(lines.drop("norm"))
        nodes = lines.groupBy("l1", "l2", "norm").agg(F.count(F.lit(1)).alias("n")).select("l1", "l2", "n", "norm", F.char_length("norm").alias("size"), F.monotonically_increasing_id().alias("id"))
        nodes = saved(nodes, "zstd")
        release(lines)
        labels = components(near_lines(nodes.select("id", "norm", "size"), distance, similarity, crowd, spanning=True))
        named = nodes.select("l1", "l2", "n", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        # lines that another line repeats, equal or similar; only their occurrences are looked at again
        named = named.where("n > 1").unionByName(named.where("n = 1").join(labels.select(F.col("node").alias("id")), "id", "left_semi"))
        named = saved(named.select("l1", "l2", "n", "label"))
        release(nodes)
        total = named.agg(F.sum("n")).head()[0] or 0
        met = saved(join_counted(saved(maybe_in(seen, named, "l1").where("__llm_maybe").drop("__llm_maybe")), named, ["l1", "l2"], "n", total).where("label IS NOT NULL"))
        first = F.struct("doc_id", K1, K2, "line_no")
        keep = saved(met.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("keep")))
    out = join_counted(met.drop("n"), keep, ["label"], "n", total)
    return out.where(~first.eqNullSafe(F.col("keep"))).groupBy(K1, K2).agg(F.collect_set("line_no").alias("drop"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (the lines that stay, joined as before).

    Lines end at a line feed. Blank lines (nothing but punctuation and space) always stay. Null texts have no
    line and stay null. Rows that repeat an id and a text are the same document and get the same result;
    null ids come first when the first occurrence is chosen. Further columns of any name are not read.
    """
    drop = occurrences_to_drop(docs, doc_id, text, **options).select(K1, K2, F.col("drop").alias("__llm_drop"))
    docs = only(docs, doc_id, text).toDF("doc_id", "text")
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.split("text", "\n", -1).alias("lines"))
    gone = F.coalesce(F.col("__llm_drop"), F.array().cast("array<int>"))
    return rows.join(drop, [K1, K2], "left").select(
        "doc_id", F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"),
        F.array_join(F.filter("lines", lambda x, i: ~F.array_contains(gone, i)), "\n").alias("text"))
