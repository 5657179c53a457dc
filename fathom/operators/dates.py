"""Date formats found from the data: which patterns a text column uses, told by its shapes.

Every value has a shape (letters, runs of digits by length, the signs between them). Shapes that no known pattern can
have are counted together; the others are few, so one map-side aggregate counts per shape how many values each of its
patterns reads. Day-first and month-first patterns share a shape: days above 12 in any shape of the column decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns tried, by shape (E, Y: runs of 8 and 4 digits; D: one or two digits; a: letters), each with
# the order of day and month in it, where another pattern of the shape has the other order.
PATTERNS = {
    "Y-D-D": [("yyyy-M-d", "")],
    "Y/D/D": [("yyyy/M/d", "")],
    "Y.D.D": [("yyyy.M.d", "")],
    "E": [("yyyyMMdd", "")],
    "D/D/Y": [("d/M/yyyy", "day"), ("M/d/yyyy", "month")],
    "D-D-Y": [("d-M-yyyy", "day"), ("M-d-yyyy", "month")],
    "D.D.Y": [("d.M.yyyy", "day"), ("M.d.yyyy", "month")],
    "D a Y": [("d MMM yyyy", ""), ("d MMMM yyyy", "")],
    "D-a-Y": [("d-MMM-yyyy", "")],
    "a D, Y": [("MMM d, yyyy", ""), ("MMMM d, yyyy", "")],
    "Y-D-D D:D": [("yyyy-M-d H:m", "")],
    "Y-D-D D:D:D": [("yyyy-M-d H:m:s", "")],
    "Y-D-DaD:D:D": [("yyyy-M-d'T'H:m:s", "")],
    "D/D/Y D:D": [("d/M/yyyy H:m", "day"), ("M/d/yyyy H:m", "month")],
    "D/D/Y D:D:D": [("d/M/yyyy H:m:s", "day"), ("M/d/yyyy H:m:s", "month")],
}
OTHER = "other"
LONGEST = 40      # longer texts are no dates
SLOTS = max(len(p) for p in PATTERNS.values())


@dataclass(frozen=True)
class DateShape:
    """What was found for one shape: values, values each pattern reads, the pattern chosen and why.

    ``status``: clear (one pattern reads all values, or all that do agree), by_column (day or month first as other values of the column show), preferred (as the caller said),
    mixed (no pattern reads all values: the one that reads most comes first, then the others), ambiguous (nothing decides; not
    converted unless a preference is given), unknown (no pattern).
    """
    shape: str
    n: int
    read: tuple[int, ...]
    formats: tuple[str, ...]
    status: str


def shape_of(c: Column) -> Column:
    text = F.regexp_replace(F.trim(c.cast("string")), "[A-Za-z]+", "a")
    text = F.regexp_replace(text, "(?<![0-9])[0-9]{8}(?![0-9])", "E")
    text = F.regexp_replace(text, "(?<![0-9])[0-9]{4}(?![0-9])", "Y")
    text = F.regexp_replace(text, "(?<![0-9])[0-9]{1,2}(?![0-9])", "D")
    return F.when(F.length(c) <= LONGEST, F.when(text.isin(list(PATTERNS)), text)).otherwise(F.lit(None))


def _read(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(F.trim(c.cast("string")), F.lit(pattern)).cast("date")


def detect_date_formats(df: DataFrame, col: str, prefer: str | None = None) -> list[DateShape]:
    """The shapes of the non-null values of ``col`` (at most one entry a known shape, and one for the rest), most frequent first.

    ``prefer`` ("day" or "month") settles what the data leaves open. One pass; a task sends a row per shape.
    """
    if prefer not in (None, "day", "month"):
        raise ValueError("prefer must be 'day', 'month' or None")
    c = F.col("`" + col.replace("`", "``") + "`")
    base = df.where(c.isNotNull()).select(c.cast("string").alias("c")).withColumn("shape", shape_of(F.col("c")))
    slots = []
    for i in range(SLOTS):
        made = F.lit(None).cast("date")
        for shape, patterns in PATTERNS.items():
            if i < len(patterns):
                made = F.when(F.col("shape") == shape, _read(F.col("c"), patterns[i][0])).otherwise(made)
        slots.append(made.alias(f"d{i}"))
    read = base.select("shape", *slots)
    differ = F.lit(False)
    for i in range(1, SLOTS):
        differ = differ | F.coalesce(F.col(f"d{i}") != F.col("d0"), F.lit(False))
    rows = read.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.count_if(differ).alias("differ"),
                                     F.count_if(F.col("d0").isNotNull() & F.col("d1").isNotNull()).alias("both"),
                                     *[F.count(f"d{i}").alias(f"r{i}") for i in range(SLOTS)]).collect()   # at most one row a shape
    # Values that only one order can read, over all shapes of the column.
    votes = {"day": 0, "month": 0}
    for r in rows:
        pats = PATTERNS.get(r["shape"], [])
        if len(pats) == 2 and pats[0][1]:
            votes["day"] += r["r0"] - r["both"]
            votes["month"] += r["r1"] - r["both"]
    found = [_decide(r, votes, prefer) for r in rows]
    return sorted(found, key=lambda s: (-s.n, s.shape))


def _decide(r, votes: dict[str, int], prefer: str | None) -> DateShape:
    shape, n = r["shape"], r["n"]
    if shape is None:
        return DateShape(OTHER, n, (), (), "unknown")
    pats = PATTERNS[shape]
    read = tuple(r[f"r{i}"] for i in range(len(pats)))
    by_count = [pats[i][0] for i in sorted(range(len(pats)), key=lambda i: -read[i]) if read[i]]
    whole = [p for p, k in zip(pats, read) if k == n]
    if not by_count:
        return DateShape(shape, n, read, (), "unknown")
    if len(whole) == 1 or (whole and not r["differ"]):
        return DateShape(shape, n, read, (whole[0][0],), "clear")
    if not whole:
        return DateShape(shape, n, read, tuple(by_count), "mixed")
    order = "day" if votes["day"] and not votes["month"] else "month" if votes["month"] and not votes["day"] else None
    chosen = order or prefer
    if chosen is None:
        return DateShape(shape, n, read, tuple(p for p, _ in whole), "ambiguous")
    return DateShape(shape, n, read, tuple(p for p, o in whole if o == chosen), "by_column" if order else "preferred")


def parse_dates(df: DataFrame, col: str, shapes: list[DateShape], out: str | None = None) -> DataFrame:
    """``col`` as a date by the formats found for its shapes; NULL for ambiguous and unknown shapes and for what does not parse."""
    c = F.col("`" + col.replace("`", "``") + "`")
    made = F.lit(None).cast("date")
    for s in shapes:
        if s.formats and s.status != "ambiguous":
            made = F.when(shape_of(c) == s.shape, F.coalesce(*[_read(c, f) for f in s.formats])).otherwise(made)
    return df.withColumn(out or col, made)
