"""Screen text columns against a token deny-list: every (row, token, line) hit, in Spark.

Per line, the hits are ``filter(tokens, t -> instr(line, t) > 0)`` on a literal array: a
projection with no join and no shuffle, so it scales with the text and the list is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The deny-list tokens and the reason given for each, in list order (the list
# names 'eval(' twice; it is kept once here).
DENY_REASONS = {
    "os.": "Operating system access can compromise file system security",
    "sys.": "System module access can allow unsafe system operations",
    "subprocess.": "Subprocess execution can run arbitrary commands",
    "open(": "Direct file access bypasses pandas security controls",
    "exec(": "Dynamic code execution can run arbitrary code",
    "eval(": "Dynamic evaluation can execute arbitrary expressions",
    "import os": "Direct OS module import bypasses security controls",
    "import sys": "Direct system module import bypasses security controls",
    "document.": "DOM access is not relevant for pandas data analysis",
    "window.": "Browser window access is not relevant for pandas data analysis",
    "XMLHttpRequest": "Network requests are not relevant for pandas data analysis",
    "fetch(": "Network requests are not relevant for pandas data analysis",
    "Function(": "Dynamic function creation can execute arbitrary code",
    "script": "Script tags are not relevant for pandas data analysis",
    "javascript:": "JavaScript execution is not relevant for pandas data analysis",
}
DEFAULT_REASON = "This operation is forbidden for security reasons"
# Leading/trailing blanks removed from a reported line (ASCII whitespace, stated explicitly).
STRIP = r"^[ \t\r\f\v]+|[ \t\r\f\v]+$"


def scan_text(df: DataFrame, id_col: str, text_col: str, tokens: dict[str, str] | list[str] | None = None) -> DataFrame:
    """(id, token, reason, line_no, line): line numbers are 1-based, lines are stripped.

    A token is a plain, case-sensitive substring. All tokens are reported, not only the first.
    """
    tokens = DENY_REASONS if tokens is None else tokens
    if not isinstance(tokens, dict):
        tokens = {t: DENY_REASONS.get(t, DEFAULT_REASON) for t in tokens}
    token_arr = F.array(*[F.lit(t) for t in tokens])
    reasons = F.create_map(*[x for t, r in tokens.items() for x in (F.lit(t), F.lit(r))])
    lines = df.select(F.col(f"`{id_col}`").alias(id_col),
                      F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("_i", "_line"))
    # explode() of an empty hit list emits no row, so lines without a hit vanish here; the
    # token filter is evaluated once per line.
    ident = F.col(f"`{id_col}`")
    hits = lines.select(ident, "_i", "_line",
                        F.explode(F.filter(token_arr, lambda t: F.instr(F.col("_line"), t) > 0)).alias("token"))
    return hits.select(
        ident, "token", reasons[F.col("token")].alias("reason"),
        (F.col("_i") + 1).cast("bigint").alias("line_no"),
        F.regexp_replace(F.col("_line"), STRIP, "").alias("line"))
