"""Headline timings: prints ONE JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 3).
Every query is run once to warm up, then all of them BENCH_REPEAT times; medians are reported. Results
are fully evaluated through the ``noop`` sink (no collect of big results to the driver).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from fathom import get_spark  # noqa: E402
from fathom.operators import clean as C  # noqa: E402
from fathom.operators.profile import profile  # noqa: E402
from fathom.operators.scan import scan_text  # noqa: E402
from fathom.operators.transform import token_counts  # noqa: E402
from fathom.sources.files import read_table  # noqa: E402


def dirty_lineitem(li):
    base = li.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 7 == 0, F.lit(None).cast("double"))
                         .otherwise(F.col("l_extendedprice")))
    return base.unionAll(base.where(F.col("l_orderkey") % 10 == 0))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus),
                      conf={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                            "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # the test tables are one row group each, so a scan is one task: deal the rows out, as many files would
    deal = lambda name: read_table(spark, sf_dir, name).repartition(int(cpus))
    li = lambda: deal("lineitem")
    rules = C.CleanRules(null_subset=["l_extendedprice"], outlier_cols={"l_extendedprice": "cap"})
    plans = {
        "profile_exact": lambda: profile(li(), "lineitem", exact=True),
        "profile_approx": lambda: profile(li(), "lineitem", exact=False),
        "clean_composite": lambda: C.clean(dirty_lineitem(li()), rules)[0],
        "clean_report": lambda: C.clean(dirty_lineitem(li()), rules)[1],
        "cap_p99": lambda: C.cap_outliers(li(), "l_extendedprice", upper=0.99),
        "scan_text": lambda: scan_text(deal("documents"), "doc_id", "text"),
        "token_counts": lambda: token_counts(deal("documents"), "text"),
    }
    # One warm-up pass over every plan first (JIT, codegen caches), then REPEAT timed rounds.
    for build in plans.values():
        run(build())
    samples = {name: [] for name in plans}
    for _ in range(repeat):
        for name, build in plans.items():
            t0 = time.perf_counter()
            run(build())   # planning (incl. fitted statistics) + full evaluation
            samples[name].append(time.perf_counter() - t0)
    timings = {name: round(statistics.median(v), 3) for name, v in samples.items()}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
