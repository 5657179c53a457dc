import subprocess
import sys

import corpus_pipeline as P
from fathom.llm import decontam, exact_dedup, simhash, source_mix, toxicity
from fathom.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_stages_and_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "source_mix"]
    assert sorted({q.split("_")[0] for q in QUERIES}, key=lambda q: int(q[2:])) == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [r for r in rows if toxicity._sigmoid(model.score(toxicity.words(r["text"])) - model.thresholds[0]) < model.cut]
    best = {}
    for r in rows:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    rows = sorted((r for r in rows if best[r["text"]] == r["doc_id"]), key=lambda r: r["doc_id"])
    fps = [simhash.fingerprint(r["text"]) & ((1 << 64) - 1) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= simhash.DISTANCE:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    windows = {tuple(w[s:s + 10]) for t in items for w in [decontam.words(t)] for s in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}

    def leaks(t):
        w = decontam.words(t)
        return any(tuple(w[p:p + n]) in windows for n in sizes for p in range(len(w) - n + 1))
    rows = [r for r in rows if not leaks(r["text"])]
    kept = spark.createDataFrame(rows, docs.schema)
    copies = {r.doc_id: r.copies for r in source_mix.mix(kept).collect()}
    want = sorted((r["doc_id"], k) for r in rows for k in range(1, copies[r["doc_id"]] + 1))
    got = P.run(spark, SMALL)
    assert got.columns == [*docs.columns, "copy_no"]
    assert sorted((r.doc_id, r.copy_no) for r in got.collect()) == want


def test_every_stage_takes_odd_rows_and_extra_columns(spark, tmp_path):
    rows = [(1, "a text", "en", "s"), (1, "a text", "en", "s"), (2, None, None, None), (None, "", "en", "s"), (None, None, None, None), (3, "long " * 50_000, "en", "t"), (4, "a text", "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1))
    for name in ("digest", "kept", "fp", "label", "items", "size", "target", "copies", "severity", "key", "n", "K1"):
        docs = docs.withColumn(name, F.lit(name))
    for stage, function in P.STAGES:
        out = function(spark, docs, SMALL)
        assert out.columns[:len(docs.columns)] == docs.columns, stage
        assert function(spark, docs.limit(0), SMALL).count() == 0
        texts = {r.text for r in out.select("text").collect()}
        assert "long " * 50_000 in texts or stage == "source_mix"
    assert P.drop_copies(spark, docs, SMALL).count() == 3      # 'a text', '' (null counts as empty), the long one


def test_the_rest_works_without_the_subpackage(tmp_path):
    """A copy of the repository without the llm folders and the pipeline still imports and lists its own queries."""
    import os
    import shutil
    root = os.path.dirname(os.path.abspath(P.__file__))
    shutil.copytree(os.path.join(root, "fathom"), tmp_path / "fathom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
    assert exact_dedup.__name__ == "fathom.llm.exact_dedup"
