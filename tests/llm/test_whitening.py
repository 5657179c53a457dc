"""Whitening: the solver against numpy's decompositions, the query against plain sums and an eigen-decomposition."""

import math

import numpy as np
import pytest

from fathom.llm import whitening as W


def shapes(d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((3 * d + 5, d))
    yield x
    yield x * np.logspace(0, -12, d)                     # far apart
    yield np.linalg.qr(x)[0]                             # all equal
    yield np.linalg.qr(x)[0] * np.resize([3, 3, 2, 1], d)   # clusters
    yield np.outer(x[:, 0], x[0])                        # rank one
    y = x.copy()
    y[:, d // 2] = 0
    yield y
    yield np.round(x) * (np.arange(d) % 3 == 0)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_solver(d):
    for x in shapes(d):
        r = np.linalg.qr(x, mode="r")
        a, b, _ = W.bidiagonal(r)
        exact = np.linalg.svd(r, compute_uv=False)
        assert np.abs(W.dqds(a, b) - exact).max() <= 1e-14 * max(exact[0], 1e-300)
        values, v = W.principal(r, 8)
        assert len(values) == min(8, np.sum(exact > d * W.EPS * exact[0]))
        assert np.abs(r.T @ (r @ v) - v * values ** 2).max(initial=0) <= 1e-10 * max(exact[0], 1e-300) ** 2
        assert np.abs(v.T @ v - np.eye(len(values))).max(initial=0) <= 1e-9


def test_small_values_are_accurate():
    """dqds keeps relative accuracy where the entries alone fix it (a graded bidiagonal matrix with known values)."""
    a, b = np.array([1.0, 1e-5, 1e-10, 1e-15]), np.array([1e-3, 1e-8, 1e-13])
    from fractions import Fraction as Q
    t = [[Q(0)] * 4 for _ in range(4)]
    for i in range(4):
        t[i][i] += Q(float(a[i])) ** 2
        if i < 3:
            t[i][i + 1] = t[i + 1][i] = Q(float(a[i])) * Q(float(b[i]))
            t[i + 1][i + 1] += Q(float(b[i])) ** 2

    def below(x):       # eigenvalues of B^T B below x, exact
        count, p = 0, None
        for i in range(4):
            p = t[i][i] - x - (t[i][i - 1] ** 2 / p if i else 0)
            count += p < 0
        return count

    for k, s in enumerate(sorted(W.dqds(a, b))):
        assert below(Q(float(s)) ** 2 * (1 - Q(1, 10 ** 13))) == k and below(Q(float(s)) ** 2 * (1 + Q(1, 10 ** 13))) == k + 1


def brute(rows):
    """(n, deviations, components) in plain Python and numpy from (id, list) rows."""
    good = [(i, [math.floor(1024.0 * c) + 100000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    sums = [sum(x[k] for _, x in good) for k in range(d)]
    dev = {}
    for i, x in good:
        dev.setdefault(i, []).append(sum((n * c - s) ** 2 for c, s in zip(x, sums)))
    c = np.array([[float(n * v - s) / n for v, s in zip(x, sums)] for _, x in good])
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, dev, [i for i, _ in good], c, e[::-1], u[:, ::-1]


def hold(got, rows, top=8):
    n, dev, ids, c, e, u = brute(rows)
    assert len(got) == n * top and {r.n for r in got} == {n}
    for i, want in dev.items():
        assert sorted(int(r.deviation) for r in got if r.vec_id == i and r.component == 1) == sorted(want)
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-9
    for k in range(top):
        part = sorted((r for r in got if r.component == k + 1), key=lambda r: (r.vec_id, int(r.deviation), r.whitened))
        assert all(abs(r.explained - e[k] / e.sum()) < 1e-9 for r in part)
        want = {}
        for i, w in zip(ids, c @ u[:, k] / np.sqrt(e[k])):
            want.setdefault(i, []).append(w)
        sign = np.sign(sum(r.whitened * want[r.vec_id][0] for r in part))
        assert all(min(abs(sign * r.whitened - w) for w in want[r.vec_id]) < 1e-6 for r in part)


def test_query_whole_table(spark):
    from fathom.llm.queries import op13_whitening
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    hold(op13_whitening(spark, sf).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(9) * np.arange(1, 10)]) for i in range(60)]
    rows += [rows[0], rows[0], (70, None), (71, [1.0] * 8 + [None]), (72, [math.nan] * 9), (73, [math.inf] * 9), (74, []), (None, rows[5][1])]
    kept = [(i if i is not None else -1, v) for i, v in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, component string").repartition(7)
    model = W.fit(df)
    got = W.whiten(df, model, ["vec_id"], error=W.identity_error(df, model)).na.fill({"vec_id": -1}).collect()
    hold(got, kept)
    # another length is left out, an extra column with a clashing name is no matter
    mixed = df.unionByName(spark.createDataFrame([(90, [1.0, 2.0], "y")], df.schema))
    assert W.fit(mixed).n == model.n and W.whiten(mixed, model, ["vec_id"]).where("vec_id = 90").isEmpty()


def test_without_rows_or_variance(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([(1, None)], schema)
    model = W.fit(none)
    assert (model.n, len(model.eigenvalues)) == (0, 0) and W.identity_error(none, model) is None
    assert W.whiten(none, model, ["vec_id"]).collect() == []
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], schema)
    model = W.fit(same)
    assert (model.n, len(model.eigenvalues)) == (5, 0) and W.whiten(same, model, ["vec_id"]).collect() == []


def test_large_values_stay_exact(spark):
    rows = [(k, [3e14 * (k - 2), -1e15 + k, float(k % 3)]) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = W.fit(df)
    got = {(r.vec_id, r.component): r.deviation for r in W.whiten(df, model, ["vec_id"]).collect()}
    dev = brute(rows)[1]
    assert all(got[i, 1] == want[0] for i, want in dev.items())
