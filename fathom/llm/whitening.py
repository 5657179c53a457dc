"""Embedding whitening by a bidiagonal qd solver.

Entries are put on an integer grid, so counts, sums and deviations are exact. The centred rows are
reduced block by block to a triangle R (QR of the triangle so far stacked on the next rows, in every task, then
over the tasks' triangles); Householder reflections make R bidiagonal; dqds finds the singular values; twisted
factorisations of the shifted bidiagonal's square give the directions. Only sums (two numbers a
dimension) and R (dimensions x dimensions) reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ship

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
GRID = 2.0 ** 60          # grid values beyond +-GRID count as +-GRID
BLOCK = 1 << 19           # entries turned into doubles at a time
REDUCERS = 64             # tasks that reduce the triangles of all tasks before one task reduces theirs
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    dims: int = 0
    n: int = 0
    sums: list = field(default_factory=list)                              # exact integers, one per dimension
    directions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))   # dims x components, unit columns
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))       # falling
    trace: float = 0.0


# ---- the bidiagonal solver (small matrices, numpy) ----

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """r = U B V^T with B upper bidiagonal: its diagonal, its superdiagonal and V's reflectors (first row, vector)."""
    m, right = np.array(r, float), []
    d = m.shape[1]

    def reflector(x: np.ndarray) -> np.ndarray | None:
        scale = np.abs(x).max()
        if not scale or not np.any(x[1:]):
            return None
        v = x / scale
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        return v / np.sqrt(v @ v)

    for k in range(d):
        if (v := reflector(m[k:, k])) is not None:
            m[k:, k:] -= 2.0 * np.outer(v, v @ m[k:, k:])
        if k < d - 2 and (v := reflector(m[k, k + 1:])) is not None:
            m[k:, k + 1:] -= 2.0 * np.outer(m[k:, k + 1:] @ v, v)
            right.append((k + 1, v))
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _sweep(q: list, e: list, shift: float) -> tuple[list, list, list] | None:
    """One differential qd transform with a shift: new q, new e and the d's; None if the shift was too large."""
    n, d = len(q), q[0] - shift
    new_q, new_e, ds = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    for k in range(n - 1):
        if d < 0:
            return None
        ds[k] = d
        new_q[k] = d + e[k]
        if new_q[k] > 0:
            t = q[k + 1] / new_q[k]
            new_e[k] = e[k] * t
            d = d * t - shift
        else:
            d = q[k + 1] - shift
    if d < 0:
        return None
    new_q[-1] = ds[-1] = d
    return new_q, new_e, ds


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values (falling) of the upper bidiagonal matrix with diagonal ``a`` and superdiagonal ``b``.

    Shifts never exceed the smallest eigenvalue that is left: a shift that makes a d negative is taken
    back for the bound 1 / sum(1 / d_k) of a transform without shift, so relative accuracy is kept.
    """
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if not len(a) or not scale:
        return np.zeros(len(a))
    tol, found = (4 * EPS) ** 2, []
    work = [([float(x) for x in (a / scale) ** 2], [float(x) for x in (b / scale) ** 2], 0.0)]
    while work:
        q, e, moved = work.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(moved + q[0])
                break
            if e[-1] <= tol * (moved + q[-1]):
                found.append(moved + q.pop())
                e.pop()
                continue
            cut = next((k for k in range(n - 1) if e[k] <= tol * min(moved + q[k], moved + q[k + 1])), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1], e[::-1]
            q, e, ds = _sweep(q, e, 0.0)
            low = min(ds)
            safe = 1.0 / sum(1.0 / d for d in ds) if low > 0 else 0.0
            mean, half = (q[-2] + e[-1] + q[-1]) / 2, (q[-2] + e[-1] - q[-1]) / 2
            tip = q[-2] * q[-1] / (mean + np.sqrt(half * half + e[-1] * q[-1])) if mean else 0.0     # trailing 2 x 2
            bold = float(min(tip, low)) - (e[-2] if n > 2 else 0.0)
            for shift in sorted({bold, safe, safe * (1 - 1e-8)}, reverse=True):
                if 0 < shift and shift >= safe * (1 - 1e-8) and (got := _sweep(q, e, shift)):
                    q, e, _ = got
                    moved += shift
                    break
    return scale * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _pivot(x: float, tiny: float) -> float:
    return x if abs(x) > tiny else (tiny if x >= 0 else -tiny)


class Twisted:
    """Twisted factorisations of B^T B - value, B^T B = L diag(d) L^T: one from the top, one from the bottom, joined at a row."""

    def __init__(self, d: np.ndarray, low: np.ndarray, value: float, tiny: float):
        n = len(d)
        self.top, self.bottom, self.gamma = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n)
        self.pivots = np.zeros(n)
        s, held = -value, []
        for k in range(n - 1):
            held.append(s)
            self.pivots[k] = p = _pivot(s + d[k], tiny)
            self.top[k] = d[k] * low[k] / p
            s = self.top[k] * low[k] * s - value
        held.append(s)
        self.pivots[-1] = _pivot(s + d[-1], tiny)
        p, self.gamma[-1] = d[-1] - value, s + d[-1]
        for k in range(n - 2, -1, -1):
            t = d[k] / _pivot(d[k] * low[k] ** 2 + p, tiny)
            self.bottom[k] = low[k] * t
            self.gamma[k] = held[k] + t * p
            p = p * t - value

    def vector(self) -> np.ndarray:
        """The vector that solves all rows but the one of the smallest joint pivot, unit length."""
        n, at = len(self.gamma), int(np.abs(self.gamma).argmin())
        z = np.zeros(n)
        z[at] = 1.0
        for k in range(at - 1, -1, -1):
            z[k] = -self.top[k] * z[k + 1]
        for k in range(at, n - 1):
            z[k + 1] = -self.bottom[k] * z[k]
        return z / np.linalg.norm(z)

    def solve(self, y: np.ndarray) -> np.ndarray:
        """Inverse iteration step: (B^T B - value) x = y, x to unit length."""
        x = np.array(y, float)
        for k in range(len(x) - 1):
            x[k + 1] -= self.top[k] * x[k]
        x /= self.pivots
        for k in range(len(x) - 2, -1, -1):
            x[k] -= self.top[k] * x[k + 1]
        return x / np.linalg.norm(x)


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors (columns) of the bidiagonal matrix for some of its singular values.

    A value apart from its neighbours takes its twisted factorisation's vector. Values that agree in the first
    three digits are a cluster: their vectors are kept orthogonal, with steps of inverse iteration.
    """
    n = len(a)
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)) or 1.0
    a, b, values = a / scale, b / scale, values / scale
    a = np.where(np.abs(a) < EPS * 1e-3, np.copysign(EPS * 1e-3, a), a)     # keeps L finite; far below the rounding of R
    d, low, tiny = a * a, b / a[:-1] if n > 1 else np.zeros(0), EPS ** 3
    out, first, noise = np.zeros((n, len(values))), 0, np.random.default_rng(1)
    for k, v in enumerate(values):
        if k and abs(values[k - 1] - v) > 1e-3 * values[k - 1]:
            first = k
        factors = Twisted(d, low, v * v, tiny)
        z, before = factors.vector(), out[:, first:k]
        for turn in range(8):
            y = z - before @ (before.T @ z)
            y -= before @ (before.T @ y)
            if first == k or turn > 1 and np.linalg.norm(y) > 0.5:
                break
            z = factors.solve(y / np.linalg.norm(y) if np.linalg.norm(y) > 1e-3 else noise.standard_normal(n))
        out[:, k] = y / np.linalg.norm(y)
    return out


def principal(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values of a square triangle and their right vectors; values that are zero to rounding are left out."""
    a, b, right = bidiagonal(r)
    values = dqds(a, b)
    values = values[:components][values[:components] > len(a) * EPS * values[:1].max(initial=0.0)]
    v = directions(a, b, values)
    for at, w in reversed(right):
        v[at:] -= 2.0 * np.outer(w, w @ v[at:])
    return values, v / np.linalg.norm(v, axis=0, keepdims=True)


# ---- rows on the grid ----

def _blocks(column: pa.Array, dims: int):
    """(first row, grid values) of one Arrow column of lists, a bounded block at a time."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)
    step = max(1, BLOCK // dims)
    for at in range(0, len(values), step):
        yield at, np.clip(np.floor(SCALE * values[at:at + step]), -GRID, GRID).astype(np.int64) + OFFSET


def _centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n * x - sums, exact: 64-bit where that is proven to fit, else Python integers."""
    floor = [s // n for s in sums]
    rest = [s - n * f for s, f in zip(sums, floor)]
    apart = x - np.array(floor, np.int64)
    if (int(np.abs(apart).max(initial=0)) + 1) * n < 2 ** 62:
        return apart * n - np.array(rest, np.int64)
    return apart.astype(object) * n - np.array(rest, object)


def _deviation(c: np.ndarray) -> list:
    if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * c.shape[1] < 2.0 ** 62:
        return (c * c).sum(axis=1).tolist()
    return [sum(int(y) ** 2 for y in row) for row in c.tolist()]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector holds at least one entry, and none that is null, NaN or infinite."""
    whole = "{v} IS NOT NULL AND size({v}) > 0 AND forall({v}, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    return df.where(F.expr(whole.format(v=f"CAST(`{vector}` AS array<double>)")))


def dimension(df: DataFrame, vector: str) -> int:
    """The most frequent vector length (the longer one of a tie); 0 for no rows."""
    got = df.groupBy(F.size(f"`{vector}`").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return got[0]["dims"] if got else 0


def _lists(df: DataFrame, vector: str, dims: int, *columns) -> DataFrame:
    return usable(df, vector).where(F.size(f"`{vector}`") == dims).select(*columns, F.col(f"`{vector}`").cast("array<double>").alias("__llm_v"))


def _sums(rows: DataFrame, dims: int) -> tuple[int, list]:
    def run(batches):
        n, totals = 0, [0] * dims
        for b in batches:
            for _, x in _blocks(b.column(0), dims):
                high, low = x >> 32, x & 0xFFFFFFFF
                totals = [t + (int(h) << 32) + int(w) for t, h, w in zip(totals, high.sum(axis=0), low.sum(axis=0))]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(dims), -1], pa.int32()), pa.array([str(t) for t in [*totals, n]])], ["pos", "s"])

    parts = rows.mapInArrow(run, "pos int, s string").groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["pos"]: int(r["s"]) for r in parts.collect()}          # a number per dimension
    return got.get(-1, 0), [got.get(k, 0) for k in range(dims)]


def _triangle(rows: DataFrame, dims: int, n: int, sums: list) -> np.ndarray:
    def fold(r, x):
        return np.linalg.qr(np.concatenate([r, x]), mode="r")

    def emit(r):
        for at in range(0, len(r), max(1, BLOCK // dims)):
            part = r[at:at + max(1, BLOCK // dims)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dims, pa.int32()), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([lists], ["row"])

    def first(batches):
        r = np.zeros((0, dims))
        for b in batches:
            for _, x in _blocks(b.column(0), dims):
                r = fold(r, _centred(x, n, sums).astype(float) / n)
        yield from emit(r)

    def again(batches):
        r = np.zeros((0, dims))
        for b in batches:
            r = fold(r, b.column(0).flatten().to_numpy().reshape(-1, dims))
        yield from emit(r)

    schema = "row array<double>"
    some = rows.mapInArrow(first, schema).repartition(REDUCERS).mapInArrow(again, schema)
    got = some.repartition(1).mapInArrow(again, schema).collect()          # at most dims rows
    r = np.zeros((dims, dims))
    if got:
        r[:len(got)] = np.array([row["row"] for row in got])
    return r


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Means, directions and eigenvalues of the usable vectors of the most frequent length.

    Null vectors and vectors with a null, NaN or infinite entry (and empty ones) take no part; no rows, or rows
    without any variance, give a model without components. Repeated rows count as often as they stand.
    """
    dims = dimension(usable(df, vector), vector)
    if not dims:
        return Whitening()
    rows = _lists(df, vector, dims)
    n, sums = _sums(rows, dims)
    r = _triangle(rows, dims, n, sums)
    values, v = principal(r, components)
    return Whitening(dims, n, sums, v, values ** 2 / n, float((r * r).sum() / n))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity; None without components."""
    k = len(model.eigenvalues)
    if not k:
        return None
    held = df.sparkSession.sparkContext.broadcast(model)       # dims x components numbers

    def run(batches):
        m, total = held.value, np.zeros((k + 1, k))
        for b in batches:
            for _, x in _blocks(b.column(0), m.dims):
                w = _centred(x, m.n, m.sums).astype(float) / m.n @ m.directions / np.sqrt(m.eigenvalues)
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["pos", "s"])

    got = dict(map(tuple, _lists(df, vector, model.dims).mapInArrow(run, "pos long, s double").groupBy("pos").agg(F.sum("s")).collect()))
    total = np.array([got[p] for p in range((k + 1) * k)]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, columns: list, vector: str = "embedding", error: float | None = None) -> DataFrame:
    """A row per usable vector and component: ``columns``, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that the fit left out (null, empty, non-finite entries, another length) have no rows here. deviation is
    an exact decimal(38,0), null where it needs more digits. ``columns`` are picked by the caller, so further columns of
    ``df`` can have any name.
    """
    held, k = df.sparkSession.sparkContext.broadcast(model), len(model.eigenvalues)
    source = _lists(df, vector, model.dims, *columns)
    fields = source.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"])

    def run(batches):
        m = held.value
        for b in batches:
            for at, x in _blocks(b.column(b.num_columns - 1), m.dims):
                c = _centred(x, m.n, m.sums)
                w = c.astype(float) / m.n @ m.directions / np.sqrt(m.eigenvalues)
                row = np.repeat(np.arange(len(x)), k)
                dev = pa.array([d if d < 10 ** 38 else None for d in _deviation(c)], pa.decimal128(38, 0))
                part = [col.slice(at, len(x)).take(pa.array(row)) for col in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*part, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), m.n)), dev.take(pa.array(row)),
                     pa.array(w.ravel()), pa.array(np.tile(m.eigenvalues / m.trace, len(x))), pa.array(np.full(len(row), error, float))],
                    [*b.schema.names[:-1], "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(run, schema) if k else df.sparkSession.createDataFrame([], schema)


ship(__name__)
