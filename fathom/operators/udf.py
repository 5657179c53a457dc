"""User code over batches or groups, through Arrow (the only Python in the data path)."""

from __future__ import annotations

import inspect
import pickle
from dataclasses import dataclass
from typing import Any, Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HELD_GROUPS = 10_000      # partial states a task holds before it passes them on
FAN = 64                  # parts in which the states of one group are merged before they meet


def apply_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``fn`` on each Arrow batch of every partition (stateless, no shuffle)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def apply_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
                 schema: str, many: bool = False) -> DataFrame:
    """Run ``fn`` on all rows of each group (one shuffle by ``keys``).

    With ``many`` a call of ``fn`` gets one or more whole groups, a group's rows next to each other, and tells them apart itself
    (``pdf.groupby(keys, dropna=False)``): a call a group takes a millisecond or so, which small groups have no use for.

    Each group is materialised in one Python worker, so use keys whose groups are bounded
    (an order's lines, a user's day); for unbounded groups express the logic with built-in
    aggregates and windows, or user code in combinable form (:func:`combine_groups`), instead.

    Groups travel many to an Arrow batch and are cut apart in the worker: an Arrow stream for each group of a few rows, as
    ``applyInPandas`` has it, takes longer than the user's code.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not keys or not many and len(inspect.signature(fn).parameters) != 1:
        return df.repartition(n, *keys).groupBy(*keys).applyInPandas(fn, schema)
    names, kinds = list(df.columns), [f.dataType for f in df.schema.fields]
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    by = [f"c{names.index(k)}" for k in keys]
    # An explicit hash repartition on the keys: the window reuses it (no second shuffle), and
    # AQE does not fold it into a single task when the input is small.
    rows = flat.repartition(n, *by).withColumn("first", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1))) == 1)
    # in pandas a null makes a column of whole numbers float and one of truth values object: of a group, not of its batch
    typed = {i: F.lit(0 if isinstance(k, T.IntegralType) else False).cast(k) for i, k in enumerate(kinds) if isinstance(k, (T.IntegralType, T.BooleanType))}
    rows = rows.select("first", *[F.coalesce(f"c{i}", typed[i]).alias(f"c{i}") if i in typed else f"c{i}" for i in range(len(names))],
                       *[F.col(f"c{i}").isNull().alias(f"n{i}") for i in typed])
    columns, holes = [f"c{i}" for i in range(len(names))], {i: "float64" if isinstance(kinds[i], T.IntegralType) else "object" for i in typed}

    def groups(held: list[pd.DataFrame], cuts: list[int]) -> Iterator[pd.DataFrame]:
        """What ``fn`` gives for the groups rows[cuts[0]:cuts[1]], rows[cuts[1]:cuts[2]], ... of the frames together."""
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        body, null = rows[columns], {i: rows[f"n{i}"].to_numpy(bool) for i in holes}
        body = body.set_axis(names, axis=1)
        null = {i: x for i, x in null.items() if x.any()}
        if many:
            # groups that follow each other and have their nulls in the same columns go together
            with_null = [np.logical_or.reduceat(x[:cuts[-1]], cuts[:-1]) for x in null.values()]
            cuts = [c for k, c in enumerate(cuts) if k in (0, len(cuts) - 1) or any(x[k] != x[k - 1] for x in with_null)]
        for a, b in zip(cuts, cuts[1:]):
            group = body.iloc[a:b].reset_index(drop=True)
            for i, x in null.items():
                if x[a:b].any():
                    group.isetitem(i, group.iloc[:, i].astype(holes[i]).mask(x[a:b], None))
            yield fn(group)

    def together(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Neighbouring results of equal columns and types in one frame."""
        same, kind = [], None
        for p in parts:
            this = (tuple(p.columns), tuple(p.dtypes)) if isinstance(p, pd.DataFrame) else p
            if same and this != kind:
                yield pd.concat(same, ignore_index=True)
                same = []
            if not isinstance(p, pd.DataFrame):
                yield p        # Spark says what is wrong with it
            elif len(p) or len(p.columns):
                same.append(p)
                kind = this
        if same:
            yield pd.concat(same, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []        # rows of the last group, which may go on in the next batch
        for pdf in batches:
            starts = np.flatnonzero(pdf["first"].to_numpy(bool))
            if not len(starts):
                held.append(pdf)
                continue
            before, last = sum(map(len, held)), int(starts[-1])
            if before or last:
                yield from together(groups([*held, pdf.iloc[:last]], [*([0] if before else []), *(int(x) + before for x in starts)]))
            held = [pdf.iloc[last:]]
        if held:
            yield from together(groups(held, [0, sum(map(len, held))]))

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class GroupFold:
    """User code over a group in combinable form. States are any picklable values of bounded size (sums, counters, sketches).

    ``update(state, rows)`` adds rows of the group (a pandas frame, some of the group's rows in any order); ``merge(a, b)`` joins the
    states of two parts; both return the new state and ``merge`` must be associative and commutative. ``finish(state)`` gives
    the result columns as a dict.
    """
    init: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], dict]


def combine_groups(df: DataFrame, keys: list[str], fold: GroupFold, schema: str, held_groups: int = HELD_GROUPS, fan: int = FAN) -> DataFrame:
    """One row per group: ``keys`` and the columns of ``schema`` that ``fold.finish`` returns.

    No worker sees a whole group. Rows are folded where they are read, batch by batch; only states move. The states of a
    group meet in ``fan`` parts first (dealt by the task that made them) and the parts then, each time in a stream of
    sorted states of which a worker holds one. So a group with a third of the rows costs a state per task, not its rows.
    Null keys are a group of their own (a NaN key counts as null); without ``keys`` all rows are one group, also of an empty table.
    """
    source = df.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    names, columns_in, width = [f"_k{i}" for i in range(len(keys))], list(df.columns), len(keys)
    init, update, merge, finish = fold.init, fold.update, fold.merge, fold.finish
    key_fields = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, source.schema.fields)]
    state_schema = ", ".join([*key_fields, "_part int", "_state binary"])

    def emit(held: dict, part: int, kinds: list):
        rows = list(held.items())
        for at in range(0, len(rows), 256):
            some = rows[at:at + 256]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k, _ in some], kind) for i, kind in enumerate(kinds)), pa.array([part] * len(some), pa.int32()),
                 pa.array([pickle.dumps(s, pickle.HIGHEST_PROTOCOL) for _, s in some], pa.binary())], [*names, "_part", "_state"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        context = TaskContext.get()
        part = context.partitionId() % fan if context else 0
        held, kinds = {}, []
        for b in batches:
            kinds = [b.schema.field(i).type for i in range(width)]
            if not b.num_rows:
                continue
            rows = pa.Table.from_arrays(b.column(width).flatten(), names=columns_in).to_pandas()
            values = [c.to_pylist() for c in b.columns[:width]]
            values = [tuple(None if v != v else v for v in key) for key in zip(*values)] if width else [()] * b.num_rows
            codes: dict = {}
            at = pd.Series([codes.setdefault(key, len(codes)) for key in values])
            for key, index in zip(codes, at.groupby(at, sort=True).indices.values()):
                held[key] = update(held[key] if key in held else init(), rows.iloc[index])
            if len(held) > held_groups:
                yield from emit(held, part, kinds)
                held = {}
        yield from emit(held, part, kinds)

    def merged(batches: Iterator[pa.RecordBatch]):
        """(key, state, types) of neighbouring rows with equal keys."""
        key, state, kinds = None, None, []
        for b in batches:
            kinds = [b.schema.field(i).type for i in range(width)]
            columns = [b.column(i).to_pylist() for i in range(width)]
            packed = b.column(b.schema.get_field_index("_state"))
            for r in range(b.num_rows):
                this, new = tuple(c[r] for c in columns), pickle.loads(packed[r].as_py())
                if key == this:
                    state = merge(state, new)
                    continue
                if key is not None:
                    yield key, state, kinds
                key, state = this, new
        if key is not None:
            yield key, state, kinds

    def middle(batches):
        for key, state, kinds in merged(batches):
            yield from emit({key: state}, 0, kinds)

    result = df.sparkSession.createDataFrame([], schema).schema
    types = {f.name: f.type for f in to_arrow_schema(result)}

    def last(batches):
        for key, state, kinds in merged(batches):
            row = finish(state)
            yield pa.RecordBatch.from_arrays([*(pa.array([v], kind) for v, kind in zip(key, kinds)), *(pa.array([row[n]], types[n]) for n in types)], [*names, *types])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = source.mapInArrow(start, state_schema)
    parts = states.repartition(n, *names, "_part").sortWithinPartitions(*names, "_part").mapInArrow(middle, state_schema)
    if keys:
        whole = parts.repartition(n, *names).sortWithinPartitions(*names)
        return whole.mapInArrow(last, ", ".join([*key_fields, schema])).toDF(*keys, *types)
    if df.isEmpty():
        return df.sparkSession.createDataFrame([finish(init())], result)
    return parts.repartition(1).mapInArrow(last, schema)      # at most ``fan`` states
