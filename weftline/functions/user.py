"""User functions over plain and weighted relations: map, expand, combine, aggregate.

Column expressions stay in generated code and are what these forms take first. Where a function is Python, rows travel in
Arrow batches; a time and weight (`__t`, `__w`) that a relation has pass by untouched. Aggregates of a user's own are
folded before the shuffle, so a group's rows never meet in one place: what is shuffled is one state for each task and group.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.zset import T as TIME
from weftline.operators.zset import W, data
from weftline.session import ship

ROWS = 2000


def _carried(df: DataFrame) -> list[str]:
    return [c for c in (TIME, W) if c in df.columns]


def _schema(df: DataFrame, schema: str, also: Sequence[str]) -> T.StructType:
    own = T._parse_datatype_string(schema)
    return T.StructType([*own.fields, *[df.schema[c] for c in also]])


def mapped(df: DataFrame, **columns: Column | str) -> DataFrame:
    """A projection to new columns by expressions (strings are SQL); time and weight are kept."""
    return df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()], *_carried(df))


def expand(df: DataFrame, rows: Callable[[tuple], Iterable[tuple]], schema: str) -> DataFrame:
    """Any number of rows (of `schema`) for each row, which comes as a tuple of the data columns; time and weight go to each of them."""
    also = _carried(df)
    names, out = data(df), _schema(df, schema, also)
    arrow = [f.name for f in out.fields]
    wide = len(arrow) - len(also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, made = to_arrow_schema(out), []

        def flush() -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                for new in rows(tuple(row[: len(names)])):
                    if len(new) != wide:
                        raise ValueError(f"a row of {wide} values is wanted, not {new!r}")
                    made.append((*new, *row[len(names) :]))
                if len(made) >= ROWS:
                    yield flush()
                    made = []
        if made:
            yield flush()

    ship(df.sparkSession)
    return df.select(*names, *also).mapInArrow(run, out)


def map_rows(df: DataFrame, row: Callable[[tuple], tuple], schema: str) -> DataFrame:
    """One row for each row; see `expand`."""
    return expand(df, lambda r: (row(r),), schema)


def filter_rows(df: DataFrame, test: Callable[[tuple], bool]) -> DataFrame:
    """The rows for which a Python test holds. A Column condition in `where` is the fast form."""
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes if c in data(df))
    return expand(df, lambda r: (r,) if test(r) else (), schema)


def combined(a: DataFrame, b: DataFrame, on: Sequence[str], combine: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """Join on equal keys (null equals null) whose rows are what `combine(left, right)` makes of the two sides; each side names its columns. Weights of weighted sides multiply, times join."""
    from weftline.functions import lattice

    x, y = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side, df in (("l", a), ("r", b)))
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    new = [c.alias(n) for n, c in combine(lambda n: F.col(f"l_{n}"), lambda n: F.col(f"r_{n}")).items()]
    if TIME in a.columns and TIME in b.columns:
        new.append(lattice.join(F.col(f"l_{TIME}"), F.col(f"r_{TIME}")).alias(TIME))
    if W in a.columns and W in b.columns:
        new.append((F.col(f"l_{W}") * F.col(f"r_{W}")).alias(W))
    return x.join(y, cond).select(*new)


@dataclass(frozen=True)
class Aggregator:
    """An aggregate of one's own: add folds a row (a tuple of the value columns) and its weight into a state, merge joins states, finish gives the result."""

    zero: Callable[[], object]
    add: Callable[[object, tuple, int], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], object]
    type: str


def aggregate_with(df: DataFrame, keys: Sequence[str], values: Sequence[str], into: str, how: Aggregator) -> DataFrame:
    """keys and `into`: one row for each group. Rows without a weight count once. Groups of null keys are groups too; an empty table gives none."""
    ship(df.sparkSession)
    weight = F.col(W) if W in df.columns else F.lit(1).cast("long")
    rows = df.select(*keys, *values, weight.alias(W))
    key_schema = T.StructType([df.schema[k] for k in keys])
    n = len(keys)
    partial = T.StructType([*key_schema.fields, T.StructField("__state", T.BinaryType())])
    final = T.StructType([*key_schema.fields, T.StructField(into, T._parse_datatype_string(how.type))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        states: dict[tuple, object] = {}

        def flush() -> pa.RecordBatch:
            columns = zip(*((*k, pickle.dumps(s)) for k, s in states.items()), strict=True) if states else [[]] * (n + 1)
            kinds = to_arrow_schema(partial)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[:n]
                states[key] = how.add(states[key] if key in states else how.zero(), row[n:-1], row[-1])
            if len(states) >= 50_000:  # many groups: their states go on, a later fold joins them
                yield flush()
                states.clear()
        yield flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, made, now, state = to_arrow_schema(final), [], None, None

        def flush() -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else [[]] * (n + 1)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, part = row[:n], pickle.loads(row[n])
                if now is not None and key == now:
                    state = how.merge(state, part)
                    continue
                if now is not None:
                    made.append((*now, how.finish(state)))
                now, state = key, part
            if len(made) >= ROWS:
                yield flush()
                made = []
        if now is not None:
            made.append((*now, how.finish(state)))
        yield flush()

    states = rows.mapInArrow(fold, partial)
    dealt = states.repartition(*keys).sortWithinPartitions(*keys) if keys else states.coalesce(1)
    return dealt.mapInArrow(join, final)
