"""Sequential recursions, distributed by key: rows are dealt and sorted by key and order, and the state is carried from row to row.

A key's rows stream through one task in Arrow batches, so the work is linear in them and no key is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], results: str, begin: Any, step: Callable) -> DataFrame:
    """keys, order and columns of every row, and the results (their DDL): step(state, *columns) gives the next state and a tuple of
    results; begin is the state before a key's first row. Rows of equal order go by columns; nulls come first."""
    names = list(dict.fromkeys([*keys, *order, *columns]))
    rows = df.select(*names).repartition(*keys).sortWithinPartitions(*names)
    made = _parse_datatype_string(results)
    types = [to_arrow_type(f.dataType) for f in made.fields]
    ki, ci = [names.index(k) for k in keys], [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, begin
        for batch in batches:
            out = []
            of = zip(*[batch.column(i).to_pylist() for i in ki], strict=True)
            for key, x in zip(of, zip(*[batch.column(i).to_pylist() for i in ci], strict=True), strict=True):
                if key != last:
                    last, state = key, begin
                state, r = step(state, *x)
                out.append(r)
            made_of = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), t) for c, t in zip(made_of, types, strict=True))], [*names, *made.names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *made.fields]))


def cusum(df: DataFrame, keys: list[str], order: list[str], z: str, k: float = 0.5, h: float = 5.0, cap: float = 50.0) -> DataFrame:
    """S = min(max(0, S + z - k), cap); an alert when S > h, and S starts again from 0."""

    def step(s: float, x: float | None):
        s = min(max(0.0, s + (x or 0.0) - k), cap)
        return (0.0 if s > h else s), (s, s > h)

    return fold(df, keys, order, [z], "s double, alert boolean", 0.0, step).select(*keys, *order, "s", "alert")


def hawkes(df: DataFrame, keys: list[str], order: list[str], seconds: str, mu: float = 0.1, alpha: float = 0.5, beta: float = 1.0, unit: float = 86_400.0) -> DataFrame:
    """A = exp(-beta dt) (A + 1), 0 at the first event; intensity mu + alpha A. dt in units of `unit` seconds."""

    def step(prev: tuple | None, t: float):
        a = 0.0 if prev is None else math.exp(-beta * (t - prev[0]) / unit) * (prev[1] + 1)
        return (t, a), (a, mu + alpha * a)

    return fold(df, keys, order, [seconds], "a double, intensity double", None, step).select(*keys, *order, "a", "intensity")
