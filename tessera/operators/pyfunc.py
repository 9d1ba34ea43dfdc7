"""Python functions over rows. Rows travel in Arrow batches and keep Python's values: whole numbers of any size, None for null."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in a batch that goes back to Spark.
BATCH_ROWS = 10_000


def batch_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows as named tuples."""
    row = namedtuple("Row", batch.schema.names, rename=True)
    columns = [c.to_pylist() for c in batch.columns]
    return map(row._make, zip(*columns, strict=True)) if columns else (row() for _ in range(batch.num_rows))


def row_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows."""
    part: list[tuple] = []

    def made():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(schema)], schema=schema)

    for r in rows:
        part.append(r)
        if len(part) == BATCH_ROWS:
            yield made()
            part = []
    if part:
        yield made()


def map_partitions(df: DataFrame, f: Callable[[Iterator], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """f(iterator of rows) -> iterable of tuples, for each partition; nothing is held but a batch."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots wouldn't be found
    return plain.mapInArrow(lambda batches: row_batches(f(r for b in batches for r in batch_rows(b.rename_columns(names))), arrow), kind)


def py_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f(row) -> tuple, for each row."""
    return map_partitions(df, lambda rows: map(f, rows), schema)


def py_filter(df: DataFrame, f: Callable) -> DataFrame:
    """The rows for which f(row) is true; their values don't leave Arrow."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(lambda batches: (b.filter(pa.array([bool(f(r)) for r in batch_rows(b.rename_columns(names))], pa.bool_())) for b in batches), plain.schema).toDF(*names)


def py_flat_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f(row) -> iterable of tuples, for each row."""
    return map_partitions(df, lambda rows: (x for r in rows for x in f(r)), schema)


def py_reduce_by_key(df: DataFrame, key: str, value: str, f: Callable, initial, kind: str) -> DataFrame:
    """f folds a key's values, in each task before the shuffle; f must be associative and commutative with initial as its neutral value."""
    from ..functions.aggregates import user_aggregate

    return user_aggregate(lambda: initial, f, f, lambda b: b, kind)(df, [key], value, value)


def groups(rows: Iterable[tuple], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) for rows sorted by their first n_keys values; null equals null and NaN equals NaN."""
    from itertools import groupby

    return groupby(rows, lambda r: tuple("NaN" if isinstance(x, float) and x != x else x for x in r[:n_keys]))
