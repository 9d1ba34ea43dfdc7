"""The five core types and eagerly checked DataFrames. Spark's other types pass through untouched."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Names of types (fixed values); other names mean strings.
NAMES = {"int": T.IntegerType(), "integer": T.IntegerType(), "long": T.LongType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "boolean": T.BooleanType()}


def type_of(name: str) -> T.DataType:
    return NAMES.get(name.lower(), T.StringType())


def schema_of(columns: Sequence[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(name, type_of(kind)) for name, kind in columns])


def create_dataframe(spark: SparkSession, rows: Iterable[Sequence], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """A DataFrame of rows whose number and kinds of values are checked at once; null fits every type."""
    schema = schema_of(columns)
    rows = [tuple(r) for r in rows]
    for r in rows:
        if len(r) != len(schema):
            raise ValueError(f"row {r} has {len(r)} values, not {len(schema)}")
        for v, f in zip(r, schema, strict=True):
            if not accepts(f.dataType, v):
                raise ValueError(f"{v!r} is no {f.dataType.simpleString()} for column {f.name}")
    return spark.createDataFrame(rows, schema)


def accepts(kind: T.DataType, value) -> bool:
    if value is None:
        return True
    whole = isinstance(value, int) and not isinstance(value, bool)
    match kind:
        case T.IntegerType():
            return whole and -(2**31) <= value < 2**31
        case T.LongType():
            return whole and -(2**63) <= value < 2**63
        case T.DoubleType():
            return isinstance(value, float)
        case T.BooleanType():
            return isinstance(value, bool)
        case _:
            return isinstance(value, str)
