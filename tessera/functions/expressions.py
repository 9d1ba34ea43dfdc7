"""Scalar expressions: arithmetic that widens integers, division as of doubles, comparisons, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

col, lit = F.col, F.lit
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def name_of(x) -> str:
    """How an operand stands in a result's name: a column's own name, a literal's value."""
    if isinstance(x, Column):
        text = x._jc.toString() if hasattr(x, "_jc") else str(x)
        return text.split(" AS ")[-1].strip("`") if " AS " in text else text
    return str(x)


def _arith(sign: str, a, b, wide: bool, df: DataFrame | None) -> Column:
    """Whole numbers widen to bigint, by a factor of 1L that leaves doubles as they are, or by casts where df says that both are whole, or wide does. Overflow is an error."""
    x, y = column(a), column(b)
    if df is not None:
        wide = all(isinstance(f.dataType, _WHOLE) for f in df.select(x, y).schema)
    if wide:
        x, y = x.cast("bigint"), y.cast("bigint")
    elif df is None:
        x = x * F.lit(1).cast("bigint")
    out = {"+": x + y, "-": x - y, "*": x * y}[sign]
    return out.alias(f"{name_of(a)} {sign} {name_of(b)}")


def add(a, b, df: DataFrame | None = None, wide: bool = False) -> Column:
    """a + b, named "a + b"."""
    return _arith("+", a, b, wide, df)


def subtract(a, b, df: DataFrame | None = None, wide: bool = False) -> Column:
    return _arith("-", a, b, wide, df)


def multiply(a, b, df: DataFrame | None = None, wide: bool = False) -> Column:
    return _arith("*", a, b, wide, df)


def divide(a, b) -> Column:
    """a / b as doubles: by zero it is an infinity by the signs of both, or NaN for 0 / 0; null with null."""
    x, y = column(a).cast("double"), column(b).cast("double")
    by_zero = F.when(x.isNull(), F.lit(None).cast("double")).when((x == 0) | F.isnan(x), F.lit(float("nan"))).when((x > 0) == ~y.cast("string").startswith("-"), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)).alias(f"{name_of(a)} / {name_of(b)}")
