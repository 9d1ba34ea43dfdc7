"""Projection, filters, sorting and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns)


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true; neither false nor null."""
    return df.filter(condition)


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def order_by(df: DataFrame, *keys: str | Column | tuple[str, str]) -> DataFrame:
    """Nulls first when ascending, last when descending. A key is a name, a Column, or (name, "asc" or "desc")."""
    return df.orderBy(*[(F.desc(k[0]) if k[1].lower() == "desc" else F.asc(k[0])) if isinstance(k, tuple) else k for k in keys])


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top_n(df: DataFrame, n: int, *keys) -> DataFrame:
    """The first n rows of an order: each task keeps n, and those are merged."""
    return order_by(df, *keys).limit(n)
