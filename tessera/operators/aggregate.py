"""Grouping, HAVING and the count shorthand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import UserAggregate, count


def group_agg(df: DataFrame, keys: list, *aggregates: Column | UserAggregate, having: Column | str | None = None) -> DataFrame:
    """keys and aggregates for each group (nulls form one); without keys one row, also for no input. having sees the aggregates' names.

    Aggregates of the user's own, whose keys must be names, run in passes of their own and are joined by key to the built-in ones."""
    own = [a for a in aggregates if isinstance(a, UserAggregate)]
    out = df.groupBy(*keys).agg(*[a for a in aggregates if not isinstance(a, UserAggregate)] or [F.count("*").alias("_n")])
    for a in own:
        more = a(df, keys, a.value, a.name).withColumnsRenamed({k: f"_key_{k}" for k in keys})
        on = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_key_{k}`")) for k in keys], F.lit(True))
        out = out.join(more, on).drop(*[f"_key_{k}" for k in keys])
    if own:
        built_in = iter(out.columns[len(keys) :])
        names = [a.name if isinstance(a, UserAggregate) else next(built_in) for a in aggregates]
        out = out.select(*[f"`{c}`" for c in [*out.columns[: len(keys)], *names]])
    return out if having is None else out.filter(having)


def group_count(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(count())
