"""Joins: by key names or lists of them, by conditions, and crosswise, with clashing names on the right renamed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark's names of join types and of the strategies that a hint can ask for.
TYPES = {"inner": "inner", "left": "left_outer", "right": "right_outer", "full": "full_outer", "left_semi": "left_semi", "left_anti": "left_anti", "cross": "cross"}
STRATEGIES = {"broadcast": "broadcast", "shuffle_hash": "shuffle_hash", "sort_merge": "merge", "nested_loop": "shuffle_replicate_nl"}


def apart(left: DataFrame, right: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """right with names that left (or right itself, before) has turned into x_2, x_3 ...; old names to new ones."""
    taken, names, new = set(left.columns), {}, []
    for c in right.columns:
        name, k = c, 2
        while name in taken:
            name, k = f"{c}_{k}", k + 1
        taken.add(name)
        names.setdefault(c, name)
        new.append(name)
    return right.toDF(*new), names


#: A broadcast that was asked for is made up to this size of the right side, as its plan estimates it; beyond, Spark chooses.
MAX_BROADCAST_BYTES = 1 << 30


def estimated_bytes(df: DataFrame) -> int:
    """The size that the plan estimates; where it knows none, as over local rows, from a count."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 62 else df.count() * int(df._jdf.schema().defaultSize())


def _hinted(df: DataFrame, strategy: str | None) -> DataFrame:
    if strategy is None or strategy == "broadcast" and estimated_bytes(df) > MAX_BROADCAST_BYTES:
        return df
    return df.hint(STRATEGIES[strategy])


def equi_join(left: DataFrame, right: DataFrame, left_keys: str | list[str], right_keys: str | list[str] | None = None, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """All columns of both (of left for semi and anti joins), keys included. Null keys match nothing."""
    left_keys = [left_keys] if isinstance(left_keys, str) else left_keys
    right_keys = left_keys if right_keys is None else [right_keys] if isinstance(right_keys, str) else right_keys
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("as many right keys as left keys are needed")
    right, names = apart(left, right)
    on = reduce(lambda a, b: a & b, [F.col(a) == F.col(names[b]) for a, b in zip(left_keys, right_keys, strict=True)])
    return left.join(_hinted(right, strategy), on, TYPES[how])


def theta_join(left: DataFrame, right: DataFrame, condition: Column | str, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """A join on any condition, which sees the right side's new names. Ranges and the like compare all pairs; a small side is broadcast."""
    right, _ = apart(left, right)
    return left.join(_hinted(right, strategy), F.expr(condition) if isinstance(condition, str) else condition, "inner" if how == "cross" else TYPES[how])


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(apart(left, right)[0])
