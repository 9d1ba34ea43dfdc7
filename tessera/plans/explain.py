"""Plans as text and as lists of physical operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def explain(df: DataFrame) -> str:
    """The analyzed, optimized and physical plan."""
    q = df._jdf.queryExecution()
    return f"== Analyzed ==\n{q.analyzed()}\n== Optimized ==\n{q.optimizedPlan()}\n== Physical ==\n{q.executedPlan()}"


def physical_nodes(df: DataFrame, final: bool = False) -> list[str]:
    """Names of physical operators, from the top; final: as adaptive execution ended up, after running the query."""
    plan = df._jdf.queryExecution().executedPlan()
    if final:
        df._jdf.queryExecution().toRdd().count()
    text = plan.toString()
    text = text.split("== Initial Plan ==")[0]
    return re.findall(r"^[\s:+\-*()0-9]*([A-Z]\w+)", text, re.M)
