"""tessera: a small analytics engine on PySpark, with DataFrames, a SQL front door and keyed dataflow operators."""

from .functions.aggregates import avg, count, max_, min_, sum_
from .functions.expressions import add, col, divide, lit, multiply, subtract
from .session import get_session, load_tables

__all__ = ["add", "avg", "col", "count", "divide", "get_session", "lit", "load_tables", "max_", "min_", "multiply", "subtract", "sum_"]
