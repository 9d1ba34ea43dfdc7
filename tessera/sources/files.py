"""CSV, JSON lines and text: readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pyfunc import map_partitions

CSV_READ, CSV_WRITE = {"header", "inferSchema", "delimiter", "sep"}, {"header", "delimiter", "sep"}


def _checked(options: dict, known: set) -> dict:
    if bad := set(options) - known:
        raise ValueError(f"unknown option {sorted(bad)[0]}")
    return options


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Values are trimmed, empty and unreadable ones null, short rows padded, extra cells dropped. Without a header columns are c0, c1 ...; all are
    strings unless inferSchema. A quoted cell doubles its quotes and stays on its line."""
    _checked(options, CSV_READ)
    r = spark.read.option("header", options.get("header", False)).option("sep", options.get("sep", options.get("delimiter", ","))).options(quote='"', escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if schema is not None:
        return r.option("enforceSchema", True).schema(schema).csv(path)
    df = r.option("inferSchema", options.get("inferSchema", False)).csv(path)
    return df if str(options.get("header", False)).lower() == "true" else df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _kind(v) -> str:
    """A JSON value's kind; "" for null, which goes with every kind."""
    if v is None or isinstance(v, bool):
        return "" if v is None else "boolean"
    if isinstance(v, int):
        return "int" if -(2**31) <= v < 2**31 else "long" if -(2**63) <= v < 2**63 else "double"
    return "double" if isinstance(v, float) else "string"


def _keys(rows):
    """(key, kind, line, place) of each new pair of key and kind in (value, line) rows."""
    seen = set()
    for text, line in rows:
        try:
            obj = json.loads(text)
        except ValueError:
            continue
        for place, (k, v) in enumerate(obj.items() if isinstance(obj, dict) else ()):
            kind = _kind(v)
            if (k, kind) not in seen:
                seen.add((k, kind))
                yield k, kind, line, place


def infer_json_schema(spark: SparkSession, path: str) -> T.StructType:
    """Keys of all lines in the order first seen; whole numbers int or long by size, mixed kinds string. Lines are read where they lie; the
    driver gets one row a key."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("line"))
    found = map_partitions(lines, _keys, "key string, kind string, line long, place int")
    keys = found.groupBy("key").agg(F.collect_set("kind").alias("kinds"), F.min(F.struct("line", "place")).alias("at")).orderBy("at").collect()
    names = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}

    def merged(kinds: set) -> T.DataType:
        wider = next((k for k in ("double", "long", "int") if k in kinds), None)
        return names.get(wider if kinds <= {"int", "long", "double"} else kinds.copy().pop() if len(kinds) == 1 else "string", T.StringType())

    return T.StructType([T.StructField(r.key, merged(set(r.kinds) - {""})) for r in keys])


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; a missing key is null, a line that isn't an object a row of nulls."""
    return spark.read.schema(schema or infer_json_schema(spark, path)).json(path)


def read_text(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """One row (value) a line."""
    df = spark.read.text(path)
    return df if partitions is None else df.repartition(partitions)


def text_rdd(spark: SparkSession, path: str, partitions: int | None = None):
    return spark.sparkContext.textFile(path, partitions)


def write_csv(df: DataFrame, path: str, **options) -> None:
    """Part files, each with the header if asked for; quotes only where needed; null and empty both empty."""
    _checked(options, CSV_WRITE)
    df.write.mode("overwrite").option("header", options.get("header", False)).option("sep", options.get("sep", options.get("delimiter", ","))).options(quote='"', escape='"', emptyValue="", nullValue="").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


