"""Connected components of a table of links."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: Links that one task takes: small tables are kept in few partitions, so that rounds don't leave many small files.
TASK_LINKS = 50_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component), the smallest node that each node of a link reaches.

    Alternating large-star and small-star steps: each rewires the links of a node to its smallest neighbour,
    until only stars around each component's smallest node are left. All steps are joins and aggregates over
    links; the driver sees two sums a round. Null ends and loops are left out."""
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e, seen = checkpoint(e.distinct()), None
    tasks = max(1, math.ceil(e.count() / TASK_LINKS))  # links never grow in number from round to round
    few = lambda df: df.coalesce(tasks)
    e = few(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(few(both.filter("v > u").join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(least, "u")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v")
        e = checkpoint(few(small.distinct()))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        seen = now
