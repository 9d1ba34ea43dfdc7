"""Mixing sources to target weights by systematic sampling of whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, n_words, stored

#: Weights by the sources' order (fixed values of the contract), repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MAX_REPEAT = 3
SEED = 17


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From rows (source, size): source, source_size, target.

    All sizes are shared by weight; where that is above max_repeat times a source's own size the target
    stops there and the excess is reshared by weight. That ends in a level L with target = min(cap, weight * L):
    sources sorted by cap / weight are capped up to the first that L doesn't fill. Only the table of sources,
    one row each, goes through the global windows, in one task: millions of sources fit it; documents don't go there."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    src = src.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("w").over(W.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    src = src.withColumn("level", left / weight)
    src = src.withColumn("level", F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("at")))).over(W.partitionBy())["at"])
    return src.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row for each row of docs.

    Within a source every document expects target / source_size copies. Documents stand in the order of size
    and doc_id; the expected copies are summed along that order from one random offset a source, and a document is
    emitted once for each integer that the sum crosses. As neighbours have like sizes, the words taken come near
    the target. The order is range-partitioned with the place in a source found from counts by partition, so
    a source with a third of all rows is spread over tasks. A null text has size 0, a null source is a source of
    its own, equal rows are told apart by their place only; an empty table gives an empty result."""
    return _mixed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), weights, max_repeat, seed)


def _mixed(rows: DataFrame, weights: Sequence[float], max_repeat: int, seed: int) -> DataFrame:
    """mix() of (doc_id, source, size); further columns are carried along."""
    more = [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    if not more:  # narrow: sizes are found once; whole rows are read twice rather than written twice
        rows = stored(rows)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, F.col("source"), F.col("size"), F.col("doc_id")).sortWithinPartitions("source", "size", "doc_id")
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy("source", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("size").alias("size"))
    before = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a task and source
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    plan = targets(parts, weights, max_repeat).withColumn("_r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("_u", offset)
    parts = parts.drop("size").join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    parts = parts.select(F.col("source").alias("_source"), F.col("_part").alias("_p"), "_first", "_before", "source_size", "target", "_r", "_u")
    parts = stored(parts)  # a row for each task and source in it
    out = placed.join(F.broadcast(parts) if parts.count() <= BROADCAST_KEYS else parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p")))
    rank = (F.col("_at") - F.col("_first") + F.col("_before")).cast("double")
    crossed = F.floor(F.col("_u") + F.col("_r") * (rank + 1)) - F.floor(F.col("_u") + F.col("_r") * rank)
    return out.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.ceil("_r")).cast("long").alias("copies"), *more)


def taken(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The mix itself, as rows of docs with all their columns: each row as often as mix() says, whatever its doc_id.

    Rows go through the mix whole, as nothing in them need tell one from another: null and repeated doc_ids and any names of columns
    are as good as others. A null text has no words, so that it doesn't count for its source, but can be taken with it; an empty table gives an empty one."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    out = _mixed(rows, weights, max_repeat, seed).filter("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_i")).select("_row.*")
