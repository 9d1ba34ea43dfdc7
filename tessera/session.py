"""Sessions, configuration and the catalog of views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Short configuration names of this engine and the Spark settings that they stand for.
SETTINGS = {
    "sql.join.preferSortMergeJoin": "spark.sql.join.preferSortMergeJoin",
    "sql.adaptive.enabled": "spark.sql.adaptive.enabled",
    "coalescePartitions.targetSizeInBytes": "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "coalescePartitions.minPartitionSize": "spark.sql.adaptive.coalescePartitions.minPartitionSize",
    "skewJoin.enabled": "spark.sql.adaptive.skewJoin.enabled",
    "skewJoin.skewedPartitionThresholdInBytes": "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
    "skewJoin.skewedPartitionFactor": "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
    "memory.fraction": "spark.memory.fraction",
    "memory.storageFraction": "spark.memory.storageFraction",
    "scheduler.mode": "spark.scheduler.mode",
    "speculation": "spark.speculation",
    "speculation.interval": "spark.speculation.interval",
    "speculation.quantile": "spark.speculation.quantile",
    "speculation.multiplier": "spark.speculation.multiplier",
    "executor.instances": "spark.executor.instances",
    "executor.cores": "spark.executor.cores",
    "executor.memory": "spark.executor.memory",
    "heartbeatTimeout": "spark.network.timeout",
    "dynamicAllocation.enabled": "spark.dynamicAllocation.enabled",
    "dynamicAllocation.minExecutors": "spark.dynamicAllocation.minExecutors",
    "dynamicAllocation.maxExecutors": "spark.dynamicAllocation.maxExecutors",
    "dynamicAllocation.executorIdleTimeout": "spark.dynamicAllocation.executorIdleTimeout",
    "ui.enabled": "spark.ui.enabled",
    "ui.port": "spark.ui.port",
    "local.dir": "spark.local.dir",
    "driver.host": "spark.driver.host",
    "driver.port": "spark.driver.port",
}
#: Thresholds in rows: zero turns a broadcast off; other values leave Spark's own limit in bytes as it is.
ROW_THRESHOLDS = {
    "sql.autoBroadcastJoinThreshold.rows": "spark.sql.autoBroadcastJoinThreshold",
    "sql.adaptive.autoBroadcastJoinThreshold.rows": "spark.sql.adaptive.autoBroadcastJoinThreshold",
}
DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def translate(conf: Mapping[str, object]) -> dict[str, str]:
    """Settings of this engine as Spark's; names that start with spark. pass, unknown ones raise KeyError."""
    out = {}
    for key, value in conf.items():
        text = str(value).lower() if isinstance(value, bool) else str(value)
        if key in ROW_THRESHOLDS:
            if int(value) == 0:
                out[ROW_THRESHOLDS[key]] = "-1"
        else:
            out[key if key.startswith("spark.") else SETTINGS[key]] = text
    return out


def get_session(app: str = "tessera", master: str | None = None, conf: Mapping[str, object] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | translate(conf or {}))
    return (builder.master(master) if master else builder).getOrCreate()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Registers tables of a folder as views and returns them."""
    out = {}
    for name in names or TABLES:
        out[name] = load_table(spark, folder, name)
        out[name].createOrReplaceTempView(name)
    return out
