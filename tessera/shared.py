"""Persistence, shared variables and job control."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark import Accumulator, AccumulatorParam, Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

LEVELS = {"NONE": StorageLevel.NONE, "MEMORY_ONLY": StorageLevel.MEMORY_ONLY, "MEMORY_AND_DISK": StorageLevel.MEMORY_AND_DISK, "DISK_ONLY": StorageLevel.DISK_ONLY}


def persist(df: DataFrame, level: str = "MEMORY_AND_DISK") -> DataFrame:
    """df kept once computed, for all that derive from it."""
    return df if level == "NONE" else df.persist(LEVELS[level])


def set_checkpoint_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder that all executors share: spark.checkpoint.dir if set, else the one given; a temporary one only on a local master."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or folder
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def broadcast_value(spark: SparkSession, value) -> Broadcast:
    return spark.sparkContext.broadcast(value)


def long_accumulator(spark: SparkSession, initial: int = 0) -> Accumulator:
    """Counts exactly in actions; in transformations a rerun task counts again."""
    return spark.sparkContext.accumulator(int(initial))


def double_accumulator(spark: SparkSession, initial: float = 0.0) -> Accumulator:
    return spark.sparkContext.accumulator(float(initial))


def accumulator(spark: SparkSession, initial, zero, add) -> Accumulator:
    """An accumulator of the user's own: zero() and add(a, b)."""

    class Param(AccumulatorParam):
        def zero(self, value):
            return zero()

        def addInPlace(self, a, b):
            return add(a, b)

    return spark.sparkContext.accumulator(initial, Param())


@contextmanager
def job_group(spark: SparkSession, group: str, description: str = ""):
    """Jobs begun inside belong to a group, which cancel(group) stops."""
    spark.sparkContext.setJobGroup(group, description, True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


def cancel(spark: SparkSession, group: str | None = None) -> None:
    spark.sparkContext.cancelAllJobs() if group is None else spark.sparkContext.cancelJobGroup(group)


@contextmanager
def scheduler_pool(spark: SparkSession, pool: str):
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)


def pool_file(path: str, pools: dict[str, tuple[int, int]]) -> None:
    """Writes pools (name -> weight, minimum share) for spark.scheduler.allocation.file."""
    rows = "".join(f'<pool name="{n}"><schedulingMode>FAIR</schedulingMode><weight>{w}</weight><minShare>{m}</minShare></pool>' for n, (w, m) in pools.items())
    with open(path, "w") as f:
        f.write(f"<allocations>{rows}</allocations>")


def run_job(rdd, f, partitions: list[int] | None = None) -> list:
    """f over the chosen partitions' iterators; their results in order."""
    return rdd.context.runJob(rdd, f, partitions)


def status(spark: SparkSession) -> dict:
    """What runs now: jobs with their stages, stages with their tasks, executors with theirs, and the address of the web interface."""
    t, infos = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
    jobs = [(i, t.getJobInfo(i)) for i in t.getActiveJobsIds()]
    stages = [(i, t.getStageInfo(i)) for i in t.getActiveStageIds()]
    return {
        "jobs": [{"id": i, "status": j.status, "stages": list(j.stageIds)} for i, j in jobs if j],
        "stages": [{"id": i, "name": s.name, "tasks": s.numTasks, "active": s.numActiveTasks, "done": s.numCompletedTasks, "failed": s.numFailedTasks} for i, s in stages if s],
        "executors": [{"host": e.host(), "port": e.port(), "running": e.numRunningTasks()} for e in infos],
        "ui": spark.sparkContext.uiWebUrl,
    }
