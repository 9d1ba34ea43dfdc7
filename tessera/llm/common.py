"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words (fixed value): space, and tab to carriage return.
WS = r"[\x20\x09-\x0D]+"
#: A word (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"

#: A list of 8-byte keys is broadcast up to this many rows (16 MB); beyond, the join shuffles.
BROADCAST_KEYS = 2_000_000

#: Rows in a batch for Python: with mean texts of a few KB, a few MB.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a temporary one is taken, on a local master only."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path for it, a maker of further paths)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make(path), make


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    fs, at, _ = file_system(spark, path)
    fs.delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a copy in the shared folder, which outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like checkpoint(), as compressed columns: for what is large, or read by part of its columns."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: higher-order functions evaluate what they capture for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, as an array."""
    t = F.btrim(text, F.lit(WS_CHARS))
    return F.when((t == "") | t.isNull(), F.array().cast("array<string>")).otherwise(F.split(t, WS))


def n_words(text: Column) -> Column:
    """The number of words, without making them: each becomes one character."""
    t = F.ltrim(text, F.lit(WS_CHARS))
    return F.coalesce(F.char_length(F.regexp_replace(t, f"{WORD}{WS[:-1]}*+", "x")), F.lit(0)).cast("long")


def with_texts(docs: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs joined with wanted on key.

    docs holds whole texts and wanted, one row a key, is far smaller. If the keys of wanted fit a checked
    bound they are broadcast to thin docs out first, so that only texts that are needed are shuffled."""
    if wanted.count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(wanted.select(key)), key, "left_semi")
    return docs.join(wanted.hint("shuffle_hash"), key)


def semi(df: DataFrame, keys: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """The rows of df whose key is in keys, a stored table with one row a key.

    Keys are broadcast up to the checked bound; beyond it every key stands `salts` times, so that the rows of a hot key are spread."""
    if keys.count() <= BROADCAST_KEYS:
        return df.join(F.broadcast(keys), key, "left_semi")
    spread = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")).join(spread, [key, "_salt"], "left_semi").drop("_salt")


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers wait for further tasks beside the JVM, whose memory counts with theirs."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), run being fed slices of BATCH_ROWS rows, as texts can be long; Spark bounds batches by bytes."""

    names = df.columns

    def sliced(batches):
        yield from run(b.slice(at, BATCH_ROWS).rename_columns(names) for b in batches for at in range(0, b.num_rows, BATCH_ROWS))
        give_back()

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(sliced, schema)  # names with dots wouldn't be found


#: Bounds of Arrow batches for whole texts, which hold two of them a task in the JVM and in Python.
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by BATCH_SETTINGS where the session doesn't bound them itself, and returns it.

    For what owns a session: queries and the pipeline's stages. Operators leave settings alone and work under any."""
    conf = spark._jsparkSession.sessionState().conf()
    for key, value in BATCH_SETTINGS.items():
        if not conf.contains(key):
            spark.conf.set(key, value)
    return spark


def with_arrays(df: DataFrame, make, fields: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """df (of its columns those in keep, if given) with more columns, made from Arrow batches of its rows; columns of their names are replaced.

    make() runs once a task and returns a function from a batch to a list of Arrow arrays, in the order of fields; if that has an
    attribute close, it is called when the task ends. Batches are kept small, as texts can be long."""
    import pyarrow as pa

    new = T.StructType.fromDDL(fields)
    df = df.drop(*new.names)
    kept = [f for f in df.schema.fields if keep is None or f.name in keep]
    schema = T.StructType(kept + new.fields)
    names, at = schema.names, [df.columns.index(f.name) for f in kept]

    def run(batches):
        of = make()
        for part in batches:
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at), *of(part)], names=names)
        getattr(of, "close", bool)()

    return arrow_map(df, run, schema)
