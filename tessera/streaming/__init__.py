"""Streams. The engine's own operators are batch operators; over a stream use them inside foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs f(batch, number) over all that a stream has now, and ends; the checkpoint folder remembers what is done."""
    return stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
