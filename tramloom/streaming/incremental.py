"""Readings that keep arriving: new label files are normalised and appended once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tramloom.sources.files import append_new


def follow(spark: SparkSession, folder: str, schema: str, to: str, key: str, step: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies ``step`` to the parquet files that appear in ``folder`` and appends keys that ``to`` doesn't hold yet.

    The checkpoint makes every file count once across restarts; the anti join makes a repeated batch harmless."""
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(step(df), to, key))
    return (writer.trigger(availableNow=True) if once else writer).start()
