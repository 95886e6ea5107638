"""An extension: the keyed upsert as a stream, batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import merge


def upsert_stream(stream: DataFrame, target: str, keys: Sequence[str], values: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Merges every micro-batch into a Parquet table of versions under `target`.

    A batch reads the version before it and writes its own, so a batch that is run again
    after a failure gives the same version.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{target}/v{number - 1}") if number else batch.select(*keys, *values).limit(0)
        merge(old, batch, keys, values).write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Counts per event-time window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
