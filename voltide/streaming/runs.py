"""Starting bounded and continuous runs of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def start(writer: DataStreamWriter, spark: SparkSession, checkpoint: str, trigger_seconds: int | None = None,
          state_partitions: int | None = None) -> StreamingQuery:
    """Start a stream; without ``trigger_seconds`` it processes what is there and stops.

    The number of state partitions is fixed by the first run of a checkpoint and cannot adapt later, so it can
    be given apart from the batch setting.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else writer.trigger(availableNow=True)
    try:
        if state_partitions:
            spark.conf.set(key, str(state_partitions))
        return writer.start()
    finally:
        spark.conf.set(key, before)


def run_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None,
                trigger_seconds: int | None = None) -> None:
    """Hand each micro-batch to ``merge``, until the input is used up or for ``seconds``."""
    query = start(stream.writeStream.foreachBatch(merge), stream.sparkSession, checkpoint, trigger_seconds)
    if seconds:
        query.awaitTermination(seconds)
        query.stop()
    else:
        query.awaitTermination()


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, partitions: tuple[str, ...] = (),
                   state_partitions: int | None = None, seconds: int | None = None, trigger_seconds: int | None = None) -> None:
    """Append a stream to a Parquet table, until its input is used up or for ``seconds``."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    if partitions:
        writer = writer.partitionBy(*partitions)
    query = start(writer, stream.sparkSession, checkpoint, trigger_seconds, state_partitions)
    if seconds:
        query.awaitTermination(seconds)
        query.stop()
    else:
        query.awaitTermination()
