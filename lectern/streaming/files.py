"""Transcripts as a stream of files: each micro-batch runs the batch plan, which is right because a document is complete
in itself and every window is kept within one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def parse_stream(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """New files under ``source`` go through ``transform`` and are appended to ``sink``. A batch that is run again after
    a failure replaces its own output, so each file counts once."""

    def each(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    w = spark.readStream.schema(schema).format(fmt).load(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
