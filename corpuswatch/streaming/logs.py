"""The log as a stream: new pending lines against resolutions, once through what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs
from ..schema import PENDING


def pending_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Readable entries of JSON-lines files in ``folder`` as they appear."""
    return logs.entries(logs.read_lines(spark.readStream.text(folder)), PENDING)


def replay(spark: SparkSession, pending_folder: str, resolutions: DataFrame, target: str, checkpoint: str) -> None:
    """Appends entries that are open to ``target``; a run takes up what came since the one before, each batch under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = logs.open_entries(batch, resolutions)
        fresh.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = pending_stream(spark, pending_folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
