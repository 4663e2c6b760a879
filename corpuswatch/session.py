"""Session defaults and the table loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session with what the plans rely on: UTC, adaptive execution with skew joins. Shuffle partitions are left to the cluster unless given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuswatch")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
