"""Dated versions: the one in force and the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE, VERSION = r"\A[0-9]{5}[A-Z]{1,2}[0-9]{4}\z", r"\A0[0-9]{4}[A-Z]{1,2}[0-9]{4}-[0-9]{8}\z"
DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def well_formed(versions: DataFrame, version: str = "version", date: str = "date", version_rx: str = VERSION, date_rx: str = DATE) -> DataFrame:
    return versions.where(F.col(version).rlike(version_rx) & F.col(date).rlike(date_rx))


def read_csv(spark: SparkSession, text: str) -> DataFrame:
    """base, version and date, the first three columns of a lookup's CSV answer; columns that are missing read as empty."""
    lines = spark.createDataFrame([(line,) for line in text.splitlines()[1:] if line.strip()], "line string")  # a batch's answer is a listing at most
    row = F.from_csv("line", "base string, version string, date string", {"mode": "PERMISSIVE"}).alias("r")
    return lines.select(row).select(*(F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("base", "version", "date")))


def of_base(found: DataFrame) -> DataFrame:
    """Rows whose version is of their base: a 0, then the base's year, sector and number."""
    return found.where(F.col("version").startswith(F.concat(F.lit("0"), F.substring("base", 2, 9))))


def current_and_next(versions: DataFrame, today: Column, base: str = "base", version: str = "version", date: str = "date", position: str | None = None) -> DataFrame:
    """base, current, current_date, next_version and next_date: the latest version dated up to ``today`` and the earliest after it; dates compare as strings.

    Of one date the version that comes first by ``position`` (by its name, without one) counts. One aggregation: maxima and minima of
    structs are combined before the shuffle, and a base with many versions is no window of its own.
    """
    at = F.col(position or version)
    row = F.struct(F.col(date).alias("d"), at.alias("p"), F.col(version).alias("v"))
    past = F.col(date) <= today
    # among the latest date the smallest position: find the date first, then the least struct of that date
    grouped = versions.groupBy(base, date).agg(F.min(row).alias("r"), F.first(past).alias("past"))
    return grouped.groupBy(base).agg(
        F.max_by("r.v", F.when(F.col("past"), F.col(date))).alias("current"),
        F.max(F.when(F.col("past"), F.col(date))).alias("current_date"),
        F.min_by("r.v", F.when(~F.col("past"), F.col(date))).alias("next_version"),
        F.min(F.when(~F.col("past"), F.col(date))).alias("next_date"),
    )


def consolidations(wanted: DataFrame, links: DataFrame, ids: DataFrame, dates: DataFrame) -> DataFrame:
    """The graph pattern of a version lookup: base -> consolidated work -> its id and date, where the id carries the base's middle part after a 0.

    wanted(base); links(base, work); ids(work, version); dates(work, date).
    """
    found = wanted.join(links, "base").join(ids, "work").join(dates, "work")
    return of_base(found).select("base", "version", "date")


def batches(ids: DataFrame, column: str, size: int) -> DataFrame:
    """Distinct ids with the number of their batch: ``size`` to a batch, in order. Numbered by ranges, as in ``logs.with_ids``."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.select(column).distinct().repartitionByRange(n, column).withColumn("_part", F.spark_partition_id())
    within = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(column)))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    number = F.floor((F.col("_before") + F.col("_in") - 1) / size)
    return within.join(F.broadcast(before), "_part").select(column, number.alias("batch"))


def lookup(sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """Each source beside what its batch resolved (base, current, next_version, next_date, error): a failed batch's error is each member's, and what nobody asked for is an error too."""
    return sources.join(resolved, "base", "left").withColumn("error", F.coalesce("error", F.when(F.col("current").isNull(), F.concat("base", F.lit(": no consolidation in the graph")))))
