"""Append-only logs: typed scans of JSON lines, open entries by replay, suppression of re-filing, new ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import log_id
from ..schema import ACTIONS, LOG_KINDS, SEVERITIES

ID = r"^chg-[0-9]+$"


def _is(value: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == kind, F.lit(False))


def read_lines(lines: DataFrame, column: str = "value", pending: bool = True) -> DataFrame:
    """``lines`` with ``entry`` (a variant) and ``readable``: blank lines are gone; a row must be a JSON object with a non-empty string id, and in the pending log with kind and severity that are strings by their own type."""
    rows = lines.where(F.trim(F.regexp_replace(column, r"[\x09-\x0d\x1c-\x20]+", " ")) != "").withColumn("entry", F.try_parse_json(column))
    good = F.coalesce(F.schema_of_variant("entry").startswith("OBJECT"), F.lit(False)) & _is(F.col("entry"), "$.id", "STRING")
    good &= F.coalesce(F.try_variant_get("entry", "$.id", "string") != "", F.lit(False))
    if pending:
        good &= _is(F.col("entry"), "$.kind", "STRING") & _is(F.col("entry"), "$.severity", "STRING")
    return rows.withColumn("readable", good)


def entries(read: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The readable rows' fields."""
    return read.where("readable").select(F.from_json(column, schema).alias("e")).select("e.*")


def unreadable(*reads: DataFrame) -> DataFrame:
    """How many lines of the logs are unreadable, in one row."""
    counts = [r.agg(F.count_if(~F.col("readable")).alias("n")) for r in reads]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.union(c)
    return whole.agg(F.sum("n").alias("unreadable"))


def open_entries(pending: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Entries without a resolution of the same id; nothing is edited, so state is what replay gives."""
    return pending.join(resolutions.select("id"), "id", "left_anti")


def by_severity(entries: DataFrame, domain: tuple[str, ...] = SEVERITIES, column: str = "severity") -> DataFrame:
    """total (other severities too) and a count for each value of the domain, zero if it doesn't occur."""
    return entries.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(column) == s).alias(s) for s in domain))


def next_number(*logs: DataFrame) -> DataFrame:
    """last: the largest number of ids of the form chg-<digits> in any of the logs, 0 if there is none."""
    ids = [x.select("id") for x in logs]
    both = ids[0]
    for x in ids[1:]:
        both = both.unionByName(x)
    return both.where(F.col("id").rlike(ID)).agg(F.coalesce(F.max(F.substring("id", 5, 20).cast("long")), F.lit(0)).alias("last"))


def with_ids(new: DataFrame, order: list[Column | str], *logs: DataFrame) -> DataFrame:
    """``new`` with consecutive ids that follow those of the logs, in ``order``.

    Rows are numbered within ranges of the order and ranges by a prefix sum
    over their counts, so that no task holds all rows. Ids past 9999 are as wide as they need to be.
    """
    spark = new.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = new.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    within = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per partition
    numbered = within.join(F.broadcast(before), "_part").join(F.broadcast(next_number(*logs)))
    return numbered.withColumn("id", log_id(F.col("last") + F.col("_before") + F.col("_in"))).drop("_part", "_in", "_before", "last")


def suppress(candidates: DataFrame, open_now: DataFrame, key: list[str]) -> DataFrame:
    """Candidates of which no open entry has the same key, null counting as a value; of candidates alike in it one is filed. A key is free again once its entry is resolved."""
    left, right = candidates.dropDuplicates(key).alias("c"), open_now.select(*key).distinct().alias("o")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    return left.join(right, condition, "left_anti")


def guard_resolutions(requests: DataFrame, pending: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Requests with ``verdict``: a bad action, an unknown id, one that is already resolved, or ok."""
    known = pending.select("id").distinct().withColumn("_known", F.lit(True))
    done = resolutions.select("id").distinct().withColumn("_done", F.lit(True))
    verdict = (
        F.when(~F.col("action").isin(*ACTIONS), "bad action")
        .when(F.col("_known").isNull(), "unknown id")
        .when(F.col("_done").isNotNull(), "already resolved")
        .otherwise("ok")
    )
    return requests.join(known, "id", "left").join(done, "id", "left").withColumn("verdict", verdict).drop("_known", "_done")


def enum_problems(log: DataFrame) -> DataFrame:
    """id and problem of rows whose kind or severity isn't of its domain."""
    bad = F.array_compact(
        F.array(
            F.when(~F.col("kind").isin(*LOG_KINDS), F.lit("kind must be one of " + ", ".join(LOG_KINDS))),
            F.when(~F.col("severity").isin(*SEVERITIES), F.lit("severity must be one of " + ", ".join(SEVERITIES))),
        )
    )
    return log.select("id", F.explode(bad).alias("problem"))


def add_extra(base: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Further fields of an entry: they may add columns and never replace one of its own."""
    return base.withColumns({k: c for k, c in extra.items() if k not in base.columns})
