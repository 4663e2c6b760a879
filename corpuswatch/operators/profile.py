"""The fifteen answers: checks, differences over the fixed domain, drift since the last scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import falsy, trigger_slug
from ..schema import ANSWER_STATUSES, DIMENSIONS, WATCHED
from .validate import tuple_text


def domain(spark: SparkSession, values: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "ordinal int, slug string")


def diff(domain: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Slugs of the domain whose value (slug, value: canonical JSON) differs, in order; a missing side is null."""
    both = F.broadcast(domain).join(old.select("slug", F.col("value").alias("old")), "slug", "left").join(new.select("slug", F.col("value").alias("new")), "slug", "left")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def checks(answers: DataFrame, attested: Column | None = None) -> DataFrame:
    """ordinal, problem, blocks: what is wrong with answers (slug, value, status), a row each.

    A proposed answer is reported and does not block. ``attested`` is a column
    of how many of confirmed_by and confirmed_at are set (0 to 2).
    """
    spark = answers.sparkSession
    rows = domain(spark).join(answers.withColumn("_there", F.lit(True)), "slug", "left")
    says = lambda text: F.concat("slug", F.lit(text))
    found = F.when(F.col("_there").isNull(), F.array(F.struct(says(": missing").alias("problem"), F.lit(True).alias("blocks")))).otherwise(
        F.array_compact(
            F.array(
                F.when(~F.coalesce(F.col("status").isin(*ANSWER_STATUSES), F.lit(False)), F.struct(says(f": status must be one of {tuple_text(ANSWER_STATUSES)}").alias("problem"), F.lit(True).alias("blocks"))),
                F.when(F.col("status") == "unanswered", F.struct(says(": unanswered").alias("problem"), F.lit(True).alias("blocks"))),
                F.when(F.col("status") == "proposed", F.struct(says(": proposed, not confirmed").alias("problem"), F.lit(False).alias("blocks"))),
                F.when((F.col("status") == "confirmed") & F.coalesce(F.col("value") == "null", F.lit(True)), F.struct(says(": confirmed but value is null").alias("problem"), F.lit(True).alias("blocks"))),
            )
        )
    )
    own = rows.select("ordinal", F.explode(found).alias("p")).select("ordinal", "p.*")
    unknown = answers.where(~F.col("slug").isin(*DIMENSIONS)).select(F.lit(len(DIMENSIONS)).alias("ordinal"), F.concat("slug", F.lit(": not a known dimension")).alias("problem"), F.lit(True).alias("blocks"))
    found = own.unionByName(unknown)
    if attested is None:
        return found
    left = rows.agg(F.count_if(~F.col("status").eqNullSafe("confirmed")).alias("left")).withColumn("set", attested)
    whole = F.when((F.col("left") == 0) & (F.col("set") < 2), F.struct(F.lit("confirmed_by and confirmed_at are required once every answer is confirmed").alias("problem"), F.lit(True).alias("blocks")))
    early = whole.when((F.col("left") > 0) & (F.col("set") > 0), F.struct(F.concat(F.lit("attested while "), F.col("left").cast("string"), F.lit(" answer(s) are not confirmed")).alias("problem"), F.lit(False).alias("blocks")))
    return found.unionByName(left.select(F.lit(len(DIMENSIONS) + 1).alias("ordinal"), early.alias("p")).where("p is not null").select("ordinal", "p.*"))


def carried(answers: DataFrame, snapshot: DataFrame) -> DataFrame:
    """slug and value now: a confirmed answer's own, else the last confirmed one."""
    last = snapshot.select("slug", F.col("value").alias("_last"))
    both = answers.join(last, "slug", "full")
    return both.select("slug", F.when(F.col("status") == "confirmed", F.col("value")).otherwise(F.col("_last")).alias("value"))


def triggers(regimes: DataFrame) -> DataFrame:
    """id, status and each slug that triggers it; triggered_by: texts, a slug before a colon."""
    return regimes.select("id", "status", "position", F.explode(F.array_distinct(F.transform("triggered_by", trigger_slug))).alias("slug"))


def drift(domain: DataFrame, snapshot: DataFrame, current: DataFrame, triggers: DataFrame) -> DataFrame:
    """Log rows for changed slugs: one regime-gone (major) per watched regime that a slug which is no longer true touches; else one regime-new (info) with the ids it touches, in order."""
    changed = diff(domain, snapshot, current)
    gone = changed.where(falsy(F.col("new"))).join(triggers.where(F.col("status").isin(*WATCHED)), "slug")
    gone = gone.select("ordinal", "slug", F.lit("regime-gone").alias("kind"), F.lit("major").alias("severity"), F.array("id").alias("affects"))
    touched = triggers.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda r: r["id"]).alias("ids"))
    new = changed.where(~falsy(F.col("new"))).join(touched, "slug", "left")
    new = new.select("ordinal", "slug", F.lit("regime-new").alias("kind"), F.lit("info").alias("severity"), F.coalesce("ids", F.array().cast("array<string>")).alias("affects"))
    return gone.unionByName(new)
