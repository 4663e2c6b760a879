"""Freshness of sources in three values, and what a run reports and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CHANGED_SHOWN, FRESHNESS, WATCHED


def by_source(items: DataFrame, source: str, tier: Column | str, shown: str) -> DataFrame:
    """One row per source: freshness, n (items), n_changed, n_failed, changed (the first 20 of ``shown`` in order).

    items: source, changed (boolean), failed (boolean). ``tier`` decides:
    page-hash is moved where any item changed, whether or not others failed,
    else unreachable where any failed; any other tier is unreachable where any failed; a feed
    without entries is unreachable, a sitemap without is fresh. Lists are cut to 20 after each
    source's changed items are ordered by (rank, name), so no long list is gathered.
    """
    flags = items.groupBy(source).agg(
        F.count(shown).alias("n"), F.count_if("changed").alias("n_changed"), F.count_if("failed").alias("n_failed"), F.first(tier if isinstance(tier, Column) else F.lit(tier)).alias("tier")
    )
    return flags.withColumn("freshness", decide(F.col("tier"), F.col("n"), F.col("n_changed"), F.col("n_failed"))).drop("tier")


def decide(tier: Column, n: Column, n_changed: Column, n_failed: Column) -> Column:
    return (
        F.when((tier == "page-hash") & (n_changed > 0), "moved")
        .when(n_failed > 0, "unreachable")
        .when((tier == "feed") & (n == 0), "unreachable")
        .when(n_changed > 0, "moved")
        .otherwise("fresh")
    )


def decide_version(current: Column, last: Column, error: Column) -> Column:
    """Freshness of a source by its version in force; without one nothing can be told."""
    return F.when(error.isNotNull() | current.isNull(), "unreachable").when(~current.eqNullSafe(last), "moved").otherwise("fresh")


def first_items(items: DataFrame, source: str, item: str, limit: int = CHANGED_SHOWN) -> DataFrame:
    """source, shown (the first ``limit`` items in order) and total.

    Items are ranked within their source in two steps: each of 64 parts of a source keeps its
    first ``limit``, then those of all parts are ranked, so that a source with a third of all items is dealt over many tasks.
    """
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64(item), F.lit(64))
    rows = items.select(source, item, part.alias("_p"))
    total = rows.groupBy(source).agg(F.count(F.lit(1)).alias("total"))
    near = rows.withColumn("_r", F.row_number().over(Window.partitionBy(source, "_p").orderBy(item))).where(F.col("_r") <= limit)
    lists = near.groupBy(source).agg(F.slice(F.array_sort(F.collect_list(item)), 1, limit).alias("shown"))
    return lists.join(total, source)


def selected(sources: DataFrame, ids: list[str] | None, refuse: bool = False) -> DataFrame:
    """Sources that a run is about: the confirmed ones, or those named; ``refuse`` keeps the tier that is never fetched."""
    rows = sources.where(F.col("status") == "confirmed") if ids is None else sources.where(F.col("id").isin(ids))
    return rows if refuse else rows.where(F.col("tier") != "refuse")


def run_report(results: DataFrame, refused: Column | None = None) -> DataFrame:
    """One row: a count per freshness and exit (2 if nothing was chosen or anything refused, 1 if anything is unreachable, else 0)."""
    refused = F.lit(False) if refused is None else refused
    counts = [F.count_if(F.col("freshness") == f).alias(f) for f in FRESHNESS]
    code = F.when((F.count(F.lit(1)) == 0) | (F.count_if(refused) > 0), 2).when(F.count_if(F.col("freshness") == "unreachable") > 0, 1).otherwise(0)
    return results.agg(*counts, code.alias("exit"))


def fetch_report(results: DataFrame) -> DataFrame:
    """written and skipped summed; exit 2 on a validation refusal or a named source that is never fetched, 1 if anything else was refused, else 0. results: written, skipped, refused, invalid."""
    code = F.max(F.when(F.col("invalid"), 2).when(F.col("refused") > 0, 1).otherwise(0))
    return results.agg(F.coalesce(F.sum("written"), F.lit(0)).alias("written"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"), F.coalesce(code, F.lit(0)).alias("exit"))


def affects(regimes: DataFrame, source_ids: DataFrame | None = None) -> DataFrame:
    """source, affects: ids of watched regimes (id, status, sources, position) that cite the source, each once, in order."""
    cited = regimes.where(F.col("status").isin(*WATCHED)).select("id", "position", F.explode(F.array_distinct("sources")).alias("source"))
    if source_ids is not None:
        cited = cited.join(source_ids.select(F.col("id").alias("source")), "source", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("position", "id")))
    return cited.groupBy("source").agg(F.transform(ordered, lambda r: r["id"]).alias("affects"))


def filings(results: DataFrame, open_now: DataFrame) -> DataFrame:
    """Log rows that a check files: source-moved (major), source-unreachable and source-next (info), except where an equal one is open.

    results: id, freshness, version, detail, next_version, known_next, changed,
    affects. Moved and next entries are equal by (kind, source, to), unreachable
    ones by (kind, source).
    """
    from .logs import suppress

    none = F.lit(None).cast("string")
    row = lambda kind, severity, to, summary: (F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col("id").alias("source"), to.alias("to"), summary.alias("summary"), "affects")
    moved = results.where("freshness = 'moved'").select(*row("source-moved", "major", F.col("version"), F.col("detail")))
    lost = results.where("freshness = 'unreachable'").select(*row("source-unreachable", "info", none, F.col("detail")))
    next_ = results.where("next_version is not null and not (next_version <=> known_next)")
    next_ = next_.select(*row("source-next", "info", F.col("next_version"), F.concat(F.lit("a later version is scheduled: "), F.col("next_version"))))
    keyed = suppress(moved.unionByName(next_), open_now, ["kind", "source", "to"])
    return keyed.unionByName(suppress(lost, open_now, ["kind", "source"]))


def profile_stale(any_moved: bool, readable: bool, already_open: bool, confirmed_at: str | None, today: str) -> bool:
    """Whether a profile is to be scanned again: a source moved after it was confirmed and nothing says so yet."""
    return any_moved and readable and not already_open and (not confirmed_at or confirmed_at < today)


def dates_passed(regimes: DataFrame, open_now: DataFrame, today: str) -> DataFrame:
    """Watched regimes (id, status, review_by) whose review date has come and of which no date-passed entry is open."""
    filed = open_now.where("kind = 'date-passed'").select(F.explode("affects").alias("id"))
    due = regimes.where(F.col("status").isin(*WATCHED) & (F.col("review_by") <= today))
    return due.join(filed, "id", "left_anti")
