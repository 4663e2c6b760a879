"""Constraint checks that return a row per problem, and the checks of source records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import private_hosts_column
from ..functions.text import host, scheme
from ..schema import ADAPTERS, ADAPTER_OF_TIER, LANGUAGES, SOURCE_KINDS, SOURCE_STATUSES, TIERS

def tuple_text(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def problem_array(rules: Iterable[tuple[Column, Column]]) -> Column:
    """Messages of the rules that are broken, in order; a rule that is null counts as kept."""
    return F.array_compact(F.array(*(F.when(bad, message) for bad, message in rules)))


def problems(rows: DataFrame, key: str, rules: Iterable[tuple[Column, Column]]) -> DataFrame:
    return rows.select(key, F.explode(problem_array(rules)).alias("problem"))


def joined(problems: DataFrame, key: str) -> DataFrame:
    """key and its problems as one text, in the order of ``at``."""
    return problems.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "problem"))), lambda p: p["problem"]), "; ").alias("problems"))


def with_defaults(sources: DataFrame) -> DataFrame:
    """Sources with the adapter of their tier where none is named, and the URL's host where no host is allowed."""
    by_tier = F.coalesce(*(F.when(F.col("tier") == t, a) for t, a in ADAPTER_OF_TIER.items()))
    own = F.when(host(F.col("url")) != "", F.array(host(F.col("url")))).otherwise(F.array().cast("array<string>"))
    filled = F.size(F.coalesce("allowed_hosts", F.array().cast("array<string>"))) > 0
    return sources.withColumn("adapter", F.coalesce(F.when(F.col("adapter") != "", F.col("adapter")), by_tier)).withColumn("allowed_hosts", F.when(filled, F.col("allowed_hosts")).otherwise(own))


def source_problems(sources: DataFrame) -> DataFrame:
    """id and problem of source records, a row per problem. The texts are fixed values: they are what a run reports."""
    sources = sources.withColumn("_private", private_hosts_column(F.col("allowed_hosts")))
    says = lambda text: F.concat("id", F.lit(f": {text}"))
    one_of = lambda c, domain: (~F.coalesce(F.col(c).isin(*domain), F.lit(False)), says(f"{c} must be one of {tuple_text(domain)}"))
    no_adapter = F.coalesce(F.col("adapter"), F.lit("")) == ""
    hosts = F.col("allowed_hosts")
    listed = F.forall(hosts, lambda h: F.coalesce(h, F.lit("")) != "")
    private = F.col("_private")
    rules = [
        one_of("tier", TIERS),
        ((F.col("tier") == "api") & no_adapter, says("api tier needs an explicit adapter (eurlex)")),
        (~no_adapter & ~F.col("adapter").isin(*ADAPTERS), F.concat("id", F.lit(": unknown adapter '"), "adapter", F.lit(f"'; must be one of {tuple_text(ADAPTERS)}"))),
        one_of("kind", SOURCE_KINDS),
        one_of("status", SOURCE_STATUSES),
        (F.col("licence.redistribute").isNull(), says("licence.redistribute must be true or false")),
        (~scheme(F.col("url")).eqNullSafe("https"), says("url must be https")),
        (~F.coalesce(listed, F.lit(False)), says("allowed_hosts must be a list of hostnames")),
        (F.size(private) > 0, F.concat("id", F.lit(": allowed_hosts must not include local or private addresses ("), F.array_join(private, ", "), F.lit(")"))),
        ((F.col("adapter") == "eurlex") & ~F.coalesce(F.col("config.celex"), F.lit("")).rlike(r"\A[0-9]{5}[A-Z]{1,2}[0-9]{4}\z"), says("config.celex must be a base CELEX number (e.g. 32016R0679)")),
        ((F.col("adapter") == "eurlex") & F.col("config.language").isNotNull() & ~F.col("config.language").isin(*LANGUAGES), says("config.language must be one of [" + ", ".join(f"'{x}'" for x in sorted(LANGUAGES)) + "]")),
    ]
    return problems(sources, "id", rules)


def refusals(chosen: DataFrame, named: bool) -> DataFrame:
    """id and why a chosen source must not be touched: its problems, and a lacking confirmation where sources are named."""
    found = source_problems(chosen)
    if named:
        found = found.unionByName(chosen.where("status <> 'confirmed'").select("id", F.concat("id", F.lit(": required confirmation missing (status "), "status", F.lit(")")).alias("problem")))
    return found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("problem")), "; ").alias("why"))


def repeats(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Second and later rows of a key, in order, with their occurrence number. Keys that occur once are set aside by a combined count first."""
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    numbered = rows.join(often, keys, "left_semi").withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("occurrence > 1")


def strictly_increasing(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key and whether its values rise strictly in order."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.select(key, F.coalesce(before < F.col(value), F.lit(True)).alias("_up")).groupBy(key).agg(F.bool_and("_up").alias("increasing"), F.count(F.lit(1)).alias("n"))


def first_failure(guards: Iterable[tuple[Column, str]]) -> Column:
    """The name of the first guard whose condition doesn't hold (null counts as failing); null if all hold."""
    chain = None
    for holds, name in guards:
        failed = ~F.coalesce(holds, F.lit(False))
        chain = F.when(failed, name) if chain is None else chain.when(failed, name)
    return chain
