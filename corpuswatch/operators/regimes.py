"""Regime records: obligations from their body, validation as rows, counts over fixed domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OBLIGATION_KEYS, REGIME_REQUIRED, REGIME_STATUSES
from .validate import problems, tuple_text

HEADING = r"^### +([A-Za-z0-9][A-Za-z0-9._-]*) +[·-] +(.+?)\s*$"
BULLET = r"^- +\*\*([^*]+?):\*\*\s*(.*?)\s*$"


def carry_forward(lines: DataFrame, key: str, at: str, heading: Column) -> DataFrame:
    """``lines`` with ``heading``: the latest one at or before each line of its key; lines before the first have none."""
    order = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(heading, ignorenulls=True).over(order))


def obligations(regimes: DataFrame) -> DataFrame:
    """path, at, id, title, fields: an obligation per heading of the body; a bullet belongs to the latest heading and the last of a key counts. The window is one body."""
    lines = regimes.select("path", F.posexplode(F.split("body", "\r\n|\n|\r")).alias("at", "line"))
    head = F.when(F.col("line").rlike(HEADING), F.struct(F.col("at").alias("at"), F.regexp_extract("line", HEADING, 1).alias("id"), F.regexp_extract("line", HEADING, 2).alias("title")))
    lines = carry_forward(lines, "path", "at", head).where("heading is not null")
    key, value = F.trim(F.regexp_extract("line", BULLET, 1)), F.trim(F.regexp_extract("line", BULLET, 2))
    rows = lines.select("path", F.col("heading.at").alias("of"), "heading.id", "heading.title", F.col("at"), F.when(F.col("line").rlike(BULLET), key).alias("k"), value.alias("v"))
    last = rows.groupBy("path", "of", "id", "title", "k").agg(F.max_by("v", "at").alias("v"))
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))))
    return last.groupBy("path", "of", "id", "title").agg(fields.alias("fields")).withColumnRenamed("of", "at")


def unclear(fields: Column) -> Column:
    empty = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("")) == ""
    return empty("You must") | empty("It says")


def counts(regimes: DataFrame, obligations: DataFrame) -> DataFrame:
    """One row: regimes by status (zeros kept, other statuses not counted), obligations and the unclear ones."""
    names = {s: s.replace("-", "_") for s in REGIME_STATUSES}
    by = regimes.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in names.items()))
    of = obligations.agg(F.count(F.lit(1)).alias("obligations"), F.count_if(unclear(F.col("fields"))).alias("obligations_unclear"))
    return by.join(F.broadcast(of))


def validate(regimes: DataFrame, obligations: DataFrame) -> DataFrame:
    """path and problem. regimes: path, meta (a variant of the frontmatter); obligations as above. A row per problem."""
    meta = F.col("meta")
    text = lambda p: F.try_variant_get(meta, p, "string")
    kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(meta, p, "variant")), F.lit("VOID"))
    truthy = lambda p: ~F.coalesce(F.to_json(F.try_variant_get(meta, p, "variant")), F.lit("null")).isin("null", "false", "[]", "{}", '""', "0", "0.0")
    mapping = lambda p: kind(p).startswith("OBJECT")
    status = text("$.status")
    listed = F.try_variant_get(meta, "$.sources", "array<variant>")
    citing = kind("$.sources").startswith("ARRAY") & F.forall(listed, lambda s: F.coalesce(F.schema_of_variant(s).startswith("OBJECT"), F.lit(False)) & (F.coalesce(F.try_variant_get(s, "$.id", "string"), F.lit("")) != ""))
    some = obligations.select("path").distinct().withColumn("_some", F.lit(True))
    rules = [
        *((~truthy(f"$.{k}"), F.lit(f"{k}: required")) for k in REGIME_REQUIRED),
        (~F.coalesce(status.isin(*REGIME_STATUSES), F.lit(False)), F.lit(f"status: must be one of {tuple_text(REGIME_STATUSES)}")),
        (~F.coalesce(citing, F.lit(False)), F.lit("sources: must be a list of {id, version, retrieved}")),
        *((truthy(f"$.{k}") & ~mapping(f"$.{k}"), F.lit(f"{k}: must be a mapping")) for k in ("applies", "exempt")),
        ((status == "binds") & (mapping("$.applies") | ~truthy("$.applies")) & ~(truthy("$.applies.quote") & truthy("$.applies.cite")), F.lit("applies: quote and cite are required when status is binds")),
        ((status == "ruled-out") & (mapping("$.exempt") | ~truthy("$.exempt")) & ~truthy("$.exempt.reason"), F.lit("exempt.reason: required when status is ruled-out")),
        ((status == "ruled-out") & F.col("_some").isNotNull(), F.lit("obligations: a ruled-out regime must not list obligations")),
        (truthy("$.id") & (F.regexp_extract("path", r"([^/]*)\.md$", 1) != text("$.id")), F.concat(F.lit("filename "), F.regexp_extract("path", r"([^/]*)$", 1), F.lit(" does not match id "), text("$.id"))),
    ]
    own = problems(regimes.join(some, "path", "left"), "path", rules)
    order = Window.partitionBy("path", "id").orderBy("at")
    again = obligations.withColumn("_n", F.row_number().over(order)).where("_n > 1").select("path", F.concat(F.lit("obligations: duplicate id "), "id").alias("problem"))
    fields = obligations.select("path", "id", F.explode(F.map_keys("fields")).alias("k")).where(~F.col("k").isin(*OBLIGATION_KEYS))
    quoted = F.when(F.contains("k", F.lit("'")), F.concat(F.lit('"'), "k", F.lit('"'))).otherwise(F.concat(F.lit("'"), "k", F.lit("'")))
    return own.unionByName(again).unionByName(fields.select("path", F.concat("id", F.lit(": unknown field "), quoted).alias("problem")))


def status_of(scope: Column, exempt: Column) -> Column:
    """Three-valued: ruled out if exempt or out of scope, binding if in scope and not exempt, undetermined while an answer is null."""
    return F.when(exempt | ~scope, "ruled-out").when(scope & ~exempt, "binds").otherwise("undetermined")
