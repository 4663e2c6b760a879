"""Manifests: what of a listing is new or changed against what was stored, and the upsert afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, page_path


def needs_refresh(present: Column, lastmod: Column, hash_: Column, old_lastmod: Column, old_hash: Column) -> Column:
    """Nothing stored: yes. A hash given: if it differs. Else if a date is missing on either side, or they differ."""
    blank = lambda c: c.isNull() | (c == "")
    return (
        F.when(~present, True)
        .when(hash_.isNotNull(), ~hash_.eqNullSafe(old_hash))
        .when(blank(lastmod) | blank(old_lastmod), True)
        .otherwise(lastmod != old_lastmod)
    )


def compare(listing: DataFrame, manifest: DataFrame, keys: list[str], lastmod: str | None = "lastmod", hash_: str | None = None) -> DataFrame:
    """The listing with ``known`` and ``changed``; a key that the manifest lacks is changed."""
    stored = manifest.select(*keys, F.col("lastmod").alias("_lastmod"), F.col("hash").alias("_hash"), F.lit(True).alias("_known"))
    none = F.lit(None).cast("string")
    known = F.col("_known").isNotNull()
    changed = needs_refresh(known, F.col(lastmod) if lastmod else none, F.col(hash_) if hash_ else none, F.col("_lastmod"), F.col("_hash"))
    return listing.join(stored, keys, "left").withColumn("known", known).withColumn("changed", changed).drop("_lastmod", "_hash", "_known")


def new_entries(listing: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    return listing.join(manifest.select(*keys), keys, "left_anti")


def read_manifests(files: DataFrame) -> DataFrame:
    """Entries of manifest files (source_id, value: their JSON): what isn't an object of objects is left out."""
    parsed = files.select("source_id", F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    rows = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer())) if hasattr(DataFrame, "lateralJoin") else parsed
    rows = rows.where(F.schema_of_variant("value").startswith("OBJECT"))
    field = lambda name: F.try_variant_get("value", f"$.{name}", "string").alias(name)
    return rows.select("source_id", "key", *map(field, ("fetched", "lastmod", "hash", "path", "version")))


def upsert(manifest: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The manifest after a run: rows of the new keys replaced, the others kept."""
    return manifest.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def fetched_rows(pages: DataFrame, today: str) -> DataFrame:
    """Manifest rows of converted pages (source_id, key, lastmod, markdown, version)."""
    return pages.select("source_id", "key", F.lit(today).alias("fetched"), "lastmod", content_hash(F.col("markdown")).alias("hash"), page_path(F.col("key")).alias("path"), "version")


def provenance(pages: DataFrame, today: str, meta: list[str]) -> DataFrame:
    """Stored pages: source, source_url (the page's own, else the source's), retrieved_at, content_hash, licence fields, then the page's ``meta`` columns, which replace base columns of the same name; visibility is public only where the licence says so."""
    base = {
        "source": F.col("source_id"),
        "source_url": F.coalesce("page_url", "url"),
        "retrieved_at": F.lit(today),
        "content_hash": content_hash(F.col("markdown")),
        "licence_name": F.col("licence.name"),
        "attribution": F.col("licence.attribution"),
        "visibility": F.when(F.coalesce(F.col("licence.redistribute"), F.lit(False)), "public").otherwise("private"),
    }
    base |= {m: F.col(m) for m in meta}
    return pages.select(*(c.alias(n) for n, c in base.items()), "markdown")


def usable(pages: DataFrame) -> DataFrame:
    """Pages (status, html, markdown, body) with ``refused``: why one isn't usable, null where it is."""
    from ..functions.text import looks_like_html

    why = F.when(~F.col("status").eqNullSafe(200), "status").when(~looks_like_html(F.col("html")), "not html").when(F.col("markdown").isNull(), "nothing usable")
    return pages.withColumn("refused", why)
