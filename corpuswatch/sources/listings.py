"""Listings: sitemaps, RSS and Atom feeds, version tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_html
from ..schema import LISTING_CHILDREN, LISTING_PAGES

PARSED = "error string, kind string, items array<struct<id:string,link:string,date:string,title:string>>, children array<string>"
# Namespaces of the two XML vocabularies.
MAPS, ATOM = "{http://www.sitemaps.org/schemas/sitemap/0.9}", "{http://www.w3.org/2005/Atom}"


def guard(body: Column) -> Column:
    """Why a listing isn't parsed: HTML served in its place, or a document type or entity declaration; null if it is fine."""
    head = F.upper(body)
    return F.when(looks_like_html(body), "listing is HTML").when(head.contains("<!DOCTYPE") | head.contains("<!ENTITY"), "listing declares a document type")


def _text(x: ET.Element, name: str) -> str:
    return (x.findtext(name) or "").strip()


def _entry(x: ET.Element) -> tuple:
    usual = (link.get("href") or "" for link in x.iterfind(f"{ATOM}link") if link.get("rel") in (None, "alternate"))
    link = next(usual, "").strip()
    return _text(x, f"{ATOM}id") or link, link, _text(x, f"{ATOM}published") or _text(x, f"{ATOM}updated") or None, _text(x, f"{ATOM}title")


def _item(x: ET.Element) -> tuple:
    link = _text(x, "link")
    return _text(x, "guid") or link, link, _text(x, "pubDate") or None, _text(x, "title")


def read_listing(body: str) -> dict:
    """``PARSED`` of one listing that passed the guard: a sitemap, an index of sitemaps, an Atom feed, or else RSS items."""
    out = {"error": None, "kind": None, "items": [], "children": []}
    try:
        root = ET.fromstring(body.lstrip("\ufeff \t\r\n"))
    except (ET.ParseError, ValueError, LookupError) as error:  # a listing cut short lists nothing for sure
        return out | {"error": f"listing is not XML: {error}"}
    name = root.tag.removeprefix(MAPS)
    if name == "sitemapindex":
        return out | {"kind": "index", "children": [loc for x in root.iter(f"{root.tag[: -len(name)]}sitemap") if (loc := _text(x, f"{root.tag[: -len(name)]}loc"))]}
    if name == "urlset":
        own = root.tag[: -len(name)]
        rows = ((_text(x, f"{own}loc"), _text(x, f"{own}lastmod") or None) for x in root.iterfind(f"{own}url"))
        return out | {"kind": "sitemap", "items": [(loc, loc, day, None) for loc, day in rows if loc]}
    found = map(_entry, root.iterfind(f"{ATOM}entry")) if root.tag == f"{ATOM}feed" else map(_item, root.iter("item"))
    return out | {"kind": "feed", "items": [x for x in found if x[0] and x[1]]}


def parsed(files: DataFrame) -> DataFrame:
    """files (source, body) with ``listing`` (``PARSED``); its error says why a guarded or malformed body, or a null one, isn't read. An Arrow-batched parse of whole bodies, which are bounded by the fetcher's budget."""

    def read(why: pd.Series, body: pd.Series) -> pd.DataFrame:
        empty = {"kind": None, "items": [], "children": []}
        rows = [{"error": w, **empty} if isinstance(w, str) else read_listing(b) if isinstance(b, str) else {"error": "no listing", **empty} for w, b in zip(why, body, strict=True)]
        return pd.DataFrame(rows, columns=["error", "kind", "items", "children"])

    read.__annotations__ = {"why": pd.Series, "body": pd.Series, "return": pd.DataFrame}  # postponed ones don't resolve in here
    return files.withColumn("listing", F.pandas_udf(read, PARSED)(guard(F.col("body")), F.col("body")))


def errors(files: DataFrame) -> DataFrame:
    """source and error of files that can't be read as a listing."""
    return parsed(files).where("listing.error is not null").select("source", F.col("listing.error").alias("error"))


def sitemap(files: DataFrame) -> DataFrame:
    """files (source, body) -> source, position, loc, lastmod of url elements with a loc; files with an error give none."""
    rows = parsed(files).where("listing.kind = 'sitemap'").select("source", F.posexplode("listing.items").alias("position", "x"))
    return rows.select("source", "position", F.col("x.link").alias("loc"), F.col("x.date").alias("lastmod"))


def sitemap_children(files: DataFrame, most: int = LISTING_CHILDREN) -> DataFrame:
    """source, position, loc of an index's child sitemaps, the first ``most``; n is how many it lists."""
    rows = parsed(files).where("listing.kind = 'index'").select("source", F.col("listing.children").alias("locs"))
    return rows.select("source", F.size("locs").alias("n"), F.posexplode(F.slice("locs", 1, most)).alias("position", "loc"))


def feed(files: DataFrame) -> DataFrame:
    """files (source, body) -> source, position, id, title, published, link of RSS items and Atom entries that have an id and a link."""
    rows = parsed(files).where("listing.kind = 'feed'").select("source", F.posexplode("listing.items").alias("position", "x"))
    return rows.select("source", "position", F.col("x.id").alias("id"), F.col("x.title").alias("title"), F.col("x.date").alias("published"), F.col("x.link").alias("link"))


def included(listing: DataFrame, prefixes: list[str], column: str = "loc") -> DataFrame:
    """Rows that start with one of the prefixes; all, if there are none."""
    if not prefixes:
        return listing
    keep = F.lit(False)
    for p in prefixes:
        keep |= F.col(column).startswith(p)
    return listing.where(keep)


def capped(listing: DataFrame, source: str, order: list[str], most: int = LISTING_PAGES) -> DataFrame:
    """The first ``most`` rows of each source in order, with ``listed``, how many there are.

    The cap is part of the listing's meaning. A source is ranked within 64 parts first, each of which keeps ``most`` rows, so no
    task gets all rows of a large source.
    """
    total = listing.groupBy(source).agg(F.count(F.lit(1)).alias("listed"))
    part = listing.withColumn("_p", F.pmod(F.xxhash64(*order), F.lit(64)))
    near = part.withColumn("_r", F.row_number().over(Window.partitionBy(source, "_p").orderBy(*order))).where(F.col("_r") <= most).drop("_r", "_p")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_r") <= most).drop("_r").join(total, source)
