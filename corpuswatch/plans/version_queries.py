"""Versions, manifests and freshness, from orders, documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import freshness, manifest, validate, versions
from ..sources import listings
from ..session import table
from .common import TODAY, hashed, host
from .registry import query

DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(
    f"""WITH v AS (SELECT o_custkey, o_orderkey, {DAY} AS day FROM orders),
    past AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey) AS r FROM v WHERE day <= '{TODAY}'),
    future AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS r FROM v WHERE day > '{TODAY}')
    SELECT c.o_custkey, p.o_orderkey AS current, p.day AS current_date, f.o_orderkey AS next_version, f.day AS next_date
    FROM (SELECT DISTINCT o_custkey FROM v) c LEFT JOIN (SELECT * FROM past WHERE r = 1) p USING (o_custkey) LEFT JOIN (SELECT * FROM future WHERE r = 1) f USING (o_custkey)"""
)
def asof_current_next(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return versions.current_and_next(rows, F.lit(TODAY), "o_custkey", "o_orderkey", "day")


_OLD_DAY = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '2024-01-01' ELSE '2023-12-31' END"
_NEW_DAY = "CASE doc_id % 5 WHEN 0 THEN NULL ELSE '2024-01-01' END"


@query(
    f"""WITH listing AS (SELECT doc_id, {_NEW_DAY} AS lastmod FROM documents), stored AS (SELECT doc_id, {_OLD_DAY} AS old FROM documents WHERE doc_id % 3 <> 0)
    SELECT doc_id, s.doc_id IS NOT NULL AS known, CASE WHEN s.doc_id IS NULL THEN true WHEN lastmod IS NULL OR old IS NULL THEN true ELSE lastmod <> old END AS changed
    FROM listing l LEFT JOIN stored s USING (doc_id)"""
)
def needs_refresh_lastmod(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = docs.where("doc_id % 3 <> 0").select("doc_id", F.expr(_OLD_DAY).alias("lastmod"), F.lit(None).cast("string").alias("hash"))
    found = manifest.compare(docs.select("doc_id", F.expr(_NEW_DAY).alias("lastmod")), stored, ["doc_id"])
    return found.select("doc_id", "known", "changed")


@query(
    f"""WITH now AS (SELECT page_id, {hashed('html')} AS hash FROM pages), stored AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'x' ELSE {hashed('html')} END AS old FROM pages WHERE page_id % 7 <> 0)
    SELECT page_id, CASE WHEN s.page_id IS NULL THEN true ELSE hash <> old END AS changed FROM now n LEFT JOIN stored s USING (page_id)"""
)
def needs_refresh_hash(spark, sf_dir):
    now = table(spark, sf_dir, "pages").select("page_id", tx.content_hash(F.col("html")).alias("hash"))
    stored = now.where("page_id % 7 <> 0").select("page_id", F.lit(None).cast("string").alias("lastmod"), F.when(F.col("page_id") % 5 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return manifest.compare(now, stored, ["page_id"], None, "hash").select("page_id", "changed")


_TIER = "CASE WHEN length(host) % 2 = 0 THEN 'page-hash' ELSE 'sitemap' END"


@query(
    f"""WITH items AS (SELECT {host('url')} AS host, page_id % 9 = 0 AS changed, page_id % 31 = 0 AS failed FROM pages),
    per AS (SELECT host, {_TIER} AS tier, count(*) AS n, count(*) FILTER (changed) AS n_changed, count(*) FILTER (failed) AS n_failed FROM items GROUP BY host)
    SELECT host, n, n_changed, n_failed, CASE WHEN tier = 'page-hash' AND n_changed > 0 THEN 'moved' WHEN n_failed > 0 THEN 'unreachable' WHEN n_changed > 0 THEN 'moved' ELSE 'fresh' END AS freshness FROM per"""
)
def freshness_three_valued(spark, sf_dir):
    items = table(spark, sf_dir, "pages").select(tx.host(F.col("url")).alias("host"), "page_id", (F.col("page_id") % 9 == 0).alias("changed"), (F.col("page_id") % 31 == 0).alias("failed"))
    tier = F.when(F.length("host") % 2 == 0, "page-hash").otherwise("sitemap")
    return freshness.by_source(items, "host", tier, "page_id").select("host", "n", "n_changed", "n_failed", "freshness")


@query(f"SELECT host, page_id, listed FROM (SELECT {host('url')} AS host, page_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY {host('url')}) AS listed FROM pages WINDOW w AS (PARTITION BY {host('url')} ORDER BY page_id)) WHERE r <= 3")
def listing_caps_per_host(spark, sf_dir):
    return listings.capped(table(spark, sf_dir, "pages").select(tx.host(F.col("url")).alias("host"), "page_id"), "host", ["page_id"], 3)


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.') OR starts_with(url, 'http://th')")
def include_prefix_filter(spark, sf_dir):
    return listings.included(table(spark, sf_dir, "pages").select("page_id", "url"), ["https://m.", "http://th"], "url")


@query(
    """SELECT l_suppkey, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) FILTER (r <= 20) AS shown, count(*) AS total
    FROM (SELECT l_suppkey, item, row_number() OVER (PARTITION BY l_suppkey ORDER BY item) AS r FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS item FROM lineitem)) GROUP BY l_suppkey"""
)
def changed_top20(spark, sf_dir):
    """A supplier's lines, of which the first 20 are shown."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"))
    lists = freshness.first_items(lines, "l_suppkey", "item")
    return lists.select("l_suppkey", F.array_join("shown", ",").alias("shown"), "total")


@query(
    r"""SELECT p_partkey, p_name, p_type FROM (SELECT p_partkey, p_name, p_type, 'Brand#' || right(p_brand, 2) AS b FROM parts_view)
    WHERE regexp_full_match(b, 'Brand#[1-3][0-9]') AND regexp_full_match(p_type, '[A-Z]+( [A-Z]+)*')""".replace("parts_view", "part")
)
def version_wellformed_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("b", F.concat(F.lit("Brand#"), F.expr("right(p_brand, 2)")))
    return versions.well_formed(rows, "b", "p_type", r"\ABrand#[1-3][0-9]\z", r"\A[A-Z]+( [A-Z]+)*\z").select("p_partkey", "p_name", "p_type")


@query(
    """WITH ids AS (SELECT p_partkey AS work, '0' || lpad(CAST(p_partkey % 500 AS VARCHAR), 9, '0') || '-' || p_partkey AS version FROM part)
    SELECT '1' || lpad(CAST(o_orderkey % 500 AS VARCHAR), 9, '0') AS base, version, strftime(l_shipdate, '%Y-%m-%d') AS date
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN ids ON work = l_partkey
    WHERE starts_with(version, '0' || lpad(CAST(o_orderkey % 500 AS VARCHAR), 9, '0'))"""
)
def graph_pattern_join(spark, sf_dir):
    """Works are parts, dates those of shipping: order -> its lines' parts -> their ids."""
    base = F.concat(F.lit("1"), F.lpad((F.col("o_orderkey") % 500).cast("string"), 9, "0"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("work"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.concat(F.lit("0"), F.lpad((F.col("p_partkey") % 500).cast("string"), 9, "0"), F.lit("-"), F.col("p_partkey").cast("string")).alias("version"))
    orders = table(spark, sf_dir, "orders").select(base.alias("base"), F.col("o_orderkey").alias("item"))
    wanted, links = orders.select("base", "item"), lines.select(F.col("o_orderkey").alias("item"), "work").distinct()
    dates = lines.select(F.col("o_orderkey").alias("item"), "work", "date")
    keyed = lambda df: df.withColumn("work", F.struct("item", "work"))  # noqa: E731  a line's date is of its order and part
    ids = ids.join(links, "work").select(F.struct("item", "work").alias("work"), "version")
    return versions.consolidations(orders.select("base").distinct(), wanted.join(links, "item").select("base", F.struct("item", "work").alias("work")), ids, keyed(dates).select("work", "date"))


@query("SELECT p_brand || '/' || p_size AS id, CAST(floor((row_number() OVER (ORDER BY p_brand || '/' || p_size) - 1) / 100) AS BIGINT) AS batch FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def basket_batches(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("id"))
    return versions.batches(ids, "id", 100)


@query(
    f"""SELECT o_orderkey, {DAY} AS review_by FROM orders o WHERE o_orderstatus IN ('F', 'P') AND {DAY} <= '{TODAY}'
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"""
)
def date_passed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus").isin("F", "P"), "binds").otherwise("ruled-out").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("review_by"))
    filed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.lit("date-passed").alias("kind"), F.array("l_orderkey").alias("affects"))
    return freshness.dates_passed(orders, filed, TODAY).select(F.col("id").alias("o_orderkey"), "review_by")


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}') AS INTEGER) END AS age FROM orders"""
)
def age_days(spark, sf_dir):
    stamp = F.when(F.col("o_orderkey") % 26 == 0, "soon").when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.age_days(stamp, TODAY).alias("age"))


@query(
    """SELECT o_custkey AS source, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS affects FROM (
        SELECT DISTINCT o_custkey, l_suppkey AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('O', 'P')) GROUP BY o_custkey"""
)
def affects_rollup(spark, sf_dir):
    """A supplier is a regime that cites the customers of its orders; orders still open are watched."""
    cites = table(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'P')").join(table(spark, sf_dir, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    regimes = cites.select(F.col("l_suppkey").alias("id"), "o_custkey").distinct().select("id", F.lit("binds").alias("status"), F.col("id").alias("position"), F.array("o_custkey").alias("sources"))
    return freshness.affects(regimes).select("source", F.array_join("affects", ",").alias("affects"))


@query(
    """SELECT l_orderkey, bool_and(before IS NULL OR before < l_partkey) AS increasing, count(*) AS n
    FROM (SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem) GROUP BY l_orderkey"""
)
def strictly_increasing_check(spark, sf_dir):
    """Whether part numbers rise along an order's lines (of lines with one number, by part)."""
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey"))
    return validate.strictly_increasing(lines, "l_orderkey", "at", "l_partkey")
