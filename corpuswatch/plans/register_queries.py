"""Records, manifests, selections and guards of the register, over rows made from the driver's tables by key arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..acquire import article_guard
from ..functions import html as hx
from ..functions import text as tx
from ..operators import freshness, logs, manifest, profile, regimes, robots, validate, versions
from ..schema import DIMENSIONS, LANGUAGES
from ..session import table
from ..sources import frontmatter
from .common import hashed
from .page_queries import _HTML
from .registry import query

_FRONT = "CASE WHEN doc_id % 50 = 0 THEN '---\\nid: d' WHEN doc_id % 7 = 0 THEN coalesce(text, '') ELSE concat('---\\nid: d', doc_id, '\\nday: 2024-01-0', 1 + doc_id % 9, '\\n---\\n\\n', coalesce(text, '')) END"


@query(
    """SELECT doc_id, CASE WHEN doc_id % 50 <> 0 AND doc_id % 7 <> 0 THEN 'd' || doc_id END AS id, CASE WHEN doc_id % 50 <> 0 AND doc_id % 7 <> 0 THEN '2024-01-0' || (1 + doc_id % 9) END AS day,
    CASE WHEN doc_id % 50 <> 0 THEN sha256(coalesce(text, '')) END AS body_hash, doc_id % 50 = 0 AS unreadable FROM documents WHERE NOT starts_with(coalesce(text, ''), chr(10))"""
)
def frontmatter_rows(spark, sf_dir):
    """Dates come out as text; a block that never ends is a row with an error."""
    docs = table(spark, sf_dir, "documents").where("not startswith(coalesce(text, ''), '\\n')")
    rows = docs.select("doc_id", frontmatter.parsed(F.expr(_FRONT)).alias("p"))
    field = lambda k: F.get_json_object("p.meta", f"$.{k}").alias(k)
    return rows.select("doc_id", field("id"), field("day"), F.sha2("p.body", 256).alias("body_hash"), F.col("p.error").isNotNull().alias("unreadable"))


@query(
    """SELECT 's' || doc_id AS source_id, 'https://x/' || doc_id AS key, 'h' || doc_id AS hash, CASE WHEN doc_id % 3 = 0 THEN '2024-01-01' END AS lastmod FROM documents WHERE doc_id % 20 NOT IN (0, 1)"""
)
def manifest_scan(spark, sf_dir):
    """A manifest a document: entries that are no objects are left out, and so are files that aren't JSON objects."""
    text = """CASE doc_id % 20 WHEN 0 THEN '{bad' WHEN 1 THEN '[1]' ELSE concat('{"junk": 3, "https://x/', doc_id, '": {"hash": "h', doc_id, '"', if(doc_id % 3 = 0, ', "lastmod": "2024-01-01"', ''), '}}') END"""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), F.expr(text).alias("value"))
    return manifest.read_manifests(files).select("source_id", "key", "hash", "lastmod")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS hash FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def manifest_upsert(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    old, new = keys.where("key % 2 = 0").withColumn("hash", F.lit("old")), keys.where("key % 3 = 0").withColumn("hash", F.lit("new"))
    return manifest.upsert(old, new, ["key"])


@query(
    f"""SELECT 'site' AS source_id, url AS key, '2024-02-01' AS fetched, CASE WHEN page_id % 2 = 0 THEN '2024-01-01' END AS lastmod, {hashed('html')} AS hash, left(sha1(url), 16) || '.md' AS path, page_id FROM pages"""
)
def fetched_manifest_rows(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("site").alias("source_id"), F.col("url").alias("key"), F.expr("if(page_id % 2 = 0, '2024-01-01', null)").alias("lastmod"), F.col("html").alias("markdown"), F.col("page_id").alias("version"))
    return manifest.fetched_rows(pages, "2024-02-01").withColumnRenamed("version", "page_id")


@query(
    f"""SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'status' WHEN NOT {_HTML.format(t="h")} THEN 'not html' WHEN page_id % 9 = 0 THEN 'nothing usable' END AS refused
    FROM (SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'plain text' ELSE html END AS h FROM pages)"""
)
def usable_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.expr("if(page_id % 10 = 0, 404, 200)").alias("status"), F.expr("if(page_id % 8 = 0, 'plain text', html)").alias("html"), F.expr("if(page_id % 9 = 0, null, 'x')").alias("markdown")
    )
    return manifest.usable(pages).select("page_id", "refused")


_PATH = "CASE doc_id % 6 WHEN 0 THEN 'profile.md' WHEN 1 THEN 'regimes/r.md' WHEN 2 THEN 'mirror/public/nl/x/a.md' WHEN 3 THEN 'regimes' WHEN 4 THEN 'notes/profile.md' ELSE 'mirrored.md' END"


@query(f"SELECT doc_id, {_PATH} AS path, CASE doc_id % 6 WHEN 0 THEN 'profile' WHEN 1 THEN 'regime' WHEN 2 THEN 'mirror' ELSE 'other' END AS kind FROM documents")
def kind_from_path(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path")).withColumn("kind", tx.kind_of(F.col("path")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.iso_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"))


@query("SELECT doc_id, doc_id % 7 AS longest, repeat('`', CAST(greatest(3, doc_id % 7 + 1) AS BIGINT)) AS fence FROM documents WHERE NOT contains(coalesce(text, ''), '`')")
def fence_widths(spark, sf_dir):
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" ` "), F.expr("repeat('`', int(doc_id % 7))"), F.lit(" x"))
    docs = table(spark, sf_dir, "documents").where("not contains(coalesce(text, ''), '`')").withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(body))
    return docs.select("doc_id", tx.longest_run(F.coalesce("body", F.lit(""))).cast("long").alias("longest"), tx.fence(F.coalesce("body", F.lit(""))).alias("fence"))


@query("SELECT doc_id, 'Content-Type,X-' || upper(left(lang, 1)) || substr(lang, 2) || '-Id' AS names FROM documents")
def header_names(spark, sf_dir):
    headers = F.create_map(F.lit("content-TYPE"), F.lit("a"), F.concat(F.lit("x-"), "lang", F.lit("-id")), F.lit("b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.map_keys(tx.header_case(headers)), ",").alias("names"))


_CODES = "CASE upper(lang) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " END"


@query(f"SELECT doc_id, {_CODES} AS code FROM documents")
def language_codes(spark, sf_dir):
    codes = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return table(spark, sf_dir, "documents").select("doc_id", F.try_element_at(codes, F.upper("lang")).alias("code"))


_TIER = "CASE s_suppkey % 4 WHEN 0 THEN 'refuse' WHEN 1 THEN 'feed' ELSE 'sitemap' END"
_STATUS = "CASE WHEN s_suppkey % 3 = 0 THEN 'proposed' ELSE 'confirmed' END"


@query(
    f"""WITH s AS (SELECT s_suppkey AS id, {_TIER} AS tier, {_STATUS} AS status FROM supplier)
    SELECT 'check' AS run, id FROM s WHERE status = 'confirmed' AND tier <> 'refuse' UNION ALL SELECT 'fetch', id FROM s WHERE status = 'confirmed'
    UNION ALL SELECT 'named', id FROM s WHERE id IN (3, 4, 5)"""
)
def source_selection(spark, sf_dir):
    """A check leaves out the tier that is never fetched, a fetch reports it, and sources that are named needn't be confirmed to be chosen."""
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(_TIER).alias("tier"), F.expr(_STATUS).alias("status"))
    runs = {"check": freshness.selected(sources, None), "fetch": freshness.selected(sources, None, True), "named": freshness.selected(sources, [3, 4, 5], True)}
    first, second, third = (df.select(F.lit(run).alias("run"), "id") for run, df in runs.items())
    return first.unionByName(second).unionByName(third)


@query(
    """SELECT CAST(sum(o_orderkey % 5) AS BIGINT) AS written, CAST(sum(o_orderkey % 3) AS BIGINT) AS skipped, CAST(max(CASE WHEN o_orderkey % 1000 = 7 THEN 2 WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS exit FROM orders"""
)
def fetch_totals(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((key % 5).alias("written"), (key % 3).alias("skipped"), (key % 11 == 0).cast("int").alias("refused"), (key % 1000 == 7).alias("invalid"))
    return freshness.fetch_report(rows)


_CODE = "CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 301 END"


@query(f"SELECT event_id, CASE WHEN c BETWEEN 200 AND 299 THEN 'rules' WHEN c BETWEEN 400 AND 499 THEN 'none' ELSE 'unknown' END AS state FROM (SELECT event_id, {_CODE} AS c FROM events)")
def robots_file_states(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", robots.file_state(F.expr(_CODE)).alias("state"))


@query(
    """SELECT o_orderkey, CASE WHEN error IS NOT NULL THEN error WHEN current IS NULL THEN base || ': no consolidation in the graph' END AS error, current
    FROM (SELECT o_orderkey, 'b' || o_custkey AS base FROM orders) LEFT JOIN
         (SELECT 'b' || c_custkey AS base, CASE WHEN c_custkey % 4 = 0 THEN 'failed batch' END AS error, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'v' || c_custkey END AS current FROM customer WHERE c_custkey % 5 <> 0) USING (base)"""
)
def basket_lookup(spark, sf_dir):
    """A failed batch's error is each member's, and what nobody resolved is an error too."""
    sources = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("base"))
    found = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").selectExpr("concat('b', c_custkey) AS base", "if(c_custkey % 4 = 0, 'failed batch', null) AS error", "if(c_custkey % 4 IN (1, 2), concat('v', c_custkey), null) AS current")
    return versions.lookup(sources, found).select("o_orderkey", "error", "current")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 THEN 'unreachable' WHEN o_custkey % 3 <> 1 OR o_orderkey % 5 = 0 THEN 'moved' ELSE 'fresh' END AS freshness FROM orders"""
)
def version_states(spark, sf_dir):
    key = F.col("o_orderkey")
    current, last = F.when(key % 7 != 0, F.lit("v1")), F.when(key % 5 != 0, F.concat(F.lit("v"), (F.col("o_custkey") % 3).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", freshness.decide_version(current, last, F.when(key % 9 == 0, F.lit("error"))).alias("freshness"))


_RESULTS = """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'moved' WHEN 1 THEN 'unreachable' ELSE 'fresh' END AS freshness, 'v' || (o_custkey % 4) AS version, 'd' || o_custkey AS detail,
    CASE WHEN o_orderkey % 4 = 0 THEN 'n' || (o_custkey % 3) END AS next_version, CASE WHEN o_orderkey % 8 = 0 THEN 'n0' END AS known_next FROM orders"""


@query(
    f"""WITH r AS ({_RESULTS}), open AS (SELECT o_orderkey AS source, CASE o_orderkey % 3 WHEN 0 THEN 'source-moved' WHEN 1 THEN 'source-unreachable' ELSE 'source-next' END AS kind, CASE WHEN o_orderkey % 3 <> 1 THEN 'v1' END AS "to" FROM orders WHERE o_orderkey % 5 = 0),
    filed AS (
        SELECT 'source-moved' AS kind, 'major' AS severity, id AS source, version AS "to", detail AS summary FROM r WHERE freshness = 'moved'
        UNION ALL SELECT 'source-unreachable', 'info', id, NULL, detail FROM r WHERE freshness = 'unreachable'
        UNION ALL SELECT 'source-next', 'info', id, next_version, 'a later version is scheduled: ' || next_version FROM r WHERE next_version IS NOT NULL AND next_version IS DISTINCT FROM known_next)
    SELECT * FROM filed f WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.kind = f.kind AND o.source = f.source AND (f.kind = 'source-unreachable' OR o."to" = f."to"))"""
)
def check_filings(spark, sf_dir):
    """What a check files: a scheduled version once, an unreachable source once while its entry is open."""
    orders = table(spark, sf_dir, "orders")
    results = orders.selectExpr(
        "o_orderkey AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'moved' WHEN 1 THEN 'unreachable' ELSE 'fresh' END AS freshness", "concat('v', o_custkey % 4) AS version", "concat('d', o_custkey) AS detail",
        "if(o_orderkey % 4 = 0, concat('n', o_custkey % 3), null) AS next_version", "if(o_orderkey % 8 = 0, 'n0', null) AS known_next", "array('r') AS affects",
    )
    now = orders.where("o_orderkey % 5 = 0").selectExpr("o_orderkey AS source", "CASE o_orderkey % 3 WHEN 0 THEN 'source-moved' WHEN 1 THEN 'source-unreachable' ELSE 'source-next' END AS kind", "if(o_orderkey % 3 <> 1, 'v1', null) AS `to`")
    return freshness.filings(results, now).select("kind", "severity", "source", "to", "summary")


@query(
    """SELECT event_id AS id, 'kind must be one of source-moved, source-unreachable, source-next, regime-new, regime-gone, date-passed, profile-stale' AS problem FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, 'severity must be one of major, minor, info' FROM events WHERE event_id % 4 = 0"""
)
def log_enum_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS id", "if(event_id % 3 = 0, event_type, 'date-passed') AS kind", "if(event_id % 4 = 0, 'grave', 'info') AS severity")
    return logs.enum_problems(rows)


_SLUGS = "[" + ", ".join(f"'{d}'" for d in DIMENSIONS) + "]"
_ANSWERS = f"SELECT CASE WHEN n_nationkey < 12 THEN {_SLUGS}[n_nationkey + 1] ELSE 'zz' || n_nationkey END AS slug, CASE n_nationkey % 5 WHEN 0 THEN 'unanswered' WHEN 1 THEN 'proposed' WHEN 2 THEN 'odd' ELSE 'confirmed' END AS status, CASE WHEN n_nationkey % 5 = 3 THEN 'null' ELSE '1' END AS value FROM nation WHERE n_nationkey < 14"


@query(
    f"""WITH a AS ({_ANSWERS}), d AS (SELECT unnest({_SLUGS}) AS slug, unnest(range(15)) AS ordinal), r AS (SELECT * FROM d LEFT JOIN a USING (slug))
    SELECT CAST(ordinal AS INTEGER) AS ordinal, slug || CASE WHEN status IS NULL THEN ': missing' WHEN status = 'odd' THEN ': status must be one of (''unanswered'', ''proposed'', ''confirmed'')' WHEN status = 'unanswered' THEN ': unanswered'
        WHEN status = 'proposed' THEN ': proposed, not confirmed' ELSE ': confirmed but value is null' END AS problem, coalesce(status, '') <> 'proposed' AS blocks
    FROM r WHERE status IS NULL OR status <> 'confirmed' OR value = 'null'
    UNION ALL SELECT 15, slug || ': not a known dimension', true FROM a WHERE starts_with(slug, 'zz')"""
)
def profile_problems(spark, sf_dir):
    """Answers against the fixed domain; the one that is merely proposed doesn't block."""
    names = F.array(*map(F.lit, DIMENSIONS))
    key = F.col("n_nationkey")
    slug = F.when(key < 12, F.try_element_at(names, (key + 1).cast("int"))).otherwise(F.concat(F.lit("zz"), key.cast("string")))
    answers = table(spark, sf_dir, "nation").where("n_nationkey < 14").select(
        slug.alias("slug"), F.expr("if(n_nationkey % 5 = 3, 'null', '1')").alias("value"), F.expr("CASE n_nationkey % 5 WHEN 0 THEN 'unanswered' WHEN 1 THEN 'proposed' WHEN 2 THEN 'odd' ELSE 'confirmed' END").alias("status")
    )
    return profile.checks(answers)


@query(
    """WITH s AS (SELECT s_suppkey, 'regimes/s' || s_suppkey || '.md' AS path, s_suppkey % 5 AS k FROM supplier)
    SELECT path, 'title: required' AS problem FROM s WHERE k = 1
    UNION ALL SELECT path, 'status: must be one of (''binds'', ''ruled-out'', ''undetermined'', ''no-longer-applies'')' FROM s WHERE k = 2
    UNION ALL SELECT path, 'sources: must be a list of {id, version, retrieved}' FROM s WHERE k = 3
    UNION ALL SELECT path, 'applies: quote and cite are required when status is binds' FROM s WHERE s_suppkey % 2 = 0 AND k <> 2
    UNION ALL SELECT path, 'obligations: a ruled-out regime must not list obligations' FROM s WHERE s_suppkey % 2 = 1 AND k <> 2 AND s_suppkey % 3 = 0
    UNION ALL SELECT path, 'exempt.reason: required when status is ruled-out' FROM s WHERE s_suppkey % 2 = 1 AND k <> 2
    UNION ALL SELECT path, 'obligations: duplicate id A-1' FROM s WHERE s_suppkey % 3 = 0
    UNION ALL SELECT path, 'A-1: unknown field ''Why''' FROM s WHERE s_suppkey % 3 = 0"""
)
def regime_problems(spark, sf_dir):
    """Regime records from JSON front matter and bodies with headings and bullets."""
    meta = """concat('{"id": "s', s_suppkey, '", "jurisdiction": "nl", "confirmed_by": "me", "confirmed_at": "2024-01-01", "title": "', if(s_suppkey % 5 = 1, '', 't'), '", "status": "',
        CASE WHEN s_suppkey % 5 = 2 THEN 'odd' WHEN s_suppkey % 2 = 0 THEN 'binds' ELSE 'ruled-out' END, '", "sources": ', if(s_suppkey % 5 = 3, '["x"]', '[{"id": "x"}]'), '}')"""
    body = "if(s_suppkey % 3 = 0, '### A-1 · One\\n- **You must:** x\\n### A-1 · Two\\n- **Why:** y\\n', 'text\\n')"
    rows = table(spark, sf_dir, "supplier").select(F.expr("concat('regimes/s', s_suppkey, '.md')").alias("path"), F.parse_json(F.expr(meta)).alias("meta"), F.expr(body).alias("body"))
    return regimes.validate(rows.select("path", "meta"), regimes.obligations(rows))


@query(
    """SELECT p_partkey AS path, v.id, v.title, v.k, CASE WHEN v.k = 'You must' THEN 'pay ' || p_partkey ELSE v.v END AS v
    FROM part CROSS JOIN (VALUES ('A-1', 'First thing', 'You must', ''), ('A-1', 'First thing', 'It says', 'twice'), ('B.2', 'Second', 'Note', '')) v(id, title, k, v)"""
)
def obligation_fields(spark, sf_dir):
    """Bullets belong to the latest heading, the last of a key counts, and what comes before any heading belongs to none."""
    body = "concat('- **Note:** stray\\n### A-1 · First thing\\n- **You must:** pay ', p_partkey, '\\n- **It says:** once\\n- **It says:** twice \\ntext\\n### B.2 - Second  \\n- **Note:**\\n')"
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.expr(body).alias("body"))
    return regimes.obligations(rows).select("path", "id", "title", F.explode("fields").alias("k", "v"))


_GUARDED = """concat('<p>02016R0679 — ', if(page_id % 7 = 0, 'FR', 'EN'), ' — 01.01.2024</p>', if(page_id % 5 = 0, '', '<p class="disclaimer">d</p>'), CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '<div id="art_2"></div><div id="art_2">' ELSE '<div id="art_1"></div><div id="art_2">' END, html)"""


@query(
    """SELECT page_id, CASE WHEN page_id % 11 = 0 OR page_id % 13 = 0 THEN 'G1' WHEN page_id % 5 = 0 THEN 'G2' WHEN page_id % 6 = 0 THEN 'G3' WHEN page_id % 7 = 0 THEN 'G4' WHEN page_id % 6 = 1 THEN 'G5' END AS guard FROM pages"""
)
def article_guards(spark, sf_dir):
    """The five structural checks of a consolidated page."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr("if(page_id % 11 = 0, 202, 200)").alias("status"), F.expr("if(page_id % 13 = 0, 'text/plain', 'text/html; charset=utf-8')").alias("type"), F.expr(_GUARDED).alias("html"))
    guard = article_guard(F.col("status"), F.col("type"), F.col("html"), F.lit("02016R0679-20240101"), F.lit("EN"))
    return pages.select("page_id", F.substring(guard, 1, 2).alias("guard"))


_ADDRESS = "CASE c_custkey % 10 WHEN 0 THEN '10.1.2.' || c_custkey % 250 WHEN 1 THEN '8.8.8.' || c_custkey % 250 WHEN 2 THEN '100.64.0.' || c_custkey % 250 WHEN 3 THEN '172.' || (c_custkey % 40) || '.0.1' WHEN 4 THEN '[fe80::1]' WHEN 5 THEN 'fd00::1' WHEN 6 THEN '10.example.com' WHEN 7 THEN 'LOCALHOST' WHEN 8 THEN '224.0.0.1' ELSE '2606:4700::1111' END"


@query(f"SELECT c_custkey, {_ADDRESS} AS host, CASE WHEN c_custkey % 10 IN (0, 2, 4, 5, 7, 8) THEN true WHEN c_custkey % 10 = 3 THEN c_custkey % 40 BETWEEN 16 AND 31 OR c_custkey % 40 = 0 ELSE false END AS private FROM customer")
def private_hosts(spark, sf_dir):
    """Literal addresses that aren't globally routable, shared and IPv6 ranges included; a name is no address."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_ADDRESS).alias("host"))
    return rows.withColumn("private", F.size(hx.private_hosts_column(F.array("host"))) > 0)


@query(
    """SELECT 's' || s_suppkey AS id, concat_ws('; ', CASE WHEN s_suppkey % 3 = 0 THEN 's' || s_suppkey || ': required confirmation missing (status proposed)' END, CASE WHEN s_suppkey % 4 = 0 THEN 's' || s_suppkey || ': url must be https' END) AS why
    FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0"""
)
def refusals(spark, sf_dir):
    """Why a named source must not be touched."""
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "concat('s', s_suppkey) AS id", "concat(if(s_suppkey % 4 = 0, 'http', 'https'), '://h.example/', s_suppkey) AS url", "'feed' AS tier", "'feed' AS adapter", "'gazette' AS kind", "if(s_suppkey % 3 = 0, 'proposed', 'confirmed') AS status",
        "named_struct('redistribute', true) AS licence", "array('h.example') AS allowed_hosts", "named_struct('celex', CAST(NULL AS STRING), 'language', CAST(NULL AS STRING)) AS config",
    )
    return validate.refusals(rows, True)


ANSWER = "work,number,day\n32016R0679,02016R0679-20240101,2024-01-01\n32016R0679,02016R0678-20240101,2024-01-01\n\n32016R0680\n\"32016R0681\",\"02016R0681-20200101\",\n"


@query("SELECT * FROM (VALUES ('32016R0679', '02016R0679-20240101', '2024-01-01'), ('32016R0681', '02016R0681-20200101', '')) t(base, version, date)")
def lookup_answer(spark, sf_dir):
    """A CSV answer: missing columns read as empty, and a version that isn't of its base is left out."""
    return versions.of_base(versions.read_csv(spark, ANSWER))


@query(
    """SELECT doc_id, CASE WHEN quality IS NULL OR toxic IS NULL THEN 'undetermined' WHEN toxic = 1 OR quality = 0 THEN 'ruled-out' ELSE 'binds' END AS status FROM documents LEFT JOIN labels USING (doc_id)"""
)
def regime_states(spark, sf_dir):
    """In scope (good quality) and not exempt (toxic): binding, ruled out, or undetermined while an answer is missing."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", regimes.status_of(F.col("quality") == 1, F.col("toxic") == 1).alias("status"))
