"""Records: validation, regimes, profiles and drift, from TPC-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import profile, regimes, validate
from ..schema import DIMENSIONS
from ..session import table
from .common import host
from .registry import query


@query(
    """SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'P') AS partial,
    CAST(0 AS BIGINT) AS withdrawn, count(*) AS obligations, count(*) FILTER (o_totalprice < 1000 OR o_orderpriority = '5-LOW') AS obligations_unclear FROM orders"""
)
def status_counts_fixed_domain(spark, sf_dir):
    """The domain has a value that never occurs; an obligation is unclear where what must be done or what is said is empty."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "binds").when(F.col("o_orderstatus") == "F", "ruled-out").when(F.col("o_orderstatus") == "P", "undetermined")
    must = F.when(F.col("o_totalprice") < 1000, "").otherwise("pay")
    says = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("now")
    obligations = orders.select(F.create_map(F.lit("You must"), must, F.lit("It says"), says).alias("fields"))
    found = regimes.counts(orders.select(status.alias("status")), obligations)
    return found.select(F.col("binds").alias("open"), F.col("ruled_out").alias("filled"), F.col("undetermined").alias("partial"), F.col("no_longer_applies").alias("withdrawn"), "obligations", "obligations_unclear")


@query("SELECT l_orderkey, l_suppkey, l_linenumber, CAST(r AS INTEGER) AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r > 1")
def duplicate_ids(spark, sf_dir):
    return validate.repeats(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], ["l_linenumber"]).select("l_orderkey", "l_suppkey", "l_linenumber", "occurrence")


@query(
    """SELECT doc_id, concat_ws('; ', CASE WHEN quality IS NULL THEN 'quality: missing' END, CASE WHEN quality = 0 THEN 'quality: rejected' END,
        CASE WHEN toxic = 1 THEN 'toxic: flagged' END, CASE WHEN n_chars > 5000 THEN 'text: long' END) AS problems
    FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0 OR toxic = 1 OR n_chars > 5000"""
)
def problem_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    found = validate.problem_array(
        [
            (F.col("quality").isNull(), F.lit("quality: missing")),
            (F.col("quality") == 0, F.lit("quality: rejected")),
            (F.col("toxic") == 1, F.lit("toxic: flagged")),
            (F.col("n_chars") > 5000, F.lit("text: long")),
        ]
    )
    return rows.select("doc_id", found.alias("p")).where(F.size("p") > 0).select("doc_id", F.array_join("p", "; ").alias("problems"))


_URL = "CASE WHEN page_id % 17 = 0 THEN CASE page_id % 5 WHEN 0 THEN 'https://127.0.0.1/x' WHEN 1 THEN 'https://100.64.0.1/x' WHEN 2 THEN 'https://[fe80::1]/x' WHEN 3 THEN 'https://[fd00::1]/x' ELSE 'https://10.example.com/x' END WHEN page_id % 19 = 0 THEN 'page' ELSE url END"


@query(
    f"""WITH s AS (SELECT page_id, 's' || page_id AS id, {_URL} AS url, CASE page_id % 4 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'api' WHEN 2 THEN 'feed' ELSE 'ftp' END AS tier FROM pages),
    h AS (SELECT *, {host('url')} AS host FROM s)
    SELECT id, id || ': tier must be one of (''api'', ''sitemap'', ''feed'', ''page-hash'', ''refuse'')' AS problem FROM h WHERE tier = 'ftp'
    UNION ALL SELECT id, id || ': api tier needs an explicit adapter (eurlex)' FROM h WHERE tier = 'api'
    UNION ALL SELECT id, id || ': licence.redistribute must be true or false' FROM h WHERE page_id % 6 = 0
    UNION ALL SELECT id, id || ': url must be https' FROM h WHERE NOT starts_with(url, 'https:')
    UNION ALL SELECT id, id || ': allowed_hosts must not include local or private addresses (' || CASE page_id % 5 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '100.64.0.1' WHEN 2 THEN '[fe80::1]' ELSE '[fd00::1]' END || ')'
    FROM h WHERE page_id % 17 = 0 AND page_id % 5 <> 4"""
)
def source_validation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    tier = F.expr("CASE page_id % 4 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'api' WHEN 2 THEN 'feed' ELSE 'ftp' END")
    none = F.lit(None).cast("string")
    sources = pages.select(
        F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("id"),
        F.expr(_URL).alias("url"),
        tier.alias("tier"),
        none.alias("adapter"),
        F.lit("gazette").alias("kind"),
        F.lit("confirmed").alias("status"),
        F.struct(F.when(F.col("page_id") % 6 != 0, True).alias("redistribute")).alias("licence"),
        F.array().cast("array<string>").alias("allowed_hosts"),
        F.struct(none.alias("celex"), none.alias("language")).alias("config"),
    )
    return validate.source_problems(validate.with_defaults(sources))


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS "at", unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, CAST("at" AS INTEGER) AS "at", CAST(max(CASE WHEN "at" % 3 = 1 AND length(line) > 20 THEN "at" END) OVER (PARTITION BY doc_id ORDER BY "at") AS INTEGER) AS heading FROM l"""
)
def heading_carry_forward(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    head = F.when((F.col("at") % 3 == 1) & (F.length("line") > 20), F.col("at"))
    return regimes.carry_forward(lines, "doc_id", "at", head).select("doc_id", "at", "heading")


def _answers(spark, sf_dir, modulus: int, shift: int):
    """Answers as JSON of nations: slug of the fixed domain by nation number."""
    names = F.array(*map(F.lit, DIMENSIONS))
    slug = F.element_at(names, (F.col("n_nationkey") % 15 + 1).cast("int"))
    value = F.when(F.col("total") % modulus == shift, "null").otherwise(F.col("total").cast("string"))
    return slug.alias("slug"), value.alias("value")


_DOMAIN = "(SELECT unnest([" + ", ".join(f"'{d}'" for d in DIMENSIONS) + "]) AS slug, unnest(range(15)) AS ordinal)"
_SIDE = "SELECT n_nationkey AS ordinal, CASE WHEN total % {m} = {s} THEN 'null' ELSE CAST(total AS VARCHAR) END AS value FROM (SELECT {k} AS n_nationkey, count(*) AS total FROM {t} GROUP BY 1) WHERE n_nationkey < {limit}"


def _side(spark, sf_dir, name: str, key: str, modulus: int, shift: int, limit: int):
    totals = table(spark, sf_dir, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias("total")).where(F.col("n_nationkey") < limit)
    return totals.select(*_answers(spark, sf_dir, modulus, shift))


_OLD = _SIDE.format(m=3, s=0, k="c_nationkey", t="customer", limit=13)
_NEW = _SIDE.format(m=4, s=1, k="s_nationkey", t="supplier", limit=15)


@query(f"SELECT d.ordinal::INTEGER AS ordinal, slug, o.value AS old, n.value AS new FROM {_DOMAIN} d LEFT JOIN ({_OLD}) o ON o.ordinal = d.ordinal LEFT JOIN ({_NEW}) n ON n.ordinal = d.ordinal WHERE o.value IS DISTINCT FROM n.value")
def profile_diff_fixed_domain(spark, sf_dir):
    old, new = _side(spark, sf_dir, "customer", "c_nationkey", 3, 0, 13), _side(spark, sf_dir, "supplier", "s_nationkey", 4, 1, 15)
    return profile.diff(profile.domain(spark), old, new).select("ordinal", "slug", "old", "new")


@query(
    f"""WITH trig AS (SELECT n_name AS id, n_nationkey % 15 AS ordinal, n_nationkey AS position, n_regionkey <> 2 AS watched FROM nation),
    changed AS (SELECT d.ordinal, d.slug, o.value AS old, coalesce(n.value, o.value) AS new FROM {_DOMAIN} d LEFT JOIN ({_OLD}) o ON o.ordinal = d.ordinal LEFT JOIN ({_NEW}) n ON n.ordinal = d.ordinal
        WHERE o.value IS DISTINCT FROM coalesce(n.value, o.value))
    SELECT slug, 'regime-gone' AS kind, 'major' AS severity, id AS affects FROM changed JOIN trig USING (ordinal) WHERE new = 'null' AND watched
    UNION ALL SELECT slug, 'regime-new', 'info', coalesce(string_agg(id, ', ' ORDER BY position), '') FROM changed LEFT JOIN trig USING (ordinal) WHERE new <> 'null' GROUP BY slug"""
)
def rescan_drift(spark, sf_dir):
    snapshot = _side(spark, sf_dir, "customer", "c_nationkey", 3, 0, 13)
    answers = _side(spark, sf_dir, "supplier", "s_nationkey", 4, 1, 15).withColumn("status", F.lit("confirmed"))
    nation = table(spark, sf_dir, "nation")
    names = F.array(*map(F.lit, DIMENSIONS))
    text = F.concat(F.element_at(names, (F.col("n_nationkey") % 15 + 1).cast("int")), F.lit(": any"))
    listed = nation.select(F.col("n_name").alias("id"), F.when(F.col("n_regionkey") == 2, "ruled-out").otherwise("binds").alias("status"), F.col("n_nationkey").alias("position"), F.array(text).alias("triggered_by"))
    found = profile.drift(profile.domain(spark), snapshot, profile.carried(answers, snapshot), profile.triggers(listed))
    return found.select("slug", "kind", "severity", F.array_join("affects", ", ").alias("affects"))
