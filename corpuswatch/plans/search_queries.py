"""Search over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search
from ..session import table
from .common import QUERY, collapsed, hashed, tok
from .registry import query

SCORED = f"""
    docs AS (SELECT 'documents/' || doc_id AS path, lang AS kind, {tok("text")} AS toks FROM documents),
    corpus AS (SELECT count(*) AS n, coalesce(avg(len(toks)), 0) AS avgdl FROM docs),
    asked AS (SELECT unnest({tok("'%s'")}) AS term, generate_subscripts({tok("'%s'")}, 1) AS pos),
    df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT path, unnest(toks) AS term FROM docs) GROUP BY term),
    tf AS (SELECT path, kind, len(toks) AS dl, term, pos, len(list_filter(toks, lambda w: w = term)) AS f FROM docs CROSS JOIN asked),
    parts AS (
        SELECT path, kind, pos, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS part
        FROM tf JOIN df USING (term) CROSS JOIN corpus WHERE f > 0
    ),
    scored AS (SELECT path, kind, sum(part ORDER BY pos) AS score FROM parts GROUP BY path, kind)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("kind"), "text")


def shown(hits: DataFrame) -> DataFrame:
    """Scores as they are compared: two engines' last digits differ. The ranking is by the whole score."""
    return hits.withColumn("score", F.round("score", 6))


@query(f"WITH {SCORED % (QUERY, QUERY)} SELECT path, kind, round(score, 6) AS score FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, path LIMIT 10)")
def bm25_search(spark, sf_dir):
    return shown(search.search(documents(spark, sf_dir), QUERY, 10))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY doc_id, term")
def bm25_term_frequency(spark, sf_dir):
    return search.postings(table(spark, sf_dir, "documents"), "doc_id")


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY term")
def bm25_document_frequency(spark, sf_dir):
    return search.document_frequency(table(spark, sf_dir, "documents"))


@query(f"SELECT count(*) AS n, round(coalesce(avg(len({tok('text')})), 0), 6) AS avgdl FROM documents")
def bm25_corpus_stats(spark, sf_dir):
    return search.corpus_stats(table(spark, sf_dir, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {SCORED % (QUERY, QUERY)} SELECT path, kind, round(score, 6) AS score FROM (SELECT * FROM scored WHERE score > 0 AND kind = 'fr' ORDER BY score DESC, path LIMIT 10)")
def bm25_search_kind_filter(spark, sf_dir):
    return shown(search.search(documents(spark, sf_dir), QUERY, 10, "fr"))


@query(f"WITH {SCORED % (QUERY + ' ouble', QUERY + ' ouble')} SELECT path, kind, round(score, 6) AS score FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, path LIMIT 10)")
def bm25_duplicate_query_terms(spark, sf_dir):
    return shown(search.search(documents(spark, sf_dir), f"{QUERY} ouble", 10))


_AT = f"list_min(list_filter(list_transform({tok(repr(QUERY))}, lambda t: instr(lower(text), t)), lambda p: p > 0))"


@query(
    f"""WITH {SCORED % (QUERY, QUERY)}, hits AS (SELECT path, kind, round(score, 6) AS score FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, path LIMIT 10))
    SELECT path, kind, score, {collapsed(f"substring(text, greatest(coalesce({_AT}, 1) - 60, 1), 160)")} AS snippet
    FROM hits JOIN (SELECT 'documents/' || doc_id AS path, text FROM documents) USING (path)"""
)
def search_snippet(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return shown(search.with_snippets(search.search(docs, QUERY, 10), docs, QUERY))


@query(f"SELECT {hashed('text')} AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(tx.content_hash(F.col("text")).alias("content_hash"))
    return groups.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(
    f"""WITH files AS (SELECT 'documents/' || doc_id AS path, strlen(text) AS size, {hashed('text')} AS hash FROM documents),
    shards AS (SELECT left(sha1(path), 3) AS shard, count(*) AS files, sha256(string_agg(path || '|' || size || '|' || hash, chr(10) ORDER BY path)) AS hash FROM files GROUP BY 1)
    SELECT CAST(sum(files) AS BIGINT) AS files, sha256(string_agg(hash, chr(10) ORDER BY shard)) AS signature FROM shards"""
)
def corpus_signature(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return search.signature(docs.select("path", F.octet_length("text").alias("size"), tx.content_hash(F.col("text")).alias("hash")))
