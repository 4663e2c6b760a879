"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, lm_scoring, mixing, quality, segmentation, simhash, token_counts, topk, warc

#: Shares of tokens that op10 mixes to.
WEIGHTS = {"clean": 0.9, "junk": 0.08, "toxic": 0.02}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.where(quality.fold("doc_id", 4) != 2))
    return quality.score_quality(docs, model).select("doc_id", (quality.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(table(spark, sf_dir, "pages"), warc.archive(spark))
    return warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), partial(public_tokenizers.path, "word_bpe_49k.json"), 2048)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations a document, decoded again."""
    docs = table(spark, sf_dir, "documents")
    found = segmentation.sample_segmentations(docs, partial(public_tokenizers.path, "piece_bpe_32k.model"), k=2, alpha=1.0)
    return found.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "inclusion", "round_trip")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.interpolated_scores(docs, held_out=quality.fold("doc_id", 5) == 1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup.exact_dedup(docs, carry=["text_sha256"], full_hash="text_sha256")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "removed_chunks", "removed_lines", F.octet_length("text").alias("bytes_left"), F.sha2("text", 256).alias("text_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labelled, WEIGHTS, ["doc_id", "source"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_quality, op3_warc, op4_token_counts, op5_topk, op6_sentencepiece, op7_language_model, op8_exact_dedup, op9_line_dedup, op10_mixing)
}

#: The words of a line, as SQL.
_WORDS = "len(list_filter(regexp_split_to_array(line, '[\\t-\\r ]+'), lambda w: w <> ''))"

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        k AS (SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
        b AS (SELECT *, list_transform([1, 11, 21, 31], lambda i: CAST('0x' || substr(x, i, 10) AS UBIGINT)) AS v FROM k)
        SELECT page_id, strlen(h) AS payload_bytes, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS payload_digest
        FROM b
    """,
    "op9_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d),
        c AS (
            SELECT doc_id, pos, 2 AS size, line || chr(10) || after AS chunk FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM l) WHERE after IS NOT NULL
            UNION ALL SELECT doc_id, pos, 1, line FROM l WHERE {_WORDS} > 50
        ),
        f AS (SELECT *, first_value(doc_id) OVER w AS d0, first_value(pos) OVER w AS a0 FROM c WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, pos)),
        g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos, true AS gone FROM f WHERE doc_id <> d0 OR pos >= a0 + size),
        m AS (SELECT l.*, coalesce(gone, false) AS gone, coalesce(lag(gone) OVER (PARTITION BY l.doc_id ORDER BY l.pos), false) AS before FROM l LEFT JOIN g USING (doc_id, pos)),
        t AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone AND NOT before) AS INTEGER) AS removed_chunks, CAST(count(*) FILTER (gone) AS INTEGER) AS removed_lines,
                     coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest FROM m GROUP BY doc_id)
        SELECT doc_id, n_lines, removed_chunks, removed_lines, CAST(strlen(rest) AS INTEGER) AS bytes_left, sha256(rest) AS text_sha256 FROM t
    """,
    "op5_topk": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
