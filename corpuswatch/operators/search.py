"""BM25 keyword search over documents (path, kind, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import K1, B
from ..storage import written


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The query's terms in order, repeats included, by the documents' own tokenizer."""
    return spark.range(1).select(tx.tokenize(F.lit(query))).first()[0]


def postings(docs: DataFrame, key: str = "path") -> DataFrame:
    """key, term, tf. One row per distinct term of a document: counts are combined before the shuffle."""
    return docs.select(key, F.explode(tx.tokenize(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df, without a shuffle per occurrence: each document gives a term once."""
    return docs.select(F.explode(F.array_distinct(tx.tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n and avgdl (0 for no documents) in one row."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(tx.tokenize(F.col("text")))), F.lit(0.0)).alias("avgdl"))


def search(docs: DataFrame, query: str, k: int = 5, kind: str | None = None, key: str = "path") -> DataFrame:
    """key, kind and score of the ``k`` best documents: score down, then key up.

    Statistics are those of all documents; ``kind`` filters afterwards. A term
    that the query repeats counts again. Documents are ranked by the score as it is, not rounded. One scan turns each text into its
    length and the counts of the query's distinct terms, a narrow table that is written and read
    twice: for the statistics, one row, and for the hits. Nothing but partial sums and the top k is shuffled.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    terms = query_terms(docs.sparkSession, query)
    if not terms or not k:
        return docs.select(F.col(key), "kind", F.lit(0.0).alias("score")).limit(0)
    distinct = list(dict.fromkeys(terms))
    toks = docs.select(key, "kind", tx.tokenize(F.col("text")).alias("toks"))
    counted = toks.select(
        key, "kind", F.size("toks").alias("len"), *((F.size("toks") - F.size(F.array_remove("toks", t))).alias(f"f{i}") for i, t in enumerate(distinct))
    )
    counted = written(counted, "search-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(distinct))))

    def part(i: int) -> Column:
        f, df = F.col(f"f{i}"), F.col(f"d{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))))

    score = sum((part(distinct.index(t)) for t in terms[1:]), part(distinct.index(terms[0])))
    hits = counted if kind is None else counted.where(F.col("kind") == kind)
    some = sum((F.col(f"f{i}") for i in range(len(distinct))), F.lit(0)) > 0
    scored = hits.where(some).join(F.broadcast(stats)).select(key, "kind", score.alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(k)


def with_snippets(hits: DataFrame, docs: DataFrame, query: str, key: str = "path") -> DataFrame:
    """The hits (a bounded top k, so they are sent to the scan of the texts) with a snippet each."""
    terms = F.array(*map(F.lit, query_terms(docs.sparkSession, query)))
    return docs.select(key, "text").join(F.broadcast(hits), key).select(key, "kind", "score", tx.snippet(F.col("text"), terms).alias("snippet"))


def signature(files: DataFrame) -> DataFrame:
    """One row, the hash of a set of files (path, size, hash): of each of 4,096 shards by path, then of the shards in order."""
    line = F.concat_ws("|", "path", F.col("size").cast("string"), "hash")
    shards = files.select("path", line.alias("line"), F.substring(F.sha1("path"), 1, 3).alias("shard"))
    each = shards.groupBy("shard").agg(F.sha2(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY path)"), 256).alias("hash"), F.count(F.lit(1)).alias("files"))
    return each.agg(F.sum("files").alias("files"), F.sha2(F.expr("listagg(hash, '\n') WITHIN GROUP (ORDER BY shard)"), 256).alias("signature"))


class Index:
    """Postings, document frequencies and lengths as tables under a folder, valid for one signature of the files."""

    def __init__(self, folder: str):
        self.folder = folder

    def load(self, docs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The tables; built anew if no build of the files' signature is complete.

        A build has a folder of its own, named by the signature, and counts once its
        ``complete`` file is there, so that a reader sees a whole build or none.
        """
        spark = docs.sparkSession
        now = signature(files).first()["signature"] or "empty"
        build = f"{self.folder}/{now}"
        names = ("postings", "terms", "docs")
        jvm = spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{build}/complete")
        fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(mark):
            tables = (postings(docs), document_frequency(docs), docs.select("path", "kind", F.size(tx.tokenize(F.col("text"))).alias("len")))
            for name, table in zip(names, tables, strict=True):
                table.write.mode("overwrite").parquet(f"{build}/{name}")
            fs.create(mark, True).close()
            for other in fs.listStatus(mark.getParent().getParent()):  # builds of other signatures, a few
                if other.getPath().getName() != now:
                    fs.delete(other.getPath(), True)
        return tuple(spark.read.parquet(f"{build}/{t}") for t in names)

    def search(self, docs: DataFrame, files: DataFrame, query: str, k: int = 5, kind: str | None = None) -> DataFrame:
        """As ``search``, from the tables: the query's terms, a few rows, are broadcast to the postings."""
        spark = docs.sparkSession
        posted, df, lengths = self.load(docs, files)
        terms = query_terms(spark, query)
        if not terms or not k:
            return lengths.select("path", "kind", F.lit(0.0).alias("score")).limit(0)
        wanted = spark.createDataFrame([(t, terms.count(t)) for t in dict.fromkeys(terms)], "term string, times int")
        stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))
        known = df.join(F.broadcast(wanted), "term").join(F.broadcast(stats))
        rows = posted.join(F.broadcast(known), "term").join(lengths if kind is None else lengths.where(F.col("kind") == kind), "path")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))))
        scored = rows.groupBy("path", "kind").agg(F.sum(part).alias("score"))
        return scored.where("score > 0").orderBy(F.desc("score"), "path").limit(k)
