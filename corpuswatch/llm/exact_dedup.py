"""Exact dedup by progressive refinement: length, then a hash of the head, then a hash of the whole text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_SLOTS, KeyFilter, column_or_empty, written

#: Characters of the head that the second step hashes.
HEAD = 256


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), head: int = HEAD, filter_bits: int = MOST_SLOTS, full_hash: str | None = None
) -> DataFrame:
    """One row for each row of ``docs``: id_col, keep_id, group_size, kept, and the columns in ``carry``.

    Step 1 counts byte lengths. Step 2 hashes the heads of rows of a shared
    length. Step 3 hashes the whole text (SHA-256) of rows whose length and
    head are shared; groups are rows with equal length, head and SHA-256. Only those rows are
    shuffled, as hashes and the columns in ``carry``; the others go straight to the result. What survives a step reaches the
    next scan as a bitmap sized by the keys, of ``filter_bits`` slots at most, or by an
    equality join beyond; some rows may pass that needn't, and the groups stay the same.
    ``full_hash`` names a column of ``docs`` with the text's SHA-256 in hex digits, for callers that need it
    anyway; the text isn't hashed again then.

    Null texts count as empty. The row with the largest id of a group stays,
    null ids counting as smallest; of repeated rows with that same id one
    stays, so each group keeps just one row. An empty table gives an empty result. Further
    columns of ``docs`` are ignored unless named in ``carry``; one whose name is also that of a result column comes
    twice, so callers that carry any name pass a struct.
    """
    whole = F.unhex(F.col(full_hash)) if full_hash else F.unhex(F.sha2(column_or_empty(text_col), 256))
    base = docs.select(F.col(id_col).alias("_id"), column_or_empty(text_col).alias("_text"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"), whole.alias("_whole"))
    base = base.withColumn("_len", F.octet_length("_text").cast("long"))
    many = base.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("_len"))
    same_length = KeyFilter(many, filter_bits)
    head_of = F.xxhash64("_len", F.substring("_text", 1, head))
    heads = same_length.mark(base.select("_len", "_text"), "_pair", F.xxhash64("_len")).where("_pair").select(head_of.alias("_head"))
    same_head = KeyFilter(heads.groupBy("_head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_head"), filter_bits)
    flagged = same_head.mark(base.withColumn("_head", head_of), "_again", F.col("_head"))
    shared = flagged.where("_again").select("_id", "_carry", "_len", "_head", F.col("_whole").alias("_full"), F.monotonically_increasing_id().alias("_row"))
    shared = written(shared, "exact-hashed")
    key = ["_len", "_head", "_full"]
    groups = shared.groupBy(*key).agg(F.max(F.struct("_id", "_row")).alias("_top"), F.count(F.lit(1)).alias("_n"))
    groups = written(groups.where("_n > 1"), "exact-groups")  # so that the join deals rows anew and can split a large group
    found = shared.join(groups, key, "left").select(
        "_id", F.coalesce(F.col("_top._id"), F.col("_id")).alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"), (F.col("_top").isNull() | (F.col("_row") == F.col("_top._row"))).alias("_kept"), "_carry"
    )
    alone = flagged.where("not _again").select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), F.lit(True).alias("_kept"), "_carry")
    return found.unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"), *(F.col(f"_carry.{c}").alias(c) for c in carry)
    )
