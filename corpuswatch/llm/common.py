"""What several operators share: the shared folder, written tables, a fixed-size key filter, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, shared_dir, written  # noqa: F401


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Slots a key of a bitmap, and the most slots of a bitmap that is sent to every task (32 MB).
SLOTS, MOST_SLOTS = 16, 1 << 28


class KeyFilter:
    """Which rows have one of many 64-bit keys.

    The bitmap has ``SLOTS`` slots a key, so that one other key in sixteen
    passes, and ``bits`` slots at most, whatever the data hold. Where there are more keys
    than a quarter of those, they are joined by equality instead. A key that
    was put in is always found and others may be, so callers verify what passes.
    """

    def __init__(self, keys: DataFrame, bits: int = MOST_SLOTS):
        """keys: one column of longs that are hashes, none of them null."""
        keys = written(keys.toDF("k"), "keys")
        n = keys.count()
        self.keys = keys if n > bits // 4 else None
        if self.keys is not None:
            return
        self.bits = min(1 << bits.bit_length() - 1, max(64, 1 << (n * SLOTS - 1).bit_length() if n else 64))
        words = keys.select(self.slot(F.col("k")).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
        found = np.zeros(self.bits // 64, dtype=np.uint64)
        got = words.toArrow()  # bits / 64 rows at most
        found[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
        self.sent = keys.sparkSession.sparkContext.broadcast(found)
        # the same for expressions: one row with the bitmap as an array
        bitmap = pa.array([0, len(found)], pa.int32()), pa.array(found.view(np.int64))
        self.row = keys.sparkSession.createDataFrame(pa.table({"w": pa.ListArray.from_arrays(*bitmap)}))

    def slot(self, key: Column) -> Column:
        return key.bitwiseAND(F.lit(self.bits - 1))

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """For use in tasks: which of an array of keys may be among the keys. All may, where there is no bitmap."""
        if self.keys is not None:
            return lambda keys: np.ones(len(keys), dtype=bool)
        sent, last = self.sent, np.int64(self.bits - 1)

        def found(keys: np.ndarray) -> np.ndarray:
            s = keys.astype(np.int64) & last
            return ((sent.value[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

        return found

    def mark(self, rows: DataFrame, name: str, key: Column) -> DataFrame:
        """``rows`` with ``name``, whether ``key`` may be among the keys. The bitmap, one row of a bounded size, is broadcast, and a row looks its slot up in it."""
        if self.keys is not None:
            put = self.keys.distinct().select(F.col("k").alias(f"{name}_k"), F.lit(True).alias(f"{name}_there"))
            joined = rows.withColumn(f"{name}_key", key).join(written(put, "keys"), F.col(f"{name}_key") == F.col(f"{name}_k"), "left")
            return joined.select(*(F.col(f"`{c}`") for c in rows.columns), F.col(f"{name}_there").isNotNull().alias(name))
        bits = self.row.toDF(f"{name}_bits")
        slot = self.slot(key)
        word = F.get(F.col(f"{name}_bits"), F.shiftright(slot, 6).cast("int"))
        there = F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return rows.crossJoin(F.broadcast(bits)).withColumn(name, there).drop(f"{name}_bits")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, or that with as many underscores before it as make it none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Edges that one task may well have all of.
FEW = 200_000


def components(edges: DataFrame, name: str = "components", few: int = FEW) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs); component is the smallest node reachable.

    Alternates large-star and small-star contraction until the edges rest.
    Minima are aggregated before they are shuffled and written before they are
    joined: both sides of the join are then shuffled anew, and adaptive
    execution can split a hub's edges over many tasks, which it can't where one
    side comes straight from an aggregate on the key. (With ``few`` edges or less
    that isn't worth two more jobs a round.) The edges of each round are
    written to the shared folder.
    """
    at = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())

    before = state(at)
    while before[0]:
        kept = written if before[0] > few else lambda df, _: df
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-low")
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = kept(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name}-large")
        low = kept(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        # small star: smaller neighbours and the node itself move to the smallest of them
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        at = written(small, name)
        after = state(at)
        if after == before:
            break
        before = after
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
