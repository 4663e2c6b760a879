"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SLOTS, KeyFilter, column_or_empty, slices, written

#: Lines that the rolling hash spans, and mean windows between boundaries.
SPAN, MEAN = 2, 1
#: A line of more words than this is a chunk of its own.
LONG = 50
PRIME = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def _mix(h: int) -> int:
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    return h ^ (h >> 31)


def chunks(lines: list[str], span: int = SPAN, mean: int = MEAN, long: int = LONG) -> Iterator[tuple[int, int, int]]:
    """(start, lines, key) of a text's chunks.

    A polynomial rolling hash of the last ``span`` line hashes marks a boundary where it is 0
    modulo ``mean``; the lines it spans there are a chunk. So a boundary depends on
    those lines alone, wherever they stand. A line of over ``long`` words is a chunk too. ``key`` is
    the rolling hash, signed, and only says which chunks may be equal.
    """
    drop, roll = pow(PRIME, span, 1 << 64), 0
    hashes = [xxhash.xxh64_intdigest(line.encode()) for line in lines]
    for i, h in enumerate(hashes):
        roll = (roll * PRIME + h) & MASK
        if i >= span:
            roll = (roll - hashes[i - span] * drop) & MASK
        if i + 1 >= span:
            key = _mix(roll)
            if mean == 1 or key % mean == 0:
                yield i + 1 - span, span, key - (1 << 63)
        if len(lines[i]) > 2 * long and len(lines[i].encode().split()) > long:  # so many words have so many characters
            yield i, 1, _mix(h ^ long) - (1 << 63)


def digest(unit: str) -> Column:
    """With a chunk's key, what stands for its bytes wherever no other bytes have the same two."""
    return F.xxhash64(unit)


def _repeats(held: DataFrame) -> DataFrame:
    """id, of and line of each line of ``held`` that lies in a chunk which also stands at a smaller place.

    The bytes are shuffled once, to be grouped. Rows are then joined to their group by key and digest;
    where groups of different bytes agree in both, which the groups themselves tell, by the bytes.
    """
    least = [F.min(F.struct("id", "of", "at")).alias("first"), F.count(F.lit(1)).alias("n")]
    groups = written(held.groupBy("h", "unit").agg(*least).select("h", digest("unit").alias("d"), "first", "n"), "line-groups")
    known = written(groups.groupBy("h", "d").agg(F.count(F.lit(1)).alias("units"), F.min("first").alias("first"), F.max("n").alias("n")).where("n > 1"), "line-stays")  # so that the join deals rows anew and can split a common passage
    rows = held.withColumn("d", digest("unit"))
    going = rows.drop("unit").join(known.where("units = 1").drop("units", "n"), ["h", "d"]).drop("h", "d")
    if not (clash := known.where("units > 1").select("h", "d")).isEmpty():
        alike = written(rows.join(clash, ["h", "d"]).select(*held.columns), "line-clashes")
        stays = written(alike.groupBy("h", "unit").agg(*least).where("n > 1").drop("n"), "line-clash-stays")
        going = going.unionByName(alike.join(stays, ["h", "unit"]).drop("h", "unit"))
    overlaps = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("of") == F.col("first.of")) & (F.col("at") < F.col("first.at") + F.col("size"))
    return going.where(~overlaps).select("id", "of", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("line"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, mean: int = MEAN, long: int = LONG, filter_bits: int = MOST_SLOTS) -> DataFrame:
    """id_col, text (without repeated chunks), n_lines, removed_chunks (runs of lines that went) and removed_lines for each row of ``docs``.

    A line goes if it lies in a chunk that also stands at a smaller (id, place in the text).
    With ``mean`` 1 each window of ``span`` lines is a chunk, as a passage of just
    two lines holds no other that doesn't depend on what is around it; a passage of
    two or more lines that stands whole in an earlier text goes whole then. With
    a larger ``mean`` fewer chunks are compared and the edges of passages, and short ones, stay.
    The first place of each line's content stays, and so does the first of a
    passage's places that overlap in one text; a passage's first place may itself lose lines that stand earlier still.

    A first pass sends the key of each chunk; those that come up again reach
    the second pass as a bitmap sized by their number, or by an equality join beyond it. That pass sends the candidates'
    text, and the bytes themselves are the key of the groups. Groups are
    aggregated before the shuffle and written, and their members are joined to the one
    that stays, without their bytes, so that a common chunk is split over tasks. Only rows that lose a line are shuffled with their text.

    Null texts count as empty, with one empty line. Null ids count as smallest. Rows alike in both id and text count as one and keep or lose
    the same lines. An empty table gives an empty result; further columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), column_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [key for text in batch.column(0).to_pylist() for _, _, key in chunks(text.split("\n"), span, mean, long)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["h"])

    again = base.select("text").mapInArrow(first, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    repeated = KeyFilter(again, filter_bits)

    may = repeated.test()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple[int, int, int, int, str]] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                lines = text.split("\n")
                found = list(chunks(lines, span, mean, long))
                passed = may(np.fromiter((key for _, _, key in found), dtype=np.int64, count=len(found)))
                rows += [(k, a, n, key, "\n".join(lines[a : a + n])) for (a, n, key), ok in zip(found, passed, strict=True) if ok]
            row, at, size, h, unit = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(2).take(row), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(h, pa.int64()), pa.array(unit, pa.string())],
                ["id", "of", "at", "size", "h", "unit"],
            )

    marked = base.withColumn("of", F.xxhash64("text"))
    held = marked.mapInArrow(second, f"id {kind}, of long, at long, size long, h long, unit string")
    if repeated.keys is not None:  # too many for a bitmap
        held = repeated.mark(held, "again", F.col("h")).where("again").drop("again")
    held = written(held, "line-chunks")
    going = _repeats(held)
    going = written(going.groupBy("id", "of").agg(F.collect_set("line").alias("gone")), "line-gone")
    touched = KeyFilter(going.select(F.xxhash64("id", "of").alias("k")), filter_bits)
    flagged = touched.mark(marked, "_touched", F.xxhash64("id", "of"))
    lines = F.size(F.split("text", "\n", -1))
    whole = flagged.where("not _touched").select("id", "text", lines.alias("n_lines"), F.lit(0).alias("removed_chunks"), F.lit(0).alias("removed_lines"))
    part = flagged.where("_touched").alias("d").join(going.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.of") == F.col("g.of")), "left").select("d.id", "d.text", "g.gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, total, runs, n_gone = [], [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, gone = text.split("\n"), set(gone or ())
                total.append(len(lines))
                n_gone.append(len(gone))
                runs.append(sum(x - 1 not in gone for x in gone))
                texts.append("\n".join(line for x, line in enumerate(lines) if x not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(runs, pa.int32()), pa.array(n_gone, pa.int32())], ["id", "text", "n_lines", "removed_chunks", "removed_lines"])

    shorter = part.mapInArrow(cut, f"id {kind}, text string, n_lines int, removed_chunks int, removed_lines int")
    return whole.unionByName(shorter).withColumnRenamed("id", id_col)
