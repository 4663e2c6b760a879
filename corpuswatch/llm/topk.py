"""Exact top-k inner products by distributed selection over score histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, written

#: Queries of one block, and bins of one histogram.
BLOCK, BINS = 1024, 1024
#: Scores that one tile holds.
TILE = 2_000_000
LOWEST = np.iinfo(np.int64).min


def quantised(flat: np.ndarray) -> np.ndarray:
    return np.floor(256 * flat.astype(np.float64))


def _matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Quantised vectors as a matrix of ``width`` columns (zeros fill shorter ones), and which rows take part: none that is null or holds a null or non-finite component."""
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.asarray(column.is_valid()).astype(bool)
    bad = ~np.isfinite(x)
    good[row[bad]] = False
    width = int(lengths.max(initial=0)) if width is None else width
    col = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, inside = np.zeros((len(lengths), width)), (col < width) & ~bad
    out[row[inside], col[inside]] = quantised(x[inside])
    return out, good


def _tiles(batches: Iterator[pa.RecordBatch], q: np.ndarray, ids: np.ndarray, active: np.ndarray):
    """(query numbers, candidate ids, scores as a matrix of longs, the query's own marked LOWEST) tile by tile; q: quantised queries, active: those wanted."""
    for batch in batches:
        c, good = _matrix(batch.column(1), q.shape[1])
        c, cand = c[good], np.asarray(batch.column(0).fill_null(LOWEST))[good]
        if not len(c):
            continue
        exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
        if exact >= 2**62:
            raise ValueError("scores of these vectors don't fit in a long")
        step = max(1, TILE // len(c))
        for at in range(0, len(active), step):
            some = active[at : at + step]
            s = (q[some] @ c.T).astype(np.int64) if exact < 2**53 else q[some].astype(np.int64) @ c.T.astype(np.int64)
            s[ids[some][:, None] == cand[None, :]] = LOWEST
            yield some, cand, s


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """query_id, rank (from 1), id_col and score: for each row of ``queries`` the ``k`` rows of ``vectors`` with the highest integer inner products of floor(256 x) components, ties to the smaller id.

    Queries are taken in blocks of ``block``, in the order of their ids. For a
    block every candidate is scored in each pass: passes count scores in
    ``bins`` equal bins of each query's current range, the counts are added
    over all tasks, and the bin that holds the kth value becomes the next
    range, until that value is known. A task sends the counts of its highest bins only, down to its own kth value,
    as lower ones can't matter. A last pass emits what lies above each kth value and the smallest ids that tie with it. The driver holds
    one block's vectors and histograms, never candidates.

    Vectors that are null or hold null or non-finite components take no part;
    shorter vectors count as filled with zeros. Rows that share the query's id count as its own row. A query id that
    is repeated is asked once, with its least vector; repeated candidates are each ranked. Null ids are never
    queries, and rank before any other among tied candidates. No queries or no candidates give an empty result.
    Scores beyond a long raise an error.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = "v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    asked = asked.where("id is not null").where(finite)
    asked = written(asked.groupBy("id").agg(F.min("v").alias("v")), "topk-queries")  # read anew for each block
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    top = base.where(finite).agg(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + pow(abs(256D * x) + 1, 2))"))).first()[0]
    folder, last, any_block = new_folder(spark, "topk"), None, False
    out = f"query_id long, rank int, {id_col} long, score long"
    while top is not None:
        part = asked if last is None else asked.where(F.col("id") > last)
        got = part.orderBy("id").limit(block).toArrow()
        if not got.num_rows:
            break
        ids = got["id"].to_numpy()
        q, _ = _matrix(got["v"].combine_chunks() if got["v"].num_chunks != 1 else got["v"].chunk(0))
        last = int(ids[-1])
        _block(base, q, ids, float(top), k, bins).select("query_id", "rank", F.col("id").alias(id_col), "score").write.mode("append").parquet(folder)
        any_block = True
    return spark.read.schema(out).parquet(folder) if any_block else spark.createDataFrame([], out)


def _block(base: DataFrame, q: np.ndarray, ids: np.ndarray, top: float, k: int, bins: int) -> DataFrame:
    spark, n = base.sparkSession, len(ids)
    sent = spark.sparkContext.broadcast((q, ids))
    reach = np.ceil(np.sqrt((q**2).sum(axis=1)) * np.sqrt(top)) + 1  # no score is beyond the product of the lengths
    if reach.max() >= 2.0**62:
        raise ValueError("scores of these vectors don't fit in a long")
    reach = reach.astype(np.int64)
    lo, hi, need = -reach, reach.copy(), np.full(n, k, dtype=np.int64)
    done = np.zeros(n, dtype=bool)  # the kth value is lo; need: how many of those that tie with it are wanted
    while not done.all():
        active = np.flatnonzero(~done)
        width = -(-(hi - lo + 1) // bins)
        now = spark.sparkContext.broadcast((active, lo, hi, width, need))

        def count(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            (q, ids), (active, lo, hi, width, need) = sent.value, now.value
            hist = np.zeros((len(active), bins), dtype=np.int64)
            row = np.zeros(len(ids), dtype=np.int64)
            row[active] = np.arange(len(active))
            for some, _, s in _tiles(batches, q, ids, active):
                a, b = lo[some][:, None], hi[some][:, None]
                at = (s - a) // width[some][:, None] + (np.arange(len(some)) * bins)[:, None]
                at = at[(s >= a) & (s <= b)]
                hist[row[some]] += np.bincount(at, minlength=len(some) * bins).reshape(len(some), bins)
            above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist
            r, b = np.nonzero((hist > 0) & (above < need[active][:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(active[r]), pa.array(b.astype(np.int64)), pa.array(hist[r, b])], ["q", "bin", "n"])

        counts = base.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
        now.unpersist()
        hist = np.zeros((n, bins), dtype=np.int64)
        hist[counts["q"].to_numpy(), counts["bin"].to_numpy()] = counts["n"].to_numpy()
        for i in active:
            total = np.cumsum(hist[i, ::-1])
            b = int(np.searchsorted(total, need[i]))
            if b == bins:  # fewer candidates than k: all of them are wanted
                lo[i], done[i] = LOWEST + 1, True
                continue
            need[i] -= total[b] - hist[i, bins - 1 - b]
            lo[i] += (bins - 1 - b) * width[i]
            hi[i] = min(hi[i], lo[i] + width[i] - 1)
            done[i] = lo[i] == hi[i]
    final = spark.sparkContext.broadcast((lo, need))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q, ids), (lo, need) = sent.value, final.value
        ties: dict[int, np.ndarray] = {}
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for some, cand, s in _tiles(batches, q, ids, np.arange(len(ids))):
            r, c = np.nonzero(s > np.maximum(lo[some], LOWEST + 1)[:, None])
            got.append((some[r], cand[c], s[r, c]))
            r, c = np.nonzero(s == lo[some][:, None])
            for i in np.unique(r):
                own = some[i]
                ties[own] = np.sort(np.concatenate([ties.get(own, np.zeros(0, dtype=np.int64)), cand[c[r == i]]]))[: need[own]]
        got += [(np.full(len(v), i), v, np.full(len(v), lo[i])) for i, v in ties.items()]
        if got:
            i, c, s = (np.concatenate(x) for x in zip(*got, strict=True))
            c = pa.array(c, pa.int64(), mask=c == LOWEST)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), c, pa.array(s.astype(np.int64))], ["query_id", "id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    near = base.mapInArrow(pick, "query_id long, id long, score long")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
