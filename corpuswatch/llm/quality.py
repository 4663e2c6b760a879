"""A generalised additive model with pairwise interactions that scores text quality.

Cyclic boosted shallow trees on one binned feature at a time (then on a few
pairs of features) add up to one lookup table per feature and pair, so that
scoring a document is a handful of table additions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import column_or_empty

FEATURES = (
    "log_bytes", "letters", "capitals", "digits", "non_ascii", "white_space", "sentence_marks", "other_marks", "pipes", "exclamations",
    "log_words", "word_bytes", "word_bytes_spread", "short_words", "longest_word", "distinct_words", "commonest_word", "repeated_next",
    "all_capital_words", "marked_words", "log_lines", "line_bytes", "distinct_lines", "ended_lines",
)
#: Most labelled rows that a model learns from.
SAMPLE = 20_000

_KIND = np.zeros(256, dtype=np.int64)  # 0 other marks
for _of, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, range(128, 256)), (5, b" \t\n\r\x0b\x0c"), (6, b".,;:?'\"()-"), (7, b"|"), (8, b"!")):
    _KIND[list(_bytes)] = _of


def features(text: str) -> np.ndarray:
    """The numbers in ``FEATURES`` for one whole text; all defined for an empty one."""
    raw = text.encode()
    n = max(1, len(raw))
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), minlength=9) / n
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    capital = sum(map(bytes.isupper, words))
    marked = sum([w[-1] in b"!#$%&*|@^~<>=+_/\\" for w in words])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    return np.array(
        [
            np.log1p(len(raw)), kinds[1] + kinds[2], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[0], kinds[7], kinds[8],
            np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes <= 3).mean(), sizes.max(), len(counts) / m, max(counts.values(), default=0) / m,
            sum(map(bytes.__eq__, words, words[1:])) / m,
            capital / m, marked / m, np.log1p(len(lines)), len(raw) / k, len(set(lines)) / k, sum([x.rstrip()[-1:] in (b".", b"?", b"!") for x in lines]) / k,
        ]
    )


@dataclass
class Gam:
    """Bin edges and a table per feature; per pair its coarser edges and table."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        z = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for p in self.pairs for f in p}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, floor: float, ridge: float) -> np.ndarray:
    """Values per bin of a tree with up to ``leaves`` leaves that cut the bins into runs; g, h: gradient and hessian sums per bin."""
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + ridge)
    runs, out = [(0, len(g))], np.zeros(len(g))

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        G, H = g[a:b].sum(), h[a:b].sum()
        gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
        gain[(hl < floor) | (H - hl < floor)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    while len(runs) < leaves:
        options = [(*best(a, b), a, b) for a, b in runs]
        gain, cut, a, b = max(options)
        if gain <= 1e-9:
            break
        runs.remove((a, b))
        runs += [(a, cut), (cut, b)]
    for a, b in runs:
        out[a:b] = value(a, b)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, floor: float, ridge: float) -> np.ndarray:
    """Values over a grid of a tree of depth two: the cut of the rows for which the best cuts of the columns on its two sides gain most."""
    sides = [(np.cumsum(m, axis=0)[:-1], m.sum(0) - np.cumsum(m, axis=0)[:-1]) for m in (g, h)]
    best, out = 1e-9, np.zeros_like(g)
    halves = [(sides[0][k], sides[1][k]) for k in (0, 1)]
    for cut in range(len(g) - 1):
        values = [_tree(gs[cut], hs[cut], 2, floor, ridge) for gs, hs in halves]
        gain = sum(float((2 * gs[cut] * v - (hs[cut] + ridge / len(v)) * v**2).sum()) for (gs, hs), v in zip(halves, values, strict=True))
        if gain > best and min(hs[cut].sum() for _, hs in halves) >= floor:
            best = gain
            out[: cut + 1], out[cut + 1 :] = values
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 200, rate: float = 0.1, leaves: int = 4, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60, floor: float = 5.0, ridge: float = 1.0) -> Gam:
    """Boosts the features in turn, ``rounds`` times, then the ``pairs`` most useful pairs; with one label only, or no rows, a constant."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    model = Gam(float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    count = x.shape[1]
    model.edges = [_edges(x[:, f], bins) for f in range(count)]
    at = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(count)]
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in size]
    z = np.full(n, model.intercept)
    p = lambda: 1 / (1 + np.exp(-z))
    for _ in range(rounds):
        for f in range(count):
            q = p()
            step = rate * _tree(np.bincount(at[f], y - q, size[f]), np.bincount(at[f], q * (1 - q), size[f]), leaves, floor, ridge)
            model.tables[f] += step
            z += step[at[f]]
    model.pair_edges = [_edges(x[:, f], pair_bins) for f in range(count)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, cell = p(), coarse[i] * wide[j] + coarse[j]
        return np.bincount(cell, y - q, wide[i] * wide[j]), np.bincount(cell, q * (1 - q), wide[i] * wide[j]), cell

    gains = sorted(((float((g**2 / (h + ridge + floor)).sum()), i, j) for i in range(count) for j in range(i) for g, h, _ in [cells(i, j)]), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:pairs]]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h, cell = cells(i, j)
            step = _pair_tree(g.reshape(wide[i], wide[j]), h.reshape(wide[i], wide[j]), floor, ridge)
            table += rate * step
            z += rate * step.ravel()[cell]
    return model


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``x``, the array of features, for each row."""
    base = docs.select(F.col(id_col).alias("_id"), column_or_empty(text_col).alias("_text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["_id", "x"])

    out = StructType([StructField("_id", docs.schema[id_col].dataType), StructField("x", ArrayType(DoubleType()))])
    return base.mapInArrow(make, out).select(F.col("_id").alias(id_col), "x")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = SAMPLE) -> Gam:
    """Learns from at most ``max_rows`` rows of ``labels`` (those with the lowest hashes of their ids); features of these rows alone come to the driver.

    Rows with a null id or label are left out; of an id labelled twice the
    larger label counts, of a repeated document the least feature row. The
    sampled ids, ``max_rows`` at most, are broadcast, and no text is shuffled.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    some = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col, "left_semi")
    rows = feature_rows(some, id_col, "_text").groupBy(id_col).agg(F.min("x").alias("x")).join(F.broadcast(chosen), id_col).orderBy(id_col)
    got = rows.select("x", "_y").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["_y"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep_columns: bool = False) -> DataFrame:
    """id_col, score and predicted (1 where score >= threshold) for each row of ``docs``; with ``keep_columns`` all columns of ``docs`` before score and predicted.

    One pass over Arrow batches; the model, a few kilobytes, goes to each task.
    Null texts count as empty and have a score too; null and repeated ids are kept; an empty
    table gives an empty result. Columns of ``docs`` are read by position, so any names may clash.
    """
    kept = docs.columns if keep_columns else [id_col]
    struct = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)))
    base = docs.select(struct.alias("kept"), column_or_empty(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["kept", "score"])

    out = StructType([base.schema["kept"], StructField("score", DoubleType())])
    found = base.mapInArrow(score, out)
    return found.select(*(F.col(f"kept.c{k}").alias(c) for k, c in enumerate(kept)), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fold(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; null ids have none (-1)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(-1))


def python_fold(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts
