"""LM scoring by deleted interpolation of unigram and bigram estimates.

Counts never have to fit one place. Documents are dealt into bundles; each
bundle asks for the counts of its distinct n-grams with one row per bucket of
n-gram hashes, buckets add up what all bundles have and answer, and bundles
look their answers up in the order in which they asked. Where there are many
bundles, groups of them ask coarse buckets that pass their sums on to fine
ones, so that messages grow as the input to the power 1.5 in number, not 2, and stay large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import column_or_empty, partitions, written

#: Text bytes of a bundle, and of what one bucket of n-grams answers for.
BUNDLE = 8 << 20
#: Parts of the learning documents, each deleted from the counts in turn.
PARTS = 16
#: Bundles from which on messages go by coarse buckets.
MANY = 4096
#: Steps of a nat in which held-out tokens' estimates are tabled for expectation-maximisation, and its rounds.
STEP, ROUNDS = 0.05, 60
#: Least weight of the uniform part.
LEAST = 1e-4
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Grams:
    """The n-grams of some texts: word numbers 1, 2, ... by first appearance, 0 for the end of a text and, as a context, its start."""

    def __init__(self, texts: list[str], learn: np.ndarray):
        number: dict[bytes, int] = {}
        known, parts, sizes = number.setdefault, [], []
        for text in texts:
            words = text.encode().lower().split()
            sizes.append(len(words) + 1)
            parts.append(np.fromiter((known(w, len(number) + 1) for w in words), dtype=np.int64, count=len(words)))
            parts.append(np.zeros(1, dtype=np.int64))
        self.token = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        context = np.zeros_like(self.token)
        context[1:] = self.token[:-1]  # the end of the text before is the start of this one
        of = np.repeat(np.arange(len(texts)), self.sizes)
        word_hash = np.zeros(len(number) + 1, dtype=np.uint64)
        word_hash[1:] = [xxhash.xxh64_intdigest(w, 7) for w in number]
        ones, self.at1 = np.unique(self.token, return_inverse=True)
        twos, self.at2 = np.unique((context << 32) | self.token, return_inverse=True)
        hashes = {1: _scramble(word_hash[ones] + _A), 2: _scramble(_scramble(word_hash[twos >> 32] + _B) * _A + word_hash[twos & 0xFFFFFFFF])}
        learned = learn[of].astype(np.float64)
        self.order, self.keys, self.counts = {}, {}, {}
        for kind, at in ((1, self.at1), (2, self.at2)):
            self.order[kind] = np.argsort(hashes[kind])
            self.keys[kind] = hashes[kind][self.order[kind]]
            self.counts[kind] = np.bincount(at, learned, len(hashes[kind])).astype(np.uint32)[self.order[kind]]

    def cuts(self, kind: int, buckets: int) -> np.ndarray:
        """Where each bucket, an equal range of hashes, starts among the sorted keys."""
        starts = np.array([k * ((1 << 64) // buckets) for k in range(buckets)], dtype=np.uint64)
        return np.append(np.searchsorted(self.keys[kind], starts), len(self.keys[kind]))


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as their bytes by place, without places that are zero throughout, compressed. The first byte is how many places there are."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    places = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes((width,)) + zstandard.ZstdCompressor(level=1).compress(places.tobytes())


def loosen(squeezed: bytes) -> np.ndarray:
    width = squeezed[0]
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(squeezed[1:]), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((places.shape[1], 8), dtype=np.uint8)
    out[:, :width] = places.T
    return out.view(np.uint64).ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(loosen(packed), dtype=np.uint64)


ASK = "bucket int, kind int, bundle int, part int, keys binary, counts binary"
ANSWER = "bucket int, kind int, bundle int, part int, totals binary, vocabulary long"


_INT, _BYTES = pa.int32(), pa.binary()
_ASK = pa.schema({"bucket": _INT, "kind": _INT, "bundle": _INT, "part": _INT, "keys": _BYTES, "counts": _BYTES}.items())
_ANSWER = pa.schema({"bucket": _INT, "kind": _INT, "bundle": _INT, "part": _INT, "totals": _BYTES, "vocabulary": pa.int64()}.items())


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(schema, zip(*rows, strict=True) if rows else [()] * len(schema), strict=True)}, schema=schema)


def _grams(table: pa.Table) -> Grams:
    return Grams(table["text"].to_pylist(), np.asarray(table["learn"].combine_chunks()).astype(bool))


def _ask(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        grams, bundle, part = _grams(table), table["bundle"][0].as_py(), table["part"][0].as_py()
        rows = []
        for kind in (1, 2):
            cut = grams.cuts(kind, buckets)
            for b in np.flatnonzero(np.diff(cut)):
                own = slice(cut[b], cut[b + 1])
                rows.append((int(b), kind, bundle, part, pack(grams.keys[kind][own]), squeeze(grams.counts[kind][own])))
        return _table(_ASK, rows)

    return ask


def _merge(buckets: int, fine: int):
    """Adds up what the bundles of one group and part ask a coarse bucket, and asks its fine buckets in the name of the group's first bundle."""

    def merge(table: pa.Table) -> pa.Table:
        coarse, kind, bundle, part = table["bucket"][0].as_py(), table["kind"][0].as_py(), min(table["bundle"].to_pylist()), table["part"][0].as_py()
        keys, at = np.unique(np.concatenate([unpack(x.as_py()) for x in table["keys"]]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([loosen(x.as_py()) for x in table["counts"]]).astype(np.float64), len(keys)).astype(np.uint64)
        cut = np.append(np.searchsorted(keys, [np.uint64(x) for x in fine_starts(coarse, buckets, fine)]), len(keys))
        own = [(f, slice(cut[f], cut[f + 1])) for f in np.flatnonzero(np.diff(cut))]
        return _table(_ASK, [(coarse * fine + int(f), kind, bundle, part, pack(keys[k]), squeeze(counts[k])) for f, k in own])

    return merge


def fine_starts(coarse: int, buckets: int, fine: int) -> list[int]:
    width = (1 << 64) // buckets
    return [coarse * width + f * (width // fine) for f in range(fine)]


def _expand(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """Hands a group's answers to each of its bundles, in the order in which that asked."""
    keys = [unpack(x.as_py()) for x in asked["keys"]]
    merged = np.unique(np.concatenate(keys))
    by_bucket = sorted(zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist(), strict=True))
    totals = np.concatenate([loosen(t).reshape(2, -1) for _, t in by_bucket], axis=1)
    words = [sum(answers["vocabulary"].to_pylist())] + [0] * (len(keys) - 1)
    own = zip(*(asked[c].to_pylist() for c in ("bucket", "kind", "bundle", "part")), keys, words, strict=True)
    return _table(_ANSWER, [(b, kind, bundle, part, squeeze(totals[:, np.searchsorted(merged, k)].ravel()), n) for b, kind, bundle, part, k, n in own])


def _answer(table: pa.Table) -> pa.Table:
    """Adds up the counts of each n-gram of a bucket, and answers each bundle in its own order: all counts, and those of its part. The first row says how many words the bucket has."""
    keys = [unpack(x.as_py()) for x in table["keys"]]
    counts = np.concatenate([loosen(x.as_py()) for x in table["counts"]]).astype(np.float64)
    sizes = [len(k) for k in keys]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, counts, len(found)).astype(np.uint64)
    in_part = at * PARTS + np.repeat(table["part"].to_numpy(), sizes)
    of_part = np.bincount(in_part, counts, len(found) * PARTS).astype(np.uint64)
    words = int((total > 0).sum()) if table["kind"][0].as_py() == 1 else 0
    ends = np.cumsum(sizes)
    out = [squeeze(np.concatenate([total[at[e - n : e]], of_part[in_part[e - n : e]]])) for n, e in zip(sizes, ends, strict=True)]
    return pa.table({"bucket": table["bucket"], "kind": table["kind"], "bundle": table["bundle"], "part": table["part"], "totals": pa.array(out, pa.binary()), "vocabulary": pa.array([words] + [0] * (len(out) - 1), pa.int64())})


def _counted(buckets: int, id_type: pa.DataType):
    def counted(table: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _grams(table)
        totals = {}
        for kind in (1, 2):
            cut = grams.cuts(kind, buckets)
            ordered = np.zeros((2, len(grams.keys[kind])), dtype=np.uint64)
            for b, k, t in zip(answers["bucket"].to_pylist(), answers["kind"].to_pylist(), answers["totals"], strict=True):
                if k == kind:
                    ordered[:, cut[b] : cut[b + 1]] = loosen(t.as_py()).reshape(2, -1)
            back = np.empty_like(ordered)
            back[:, grams.order[kind]] = ordered
            totals[kind] = back
        (word, own_word), (pair, own_pair) = totals[1][:, grams.at1], totals[2][:, grams.at2]
        starts = grams.ends - grams.sizes
        learn = np.repeat(np.asarray(table["learn"].combine_chunks()).astype(bool), grams.sizes)
        before = np.concatenate([[0], np.arange(len(word) - 1)]) if len(word) else np.zeros(0, dtype=np.int64)
        before[starts] = grams.ends - 1  # texts end and start equally often
        rest_word, rest_pair = word - own_word, pair - own_pair
        keys, times = held_out_keys(rest_word[learn], rest_pair[learn], rest_word[before][learn])
        known = np.add.reduceat(word > 0, starts, dtype=np.int64) if len(starts) else starts
        logs = np.add.reduceat(np.log10(word + 0.5), starts) if len(starts) else starts.astype(float)
        first = [0] * (len(starts) - 1)
        both = np.stack([word, pair])
        return pa.table(
            {
                "id": table["id"].cast(id_type), "learn": table["learn"], "part": table["part"], "n_tokens": pa.array(grams.sizes), "n_known": pa.array(known), "log_counts": pa.array(logs),
                "vocabulary": pa.array([sum(answers["vocabulary"].to_pylist()), *first], pa.int64()),
                "counts": pa.array([squeeze(both[:, a:b].ravel()) for a, b in zip(starts, grams.ends, strict=True)], pa.binary()),
                "held": pa.array([pack(keys), *(None for _ in first)], pa.binary()), "times": pa.array([squeeze(times), *(None for _ in first)], pa.binary()),
            }
        )

    return counted


NONE, PLACES = 0, 1 << 20


def held_out_keys(word: np.ndarray, pair: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Held-out tokens by the level of their context, the steps by which pair / context is below 1, and those of the word's count above 1; how often each.

    Steps are numbered from 1; 0 stands for an estimate of 0.
    """
    word, pair, context = (x.astype(np.float64) for x in (word, pair, context))
    down = np.where(pair > 0, 1 + np.rint(-np.log(np.maximum(pair, 1) / np.maximum(context, 1)) / STEP), NONE)
    up = np.where(word > 0, 1 + np.rint(np.log(np.maximum(word, 1)) / STEP), NONE)
    keys, times = np.unique((level(context).astype(np.uint64) * PLACES + down.astype(np.uint64)) * PLACES + up.astype(np.uint64), return_counts=True)
    return keys, times.astype(np.uint64)


def _sequence(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each token, of its bigram, and of its context."""
    word, pair = loosen(data).astype(np.float64).reshape(2, -1)
    return word, pair, np.concatenate([word[-1:], word[:-1]])  # texts end and start equally often


def level(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 if it is unseen, else 1 + floor(log2)."""
    return np.where(context > 0, np.frexp(np.maximum(context, 1))[1], 0)


def _estimates(word: np.ndarray, pair: np.ndarray, context: np.ndarray, n: float, v: int) -> np.ndarray:
    return np.stack([np.divide(pair, context, out=np.zeros_like(pair), where=context > 0), word / max(n, 1.0), np.full_like(word, 1 / (v + 1))])


def learn_weights(levels: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each of 65 levels, by expectation-maximisation on tabled held-out tokens.

    p: the three estimates (rows) of tokens that occur ``n`` times. A level without held-out
    tokens takes the weights of the nearest level that has some.
    """
    weights = np.full((65, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    mass = np.bincount(levels, n, 65)
    for _ in range(rounds if len(n) else 0):
        part = weights[levels].T * p
        part *= n / part.sum(axis=0)
        got = np.stack([np.bincount(levels, q, 65) for q in part], axis=1)
        there = mass > 0
        weights[there] = got[there] / mass[there, None]
        weights[:, 2] = np.maximum(weights[:, 2], LEAST)
        weights /= weights.sum(axis=1, keepdims=True)
    have = np.flatnonzero(mass[1:] > 0) + 1
    for b in range(1, 65):
        if mass[b] == 0 and len(have):
            weights[b] = weights[have[np.argmin(np.abs(have - b))]]
    return weights


def interpolated_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", bundle_bytes: int = BUNDLE, many: int = MANY) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    Tokens are the words (runs of anything but 0x20 and 0x09-0x0D, A-Z in
    lower case) and one end. Rows where ``held_out`` is not true are learned
    from. p(w | c) mixes count(c w) / count(c), count(w) / N and 1 / (V + 1)
    with weights that depend on the level of count(c). The learning rows are cut in ``PARTS`` by a hash
    of the text, and each part is deleted in turn: expectation-maximisation sees every learning token, under
    the counts of the other parts. It reads estimates in steps of ``STEP`` nats. Scores
    use the counts of all learning rows. ``score`` sums log10 p; ``base_score`` sums log10 of the words' add-0.5 estimates.

    No count is pruned or capped. A bundle holds rows of one part, and rows alike are dealt over a part's bundles by their number.
    Each bundle sends a distinct n-gram once, so
    that a word pair that every text holds costs a row per bundle and not per
    text. n-grams are told apart by 64-bit hashes. A text is never cut; memory of a task is bounded by its bundle or bucket, and both
    grow in number with the input. From ``many`` bundles on, groups of them ask coarse buckets first. Only the table of held-out estimates, at most a row per level and pair of steps, comes to the driver.

    ``docs`` should give its rows in the same order whenever it is read, as stored tables do. Null texts count as empty (one token, the end). Null ids are learned from unless held_out is true for them.
    Repeated rows each count and each have a score. Without learning rows N and V are 0 and unigrams have
    base log10(1). An empty table gives an empty result; other columns may have any name.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), column_or_empty(text_col).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("learn"))
    base = base.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(PARTS)).cast("int"))
    sizes = dict(base.groupBy("part").agg(F.sum(F.octet_length("text"))).collect())  # a row a part
    fair = max(1, min(bundle_bytes, sum(sizes.values()) // partitions(spark)))
    per = [max(1, -(-sizes.get(p, 0) // fair)) for p in range(PARTS)]
    bundles, first = sum(per), [sum(per[:p]) for p in range(PARTS)]
    number = F.xxhash64("id", "text", F.monotonically_increasing_id())
    of_part = lambda a: F.element_at(F.array(*map(F.lit, a)), F.col("part") + 1)
    dealt = base.withColumn("bundle", (of_part(first) + F.pmod(number, of_part(per))).cast("int")).repartition(bundles, "bundle")
    coarse = bundles if bundles < many else int(np.ceil(np.sqrt(bundles)))
    asked = dealt.groupBy("bundle").applyInArrow(_ask(coarse), ASK)
    if coarse == bundles:
        answers = asked.groupBy("bucket", "kind").applyInArrow(_answer, ANSWER)
    else:
        fine = -(-bundles // coarse)
        group = F.floor(F.col("bundle") / coarse).alias("group")
        merged = asked.groupBy("bucket", "kind", "part", group).applyInArrow(_merge(coarse, fine), ASK)
        of_group = merged.groupBy("bucket", "kind").applyInArrow(_answer, ANSWER)
        answers = asked.groupBy("bucket", "kind", "part", group).cogroup(of_group.groupBy(F.floor(F.col("bucket") / fine), "kind", "part", group)).applyInArrow(_expand, ANSWER)
    id_type = docs.schema[id_col].dataType

    out = f"id {id_type.simpleString()}, learn boolean, part int, n_tokens long, n_known long, log_counts double, vocabulary long, counts binary, held binary, times binary"
    seen = dealt.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(_counted(coarse, to_arrow_type(id_type)), out)
    seen = written(seen, "lm-counts")
    got = seen.groupBy("part").agg(F.sum(F.when(F.col("learn"), F.col("n_tokens"))).alias("n"), F.sum("vocabulary").alias("v")).collect()  # a row a part
    of, v = {r["part"]: r["n"] or 0 for r in got}, sum(r["v"] for r in got)
    n = sum(of.values())

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, int] = {}
        for batch in batches:
            for part, keys, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = unpack(keys)
                # a part's counts are of n less its own tokens: its words' steps are those they would have of n
                shift = round(np.log(max(n, 1) / max(n - of[part], 1)) / STEP)
                up = key % PLACES
                key = key - up + np.where(up == NONE, up, up + np.uint64(shift))
                for k, t in zip(key.tolist(), loosen(times).tolist(), strict=True):
                    table[k] = table.get(k, 0) + t
        yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.int64()), pa.array(list(table.values()), pa.int64())], ["k", "n"])

    rows = seen.where("held is not null").select("part", "held", "times").mapInArrow(tabled, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    key, times = rows["k"].to_numpy(), rows["n"].to_numpy()
    down, up = (key // PLACES) % PLACES, key % PLACES
    p = np.stack([np.where(down == NONE, 0.0, np.exp(-(down - 1) * STEP)), np.where(up == NONE, 0.0, np.exp((up - 1) * STEP) / max(n, 1)), np.full(len(key), 1 / (v + 1))])
    weights = learn_weights(key // PLACES**2, p, times.astype(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for counts in batch.column(1):
                word, pair, context = _sequence(counts.as_py())
                p = (weights[level(context)].T * _estimates(word, pair, context, n, v)).sum(axis=0)
                got.append(float(np.log10(p).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["kept", "score"])

    kept = seen.select(F.struct("id", "learn", "n_tokens", "n_known", "log_counts").alias("kept"), "counts")
    kind = kept.schema["kept"].dataType.simpleString()
    base_of = F.col("kept.log_counts") - F.col("kept.n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    return kept.mapInArrow(score, f"kept {kind}, score double").select(
        F.col("kept.id").alias(id_col), (~F.col("kept.learn")).alias("held_out"), F.col("kept.n_tokens").alias("n_tokens"), F.col("kept.n_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base_of.alias("base_score"), "score",
    )
