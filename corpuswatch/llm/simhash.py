"""SimHash near-dedup: 64-bit fingerprints linked through deletion-variant signatures.

For links by similarity of shingle sets see ``similar_copies``: texts that
share 0.8 of their shingles differ in some 10 of 64 bits. Segments of which
one differs by at most one bit would then have six bits or so, and each of
their buckets would hold a good part of all texts, so fingerprints there have
2,240 bits, and segments of which one is equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import MOST_SLOTS, KeyFilter, column_or_empty, components, partitions, slices, written

SEED = 42
#: Shingles whose bits are counted at once, to bound memory on very long texts.
STEP = 1 << 16
HALF = 0xFFFFFFFF


def fingerprint(text: str, size: int = 3) -> int:
    """Bit i is set where over half of the shingles' XXH64 hashes have it set; a text without words gives 0."""
    words = text.encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(words) - size + 1
    for at in range(0, n, STEP):
        part = words[at : at + STEP + size - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        h = np.array([digest(s, SEED) for s in joined], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """id_col and ``fp``, the fingerprint as a signed long, for each row of ``docs``; null texts count as empty."""
    base = docs.select(F.col(id_col).alias("_id"), column_or_empty(text_col).alias("_text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["_id", "fp"])

    out = StructType([StructField("_id", docs.schema[id_col].dataType), StructField("fp", LongType())])
    return base.mapInArrow(make, out).select(F.col("_id").alias(id_col), "fp")


def _bits(x) -> F.Column:
    return F.bit_count(x)


def links(fps: DataFrame, hot: int = 64) -> DataFrame:
    """All pairs (a, b) of different fingerprints in ``fps`` (column fp, distinct longs) that differ in 1 or 2 bits, each once.

    Cut into two halves of 32 bits, two such fingerprints have a half that
    differs in at most one bit. Three kinds of index key find every pair in
    just one way: the high half itself (the low halves differ), the low half
    itself (the high halves differ), and for one bit in each half the high
    half with one bit as a wildcard. A wildcard bucket joins only those with
    that bit set to those without.

    A bucket of over ``hot`` fingerprints isn't joined as it is: its members
    get finer keys in which the other half is cut again in two of 16 bits, and
    signed by the same deletion variants (halves of 16 bits exact where the
    wildcard already holds one of the two bits). This loses no pair, and
    members of one finer key differ in 17 bits at most. Equality joins alone
    make candidates, and a count of differing bits verifies each.
    """
    fps = fps.repartition(partitions(fps.sparkSession), "fp")  # a small table in few files makes 34 keys a row
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(HALF))
    wild = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda j: F.struct(
            (j + 2).alias("kind"),
            F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j)).bitwiseAND(high).alias("key"),
            F.call_function("shiftright", high, j).bitwiseAND(F.lit(1).cast("long")).cast("int").alias("side"),
            low.alias("rest"),
        ),
    )
    exact = F.array(
        F.struct(F.lit(0).alias("kind"), high.alias("key"), F.lit(-1).alias("side"), low.alias("rest")),
        F.struct(F.lit(1).alias("kind"), low.alias("key"), F.lit(-1).alias("side"), high.alias("rest")),
    )
    index = fps.select("fp", F.explode(F.concat(exact, wild)).alias("k")).select("fp", "k.*")
    sizes = index.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    # a bucket of one, or a wildcard bucket with one side only, holds no pair
    sizes = written(sizes.where((F.col("n") > 1) & ((F.col("kind") < 2) | (F.col("s0") != F.col("s1")))).select("kind", "key", "n"), "simhash-sizes")
    index = written(index.join(sizes, ["kind", "key"]), "simhash-index")

    def pairs(rows: DataFrame, on: list[str]) -> DataFrame:
        a, b = rows.alias("a"), rows.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
        wildcard = (F.col("a.kind") >= 2) & (F.col("a.side") == 0) & (F.col("b.side") == 1)
        whole = (F.col("a.kind") < 2) & (F.col("a.fp") < F.col("b.fp"))
        apart = _bits(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
        joined = a.join(b, [*same, wildcard | whole])
        one_each = _bits(F.col("a.rest").bitwiseXOR(F.col("b.rest"))) == 1  # else another kind has the pair
        return joined.where(apart.between(1, 2) & ((F.col("a.kind") < 2) | one_each)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    cool, warm = index.where(F.col("n") <= hot), index.where(F.col("n") > hot)
    top, bottom = F.shiftrightunsigned("rest", 16), F.col("rest").bitwiseAND(F.lit(0xFFFF))
    # differing in one or two bits, one half of 16 bits differs in at most one: equal there, or the same but for a wildcard
    def variants(k: int, half: F.Column) -> F.Column:
        bits = F.when(F.col("kind") < 2, F.sequence(F.lit(0), F.lit(15))).otherwise(F.array().cast("array<int>"))

        def without(j: F.Column) -> F.Column:
            mask = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j))
            return F.struct((j + (100 * k + 1)).alias("sub"), mask.bitwiseAND(half).alias("sub_key"))

        return F.concat(F.array(F.struct(F.lit(100 * k).alias("sub"), half.alias("sub_key"))), F.transform(bits, without))

    both = F.concat(variants(0, top), variants(1, bottom))
    fine = warm.select("*", F.explode(both).alias("v")).select("fp", "kind", "key", "side", "rest", "v.*")
    return pairs(cool, ["kind", "key"]).unionByName(pairs(fine, ["kind", "key", "sub", "sub_key"]).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, hot: int = 64) -> DataFrame:
    """id_col, fingerprint (16 lowercase hex digits) and component_id (smallest id reachable over links of 2 or fewer differing bits) for each row of ``docs``.

    Rows of one fingerprint fall together before any are linked, so copies
    are never expanded into pairs; ids of the classes are propagated over the
    links between different fingerprints by distributed contraction. Nothing is
    collected. What is aggregated by a key is written before rows are joined to it, so that a
    fingerprint or a component with a third of all rows is split over tasks. Texts without words have fingerprint 0 and link like any other;
    null texts count as empty. Repeated rows are kept. A null id is never
    the smallest; a component of null ids alone has a null component_id. An
    empty table gives an empty result; further columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, size), "simhash")
    classes = written(fps.groupBy("fp").agg(F.min(id_col).alias("_first")), "simhash-classes")
    nodes = written(components(links(classes.select("fp"), hot), "simhash-links"), "simhash-nodes")
    of_fp = written(classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_first", F.coalesce("component", "fp").alias("component")), "simhash-of")
    least = written(of_fp.groupBy("component").agg(F.min("_first").alias("component_id")), "simhash-least")
    linked = written(of_fp.join(least, "component").select("fp", "component_id"), "simhash-linked")
    return fps.join(linked, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle, and the least Jaccard similarity of near copies.
SIZE, LEAST = 5, 0.8
#: Segments of a wide fingerprint and bits of each that make a key; further words of it that candidates are held against.
SEGMENTS, BITS, WORDS = 128, 14, 3
#: Rows of a family that are compared in one task, all with all.
HOT = 128
#: Sets of fewer shingles aren't told apart by bits where the sets are at hand.
SMALL = 64
#: Edges that a task reduces to a forest at once.
MOST_EDGES = 1 << 20
_RANDOM = np.random.default_rng(SEED)
_WIDE = SEGMENTS // 4 + WORDS
_TIMES = _RANDOM.integers(0, 1 << 63, _WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, _WIDE, dtype=np.uint64)


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's shingles; a text of ``size`` or fewer words is one shingle."""
    words = text.encode().lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), dtype=np.uint64, count=len(words) - size + 1))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """A SimHash of 35 words: each bit is set where over half of the shingles have it set in hashes derived from theirs."""
    votes = np.zeros(_WIDE * 64, dtype=np.int64)
    for at in range(0, len(found), 255):  # so that counts fit a byte
        h = (found[at : at + 255, None] ^ _PLUS) * _TIMES
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        votes += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(found), bitorder="little").view("<u8")


def segments(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each segment, of its number and its bits, and the further words, signed."""
    lanes = fp[: SEGMENTS // 4].view("<u2").astype(np.int32) & ((1 << BITS) - 1)
    return lanes | (np.arange(SEGMENTS, dtype=np.int32) << BITS), fp[SEGMENTS // 4 :].view("<i8")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bits_apart(least: float, n: int) -> int:
    """Bits of ``n`` that differ at most, but for a chance of 1e-9, where sets of one size have that similarity."""
    p = float(np.arccos(2 * least / (1 + least)) / np.pi)
    return int(n * p + 6 * (n * p * (1 - p)) ** 0.5)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges reduced to one from each node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, of = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        now = of.copy()
        low = np.minimum(of[a], of[b])
        for x in (a, b):
            np.minimum.at(now, x, low)
            np.minimum.at(now, of[x], low)
        now = now[now]
        if (now == of).all():
            return nodes[of != np.arange(len(nodes))], nodes[of[of != np.arange(len(nodes))]]
        of = now


class _Forest:
    """Edges that are reduced whenever they are many."""

    def __init__(self):
        self.a, self.b, self.held, self.most = [], [], 0, MOST_EDGES

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > self.most:
            self.most = max(MOST_EDGES, 2 * len(self.rest()[0]))

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, dtype=np.int64)
        a, b = forest(np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))
        self.a, self.b, self.held = [a], [b], len(a)
        return a, b


def near_in_buckets(key: np.ndarray, node: np.ndarray, n: np.ndarray, bits: np.ndarray, least: float, hot: int, found: _Forest) -> None:
    """Edges that connect what is near in each run of one key: all pairs are compared, but in a run of over ``hot`` rows not those that are connected yet."""
    most = bits_apart(least, 64 * WORDS)
    bits = [x.view(np.uint64) for x in bits]  # of signed ones the bits of their absolute values would be counted

    def near(i, j):
        apart = sum(np.bitwise_count(bits[k][i] ^ bits[k][j]).astype(np.int16) for k in range(WORDS))
        return (apart <= most) & (np.minimum(n[i], n[j]) >= (least - 1e-9) * np.maximum(n[i], n[j]))

    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for at, size in zip(starts[sizes > hot], sizes[sizes > hot], strict=True):
        unseen, front = np.arange(at, at + size), []
        while len(unseen):
            if not front:
                front, unseen = [unseen[0]], unseen[1:]
            i = front.pop()
            here = near(i, unseen)
            if here.any():
                front.extend(unseen[here])
                found.add(np.full(here.sum(), node[i]), node[unseen[here]])
                unseen = unseen[~here]
    i, step = np.flatnonzero(np.repeat(sizes <= hot, sizes)), 0
    while len(i):
        step += 1
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        here = i[near(i, i + step)]
        found.add(node[here], node[here + step])


def near_in_sets(nodes: list[int], sets: list[np.ndarray], block: np.ndarray, known: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of that Jaccard similarity that connect all there are, within one block or else between two. Pairs connected yet, those of one ``known`` component among them, are passed over, and of larger sets those whose fingerprints differ in too many bits."""
    fps, n = np.array([wide_fingerprint(x) for x in sets]), np.array([len(x) for x in sets])
    apart = np.zeros((len(n), len(n)), dtype=np.int16)
    for word in fps.T:
        apart += np.bitwise_count(word[:, None] ^ word[None])
    may = (apart <= bits_apart(least, 64 * _WIDE)) | (np.minimum(n[:, None], n) < SMALL)
    may &= np.minimum(n[:, None], n) >= (least - 1e-9) * np.maximum(n[:, None], n)
    if (block != block[0]).any():
        may &= block[:, None] != block
    first, at = np.unique(known, return_index=True, return_inverse=True)[1:]
    may &= at[:, None] != at
    i, j = np.nonzero(np.triu(may, 1))
    of, links = first[at].tolist(), []

    def root(x: int) -> int:
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    for k in np.argsort(apart[i, j], kind="stable").tolist():
        x, y = root(int(i[k])), root(int(j[k]))
        if x != y and similarity(sets[i[k]], sets[j[k]]) >= least - 1e-12:
            of[max(x, y)] = min(x, y)
            links.append((nodes[i[k]], nodes[j[k]]))
    return links


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows as _id, _of (the text's hash) and node (their set of shingles); and the nodes with the first of their rows, size, keys and bits."""
    base = docs.select(F.col(id_col).alias("_id"), column_or_empty(text_col).alias("_text")).withColumn("_of", F.xxhash64("_text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(text.as_py(), size) for text in batch.column(1)]
            keys, bits = zip(*(segments(wide_fingerprint(x)) for x in sets), strict=True) if sets else ((), ())
            nodes = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
            own = [pa.array(nodes, pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(list(keys), pa.list_(pa.int32())), pa.array(list(bits), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *own], ["_id", "_of", "node", "n", "keys", "bits"])

    fields = [StructField("_of", LongType()), StructField("node", LongType()), StructField("n", IntegerType()), StructField("keys", ArrayType(IntegerType())), StructField("bits", ArrayType(LongType()))]
    marks = written(base.mapInArrow(mark, StructType([StructField("_id", docs.schema[id_col].dataType), *fields])), "near-marks")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_of")).alias("first")
    classes = marks.groupBy("node").agg(first, F.min("_of").alias("_of"), F.min("n").alias("n"), F.min("keys").alias("keys"), F.min("bits").alias("bits"))
    return marks.select("_id", "_of", "node"), written(classes, "near-classes")


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _reduced(edges: DataFrame) -> DataFrame:
    """(a, b): edges with the components of ``edges``, a written table. Forests that tasks have made apart name a node once a task; few tasks, of some ``MOST_EDGES`` edges each, make them one."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Forest()
        for batch in batches:
            found.add(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        yield _edges(*found.rest())

    return edges.select("a", "b").coalesce(-(-edges.count() // MOST_EDGES) or 1).mapInArrow(reduce, "a long, b long")


def _families(classes: DataFrame, least: float, hot: int) -> DataFrame:
    """(node, component): nodes connected by segments that are equal and further words that differ in few bits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = _Forest(), None
        for batch in batches:
            now = [np.asarray(batch.column(k)) for k in range(3 + WORDS)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
            if cut:
                near_in_buckets(*(x[:cut] for x in held[:3]), [x[:cut] for x in held[3:]], least, 8 * hot, found)
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            near_in_buckets(*held[:3], held[3:], least, 8 * hot, found)
        yield _edges(*found.rest())

    index = classes.select(F.explode("keys").alias("key"), "node", "n", *(F.get("bits", F.lit(k)).alias(f"w{k}") for k in range(WORDS)))
    edges = index.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")
    return written(components(_reduced(written(edges, "near-edges")), "near-families"), "near-family")


def _linked(docs: DataFrame, text_col: str, size: int, classes: DataFrame, families: DataFrame, least: float, hot: int, filter_bits: int) -> DataFrame:
    """(a, b): verified links that connect what is similar in each family. The sets of a family's nodes are made again from their texts and meet block by block.

    First sets meet those of their own block and of the family's first, so that what has links to many others is connected by
    rows in proportion to the family. Then those outside its largest component yet meet all others, and links between two
    components count once.
    """

    def texts_to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py(), size).tobytes() for x in batch.column(1)], pa.binary())], ["_of", "found"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list) -> list[tuple[int, int]]:
            return near_in_sets([r[6] for r in rows], [np.frombuffer(r[3], dtype=np.uint64) for r in rows], np.array([r[2] for r in rows]), np.array([r[6] for r in rows]), least) if len(rows) > 1 else []

        here, rows, found = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[0], row[4], row[5]) != here:
                    found += links(rows)
                    here, rows = (row[0], row[4], row[5]), []
                rows.append(row)
            yield _edges(*zip(*found, strict=True)) if found else _edges((), ())
            found = []
        found = links(rows)
        yield _edges(*zip(*found, strict=True)) if found else _edges((), ())

    blocks = written(families.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("k")), "near-blocks")
    members = classes.select("node", "_of").join(families, "node")
    members = written(written(members, "near-members").join(blocks, "component").select("_of", "node", F.col("component").alias("family"), "k", F.pmod(F.xxhash64("node"), "k").cast("int").alias("block")), "near-placed")
    asked = KeyFilter(members.select("_of"), filter_bits)
    base = docs.select(F.xxhash64(column_or_empty(text_col)).alias("_of"), column_or_empty(text_col).alias("_text"))
    texts = asked.mark(base, "_asked", F.col("_of")).where("_asked").select("_of", "_text").mapInArrow(texts_to_sets, "_of long, found binary")
    sets = written(texts.groupBy("_of").agg(F.first("found").alias("found")), "near-texts")

    def met(placed: DataFrame, name: str) -> DataFrame:
        """Links of (_of, family, node, block, known, i, j): rows with the same i and j meet."""
        dealt = placed.join(sets, "_of").select("family", "node", "block", "found", "i", "j", "known")
        return written(dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(compare, "a long, b long"), name)

    at = F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("block")))
    first = members.withColumn("i", at).withColumns({"j": F.col("i"), "block": F.lit(0), "known": F.col("node")})
    within = met(first, "near-within")
    large = members.where("k > 1").select("_of", "node", "family")
    if large.isEmpty():
        return within
    yet = written(components(_reduced(within), "near-yet"), "near-yet")
    large = written(large.join(yet, "node", "left").select("_of", "node", "family", F.coalesce("component", "node").alias("known")), "near-large")
    sizes = large.groupBy("family", "known").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max(F.struct("n", "known")).alias("main"), F.sum("n").alias("all"))
    rest = F.col("all") - F.col("main.n")
    sizes = sizes.where(rest > 0).select("family", F.col("main.known").alias("main"), *(F.ceil(n / hot).cast("int").alias(k) for k, n in (("k", F.col("main.n")), ("r", rest))))
    placed = large.join(written(sizes, "near-rest"), "family").withColumn("of_main", F.col("known") == F.col("main"))
    placed = placed.withColumn("block", F.when(F.col("of_main"), F.pmod(F.xxhash64("node"), "k")).otherwise(F.col("k") + F.pmod(F.xxhash64("node"), "r")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.when(F.col("of_main"), F.col("k")).otherwise(0), F.col("k") + F.col("r") - 1)))
    across = met(placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}), "near-across")
    return written(yet.where("node <> component").toDF("a", "b").union(across.distinct()), "near-links")


def _first_of_component(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, hot: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _of, node), and for each node the first row of its component."""
    marks, classes = _classes(docs, id_col, text_col, size)
    links = _linked(docs, text_col, size, classes, _families(classes, least, hot), least, hot, filter_bits)
    nodes = written(components(_reduced(links), "near-components"), "near-of-node")
    of_class = written(classes.join(nodes, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "near-of-class")
    firsts = written(of_class.groupBy("component").agg(F.min("first").alias("first")), "near-firsts")
    return marks, written(of_class.select("node", "component").join(firsts, "component").select("node", "first"), "near-linked")


def similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST, hot: int = HOT, filter_bits: int = MOST_SLOTS) -> DataFrame:
    """id_col and component_id (smallest id reachable over links of texts whose shingles have a Jaccard similarity of ``least`` or more) for each row of ``docs``.

    Rows with one set of shingles fall together first. Sets get a SimHash of 2,240 bits. At 0.8 some 15 in
    100 bits differ, and 14 bits of a segment are equal with a chance of 0.1, so one of 128 segments is, but for a
    chance of 1.3e-6 (8e-4 where a set of four shingles lies in one of five, which differ most). Sets with an equal segment are held against further words;
    those that differ in few bits are connected to families, of which only a spanning forest is listed.
    Inside a family the sets themselves verify each pair that isn't connected yet, so no link is wrong and a pair in one family
    needs no segment of its own. Families of over ``hot`` sets are dealt as blocks: each set meets its own and the first
    block, and what isn't in the largest component then meets all other blocks. In a bucket of over eight
    times ``hot`` sets the search goes from set to set, past those already reached. Pairs are never rows.

    Null texts count as empty; texts without words are alike. Repeated rows are
    kept. A null id is never the smallest; a component of null ids alone has a null
    component_id. An empty table gives an empty result; further columns are ignored.
    """
    marks, linked = _first_of_component(docs, id_col, text_col, size, least, hot, filter_bits)
    return marks.join(linked, "node").select(F.col("_id").alias(id_col), F.col("first.id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST, hot: int = HOT, filter_bits: int = MOST_SLOTS) -> DataFrame:
    """One row of each component of ``similar_copies``, with all columns of ``docs``: that with the smallest id, null ids counting as largest, of rows with that same id the one whose text has the least hash, and of rows alike in both any one.

    Rows that go, and rows alike in id and text, are flagged by a bitmap; only flagged rows are shuffled
    with their text. An empty table stays empty; columns may have any names.
    """
    marks, linked = _first_of_component(docs, id_col, text_col, size, least, hot, filter_bits)
    first = F.col("first.id").eqNullSafe(F.col("_id")) & (F.col("first._of") == F.col("_of"))
    counted = marks.groupBy("_id", "_of").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("rows"))
    told = written(counted.join(linked, "node").select("_id", "_of", "rows", first.alias("stays")).where("rows > 1 or not stays"), "near-told")
    special = KeyFilter(told.select(F.xxhash64("_id", "_of")), filter_bits)
    whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(column_or_empty(text_col)).alias("_of"), F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("_row"))
    flagged = special.mark(whole, "_flagged", F.xxhash64("_id", "_of"))
    gone = told.where("not stays").select(F.col("_id").alias("g"), F.col("_of").alias("h"))
    rest = flagged.where("_flagged").join(gone, F.col("_id").eqNullSafe(F.col("g")) & (F.col("_of") == F.col("h")), "left_anti").groupBy("_id", "_of").agg(F.first("_row").alias("_row"))
    stays = flagged.where("not _flagged").select("_row").unionByName(rest.select("_row"))
    return stays.select(*(F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
