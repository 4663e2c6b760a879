"""SentencePiece encoding and decoding by sampled segmentations without replacement.

A document's lattice holds every way to cut it into vocabulary pieces. As no
piece spans a word boundary, it is a chain of word lattices, which are built
once per distinct word of a batch. Gumbel noise turns drawing without
replacement into a search for the k largest perturbed log probabilities: the
largest value of a set of paths is a Gumbel at the log of its mass, truncated
by that of the set it was cut from. A path that has been found cuts its set
into those that share its first pieces and differ in the next, and the set with
the largest bound is searched next (A* over sets of paths).
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import column_or_empty

SPACE = "▁"
#: Fixed value: what the library decodes the unknown piece to.
UNKNOWN = " \u2047 ".encode()
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
#: Characters that are segmented at once (one longer text is by itself).
CHARACTERS = 600_000
PRIME, MARKED, BITS = np.uint64(0x9E3779B97F4A7C15), 1 << 23, 17
_B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniform(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) fixed by a seed and a place."""
    x = seed + at.astype(np.uint64) * PRIME
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


class Vocabulary:
    """Pieces of a SentencePiece model, and a weight for each.

    A model of merges has ranks, not probabilities: the weight of a piece is
    Zipf's, 1 / (rank + 1) to the power ``alpha``, and that of a byte is that of the last rank.
    A unigram model's own log probabilities are used, times ``alpha``.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte = np.full(256, -1, dtype=np.int64)
        usual, score = [], []
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usual.append(i)
                score.append(model.get_score(i))
        own = np.array(score)
        merges = bool(np.all(own == np.rint(own)))
        weight = -np.log1p(np.minimum(np.abs(own), size)) if merges else own
        self.byte_weight = alpha * (-np.log1p(size) if merges else float(own.min()))
        self.longest = max(len(self.text[i]) for i in usual)
        hashes, prefix = np.zeros(len(usual), dtype=np.uint64), np.zeros(MARKED, dtype=bool)
        with np.errstate(over="ignore"):
            for k, i in enumerate(usual):
                h = np.uint64(0)
                for c in self.text[i]:
                    h = (h + np.uint64(ord(c) + 1)) * PRIME
                    prefix[int(h) >> 41] = True
                hashes[k] = h
        order = np.argsort(hashes)
        self.prefix, self.hashes, self.ids = prefix, hashes[order], np.array(usual, dtype=np.int64)[order]
        self.weights = alpha * weight[order]
        self.starts = np.searchsorted(self.hashes >> np.uint64(64 - BITS), np.arange(1 << BITS)).clip(0, len(usual) - 1)
        is_byte = {int(i): b for b, i in enumerate(self.byte) if i >= 0}
        # control pieces and unused ones draw nothing; the unknown piece has a surface of its own, which stays as it is
        self.silent = [model.is_control(i) or model.is_unused(i) for i in range(size)]
        self.unknown = next((i for i in range(size) if model.is_unknown(i)), -1)
        self.raw = [b"" if self.silent[i] else UNKNOWN if i == self.unknown else bytes((is_byte[i],)) if i in is_byte else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where among the sorted hashes each of ``h`` is, if it is there: a jump by its high bits, then a few steps."""
        at = self.starts[h >> np.uint64(64 - BITS)]
        less = np.flatnonzero(self.hashes[at] < h)
        last = len(self.hashes) - 1
        while len(less):
            at[less] += 1
            less = less[at[less] < last]
            less = less[self.hashes[at[less]] < h[less]]
        return at

    def encoded(self, char: str) -> list[int]:
        return [int(self.byte[b]) for b in char.encode()]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, as the library has it: bytes are put together as UTF-8, the space that was put before the text goes, control pieces give nothing and the unknown piece its surface."""
        silent, raw = self.silent, self.raw
        runs = [ids] if not any(map(silent.__getitem__, ids)) else [list(run) for quiet, run in itertools.groupby(ids, silent.__getitem__) if not quiet]
        joined = [b"".join(map(raw.__getitem__, run)) for run in runs]  # bytes on two sides of a control piece don't make one letter
        if joined and joined[0][:1] == b" " and runs[0][0] != self.unknown and runs[0][0] != self.byte[0x20]:
            joined[0] = joined[0][1:]
        return "".join(run.decode("utf-8", "corpuswatch_each") for run in joined)


codecs.register_error("corpuswatch_each", lambda error: ("\ufffd" * (error.end - error.start), error.end))  # one mark a byte, as the library


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """The lattices of distinct words. A state is the place before a character; states are numbered by how much of their word is left, so that those a state leads to come before it.

    The edges of state s lie at first[s] .. first[s + 1], longest first; ``to`` is
    the number of states where a word ends. ``begin`` is each word's first
    character among all, ``state`` the state before each character.
    """

    def __init__(self, words: list[str], vocab: Vocabulary):
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.begin = np.cumsum(sizes) - sizes
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(code)
        left = np.repeat(self.begin + sizes, sizes) - np.arange(n)
        most = int(left.max(initial=0))
        small = left.astype(np.uint16) if most < 1 << 16 else left
        order = np.argsort(small, kind="stable")
        self.state = np.empty(n + 1, dtype=np.int32)
        self.state[order] = np.arange(n, dtype=np.int32)
        place, h, found = np.arange(n), np.zeros(n, dtype=np.uint64), []
        room = left
        for size in range(1, vocab.longest + 1):
            stays = room >= size
            place, room, h = place[stays], room[stays], h[stays]
            h = (h + code[place + (size - 1)]) * PRIME
            stays = vocab.prefix[h >> np.uint64(41)]
            place, room, h = place[stays], room[stays], h[stays]
            if not len(place) and size > 1:
                break
            at = vocab.find(h)
            hit = np.flatnonzero(vocab.hashes[at] == h)
            at, here = at[hit], place[hit]
            to = np.where(room[hit] == size, n, self.state[here + size])
            source, piece, weight = self.state[here], vocab.ids[at], vocab.weights[at]
            if size == 1:  # characters that are no piece go as bytes
                is_piece = np.zeros(n, dtype=bool)
                is_piece[here] = True
                odd = np.flatnonzero(~is_piece)
                point = (code[odd] - np.uint64(1)).astype(np.int64)
                count = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
                source = np.concatenate([source, self.state[odd]])
                to = np.concatenate([to, np.where(left[odd] == 1, n, self.state[odd + 1])])
                piece = np.concatenate([piece, np.where(point < 128, vocab.byte[np.minimum(point, 127)], -1 - point)])
                weight = np.concatenate([weight, count * vocab.byte_weight])
            found.append((size, source, to, piece, weight))
        degree = np.zeros(n, dtype=np.int64)
        for _, source, *_ in found:
            degree[source] += 1  # a state has one edge of each size at most
        self.first = np.concatenate([[0], np.cumsum(degree)])
        edges, free = int(self.first[-1]), self.first[:-1].copy()
        self.to, self.size, self.piece, weights = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        for size, source, to, piece, weight in reversed(found):
            at = free[source]
            self.to[at], self.size[at], self.piece[at], weights[at] = to, size, piece, weight
            free[source] += 1
        self.last = self.to == n
        beta = np.zeros(n + 1)
        cut = np.searchsorted(small[order], np.arange(1, most + 2))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = self.first[a], self.first[b]
            value, starts = weights[lo:hi] + beta[self.to[lo:hi]], self.first[a:b] - lo
            top = np.maximum.reduceat(value, starts)
            mass = np.add.reduceat(np.exp(value - np.repeat(top, degree[a:b])), starts)
            beta[a:b] = top + np.log(mass)
        self.log_p = weights + beta[self.to] - np.repeat(beta[:n], degree)
        p = np.exp(self.log_p)
        sums = np.cumsum(p)
        self.sums = sums - np.repeat(sums[self.first[:-1]] - p[self.first[:-1]], degree)
        self.sums[self.first[1:] - 1] = 2.0  # whatever is left goes to the last edge

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state, by its probability."""
        edge = self.first[state]
        beyond = np.flatnonzero(u > self.sums[edge])
        while len(beyond):
            edge[beyond] += 1
            beyond = beyond[u[beyond] > self.sums[edge[beyond]]]
        return edge


NONE = np.zeros(0, dtype=np.int32)


def truncated(phi: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at ``phi`` that don't exceed ``bound``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        value = phi - np.logaddexp(phi - bound, np.log(-np.log(u)))
    return np.where(np.isneginf(phi), -np.inf, value)


def segment(texts: list[str], keys: list, k: int, vocab: Vocabulary, seed: int = 0) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` different segmentations, best perturbed value first: (ids, log probability, perturbed value, inclusion score)."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    occurrences, doc_chars, doc_words = [], [], []
    for text in texts:
        words = WORDS(SPACE + text.replace(" ", SPACE)) if text else []
        occurrences += map(number.__getitem__, words)
        doc_words.append(len(words))
        doc_chars.append(len(text) + 1 if text else 0)
    if not occurrences:
        return [[(NONE, 0.0, 0.0, 1.0)] for _ in texts]
    words = list(number)
    lattice = Lattice(words, vocab)
    word = np.array(occurrences, dtype=np.int64)
    word_chars = np.fromiter(map(len, words), dtype=np.int64, count=len(words))[word]
    word_start = np.cumsum(word_chars) - word_chars  # of each occurrence, among all characters
    doc_end, word_end = np.cumsum(doc_chars), np.cumsum(doc_words)
    doc_start = doc_end - doc_chars
    doc_of_word = np.repeat(np.arange(len(texts)), doc_words)
    seeds = np.array([xxhash.xxh64_intdigest(repr(x), seed) for x in keys], dtype=np.uint64)
    total = int(doc_end[-1])
    doc_of_char = np.repeat(np.arange(len(texts), dtype=np.int32), doc_chars)

    def walk(path: np.ndarray, sample: int, doc: np.ndarray, at: np.ndarray, state: np.ndarray) -> None:
        """Draws on from each state to the end of its word."""
        salt = seeds + np.uint64(sample * 0x51_7C_C1B7_2722)
        while len(doc):
            edge = lattice.draw(state, uniform(salt[doc], at - doc_start[doc]))
            path[at] = edge
            more = np.flatnonzero(~lattice.last[edge])
            doc, edge = doc[more], edge[more]
            at, state = at[more] + lattice.size[edge], lattice.to[edge]

    path = np.full(total, -1, dtype=np.int32)
    walk(path, 0, doc_of_word, word_start, lattice.state[lattice.begin][word])
    paths, some = [path], np.flatnonzero(np.array(doc_chars) > 0)
    salt = seeds + np.uint64(0xA5A5)
    bound = np.full(len(texts), -np.inf)
    bound[some] = -np.log(-np.log(uniform(salt[some], np.zeros(len(some)))))
    found: list[list[tuple[int, float]]] = [[(0, float(b))] for b in bound]
    heaps: list[list] = [[] for _ in texts]
    begin = doc_start.copy()  # where each new path leaves the one that it was cut from
    spent: list[tuple[int, ...]] = [() for _ in texts]  # edges that are no longer free there
    for sample in range(k):
        # cut what the new paths stand for: places after which a path of the set may differ
        path = paths[sample]
        at = np.flatnonzero(path >= 0)
        doc = doc_of_char[at]
        live = np.zeros(len(texts), dtype=bool)
        live[[d for d in some if found[d][-1][0] == sample]] = True
        inside = live[doc]
        at, doc = at[inside], doc[inside]
        if not len(at):
            break
        log_p = lattice.log_p[path[at]]
        ends = np.cumsum(log_p)
        head = np.flatnonzero(np.diff(doc, prepend=-1))
        before = ends - log_p - np.repeat((ends - log_p)[head], np.diff(np.append(head, len(doc))))
        with np.errstate(divide="ignore"):
            phi = before + np.log(np.maximum(-np.expm1(np.minimum(log_p, 0.0)), 0.0))
        phi[lattice.log_p[path[at]] > -1e-12] = -np.inf  # the only edge
        phi[at < begin[doc]] = -np.inf
        for d in np.flatnonzero(live):
            if spent[d]:
                i = int(np.searchsorted(at, begin[d]))
                free = 1.0 - np.exp(lattice.log_p[[*spent[d], path[at[i]]]]).sum()
                phi[i] = before[i] + np.log(free) if free > 1e-12 else -np.inf
        value = truncated(phi, bound[doc], uniform(salt[doc] + np.uint64(sample + 1), at - doc_start[doc] + 1))
        for a, b in zip(head, np.append(head[1:], len(doc)), strict=True):
            d, wanted = int(doc[a]), k - sample
            v = value[a:b]
            best = np.argpartition(-v, wanted - 1)[:wanted] if b - a > wanted else np.arange(b - a)
            for i in best:
                if v[i] > -np.inf:
                    place = int(at[a + i])
                    gone = (*spent[d], int(path[place])) if place == begin[d] and spent[d] else (int(path[place]),)
                    heapq.heappush(heaps[d], (-float(v[i]), sample, place, gone))
        if sample == k - 1:
            break
        new = np.full(total, -1, dtype=np.int32)
        cut_doc, cut_at, cut_state = [], [], []
        from_word = np.zeros(len(texts), dtype=np.int64) + len(word)
        for d in some:
            if not heaps[d]:
                continue
            v, parent, place, gone = heapq.heappop(heaps[d])
            bound[d], begin[d], spent[d] = -v, place, gone
            found[d].append((sample + 1, -v))
            new[doc_start[d] : place] = paths[parent][doc_start[d] : place]
            w = int(np.searchsorted(word_start, place, side="right")) - 1
            state = int(lattice.state[lattice.begin[word[w]] + place - word_start[w]])
            lo, hi = lattice.first[state], lattice.first[state + 1]
            p = np.exp(lattice.log_p[lo:hi])
            p[np.array(gone) - lo] = 0.0
            sums = np.cumsum(p)
            u = uniform(salt[d : d + 1] + np.uint64(7919 * (sample + 1)), np.zeros(1))[0]
            edge = int(lo + min(np.searchsorted(sums, u * sums[-1], side="right"), np.flatnonzero(p)[-1]))
            new[place] = edge
            if not lattice.last[edge]:
                cut_doc.append(d)
                cut_at.append(place + int(lattice.size[edge]))
                cut_state.append(int(lattice.to[edge]))
            from_word[d] = w + 1
        index = np.arange(len(word))
        after = index[index >= from_word[doc_of_word]]
        walk(new, sample + 1, np.concatenate([np.array(cut_doc, dtype=np.int64), doc_of_word[after]]), np.concatenate([np.array(cut_at, dtype=np.int64), word_start[after]]), np.concatenate([np.array(cut_state, dtype=np.int32), lattice.state[lattice.begin][word[after]]]))
        paths.append(new)

    out = []
    for d in range(len(texts)):
        if not doc_chars[d]:
            out.append([(NONE, 0.0, 0.0, 1.0)])
            continue
        limit = -heaps[d][0][0] if heaps[d] else -np.inf
        rows = []
        for sample, value in found[d]:
            edges = paths[sample][doc_start[d] : doc_end[d]]
            edges = edges[edges >= 0]
            ids, log_p = lattice.piece[edges], float(lattice.log_p[edges].sum())
            if len(ids) and ids.min() < 0:
                ids = np.array([j for i in ids.tolist() for j in ((i,) if i >= 0 else vocab.encoded(chr(-1 - i)))], dtype=np.int32)
            rows.append((ids, log_p, value, float(-np.expm1(-np.exp(min(log_p - limit, 700.0)))) if limit > -np.inf else 1.0))
        out.append(rows)
    return out


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def sample_segmentations(docs: DataFrame, path: str | Callable[[], str], k: int = 2, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """id_col, sample (from 1), ids, log_prob, perturbed, inclusion and round_trip: up to ``k`` different segmentations of each text, drawn without replacement.

    ``inclusion`` is the probability, given the perturbed value that comes next after those shown,
    that a segmentation is among them (1 where a text has no others). ``round_trip`` tells
    that ``ids`` decode to the text (a U+2581 in it being a space). Draws depend on the row's id and ``seed``
    only, not on how rows are dealt. ``path`` is the model's place on every executor, or a function that gives it there.

    Texts are segmented whole. One pass, no shuffle; memory is bounded by a batch of ``CHARACTERS`` characters or one text.
    Null and empty texts have one row, without ids. Null and repeated ids are kept (rows of one id and text draw alike).
    An empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("_id"), column_or_empty(text_col).alias("_text"))
    fields = [("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("round_trip", pa.bool_())]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path() if callable(path) else path, alpha)
        for batch in batches:
            texts, a = batch.column(1).to_pylist(), 0
            while a < len(texts):
                b, chars = a + 1, len(texts[a])
                while b < len(texts) and chars + len(texts[b]) <= CHARACTERS:
                    chars += len(texts[b])
                    b += 1
                rows, of = [], []
                for i, found in enumerate(segment(texts[a:b], batch.column(0).slice(a, b - a).to_pylist(), k, vocab, seed)):
                    want = texts[a + i].replace(SPACE, " ")
                    rows += [(s + 1, ids, lp, v, q, vocab.decode(ids.tolist()) == want) for s, (ids, lp, v, q) in enumerate(found)]
                    of += [a + i] * len(found)
                columns = [pa.array(c, t) if n != "ids" else _lists(c) for c, (n, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], ["_id", *(n for n, _ in fields)])
                a = b

    out = StructType([StructField("_id", kind), StructField("sample", IntegerType()), StructField("ids", ArrayType(IntegerType())), StructField("log_prob", DoubleType()), StructField("perturbed", DoubleType()), StructField("inclusion", DoubleType()), StructField("round_trip", BooleanType())])
    return base.mapInArrow(draw, out).withColumnRenamed("_id", id_col)
