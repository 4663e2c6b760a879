"""Token counts of a byte-level BPE vocabulary with word ends, without making identifiers.

Each pre-token's symbols form a linked list, and a heap holds the adjacent
pairs that have a merge rank. The pair of the lowest rank (leftmost on a tie)
is merged again and again; the count is the number of symbols at the start
less the merges.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import column_or_empty

#: Words whose counts a worker remembers, and the longest word it remembers.
REMEMBER, LONGEST = 200_000, 64

# Capitals of newer Unicode versions than Python's tables may know, and their small letters.
NEWER = {0xA7CB: 0x264, 0xA7DC: 0x19B}
NEWER |= {c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}
NEWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEWER = regex.compile(f"[{''.join(map(chr, NEWER))}]")
# Fixed value: from here on the library knows no letters, though newer Unicode versions do.
UNKNOWN = "[\U000323b0-\U0010ffff]"
_UNKNOWN = regex.compile(UNKNOWN)


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges ``symbols`` undergo."""
    n = len(symbols)
    heap = [(r, i, i + 1, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    sym: list[str | None] = list(symbols)
    after, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if sym[i] != a or after[i] != j or sym[j] != b:
            continue  # one of the two has been merged since
        merged = a + b
        sym[i], sym[j], done = merged, None, done + 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((merged, sym[k]))) is not None:
                heapq.heappush(heap, (r, i, k, merged, sym[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((sym[h], merged))) is not None:
            heapq.heappush(heap, (r, h, i, sym[h], merged))
    return done


class Counter:
    """Counts as the ``tokenizers`` library does for a .json file of this kind: NFC, white space to one space, lower case, words split by the file's pattern, bytes, merges; no special tokens are added, and their strings in a text count as one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model = found["model"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        split = next(p for p in found["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.words_of_rare = regex.compile("(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--{UNKNOWN}]")).findall
        special = [t["content"] for t in found["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.letters = byte_letters()
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        if (n := self.known.get(word)) is not None:
            return n
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        n = len(symbols) - merges(symbols, self.ranks)
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[word] = n
        return n

    def plain(self, text: str) -> int:
        # lower case comes letter by letter: no rule for a final sigma
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        if _NEWER.search(text):
            text = text.translate(NEWER)
        known, word = self.known.get, self.word
        words = self.words if text.isascii() or not _UNKNOWN.search(text) else self.words_of_rare
        return sum([known(w) or word(w) for w in words(text)])

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str | Callable[[], str], limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of ``docs``.

    ``path`` is the vocabulary's place on every executor, or a function that
    gives it there. Each text is counted whole in one pass over Arrow batches,
    nothing is shuffled, and a worker remembers the counts of at most
    ``REMEMBER`` short words. Null texts count as empty (0 tokens); null and
    repeated ids are kept; an empty table gives an empty result; further
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("_id"), column_or_empty(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path() if callable(path) else path)
        for batch in batches:
            n = pa.array([tokens(x.as_py()) for x in batch.column(1)], pa.int64())
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], ["_id", "n_bytes", "n_tokens"])

    out = StructType([StructField("_id", kind), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return base.mapInArrow(count, out).select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
