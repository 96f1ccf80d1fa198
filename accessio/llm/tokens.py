"""Token counts of a byte-level byte-pair vocabulary, without making any token.

A piece of text starts as one symbol a byte in a doubly linked list; a heap holds
the adjacent pairs that can merge, by rank and place. Popping the lowest rank
again and again, joining the pair and pushing its new neighbours leaves the
symbols that the vocabulary would emit, so a piece's count is its bytes minus
the merges made. Identifiers are never looked up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from accessio.llm.base import bounded_batches, carried, renamed, text_of

OUTPUTS = ("n_bytes", "n_tokens", "over_limit")
#: Fixed value: how byte-level vocabularies of this family cut text before merging.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a Python worker remembers; it starts anew when full.
MEMO = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: A pair of symbol numbers as one integer.
PAIR_BITS = 20


class Merges:
    """Ranks of pairs, with numbers for symbols; the first 256 are the bytes."""

    def __init__(self, pairs: list[tuple[str, str]], specials: list[str]):
        numbers = {c: i for i, c in enumerate(byte_symbols())}
        self.ranks: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.joined.append(numbers.setdefault(a + b, len(numbers)))
            self.ranks.setdefault(numbers[a] << PAIR_BITS | numbers[b], rank)
        self.specials = sorted(specials, key=len, reverse=True)

    @classmethod
    def from_json(cls, text: str) -> Merges:
        spec = json.loads(text)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        return cls(pairs, [t["content"] for t in spec["added_tokens"]])


def merged_count(piece: bytes, ranks: dict[int, int], joined: list[int]) -> int:
    """Symbols left of the piece when no pair can merge."""
    n = len(piece)
    get = ranks.get
    places = n.bit_length()
    heap = [rank << places | i for i in range(n - 1) if (rank := get(piece[i] << PAIR_BITS | piece[i + 1])) is not None]
    if not heap:
        return n
    heapify(heap)
    symbol = list(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    merges, place = 0, (1 << places) - 1
    # An entry is a rank and a place. It is stale if the pair now at that place has another rank.
    while heap:
        entry = heappop(heap)
        i, rank = entry & place, entry >> places
        j = after[i]
        if j >= n or symbol[i] < 0 or get(symbol[i] << PAIR_BITS | symbol[j]) != rank:
            continue
        merges += 1
        whole = joined[rank]
        symbol[i], symbol[j] = whole, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := get(whole << PAIR_BITS | symbol[k])) is not None:
                heappush(heap, rank << places | i)
        if (h := before[i]) >= 0 and (rank := get(symbol[h] << PAIR_BITS | whole)) is not None:
            heappush(heap, rank << places | h)
    return n - merges


class Counter(dict):
    """Piece -> count, filled as pieces come up."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pieces = regex.compile(PIECE).findall
        self.special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = merged_count(piece.encode("utf-8"), self.merges.ranks, self.merges.joined)
        if len(piece) <= 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts)


#: The counter of the vocabulary used last in this worker.
_latest: list[Counter] = []


def token_counter(spark: SparkSession, vocabulary: str):
    """A function from a text column to its token counts. The file is read once, on the driver."""
    with open(vocabulary, encoding="utf-8") as file:
        merges: Broadcast[Merges] = spark.sparkContext.broadcast(Merges.from_json(file.read()))
    @pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not _latest or _latest[0].merges is not merges.value:
            _latest[:] = [Counter(merges.value)]
        counter = _latest[0]
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return lambda text: counted(text)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text_col: str = "text") -> DataFrame:
    """The rows with n_bytes, n_tokens and over_limit (n_tokens above the limit).

    Null and empty texts have 0 bytes and 0 tokens. A special string inside a text
    counts as the one token that it is for the vocabulary's own library. Copies and
    repeated rows are counted each; very long pieces cost n log n.
    """
    bounded_batches(docs.sparkSession)
    rows, inner = renamed(docs)
    text: Column = text_of(inner[text_col])
    counted = rows.withColumn("tokens", token_counter(docs.sparkSession, vocabulary)(text))
    return counted.select(
        *[F.col(inner[c]).alias(c) for c in carried(docs, OUTPUTS)],
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.col("tokens").alias("n_tokens"),
        (F.col("tokens") > limit).alias("over_limit"),
    )
