"""Importance resampling towards a target: documents drawn by how much their features look like the target's.

Features are all runs of one to three consecutive words, hashed to BUCKETS by CRC32.
Each bucket's gain is the log ratio of its shares in target and corpus, in
thousandths; one array of gains scores all documents. A document's weight is the sum
of its features' gains; with a fixed random number from its id (Gumbel's trick) the
highest scores are a draw without replacement.

The draw takes the k-th key of (score downwards, id upwards, row) exactly: radix
selection counts one digit of the keys after another over all rows, the highest digit
first, keeps the digit in which the k-th key lies, and stops as soon as the counts
tell. Only keys up to the k-th are then sorted by ranges and numbered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from accessio.llm.base import bounded_batches, numbered, renamed, settled, text_of

BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bits of a digit; so many counts come to the driver at most.
DIGIT = 12
#: Words whose features are hashed at once, and words that a Python worker remembers.
CHUNK, MEMO = 1 << 17, 1_000_000

# Words are runs of digits, letters a to z and anything beyond ASCII; the other bytes become blanks.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words, A-Z in lower case."""
    return text.encode("utf-8").translate(_PLAIN).split()


# CRC32 of joined texts -----------------------------------------------------------------------------
# The checksum of a text followed by n bytes is the text's, moved on by n zero bytes (a linear map of
# its bits), xor the checksum of those bytes. A word's checksum thus serves all features that hold it.

#: Words of more bytes than that are hashed with their features, byte by byte.
LONGEST = 64


def _moves() -> np.ndarray:
    """[n, i, b]: what byte i of a checksum, if it is b, becomes after n zero bytes."""
    byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.empty((LONGEST + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, LONGEST + 1):
        last = out[n - 1]
        out[n] = (last >> np.uint32(8)) ^ byte[last & np.uint32(255)]
    return out


MOVES = _moves()
_BLANK = zlib.crc32(b" ")


def moved(crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    out = MOVES[n, 0, crc & np.uint32(255)]
    for i in (1, 2, 3):
        out = out ^ MOVES[n, i, crc >> np.uint32(8 * i) & np.uint32(255)]
    return out


class Words(dict):
    """Word -> its checksum, with its length above."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = len(word) << 32 | zlib.crc32(word)
        return value


_words = Words()


def buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all features, in pieces."""
    words = words_of(text)
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK + 2]  # two more words end the features that start here
        n = min(CHUNK, len(words) - at)
        packed = np.fromiter(map(_words.__getitem__, part), np.int64, len(part))
        length, one = packed >> 32, (packed & 0xFFFFFFFF).astype(np.uint32)
        yield one[:n] % BUCKETS
        if length.max() > LONGEST:
            for k in (2, 3):
                joined = map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))
                yield np.array([zlib.crc32(f) for f, _ in zip(joined, range(n), strict=False)], np.uint32) % BUCKETS
            continue
        two = moved(moved(one[:-1], 1) ^ np.uint32(_BLANK), length[1:]) ^ one[1:]
        three = moved(moved(two[:-1], 1) ^ np.uint32(_BLANK), length[2:]) ^ one[2:]
        yield two[:n] % BUCKETS
        yield three[:n] % BUCKETS


def bucket_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Features by bucket over all texts (column text), and how many there are; BUCKETS rows a task are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                for found in buckets(text):
                    np.add.at(total, found, 1)
        bucket = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": bucket.astype(np.int32), "n": total[bucket]})

    sums = texts.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for row in sums:
        out[row.bucket] = row.n
    return out, int(out.sum())


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """A bucket's gain: log of its smoothed share in the target over that in the corpus, in thousandths, rounded down."""
    t_all, s_all = float(target.sum() + BUCKETS), float(corpus.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log((t + 1) * s_all / ((s + 1) * t_all))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def _scored(text: Column, gained: np.ndarray) -> Column:
    sent = gained.tolist()

    @pandas_udf("n_words long, n_features long, weight long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gain = np.array(sent, np.int64)
        for texts in batches:
            rows = []
            for t in texts:
                first = n = weight = 0
                for k, found in enumerate(buckets(t)):
                    first += len(found) if k % 3 == 0 else 0
                    n += len(found)
                    weight += int(gain[found].sum())
                rows.append((first, n, weight))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype="int64")

    return of(text)


def luck(id_: Column, seed: int = SEED) -> Column:
    """A Gumbel number from the id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


# Selection -----------------------------------------------------------------------------------------


def _parts(score: Column, id_: Column, row: Column, low: dict[str, int], high: dict[str, int]) -> list[tuple[Column, int]]:
    """The key from its most significant part on, each part a number from 0 and its bits. Null ids come last."""
    ids = F.when(id_.isNull(), F.lit(0)).otherwise(id_ - F.lit(low["id"]))
    wide = lambda name: max(0, high[name] - low[name]).bit_length()
    return [
        (F.lit(high["score"]) - score, wide("score")),
        (id_.isNull().cast("long"), 1),
        (ids, wide("id")),
        (row - F.lit(low["row"]), wide("row")),
    ]


def kth_key(keys: DataFrame, k: int, bits: list[int]) -> list[tuple[int, int, int]]:
    """(part, shift, digit) from the most significant on: a key is among the first k just if its digits are at most these.

    keys: columns p0, p1 .. of non-negative numbers below 2**bits[i], all rows
    together distinct. One count a digit, over the rows that agree so far; it stops
    when a whole digit's rows are taken.
    """
    path: list[tuple[int, int, int]] = []
    rest, within = k, keys
    for part, wide in enumerate(bits):
        for shift in reversed(range(0, wide, DIGIT)):
            digit = F.shiftright(F.col(f"p{part}"), shift).bitwiseAND((1 << DIGIT) - 1)
            counts = sorted((r.digit, r.n) for r in within.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect())
            for value, n in counts:
                if n >= rest:
                    break
                rest -= n
            path.append((part, shift, value))
            if n == rest:
                return path
            within = within.where(digit == value)
    return path


def up_to(path: list[tuple[int, int, int]]) -> Column:
    """The keys whose digits are at most those of the path, in order of the digits."""
    out = F.lit(True)
    for part, shift, value in reversed(path):
        digit = F.shiftright(F.col(f"p{part}"), shift).bitwiseAND((1 << DIGIT) - 1)
        out = (digit < value) | ((digit == value) & out)
    return out


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with rank 1, 2 .. in the order of keys: sorted by ranges, numbered by the places in each range and the ranges' counts."""
    placed = settled(rows.orderBy(*keys)).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a task
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", fixed: bool = False) -> DataFrame:
    """Every row's id with n_features, weight, score and rank (null if not drawn).

    PERCENT of the rows with LEAST_WORDS words are drawn, rounded down: those of
    highest score, ties to smaller ids, nulls last, then to the row read first, so equal rows are drawn one
    by one. Ids: whole numbers. Null and empty texts have no features and weight 0; so does all, if the
    target is empty, but for what smoothing gives. Two reads of the documents;
    fixed: see base.numbered.
    """
    bounded_batches(docs.sparkSession)
    source, inner = renamed(docs if fixed else settled(docs))
    text = text_of(inner[text_col])
    corpus, _ = bucket_counts(source.select(text.alias("text")))
    aims, _ = bucket_counts(target.select(text_of(target_text).alias("text")))
    rows = numbered(source, "row", True).select("row", F.col(inner[id_col]).cast("long").alias("id"), _scored(text, gains(aims, corpus)).alias("s"))
    scored = settled(rows.select("row", "id", "s.*").withColumn("score", F.col("weight") + luck(F.col("id"))))
    able = scored.where(F.col("n_words") >= LEAST_WORDS)
    names = ("score", "id", "row")
    ends = able.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{a}_{c}") for c in names for a, f in (("low", F.min), ("high", F.max))]).first()
    k = PERCENT * ends.n // 100
    low, high = ({c: ends[f"{a}_{c}"] or 0 for c in names} for a in ("low", "high"))
    parts = _parts(F.col("score"), F.col("id"), F.col("row"), low, high)
    keyed = able.select("*", *[c.alias(f"p{i}") for i, (c, _) in enumerate(parts)])
    order = [f"p{i}" for i in range(len(parts))]
    first = up_to(kth_key(keyed, k, [b for _, b in parts])) if k else F.lit(False)
    drawn = ranked(keyed.where(first), order) if k else keyed.withColumn("rank", F.lit(None).cast("long")).limit(0)
    others = keyed.where(~first).unionByName(scored.where(F.col("n_words") < LEAST_WORDS), allowMissingColumns=True)
    done = drawn.unionByName(others.withColumn("rank", F.lit(None).cast("long")))
    return done.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
