"""Histogram sort: cut a corpus into shards of near-equal bytes.

Every row gets a 64-bit sort key, the XXH64 of its id and text, so keys are
uniform whatever the ids look like. Rows alike in id and text share a key; among
them a second 64-bit key decides, a hash of the row's number, so a key that holds
a third of all rows is cut like any other stretch. Together they make a line of
128 bits. Splitters on it are found by counting, exactly and over all rows, the
bytes below candidate boundaries: the first probes cut the line into equal bins,
each later round puts new probes only inside the bins in which a splitter's target
falls, until each splitter is within the tolerance of its target or its bin holds
one row. Shards are cut to a small tolerance, the ranges inside a shard to a
quarter of their size. After that a row's range is a function of its keys, and one
exchange sorts every range: a small slice of one shard, so no task sees a whole
shard or all rows of one key.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessio.llm.base import carried, literal_longs, numbered, renamed, settled, text_of

OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Bits that one round of probes tells apart at least; a deeper round adds as many.
ROUND_BITS = 12
#: Bits of the first round at most: their counts are what the driver holds.
MOST_BITS = 20
#: Bytes that a range should hold at most.
RANGE_BYTES = 256 << 20
#: Ranges of a shard at least, and of all shards at most.
LEAST_RANGES, MOST_RANGES = 32, 1 << 17
KEY_BITS = 64
LINE = 2 * KEY_BITS
_HALF = 1 << (KEY_BITS - 1)


@dataclass(frozen=True)
class Splitter:
    """Rows with (key, tie) >= (at, tie) belong above it; below: exact bytes and rows under it."""

    at: int
    tie: int
    bytes_below: int
    rows_below: int


@dataclass
class _Target:
    """A splitter in the making: what its bin must hold of the bytes, and what lies below that bin."""

    number: int
    bytes: float
    slack: float
    #: Between copies of a row it is put at the nearest row, whichever of them come first.
    exact: bool
    bytes_below: int = 0
    rows_below: int = 0


def _splitter(place: int, bytes_below: int, rows_below: int) -> Splitter:
    """A splitter at a place of the line."""
    key, tie = divmod(place, 1 << KEY_BITS)
    return Splitter(key - _HALF, tie - _HALF, bytes_below, rows_below)


def _bin(bits: int) -> list[Column]:
    """The first bits of a row's place on the line: those of the key, and those of the tie with the whole key before them."""
    name, own = ("__key", bits) if bits <= KEY_BITS else ("__tie", bits - KEY_BITS)
    first = F.shiftright(F.col(name), KEY_BITS - own) + F.lit(1 << (own - 1) if own < KEY_BITS else 0)
    return [first] if bits <= KEY_BITS else [F.col("__key"), first]


def _number(row, bits: int) -> int:
    """A bin as one number: its first place is number << (LINE - bits)."""
    if bits < KEY_BITS:
        return row.b0
    if bits == KEY_BITS:
        return row.b0 + _HALF
    own = bits - KEY_BITS
    return ((row.b0 + _HALF) << own) + row.b1 + (_HALF if own == KEY_BITS else 0)


def _histogram(rows: DataFrame, bits: int, within: list[int] | None = None, coarse: int = 0) -> list[tuple[int, int, int, int | None]]:
    """(bin, bytes, rows, key if all its rows share one) of the bins that hold rows, in order; inside some bins of fewer bits if given."""
    if within is not None:
        parent = F.concat_ws(":", *[c.cast("string") for c in _bin(coarse)])
        rows = rows.where(parent.isin([_named(b, coarse) for b in within]))
    named = [c.alias(f"b{i}") for i, c in enumerate(_bin(bits))]
    counted = rows.groupBy(*named).agg(F.sum("__size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("__key").alias("low"), F.max("__key").alias("high"))
    return sorted((_number(r, bits), r.s, r.n, r.low if r.low == r.high else None) for r in counted.collect())


def _named(number: int, bits: int) -> str:
    """The bin as _histogram's filter spells it."""
    if bits < KEY_BITS:
        return str(number)
    if bits == KEY_BITS:
        return str(number - _HALF)
    key, tie = divmod(number, 1 << (bits - KEY_BITS))
    return f"{key - _HALF}:{tie - (_HALF if bits == LINE else 0)}"


def _locate(targets: list[_Target], bins: list[tuple[int, int, int, int | None]], bits: int, found: dict[int, Splitter]) -> dict[tuple[int, int], list[_Target]]:
    """Puts the targets (ascending, all inside these bins) at bin edges where these are close enough; the others by the deeper bin to look into."""
    deeper: dict[tuple[int, int], list[_Target]] = defaultdict(list)
    under, rows_under, i = targets[0].bytes_below, targets[0].rows_below, 0
    for t in targets:
        while i < len(bins) and under + bins[i][1] < t.bytes:
            under, rows_under, i = under + bins[i][1], rows_under + bins[i][2], i + 1
        if i == len(bins):
            end = bins[-1][0] + 1 if bins else 0
            found[t.number] = _splitter(end << (LINE - bits), under, rows_under)
            continue
        b, size, n, key = bins[i]
        before, after = t.bytes - under, under + size - t.bytes
        if n > 1 and min(before, after) > (0 if t.exact and bits > KEY_BITS else t.slack) and bits < LINE:
            t.bytes_below, t.rows_below = under, rows_under
            # a bin of one key alone is next cut by its ties
            deeper[(KEY_BITS, key + _HALF) if key is not None and bits < KEY_BITS else (bits, b)].append(t)
        elif after < before:
            found[t.number] = _splitter((b + 1) << (LINE - bits), under + size, rows_under + n)
        else:
            found[t.number] = _splitter(b << (LINE - bits), under, rows_under)
    return deeper


def find_splitters(rows: DataFrame, shards: int, tolerance: float, ranges: int = 1) -> tuple[list[Splitter], int, int]:
    """Splitters between shards of equal bytes, each shard cut into ranges; how many ranges; all rows.

    rows: __key long, __size long and, to tell rows of one key apart, __tie long.
    tolerance: as a share of a shard's bytes. ranges: of a shard at least; there are
    more if they would hold more than RANGE_BYTES.
    """
    rows = rows if "__tie" in rows.columns else rows.withColumn("__tie", F.lit(0).cast("long"))
    bits = ROUND_BITS
    bins = _histogram(rows, bits)
    total, count = sum(b[1] for b in bins), sum(b[2] for b in bins)
    ranges = max(ranges, min(-(-total // (RANGE_BYTES * shards)), MOST_RANGES // shards))
    while 8 * ranges * shards > 1 << bits and bits < MOST_BITS:
        bits += 1
    bins = bins if bits == ROUND_BITS else _histogram(rows, bits)
    pieces = shards * ranges
    slacks = (tolerance * total / shards, total / pieces / 4)
    open_targets = [_Target(k, total * k / pieces, slacks[k % ranges > 0], k % ranges == 0) for k in range(1, pieces)]
    found: dict[int, Splitter] = {}
    deeper = _locate(open_targets, bins, bits, found) if open_targets else {}
    while deeper:
        following: dict[tuple[int, int], list[_Target]] = {}
        for level in sorted({level for level, _ in deeper}):
            inside = {b: targets for (at, b), targets in deeper.items() if at == level}
            # the next edge of 64 bits is kept, so a bin is of one key or cut by keys alone
            finer = min(level + ROUND_BITS, KEY_BITS if level < KEY_BITS else LINE)
            by_parent: dict[int, list] = defaultdict(list)
            for row in _histogram(rows, finer, sorted(inside), level):
                by_parent[row[0] >> (finer - level)].append(row)
            for b, targets in inside.items():
                following |= _locate(targets, by_parent[b], finer, found)
        deeper = following
    return sorted((found[k] for k in range(1, pieces)), key=lambda x: (x.at, x.tie)), ranges, count


def _splitters_below(splitters: list[Splitter]) -> Column:
    """How many splitters lie at or below a row's (key, tie): a search by halves in two constant arrays."""
    ends = [x for x in splitters if x.at < _HALF]  # one past the largest key leaves nothing above it
    if not ends:
        return F.lit(0)
    keys, ties = literal_longs([x.at for x in ends]), literal_longs([x.tie for x in ends])
    steps = [1 << k for k in reversed(range(len(ends).bit_length()))]

    def step(low: Column, width: Column) -> Column:
        at = low + width
        key = F.get(keys, at - 1)
        below = (key < F.col("__key")) | ((key == F.col("__key")) & (F.get(ties, at - 1) <= F.col("__tie")))
        return F.when((at <= len(ends)) & below, at).otherwise(low)

    return F.aggregate(F.array(*[F.lit(w) for w in steps]), F.lit(0), step)


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.0005, id_col: str = "doc_id", text_col: str = "text", fixed: bool = False) -> DataFrame:
    """The rows with size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 1, so a null or empty text has size 1.
    law is `bytes`: shards differ by the tolerance, or by one row where rows are
    larger than that. slot counts from 0 inside a shard, without gaps, in key
    order. grown_shard is null under this law. Null ids are keys like any other.
    Rows alike in id and text are spread like others: the shards and slots that they
    fill together are the same on every run, and which of them takes which follows
    their order in the input. fixed: see base.numbered. Two reads of the input: one for its sizes, one for the exchange
    that carries all columns in use.
    """
    keep = carried(docs, OUTPUTS)
    source, inner = renamed(docs)
    id_in, text_in = inner[id_col], inner[text_col]
    size = (F.octet_length(text_of(text_in)) + 1).cast("long")
    keyed = numbered(source, "__row", fixed).withColumns({"__key": F.xxhash64(F.col(id_in), text_of(text_in)), "__tie": F.xxhash64("__row", F.lit("tie")), "__size": size})
    splitters, ranges, count = find_splitters(settled(keyed.select("__key", "__tie", "__size")), shards, tolerance, LEAST_RANGES)
    rows_below = [0, *[x.rows_below for x in splitters]]
    starts = [n - rows_below[k // ranges * ranges] for k, n in enumerate(rows_below)]
    placed = keyed.select(
        *[inner[c] for c in keep],
        "__key",
        "__tie",
        "__size",
        F.crc32(text_of(text_in).cast("binary")).alias("__crc"),
        _splitters_below(splitters).alias("__range"),
    )
    in_range = F.row_number().over(Window.partitionBy("__range").orderBy("__key", "__tie"))
    return placed.select(
        *[F.col(inner[c]).alias(c) for c in keep],
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.floor(F.col("__range") / ranges).cast("int").alias("shard"),
        (F.element_at(literal_longs(starts), F.col("__range") + 1) + in_range - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
