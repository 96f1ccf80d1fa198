"""Mixing sources to target weights, in fixed-length blocks of words.

Each source's documents, in the order of a hash of their ids, form one stream of
words that is packed into blocks of `block` words. Output shards draw how many
blocks they take from each source: a multinomial draw a shard, its chances
proportional to what is left of every source's quota and clipped to it, so the
totals are exact. Slot j of a source takes the block that a pseudorandom
permutation of that source's block numbers gives for j (a new permutation for
each pass over the source), and slots and blocks are joined by block number.

The streams' offsets are two-level prefix sums over hashed buckets, so a source
with a third of all rows is no larger a task than any other; equal rows are dealt
to parts first, so neither are they.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accessio.llm.base import WORD, numbered, renamed, settled, text_of

OUTPUTS = ("size", "source_size", "target", "taken")
#: Repeating weights of the sources in code point order, null last.
WEIGHTS = (1.0, 2.0, 3.0)
#: No source is taken more often than this.
MOST_EPOCHS = 3
BLOCK = 128
SHARDS = 64
SEED = 20
#: Rounds of the swap-or-not permutation.
ROUNDS = 10
#: Rows that a bucket of a stream should hold.
BUCKET_ROWS = 20_000
#: Parts that rows alike in id and text are dealt to.
SUBS = 1024
GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Source:
    index: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[float], most: float = MOST_EPOCHS) -> list[float]:
    """Shares of sum(sizes) by weight, none above most x its size; excess is shared anew by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        scale = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * scale > most * sizes[i]}
        for i in over or free:
            out[i] = most * float(sizes[i]) if over else weights[i] * scale
        left -= sum(out[i] for i in over)
        free = free - over if over else set()
    return out


def plan_sources(totals: dict[str | None, int], block: int = BLOCK, weight_of: Callable[[int], float] | None = None) -> list[Source]:
    """One entry a source. The number of sources is small against the corpus."""
    names = sorted((n for n in totals if n is not None)) + ([None] if None in totals else [])
    sizes = [totals[n] for n in names]
    weight_of = weight_of or (lambda i: WEIGHTS[i % len(WEIGHTS)])
    wanted = targets(sizes, [weight_of(i) for i in range(len(names))])
    found = []
    for i, (name, size, target) in enumerate(zip(names, sizes, wanted, strict=True)):
        blocks = -(-size // block)
        slots = min(MOST_EPOCHS * blocks, round(target * blocks / size)) if size else 0
        found.append(Source(i, name, size, target, blocks, slots))
    return found


def draw(sources: list[Source], shards: int = SHARDS, seed: int = SEED) -> list[list[int]]:
    """Blocks that each shard takes from each source: [shard][source]."""
    rng = np.random.default_rng(seed)
    left = np.array([s.slots for s in sources], dtype=np.int64)
    out = []
    for k in range(shards):
        want = -(-int(left.sum()) // (shards - k))
        got = np.zeros_like(left)
        while want:
            p = (left - got) / (left - got).sum()
            got = np.minimum(got + rng.multinomial(want, p), left)
            want = -(-int(left.sum()) // (shards - k)) - int(got.sum())
        left = left - got
        out.append([int(x) for x in got])
    return out


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n-1 that key selects (swap-or-not)."""

    def swap(value: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(F.lit("pivot"), r, *key) - value, n)
        chosen = F.xxhash64(F.lit("swap"), r, F.greatest(value, partner), *key) % 2 != 0
        return F.when(chosen, partner).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, swap)


def slots(spark: SparkSession, sources: list[Source], drawn: list[list[int]], seed: int = SEED) -> DataFrame:
    """One row for each block taken: shard, slot (in the shard), source index, block."""
    rows, taken, total = [], [0] * len(sources), sum(s.slots for s in sources)
    chunk = max(4096, total // 20_000)
    for shard, counts in enumerate(drawn):
        at = 0
        for s, n in zip(sources, counts, strict=True):
            for first in range(0, n, chunk):
                part = min(chunk, n - first)
                rows.append(f"({shard},{at}L,{s.index},{taken[s.index]}L,{part}L,{s.blocks}L)")
                taken[s.index] += part
                at += part
    values = ",".join(rows) or "(0,0L,0,0L,0L,1L)"
    runs = spark.sql(f"SELECT * FROM VALUES {values} AS t(shard, at, idx, first, n, blocks)").where("n > 0")
    runs = runs.repartition(max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    each = runs.select("shard", "at", "idx", "first", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    j = F.col("first") + F.col("i")
    epoch = F.floor(j / F.col("blocks"))
    return each.select(
        "shard",
        (F.col("at") + F.col("i")).alias("slot"),
        "idx",
        permuted(j % F.col("blocks"), F.col("blocks"), F.col("idx"), epoch, F.lit(seed)).alias("block"),
    )


def _tag(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def streams(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fixed: bool = False) -> tuple[DataFrame, list[Source]]:
    """Every row's place in its source's stream, and the sources.

    Columns: id, row (its number, see base.numbered), idx, size, start (in words) and
    key, which is XXH64 of id and text. Streams are in the order of keys, so rows
    alike in id and text stand together; these are dealt to SUBS parts by their
    numbers, so a third of all rows alike is no single task.
    """
    spark = docs.sparkSession
    rows = settled(
        numbered(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "row", fixed).select(
            "id",
            "row",
            _tag(F.col("source")).alias("tag"),
            F.xxhash64("id", text_of("text")).alias("key"),
            F.pmod(F.xxhash64("row"), F.lit(SUBS)).cast("int").alias("sub"),
            F.regexp_count(text_of("text"), F.lit(WORD)).cast("long").alias("size"),
        )
    )
    sums = rows.groupBy("tag").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sources = plan_sources({(None if r.tag == "n" else r.tag[1:]): r.size for r in sums}, block)
    buckets = max(64, sum(r.n for r in sums) // BUCKET_ROWS)
    values = ",".join(f"({'\'n\'' if s.name is None else _quoted('s' + s.name)},{s.index})" for s in sources) or "('n',0)"
    index = spark.sql(f"SELECT * FROM VALUES {values} AS t(tag, idx)")
    rows = rows.join(F.broadcast(index), "tag").drop("tag")
    parts = rows.groupBy("idx", "key", "sub").agg(F.sum("size").alias("in_part")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    inside = Window.partitionBy("idx", "bucket").orderBy("key", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("idx", "bucket")
        .agg(F.sum("in_part").alias("in_bucket"))
        .withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
        .drop("in_bucket")
    )
    parts = parts.withColumn("upto", F.sum("in_part").over(inside)).join(offsets, ["idx", "bucket"])
    begins = parts.select("idx", "key", "sub", (F.col("offset") + F.col("upto") - F.col("in_part")).alias("begin"))
    within = Window.partitionBy("idx", "key", "sub").orderBy("size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(begins.hint("merge"), ["idx", "key", "sub"])  # both sides grow with the corpus
    return placed.select("id", "row", "idx", "size", "key", (F.col("begin") + F.col("ahead")).alias("start")), sources


def fragments(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pieces of documents in each block: id, idx, size, key, start, block, words."""
    last = F.col("start") + F.col("size") - 1
    b = F.lit(block).cast("long")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor(last / b))))
    low = F.greatest(F.col("start"), F.col("block") * b)
    high = F.least(last + 1, (F.col("block") + 1) * b)
    return cut.withColumn("words", high - low)


def _taken(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, **columns) -> DataFrame:
    """What the mix takes of every row: the columns of streams, source_size, target and taken."""
    spark = docs.sparkSession
    placed, sources = streams(docs, block, **columns)
    placed = settled(placed)
    times = slots(spark, sources, draw(sources, shards, seed), seed).groupBy("idx", "block").agg(F.count(F.lit(1)).alias("times"))
    of_row = ["id", "row", "idx", "size", "key", "start"]
    taken = (
        fragments(placed, block)
        .join(times.hint("merge"), ["idx", "block"], "left")  # both sides grow with the corpus
        .groupBy(*of_row)
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    )
    empty = placed.where("size = 0").select(*of_row, F.lit(0).cast("long").alias("taken"))
    values = ",".join(f"({s.index},{s.size}L,double('{s.target!r}'))" for s in sources) or "(0,0L,0D)"
    about = spark.sql(f"SELECT * FROM VALUES {values} AS t(idx, source_size, target)")
    return taken.unionByName(empty).join(F.broadcast(about), "idx")


def mix(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """What the mix takes of every row: id, key, size, source_size, target, taken.

    key is XXH64 of id and text. Rows without words are never taken, and neither
    are sources without words. A null source is a source of its own. Rerunning on
    the same rows takes the same words. how: text_col, source_col, block, shards,
    seed, and fixed (see base.numbered).
    """
    return _taken(docs, id_col=id_col, **how).select(F.col("id").alias(id_col), "key", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, fixed: bool = False, **how) -> DataFrame:
    """The mix as whole documents: each row as often as the mix takes it, in the columns of docs.

    A row of which the mix takes x times its words comes floor(x) times, and once
    more with the chance of the rest, by a hash of its id and text; 3 times at most.
    For rows alike in both that chance moves on by the golden ratio from one to the
    next, so together they come as often as the mix takes them together, to a few.
    Rows without words have no say in the mix and stay once. how: as of mix.
    """
    given = docs if fixed else settled(docs)
    decided = _taken(given, fixed=True, **how)
    share = F.col("taken") / F.col("size")
    turn = F.pmod(F.xxhash64(F.lit("copy"), "key"), F.lit(1 << 20)) / F.lit(1 << 20) + F.pmod(F.col("start") / F.col("size") * GOLDEN, F.lit(1.0))
    chance = turn - F.floor(turn)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(share) + (share - F.floor(share) > chance).cast("long"))
    counts = decided.select("row", copies.alias("copies")).where("copies > 0")
    source, inner = renamed(given)
    rows = numbered(source, "row", True).join(counts.hint("merge"), "row")
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(*[F.col(inner[c]).alias(c) for c in docs.columns])
