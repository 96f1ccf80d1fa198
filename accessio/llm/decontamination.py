"""Benchmark decontamination by spaced seeds.

Texts become lower-case runs of letters and digits. A mask of ones and zeros is
laid over every position; the tokens under its ones are hashed, those under its
zeros are ignored, so a hit survives substitutions at ignored places, and several
masks survive them elsewhere. Hashes of benchmark items and documents are joined.
Around every hit item and document are compared token by token along the hit's
diagonal; of the stretches that are long and alike enough, the best-scoring one (a
match +1, a substitution -PENALTY) counts.

Items too short for every mask are hashed whole and found where all their tokens
stand in a row.

Documents stay where they are: a document's positions, hashes and probes of the
broadcast benchmark hashes are one generated stage. Of the hits that follow each
other on a diagonal the first alone goes on, with the stretch of the document that
the item can reach; these are shuffled, made distinct by document, item and
diagonal, and each diagonal is compared once. Benchmarks beyond the broadcast
limits are joined by shuffles instead, with the same results.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessio.llm.base import by_row, numbered, renamed, settled, text_of

MASKS = ("1111011", "11011011", "1110010111")
#: Matching tokens that an overlap needs, and its share of matches. Items of fewer
#: than LEAST / SIMILARITY tokens need that share of their own tokens.
LEAST = 13
SIMILARITY = 0.8
PENALTY = 2
#: Benchmark hashes (some 40 bytes each) and bytes of its items that are broadcast.
BROADCAST_SEEDS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Parts that each hash is dealt to where hashes are joined by a shuffle, as one may stand in most documents.
SALTS = 16
SHORTEST = min(map(len, MASKS))


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _seeds(tokens: Column, at: Column, whole: Iterable[int] = ()) -> Column:
    """Hashes of all masks laid at a position, then of the next n tokens for each n of whole; null where one passes the end."""

    def of(number: int, mask: str) -> Column:
        picked = [F.get(tokens, at + i) for i, bit in enumerate(mask) if bit == "1"]
        return F.when(at + len(mask) <= F.size(tokens), F.xxhash64(F.lit(number), *picked))

    return F.array(*[of(k, m) for k, m in enumerate(MASKS)], *[of(-n, "1" * n) for n in whole])


def seeded(df: DataFrame, tokens: str = "tokens", whole: Collection[int] = ()) -> DataFrame:
    """A row for every position and mask: all columns, at, mask, seed.

    explode_outer: an inner explode would have its size test pushed below, where
    every text would be cut into tokens once more.
    """
    last = F.size(tokens) - min(SHORTEST, *whole, SHORTEST)
    where = df.withColumn("at", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))))
    return where.select("*", F.posexplode_outer(_seeds(F.col(tokens), F.col("at"), whole)).alias("mask", "seed"))


def enough(n: Column) -> Column:
    """Matches that an overlap with an item of n tokens needs."""
    return F.ceil(F.least(F.lit(LEAST), n) * SIMILARITY)


def overlap(item: Column, doc: Column, shift: Column) -> Column:
    """The best stretch of item tokens q against doc tokens q + shift among those long and alike enough: (score, matches, length, item_from); null if there is none.

    A stretch that can't be bettered begins and ends with runs of matches, so all
    pairs of runs are tried, on diagonals with matches enough. Of equal scores the
    one that ends first counts, then the shortest.
    """
    first = F.greatest(F.lit(0), -shift)
    last = F.greatest(first, F.least(F.size(item), F.size(doc) - shift) - 1)
    unlike = F.filter(F.sequence(first, last), lambda q: F.get(item, q) != F.get(doc, q + shift))
    needs = enough(F.size(item))

    def runs(edges: Column) -> Column:
        """Runs of matches: the substitutions before, the first token, the token behind."""
        every = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda k: F.struct(k.alias("k"), (F.get(edges, k) + 1).alias("from"), F.get(edges, k + 1).alias("to")))
        return F.filter(every, lambda r: r["from"] < r["to"])

    def stretch(a: Column, b: Column) -> Column:
        length, missed = b["to"] - a["from"], b["k"] - a["k"]
        return F.struct((length - missed * (1 + PENALTY)).alias("score"), (-b["to"]).alias("sooner"), a["from"].alias("item_from"), (length - missed).alias("matches"), length.alias("length"))

    def qualifies(a: Column, b: Column) -> Column:
        length = b["to"] - a["from"]
        matches = length - (b["k"] - a["k"])
        return (b["k"] >= a["k"]) & (matches >= needs) & (matches >= length * SIMILARITY)

    def best(found: Column) -> Column:
        return F.array_max(F.transform(found, lambda a: F.array_max(F.transform(F.filter(found, lambda b: qualifies(a, b)), lambda b: stretch(a, b)))))

    def once(value: Column, then) -> Column:
        """then(value), with value computed a single time."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def of(bad: Column) -> Column:
        edges = F.concat(F.array(first - 1), bad, F.array(last + 1))
        return F.when(last + 1 - first - F.size(bad) >= needs, once(edges, lambda e: once(runs(e), best)))

    return once(unlike, of)


@dataclass(frozen=True)
class Benchmark:
    """items: k, item, item_tokens. keys: seed, k, n (the item's tokens), item_at, before (the seed that the mask has one token earlier)."""

    items: DataFrame
    keys: DataFrame
    whole: tuple[int, ...]
    small: bool


def prepared(benchmark: DataFrame, item_col: str, item_text: str, broadcast_seeds: int) -> Benchmark:
    given = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), tokens_of(text_of(item_text)).alias("item_tokens"))
    items = settled(given).withColumn("k", F.monotonically_increasing_id())
    n = F.size("item_tokens")
    before = F.get(_seeds(F.col("item_tokens"), F.col("at") - 1), F.col("mask"))
    keys = seeded(items, "item_tokens").where("seed IS NOT NULL").select("seed", "k", n.alias("n"), F.col("at").alias("item_at"), F.when(F.col("at") > 0, before).alias("before"))
    short = items.where(n.between(1, SHORTEST - 1))
    whole = tuple(sorted(r.n for r in short.select(n.alias("n")).distinct().collect()))
    if whole:
        same_length = F.coalesce(*[F.when(n == k, F.element_at(_seeds(F.col("item_tokens"), F.lit(0), whole), len(MASKS) + 1 + i)) for i, k in enumerate(whole)])
        keys = keys.unionByName(short.select(same_length.alias("seed"), "k", n.alias("n"), F.lit(0).alias("item_at"), F.lit(None).cast("long").alias("before")))
    keys = settled(keys)
    size = items.agg(F.sum(F.octet_length(F.array_join("item_tokens", " "))).alias("b")).first().b or 0
    return Benchmark(items, keys, whole, keys.count() <= broadcast_seeds and size <= BROADCAST_BYTES)


def diagonals(texts: DataFrame, bench: Benchmark) -> DataFrame:
    """row, k, shift, piece: each diagonal with a hit once, with the document's tokens that the item can reach on it. texts: row, text."""
    cut = texts.select("row", tokens_of(text_of("text")).alias("tokens"))
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    first = F.greatest(F.col("shift"), F.lit(0))
    piece = F.slice("tokens", first + 1, F.greatest(F.least(F.col("n") + F.least(F.col("shift"), F.lit(0)), F.size("tokens") - first), F.lit(0)))
    if bench.small:
        hits = seeded(cut, whole=bench.whole).join(F.broadcast(bench.keys), "seed")
        # of hits of one mask in a row the first is enough
        prior = F.get(_seeds(F.col("tokens"), F.col("at") - 1), F.col("mask"))
        begun = hits.where(F.col("before").isNull() | (F.col("at") == 0) | (F.col("before") != prior))
        found = begun.select("row", "k", shift, "n", "tokens").select("row", "k", "shift", piece.alias("piece"))
        return found.groupBy("row", "k", "shift").agg(F.first("piece").alias("piece"))
    spread = bench.keys.drop("before").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    probes = seeded(cut, whole=bench.whole).where("seed IS NOT NULL").select("row", "at", "seed", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    found = probes.join(spread.hint("merge"), ["seed", "salt"]).select("row", "k", shift, "n").distinct()
    return found.join(cut.hint("merge"), "row").select("row", "k", "shift", piece.alias("piece"))


def leaks(texts: DataFrame, bench: Benchmark) -> DataFrame:
    """row, item, n (the item's tokens) and b, the order of the best overlap of the two: score, matches, shorter, earlier, sooner."""
    items = F.broadcast(bench.items) if bench.small else bench.items.hint("merge")
    found = diagonals(texts, bench).join(items, "k")
    compared = found.select("row", "k", "item", "shift", F.size("item_tokens").alias("n"), overlap(F.col("item_tokens"), F.col("piece"), F.least(F.col("shift"), F.lit(0))).alias("o")).where("o IS NOT NULL")
    order = F.struct(F.col("o.score").alias("score"), F.col("o.matches").alias("matches"), (-F.col("o.length")).alias("shorter"), (-F.col("o.item_from")).alias("earlier"), (-F.col("shift")).alias("sooner"))
    return compared.groupBy("row", "k", "item", "n").agg(F.max(order).alias("b"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS, fixed: bool = False) -> DataFrame:
    """One row for each document and item that overlap: id, item, matched, length, item_tokens, similarity, item_from, doc_from.

    Tokens are counted and numbered from 0. Of several overlaps (each is tested
    before any is chosen) the one that scores best counts, then the first in the item and the document.
    Null and empty texts overlap nothing. Items too short for every mask overlap
    where all their tokens stand in a row.
    Rows that share an id (null too) give one row, and so do items. Items without an id
    are left out. fixed: see base.numbered.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = numbered(texts, "row", fixed)
    found = leaks(rows.select("row", "text"), prepared(benchmark, item_col, item_text, broadcast_seeds))
    named = by_row(rows.select("id", "row"), settled(found), "inner")
    order = F.struct("b.score", "b.matches", "b.shorter", "b.earlier", "b.sooner", (-F.col("n")).alias("n"))
    best = named.groupBy("id", "item").agg(F.max(order).alias("b"))
    length = -F.col("b.shorter")
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.col("b.matches").cast("long").alias("matched"),
        length.cast("long").alias("length"),
        (-F.col("b.n")).cast("long").alias("item_tokens"),
        (F.col("b.matches") / length).alias("similarity"),
        (-F.col("b.earlier")).cast("long").alias("item_from"),
        (-F.col("b.earlier") - F.col("b.sooner")).cast("long").alias("doc_from"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS, fixed: bool = False) -> DataFrame:
    """The documents that overlap no benchmark item, with their columns; each row is judged by its own text, whatever its id.

    Two reads of the documents; texts are not shuffled unless more of them overlap
    the benchmark than base.BROADCAST_ROWS.
    """
    given = docs if fixed else settled(docs)
    source, inner = renamed(given)
    rows = numbered(source, "row", True)
    found = settled(leaks(rows.select("row", F.col(inner[text_col]).alias("text")), prepared(benchmark, item_col, item_text, broadcast_seeds)).select("row").distinct())
    return by_row(rows, found, "left_anti").select(*[F.col(inner[c]).alias(c) for c in docs.columns])
