"""Near-duplicates by SimHash, found with the general pigeonhole principle.

A document's fingerprint has a bit set where over half the hashes of its word
shingles have it. Fingerprints within RADIUS bits are linked, and linked ones
form components. Copies share a fingerprint, so distinct fingerprints are what
is searched.

The 64 bits are divided into partitions, bits that vary together in the same
one. For thresholds t_1 .. t_m that add up to RADIUS - m + 1, two fingerprints
within RADIUS agree up to t_i bits in some partition i (-1: not even asked).
Every fingerprint chooses its own thresholds by dynamic programming on the
candidates and probes it must expect, which come from histograms over all
fingerprints, and probes the partitions' values within them. Candidates are
verified on all bits.

Values of a partition that more than CROWD fingerprints share are not compared in
pairs. Two fingerprints are within 2 bits just if some 64-bit value is within 1
of both, so each fingerprint there names the values within 1 of it outside the
partition, and those that name the same value (65 at most) are linked. That finds
the same links in work that grows with the crowd, not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from accessio.llm.base import bounded_batches, by_row, numbered, renamed, settled, text_of, with_key
from accessio.llm.components import components

BITS = 64
RADIUS = 2
WORDS = 3
SEED = 42
CROWD = 48
#: A probe's cost, against 1 for a candidate.
PROBE = 0.5
MOST_PARTITIONS = 4
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
OUTPUTS = ("fingerprint", "component_id")


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint, unsigned. A-Z count as lower case; without words it is 0."""
    found = text.encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprints of a column of texts without nulls, as signed numbers."""

    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


# The search ---------------------------------------------------------------------------------------


def bits_of(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def together(nodes: DataFrame) -> np.ndarray:
    """How often bits i and j are both set, over all fingerprints."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = bits_of(batch["fp"].to_numpy()).astype(np.float32)
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(BITS * BITS), "n": total.ravel().astype(np.int64)})

    sums = nodes.select("fp").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for row in sums:
        out[row.cell] = row.n
    return out.reshape(BITS, BITS)


def correlated_partitions(both: np.ndarray, total: int, count: int) -> list[list[int]]:
    """Bits dealt to partitions of near-equal width, each grown by the bit most correlated with it."""
    share = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tied = np.abs((both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    left, out = set(range(BITS)), []
    for k in range(count):
        width = BITS // count + (k < BITS % count)
        rest = sorted(left)
        first = rest[int(tied[np.ix_(rest, rest)].max(axis=1).argmax())]
        part = [first]
        left.discard(first)
        while len(part) < width:
            nearest = max(sorted(left), key=lambda b: tied[b, part].sum())
            part.append(nearest)
            left.discard(nearest)
        out.append(part)
    return out


def packed(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of the given bits, the first lowest. x: bits_of(...)"""
    return x[:, bits].astype(np.int64) @ (1 << np.arange(len(bits), dtype=np.int64))


def chunks_of(partition: list[int]) -> list[list[int]]:
    """Runs of 8 bits at most, small enough for histograms."""
    n = math.ceil(len(partition) / 8)
    return [partition[i::n] for i in range(n)]


def histograms(nodes: DataFrame, partitions: list[list[int]]) -> list[list[np.ndarray]]:
    """For each chunk of each partition: fingerprints by value, over all fingerprints."""
    chunks = [c for p in partitions for c in chunks_of(p)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(chunks), 256), np.int64)
        for batch in batches:
            x = bits_of(batch["fp"].to_numpy())
            for k, chunk in enumerate(chunks):
                totals[k] += np.bincount(packed(x, chunk), minlength=256)
        k, value = np.nonzero(totals)
        yield pd.DataFrame({"chunk": k.astype(np.int32), "value": value.astype(np.int32), "n": totals[k, value]})

    sums = nodes.select("fp").mapInPandas(count, "chunk int, value int, n long").groupBy("chunk", "value").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros((len(chunks), 256))
    for row in sums:
        flat[row.chunk, row.value] = row.n
    out, at = [], 0
    for p in partitions:
        out.append([flat[at + i] for i in range(len(chunks_of(p)))])
        at += len(out[-1])
    return out


def expected(x: np.ndarray, partition: list[int], counts: list[np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that should lie within 0 and within 1 bits in this partition, chunks taken as independent."""
    same, near = np.ones(len(x)), np.zeros(len(x))
    for chunk, by_value in zip(chunks_of(partition), counts, strict=True):
        share = by_value / max(total, 1)
        beside = sum(share[np.arange(256) ^ (1 << j)] for j in range(len(chunk)))
        value = packed(x, chunk)
        near = near * share[value] + same * beside[value]
        same = same * share[value]
    return total * same, total * (same + near)


def thresholds(costs: np.ndarray, total: int) -> np.ndarray:
    """The cheapest thresholds (-1, 0 or 1 a partition) that add up to total.

    costs: [row, partition, threshold + 1]. Dynamic programming over partitions;
    a state is the sum so far.
    """
    rows, parts, _ = costs.shape
    best = {0: np.zeros(rows)}
    choices: list[dict[int, np.ndarray]] = []
    for i in range(parts):
        after: dict[int, np.ndarray] = {}
        chosen: dict[int, np.ndarray] = {}
        for s, cost in best.items():
            for t in (-1, 0, 1):
                now = cost + costs[:, i, t + 1]
                if s + t not in after:
                    after[s + t], chosen[s + t] = now, np.full(rows, t, np.int8)
                else:
                    better = now < after[s + t]
                    after[s + t] = np.where(better, now, after[s + t])
                    chosen[s + t] = np.where(better, np.int8(t), chosen[s + t])
        best = after
        choices.append(chosen)
    out, state = np.empty((rows, parts), np.int8), np.full(rows, total)
    for i in reversed(range(parts)):
        for s, t in choices[i].items():
            here = state == s
            out[here, i] = t[here]
        state = state - out[:, i]
    return out


def probes(nodes: DataFrame, partitions: list[list[int]], counts: list[list[np.ndarray]], total: int) -> DataFrame:
    """part, key, fp, near, ask, flip: where each fingerprint is kept (flip false) and what else it asks for.

    near is fp with its partition's value replaced by key. ask: this row is a probe.
    """
    goal = RADIUS - len(partitions) + 1

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            x = bits_of(fp)
            costs = np.empty((len(fp), len(partitions), 3))
            for i, p in enumerate(partitions):
                same, near = expected(x, p, counts[i], total)
                costs[:, i, 0], costs[:, i, 1], costs[:, i, 2] = 0, PROBE + same, PROBE * (1 + len(p)) + near
            t = thresholds(costs, goal)
            for i, p in enumerate(partitions):
                key = packed(x, p)
                yield pd.DataFrame({"part": np.int32(i), "key": key, "fp": fp, "near": fp, "ask": t[:, i] >= 0, "flip": False})
                wide = t[:, i] == 1
                for j, bit in enumerate(p):
                    if wide.any():
                        turned = fp[wide] ^ np.uint64(1 << bit).astype(np.int64)
                        yield pd.DataFrame({"part": np.int32(i), "key": key[wide] ^ (1 << j), "fp": fp[wide], "near": turned, "ask": True, "flip": True})

    return nodes.select("fp").mapInPandas(of, "part int, key long, fp long, near long, ask boolean, flip boolean")


def links(nodes: DataFrame, total: int) -> DataFrame:
    """u, v: links between fingerprints with the same components as all pairs within RADIUS.

    nodes: fp, distinct; total: their number. Links inside crowds go through the
    least fingerprint around a value; all others are the pairs themselves.
    """
    count = int(min(MOST_PARTITIONS, max(2, BITS // (math.log2(max(total, 2)) + 2))))
    partitions = correlated_partitions(together(nodes), total, count)
    rows = settled(probes(nodes, partitions, histograms(nodes, partitions), total))
    kept = rows.where("NOT flip").select("part", "key", "fp")
    crowds = settled(kept.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("part", "key"))
    asking = rows.where("ask").select("part", "key", F.col("fp").alias("u"))
    crowded = not crowds.isEmpty()
    if crowded:
        asking = asking.join(crowds, ["part", "key"], "left_anti")
    pairs = asking.join(kept, ["part", "key"]).where((F.col("u") != F.col("fp")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= RADIUS))
    found = pairs.select(F.greatest("u", "fp").alias("u"), F.least("u", "fp").alias("v")).distinct()
    if not crowded:
        return found
    outside = F.array(*[F.array(*[F.lit(_signed(1 << b)) for b in range(BITS) if b not in p]) for p in partitions])
    own = F.col("fp")
    around = F.concat(F.array(own), F.transform(F.get(outside, F.col("part")), lambda bit: own.bitwiseXOR(bit)))
    named = rows.join(crowds, ["part", "key"], "left_semi").select("fp", F.explode(F.when(F.col("flip"), F.array("near")).otherwise(around)).alias("value"))
    # at most 65 fingerprints lie within one bit of a value
    met = named.groupBy("value").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
    starred = met.select(F.explode("met").alias("u"), F.array_min("met").alias("v")).where("u != v").distinct()
    return found.unionByName(starred)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id, component_fp, row_key: one row a document.

    component_id is the smallest id of the component, nulls aside; component_fp
    its smallest fingerprint, which names it even where all ids are null; row_key
    the XXH64 of id and text, or the key given. Null and empty texts have fingerprint 0 and link
    like any other; texts of fewer than three words count as one shingle. Repeated
    rows are kept.
    """
    bounded_batches(docs.sparkSession)
    text = text_of(text_col)
    marked = settled(docs.select(F.col(id_col).alias("id"), (F.xxhash64(F.col(id_col), text) if key is None else key).alias("row_key"), fingerprints(text).alias("fp")))
    nodes = settled(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    found = components(links(nodes, nodes.count()))
    roots = found.unionByName(found.select(F.col("root").alias("vertex"), "root").distinct())
    # a row that is a component of its own needs no look at others
    rooted = settled(nodes.join(roots, nodes["fp"] == roots["vertex"], "left").where("root IS NOT NULL OR copies > 1").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = settled(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    shared = settled(with_key(rooted, named, ["root"], F.col("fp")).select("fp", "root", "component_id"))
    own = F.col("root").isNull()
    return with_key(marked, shared, ["fp"], F.struct("id", "row_key"), "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(own, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "fp").alias("component_fp"),
        "row_key",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fixed: bool = False) -> DataFrame:
    """One document of each component, with its columns: the one of smallest id, nulls last; of rows alike in id and text one.

    fixed: see base.numbered. Two reads of the documents; texts are not shuffled
    unless more rows go than base.BROADCAST_ROWS.
    """
    source, inner = renamed(docs if fixed else settled(docs))
    rows = numbered(source, "row", True)
    own = inner[id_col]
    key = F.struct(F.xxhash64(F.col(own), text_of(inner[text_col])).alias("hash"), F.col("row"))  # the hash makes the choice the same for any partitions
    groups = near_duplicates(rows, own, inner[text_col], key)
    order = F.struct(F.col(own).isNull().alias("nameless"), F.col(own).alias("id"), F.col("row_key").alias("key"))
    first = groups.groupBy("component_fp").agg(F.min(order).alias("first"))
    # by row, not by component, which may hold a third of all rows
    others = groups.select(F.col("row_key.row").alias("row")).join(first.select(F.col("first.key.row").alias("row")), "row", "left_anti")
    return by_row(rows, settled(others), "left_anti").select(*[F.col(inner[c]).alias(c) for c in docs.columns])
