"""Near-duplicates by word shingles: SuperMinHash signatures, bands, verification on full sets, components.

A document is the set of its distinct two-word shingles, as 64-bit hashes.
Documents with equal sets are one class from here on. A class has a SuperMinHash
signature: every shingle draws a random permutation of the signature's places, gives
its k-th place the value k + r with a random fraction r, and a place keeps the least
value it is given. One shingle's values hit different places, so estimates vary less
than with independent hashes; and once every place holds less than k, no shingle's
k-th draw can matter, so long documents stop after a draw or two a shingle.

ROWS places in a row make a band. Classes alike in a band form a bucket, whose first
class is its hub. Links are searched in two rounds, so that a bucket of any size costs
in proportion to it:

* all classes of a bucket are compared with its hub, on their full sets; links make
  components;
* two classes of a bucket that are in different components then differ by what each
  differs from the hub: |x ^ y| = |x ^ h| + |y ^ h| - 2 |(x ^ h) & (y ^ h)|. One of them
  isn't linked to the hub, so it differs much from it, and a link asks for many shared
  differences. Rare ones come first in each class's differences; a pair that links
  must share one among the first few of both (prefix filter), far enough in front
  (position filter). Pairs that do are compared on their full sets.

Pairs within a component are never made; what a bucket's classes would link beyond
is in the component already. No pair of a bucket is lost; two classes at similarity 0.8 share no band with
probability (1 - 0.8^4)^40 = 7e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from accessio.llm.base import bounded_batches, by_row, numbered, renamed, settled, text_of, with_key
from accessio.llm.components import components

SIMILARITY = 80  # in hundredths
ROWS, BANDS = 4, 40
PLACES = ROWS * BANDS
#: Shingles that draw at once.
CHUNK = 4096
#: Word hashes that a Python worker remembers; it starts anew when full.
MEMO = 1_000_000
#: Rows of one key that meet one row of the other side in a join.
SLICE = 1000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_DRAWS = np.arange(1, PLACES + 1, dtype=np.uint64) * _STEP


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Hashes(dict):
    """Word -> XXH64."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = Hashes()


def shingles(text: str) -> np.ndarray:
    """The distinct two-word shingles as sorted hashes; a text of one word is one shingle, without words there is none. A-Z count as lower case."""
    words = text.encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII white space only
    found = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(found) > 1:
        found = mixed(found[:-1] * _STEP + found[1:])
    return np.unique(found)


def signature(elements: np.ndarray) -> np.ndarray:
    """The least draw of each place, k in the upper and r in the lower 32 bits; elements: not empty."""
    least = np.full(PLACES, 1 << 62, np.int64)
    for at in range(0, len(elements), CHUNK):
        part = elements[at : at + CHUNK]
        places = None  # each element's permutation, as far as it is drawn
        for k in range(PLACES):
            if int(least.max()) < k << 32:
                break
            z = mixed(part + _DRAWS[k])
            turn = k + ((z & _LOW) * np.uint64(PLACES - k) >> np.uint64(32)).astype(np.int64)
            if k == 0:
                first = place = turn
            else:
                if places is None:
                    places, every = np.tile(np.arange(PLACES, dtype=np.int16), (len(part), 1)), np.arange(len(part))
                    places[every, first] = 0
                place = places[every, turn].astype(np.int64)
                places[every, turn] = places[:, k]
            np.minimum.at(least, place, (z >> np.uint64(32)).astype(np.int64) + (k << 32))
    return least


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; keys of different bands differ."""
    rows = signed.view(np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for j in range(ROWS):
        keys = mixed(keys ^ rows[:, j])
    return keys.view(np.int64)


def _signed(text: Column) -> Column:
    """n, d0, d1 (the set's 128-bit digest), keys (null without shingles) of a column of texts."""

    @pandas_udf("n long, d0 long, d1 long, keys array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t) for t in texts]
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]).reshape(-1, 2)
            yield pd.DataFrame({"n": [len(s) for s in sets], "d0": digests[:, 0], "d1": digests[:, 1], "keys": [band_keys(signature(s)) if len(s) else None for s in sets]})

    return of(text)


def _sets(text: Column) -> Column:
    @pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)

    return of(text)


def stars(bands: DataFrame) -> DataFrame:
    """u, nu, v, nv, slice: every hub with each other class of its buckets, once.

    bands: key, node, n. One exchange by ranges of (key, node), which cuts large
    buckets; slice numbers the thousands of a task's part of a bucket.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = first = None
        before, opened, part = 0, True, TaskContext.get().partitionId() << 32
        for batch in batches:
            if not len(batch):
                continue
            keys, nodes, sizes = (batch[c].to_numpy() for c in ("key", "node", "n"))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
            place = np.arange(len(keys)) - starts[run]
            u, nu = nodes[starts][run], sizes[starts][run]
            if first is not None and keys[0] == key:  # the run goes on
                head = run == 0
                u, nu = np.where(head, first[0], u), np.where(head, first[1], nu)
                place = place + before * head
            edge = np.zeros(len(keys), bool)
            if opened:
                edge[0], opened = True, False
            others = (u != nodes) | edge
            yield pd.DataFrame({"key": keys, "u": u, "nu": nu, "v": nodes, "nv": sizes, "slice": part + place // SLICE, "edge": edge})[others]
            before = int(place[-1]) + 1
            key, first = keys[-1], (u[-1], nu[-1])
        if first is not None:
            yield pd.DataFrame({"key": [key], "u": [first[0]], "nu": [first[1]], "v": [first[0]], "nv": [first[1]], "slice": [part], "edge": [True]})

    parted = bands.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    found = settled(parted.mapInPandas(of, "key long, u long, nu long, v long, nv long, slice long, edge boolean"))
    # buckets at the edges of tasks, two a task at most: the first class of all is the hub in every task
    hubs = found.where("edge").groupBy("key").agg(F.min(F.struct("u", "nu")).alias("hub"))
    whole = found.join(F.broadcast(settled(hubs)), "key", "left").withColumns({c: F.coalesce(f"hub.{c}", c) for c in ("u", "nu")})
    return whole.where("u != v").groupBy("u", "nu", "v", "nv").agg(F.min("slice").alias("slice"))


def _near_sizes(a: str, b: str) -> Column:
    return (100 * F.least(a, b)) >= (SIMILARITY * F.greatest(a, b))


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v, slice; distinct) with both sets, own and theirs.

    A slice of u's partners meets a copy of u's set, so no set has more than a slice's pairs in one place.
    """
    theirs = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("theirs")), "v")
    own = pairs.select("u", "slice").distinct().join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("own")), "u")
    return theirs.join(own, ["u", "slice"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: the pairs whose full sets are similar enough."""
    both = F.size(F.array_intersect("own", "theirs"))
    every = F.size("own") + F.size("theirs") - both
    return _met(pairs, sets).where(100 * both >= SIMILARITY * every).select("u", "v")


#: Sets x and y are similar enough just if MORE * |x ^ y| <= LESS * (|x| + |y|).
LESS, MORE = 100 - SIMILARITY, 100 + SIMILARITY


def _differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, nu, nv, root, nd, unique, shared: how v differs from its hub u.

    nd: differences; unique: those of no other class at this hub; shared: the rest,
    the rarest first. A shingle that v lacks is told from one it adds by its bits.
    """
    added, lacking = F.array_except("theirs", "own"), F.transform(F.array_except("own", "theirs"), lambda x: F.bitwise_not(x))
    apart = settled(_met(groups, sets).select("u", "v", "nu", "nv", "root", F.concat(added, lacking).alias("d")))
    tokens = apart.select("u", "v", F.explode("d").alias("token"))
    common = tokens.groupBy("u", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    sorted_ = tokens.join(common, ["u", "token"]).groupBy("u", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "token"))), lambda x: x["token"]).alias("shared"))
    # both sides hold a row for each pair
    return apart.select("u", "v", "nu", "nv", "root", F.size("d").alias("nd")).join(sorted_, ["u", "v"]).withColumn("unique", F.col("nd") - F.size("shared"))


def _rest(pairs: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, slice: pairs of classes with a common hub, from different components, that may be similar enough.

    pairs: the stars; roots: vertex, root.
    """
    rooted = settled(pairs.join(roots, pairs["v"] == roots["vertex"], "left").select("u", "nu", "v", "nv", "slice", F.coalesce("root", "v").alias("root")))
    several = rooted.groupBy("u").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("u")
    each = _differences(with_key(rooted, settled(several), ["u"], F.col("v")), sets)
    tied = MORE * F.col("nd") <= LESS * (F.col("nu") + F.col("nv"))
    # y is at most nv / similarity large, and no further from the hub than a link
    near = ~tied & (MORE * F.col("nd") <= LESS * (F.col("nv") + F.col("nu") + 2 * F.ceil(100 * F.col("nv") / SIMILARITY)))

    def prefix(shared: Column) -> Column:
        """How many of the first differences must hold one that is shared, if so many (in units of 1 / 2 MORE) are."""
        return F.col("nd") - F.greatest(F.lit(1), F.ceil(shared / (2 * MORE) - 1e-9)) + 1

    half = prefix(MORE * F.col("nd") + LESS * (F.col("nu") - F.col("nv")))  # whoever it meets, one of both isn't linked to the hub
    longer = prefix(MORE * F.col("nd") - LESS * (F.col("nv") + F.col("nu")) + MORE - LESS)  # against one that is
    sized = each.withColumns({"tied": tied, "half": half, "most": F.when(near, F.greatest(half, longer)).otherwise(half)})
    first = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("most") - F.col("unique")).cast("int"))
    placed = settled(sized.select("u", "v", "nv", "root", "nd", "tied", "half", "unique", F.posexplode(first).alias("place", "token")).withColumn("place", F.col("place") + F.col("unique")).drop("unique"))
    x = placed.where("NOT tied").select("u", "token", *[F.col(c).alias(f"x_{c}") for c in ("v", "nv", "root", "nd", "half", "place")])
    y = placed.where("place < half").select("u", "token", *[F.col(c).alias(f"y_{c}") for c in ("v", "nv", "root", "nd", "tied", "place")])
    once = F.col("y_tied") | ((F.col("x_place") < F.col("x_half")) & (F.col("x_v") < F.col("y_v")))
    still = F.least(F.col("x_nd") - F.col("x_place"), F.col("y_nd") - F.col("y_place"))
    enough = 2 * MORE * still >= MORE * (F.col("x_nd") + F.col("y_nd")) - LESS * (F.col("x_nv") + F.col("y_nv"))
    found = settled(x.join(y, ["u", "token"]).where((F.col("x_root") != F.col("y_root")) & once & enough & _near_sizes("x_nv", "y_nv")).select(F.least("x_v", "y_v").alias("u"), F.greatest("x_v", "y_v").alias("v")).distinct())
    counts = settled(found.groupBy("u").agg(F.floor((F.count(F.lit(1)) - 1) / SLICE).alias("slices")))
    return with_key(found, counts, ["u"], F.col("v")).select("u", "v", F.pmod(F.xxhash64("v"), F.col("slices") + 1).alias("slice"))


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: row, id, text, numbered for good. Gives each row's row, id, n, d0, d1; and d0, d1, component_id, first of the classes that aren't one row alone."""
    bounded_batches(rows.sparkSession)
    marked = settled(rows.select("row", "id", _signed(F.col("text")).alias("set")).select("row", "id", "set.*"))
    ranked = F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("id"), F.col("row").alias("row"))
    classes = settled(marked.where("n > 0").groupBy("d0", "d1").agg(F.min("row").alias("node"), F.min(ranked).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    pairs = settled(stars(classes.select(F.explode("keys").alias("key"), "node", "n")))
    wanted = settled(pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).distinct())
    sets = settled(by_row(rows.select("row", "text"), wanted, "left_semi").select(F.col("row").alias("node"), _sets(F.col("text")).alias("shingles")))
    links = settled(linked(pairs.where(_near_sizes("nu", "nv")), sets))
    more = settled(linked(settled(_rest(pairs, components(links), sets)), sets))
    found = components(links.unionByName(more))
    roots = found.unionByName(found.select(F.col("root").alias("vertex"), "root").distinct())
    rooted = classes.join(roots, classes["node"] == roots["vertex"], "left").select("d0", "d1", "first", "copies", F.coalesce("root", "node").alias("root"), (F.col("root").isNotNull() | (F.col("copies") > 1)).alias("several"))
    several = settled(rooted.where("several").drop("several"))
    least = settled(several.groupBy("root").agg(F.min("first").alias("least")))
    return marked.drop("keys"), settled(with_key(several, least, ["root"], F.col("d0")).select("d0", "d1", F.col("least.id").alias("component_id"), F.col("least.row").alias("kept_row")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fixed: bool = False) -> DataFrame:
    """The rows' ids with n_shingles, component_id (smallest id of the linked rows, nulls aside) and kept (the id is the component's).

    Linked are rows whose shingle sets have a similarity of 0.8 at least. Null and
    empty texts have no shingles and are linked with nothing. Repeated rows are kept;
    of equal ids all are marked kept. fixed: see base.numbered.
    """
    source, inner = renamed(docs)
    rows = numbered(source, "row", fixed).select("row", F.col(inner[id_col]).alias("id"), text_of(inner[text_col]).alias("text"))
    marked, groups = _groups(rows)
    found = with_key(marked, groups, ["d0", "d1"], F.col("row"), "left")
    least = F.when(F.col("kept_row").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), least.alias("component_id"), F.col("id").eqNullSafe(least).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fixed: bool = False) -> DataFrame:
    """One row of each group of near_duplicates, with its columns: that of the smallest id, nulls last, of equal ids the one read first."""
    source, inner = renamed(docs if fixed else settled(docs))
    rows = numbered(source, "row", True)
    marked, groups = _groups(rows.select("row", F.col(inner[id_col]).alias("id"), text_of(inner[text_col]).alias("text")))
    others = with_key(marked, groups, ["d0", "d1"], F.col("row")).where("row != kept_row").select("row")
    return by_row(rows, settled(others), "left_anti").select(*[F.col(inner[c]).alias(c) for c in docs.columns])
