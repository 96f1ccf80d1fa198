"""Alignment of two tokenizers over a corpus: which tokens cover the same bytes, and how often.

Both tokenizers cut the same bytes, so one cut's pieces overlap the other's in as many
places as there are boundaries of either: links. Where both have a boundary a group
ends. Over the whole corpus links are counted by pair of ids, and each id of the second
tokenizer has its best partners, those of the highest count.

A text is cut once. Its links, summed by pair, are kept with those of the other texts
of its chunk, in one packed array for every stripe of ids of the second side (id modulo
STRIPES, so that frequent ids, which have low numbers, are spread out). A stripe's
counts are a dense matrix, stripe's ids times all ids of the first side: packed arrays
stream through the task that owns it and are added in place. Stripes are further cut by
salts of chunks, so frequent ids don't make long tasks; the salts' matrices are added
up, and row maxima give the best. Scoring sends the counts, nonzero cells alone, to
where links of the same stripes are dealt, ahead of them in the order of sorting.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessio.llm.base import bounded_batches, numbered, renamed, settled, text_of
from accessio.llm.tokens import PIECE, byte_symbols

STRIPES = 512
#: Groups of stripes that are scored together; a task holds the nonzero counts of one.
GROUPS = 32
#: Bytes of packed links for a group's salt, about; more input makes more salts.
SALT_BYTES = 64 << 20
SALTS = 4
#: Tasks that add up the salts' matrices.
ADDERS = 64
#: Links after which a chunk of documents ends.
LINKS = 1 << 20
OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


#: Runs of white space from this length on are cut by the vocabulary's own library: the quicker one's pattern runs out of stack in longer ones.
BLANKS = 100_000


class Side:
    """A tokenizer's ids as bytes, their lengths, and their numbers as written in a group, before another and at an end."""

    def __init__(self, pieces: list[bytes], inner: str, last: str):
        self.pieces = pieces
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.written = np.array([f"{i}{end}" for end in (inner, last) for i in range(len(pieces))], dtype=object)


class Cutters:
    """Both tokenizers, made from their files' bytes.

    A plain byte-level vocabulary goes through tiktoken, which gives the same ids
    (tested for every code point) in a quarter of the time.
    """

    def __init__(self, files: tuple[bytes, bytes]):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(files[0])
        self.first = Tokenizer.from_str(files[0].decode("utf-8"))
        self.first.no_padding()
        self.first.no_truncation()
        self.first.encode_special_tokens = True  # their strings in a text are plain text
        byte = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        pieces = [b""] * self.first.get_vocab_size(with_added_tokens=True)
        for piece, i in spec["model"]["vocab"].items():
            pieces[i] = piece.encode("utf-8") if piece in special else bytes(byte[c] for c in piece)
        ranks = {pieces[i]: i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        joined = [a + b for a, b in (m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"])]
        in_order = [spec["model"]["vocab"][p] for p in joined]
        before = spec["pre_tokenizer"]
        plain = spec.get("normalizer") is None and before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and in_order == sorted(in_order)
        self.quick = tiktoken.Encoding("first", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}) if plain else None
        self.blanks = re.compile(rf"\s{{{BLANKS}}}").search
        self.a = Side(pieces, ",", "|")
        self.second = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        count = self.second.get_piece_size()
        self.b = Side([bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i in range(count) for p in (self.second.id_to_piece(i),)], ",", ";")

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Ids of both sides and the bytes they cover, or None if a side's bytes aren't the text's."""
        whole = " " + text
        if self.quick is None or len(text) >= BLANKS and self.blanks(whole):
            a = np.array(self.first.encode(whole, add_special_tokens=False).ids, np.int64)
        else:
            a = self.quick.encode_to_numpy(whole, disallowed_special=()).astype(np.int64)
        b = self.second.encode(text, num_threads=1)
        data = whole.encode("utf-8")
        if b"".join(map(self.b.pieces.__getitem__, b)) != data or b"".join(map(self.a.pieces.__getitem__, a.tolist())) != data:
            return None
        return a, np.array(b, np.int64), len(data)

    def aligned(self, text: str) -> tuple[tuple, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256), the distinct pairs as b * (ids of a) + a, and their links."""
        cut = self.cut(text) if text else None
        if cut is None:
            return (0, 0, 0, 0, ""), np.empty(0, np.int64), np.empty(0, np.int64)
        a, b, size = cut
        ended = np.zeros((2, size + 1), bool)
        ended[0, np.cumsum(self.a.length[a])] = True
        ended[1, np.cumsum(self.b.length[b])] = True
        ends = np.flatnonzero(ended[0] | ended[1])  # a link ends at each
        of_a, of_b = ended[:, ends]
        both = of_a & of_b
        codes, links = np.unique(b[np.cumsum(of_b) - of_b] * len(self.a.pieces) + a[np.cumsum(of_a) - of_a], return_counts=True)
        group = np.cumsum(both) - both
        group_a, group_b, groups = group[of_a], group[of_b], int(group[-1]) + 1
        # a group's tokens of a, then its tokens of b
        until_a, until_b = (np.cumsum(np.bincount(g, minlength=groups)) for g in (group_a, group_b))
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.r_[0, until_b][group_a]] = self.a.written[a + both[of_a] * len(self.a.pieces)]
        words[np.arange(len(b)) + until_a[group_b]] = self.b.written[b + both[of_b] * len(self.b.pieces)]
        digest = hashlib.sha256("".join(words.tolist())[:-1].encode("ascii")).hexdigest()
        return (len(a), len(b), groups, len(ends), digest), codes, links


#: The tokenizers used last in this worker, by their broadcast's value.
_latest: list[tuple[tuple[bytes, bytes], Cutters]] = []


def _cutters(files: tuple[bytes, bytes]) -> Cutters:
    if not _latest or _latest[0][0] is not files:
        _latest[:] = [(files, Cutters(files))]
    return _latest[0][1]


# Packed links: codes inside the stripe, upwards; each one's document in the chunk; its links -------


def packed(code: np.ndarray, doc: np.ndarray, links: np.ndarray) -> bytes:
    steps = np.diff(code, prepend=0)
    return zlib.compress(b"".join([len(code).to_bytes(8, "little"), steps.astype("<u8").tobytes(), doc.astype("<u4").tobytes(), links.astype("<u8").tobytes()]), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(blob)
    n = int.from_bytes(data[:8], "little")
    return (
        np.cumsum(np.frombuffer(data, "<i8", n, 8)),
        np.frombuffer(data, "<u4", n, 8 + 8 * n).astype(np.int64),
        np.frombuffer(data, "<i8", n, 8 + 12 * n),
    )


_DOC = "chunk long, doc int, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, blob binary"


def _cut(rows: DataFrame, files: Broadcast) -> DataFrame:
    """row, id, text -> a row for each document (stripe null), and one for each chunk and stripe with its packed links."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters = _cutters(files.value)
        width = len(cutters.a.pieces)
        schema = None

        def ended(chunk, ids, facts, codes, links):
            n = len(facts)
            columns = list(zip(*facts, strict=True))
            made = [pa.array([chunk] * n, pa.int64()), pa.array(range(n), pa.int32()), ids]
            made += [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, schema=schema)
            code = np.concatenate(codes)
            if not len(code):
                return
            doc, number = np.repeat(np.arange(n), [len(c) for c in codes]), np.concatenate(links)
            b, a = np.divmod(code, width)
            stripe, inside = b % STRIPES, b // STRIPES * width + a
            order = np.argsort(stripe * (inside.max() + 1) + inside, kind="stable")
            stripe, inside, doc, number = (x[order] for x in (stripe, inside, doc, number))
            starts = np.flatnonzero(np.diff(stripe, prepend=-1))
            blobs = [packed(inside[i:j], doc[i:j], number[i:j]) for i, j in zip(starts, [*starts[1:], len(stripe)], strict=True)]
            m = len(blobs)
            none = [pa.nulls(m, f.type) for f in schema]
            none[0], none[8], none[9] = pa.array([chunk] * m, pa.int64()), pa.array(stripe[starts], pa.int32()), pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_arrays(none, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [("chunk", pa.int64()), ("doc", pa.int32()), ("id", batch.schema.field("id").type), *[(c, pa.int64()) for c in OUTPUTS[:4]], ("groups_sha256", pa.string()), ("stripe", pa.int32()), ("blob", pa.binary())]
            schema = pa.schema(kinds)
            rows_, ids = batch.column("row").to_pylist(), batch.column("id")
            at, held, facts, codes, links = 0, 0, [], [], []
            for k, text in enumerate(batch.column("text")):
                fact, code, number = cutters.aligned(text.as_py())
                facts.append(fact)
                codes.append(code)
                links.append(number)
                held += len(code)
                if held >= LINKS or k == batch.num_rows - 1:
                    yield from ended(rows_[at], ids.slice(at, k + 1 - at), facts, codes, links)
                    at, held, facts, codes, links = k + 1, 0, [], [], []

    return rows.mapInArrow(of, _DOC.format(id=rows.schema["id"].dataType.simpleString()))


def _counted(links: DataFrame, ids_a: int, ids_b: int, salts: int) -> DataFrame:
    """stripe, blob: the packed counts of each stripe's pairs (best: 1 if the pair's count is its b id's highest)."""
    rows_of = -(-ids_b // STRIPES)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, now = np.zeros(rows_of * ids_a, np.int64), None

        def flushed() -> pd.DataFrame:
            code = np.flatnonzero(block)
            out = pd.DataFrame({"stripe": [now[0]], "blob": [packed(code, np.zeros(len(code)), block[code])]})
            block[code] = 0
            return out

        for batch in batches:
            for stripe, salt, blob in zip(batch["stripe"], batch["salt"], batch["blob"], strict=True):
                if now is not None and now != (stripe, salt):
                    yield flushed()
                now = (stripe, salt)
                code, _, number = unpacked(blob)
                np.add.at(block, code, number)
        if now is not None:
            yield flushed()

    def total(parts: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(rows_of * ids_a, np.int64)
        for blob in parts["blob"]:
            code, _, number = unpacked(blob)
            block[code] += number
        code = np.flatnonzero(block)
        best = block.reshape(rows_of, ids_a).max(axis=1)
        return pd.DataFrame({"stripe": parts["stripe"][:1], "blob": [packed(code, block[code] == best[code // ids_a], block[code])]})

    salted = links.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    parts = salted.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").select("stripe", "salt", "blob").mapInPandas(add, "stripe int, blob binary")
    # a number of its own, as small partial counts would else be put together in one task
    return parts.repartition(ADDERS, "stripe").groupBy("stripe").applyInPandas(total, "stripe int, blob binary")


def _rated(links: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """chunk, doc, n_best, count_sum."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, known, chunk = None, {}, None
        doc = best = total = None

        def flushed() -> pd.DataFrame:
            n = int(doc.max()) + 1
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], doc, best)
            np.add.at(sums[1], doc, total)
            return pd.DataFrame({"chunk": [chunk], "blob": [zlib.compress(sums.tobytes(), 1)]})

        for batch in batches:
            for g, salt, counted, c, stripe, blob in batch[["group", "salt", "counted", "chunk", "stripe", "blob"]].itertuples(index=False):
                if (g, salt) != group or c != chunk:
                    if doc is not None:
                        yield flushed()
                    doc = None
                if (g, salt) != group:
                    group, known = (g, salt), {}
                if counted:
                    known[stripe] = unpacked(blob)
                    continue
                chunk = c
                code, docs, number = unpacked(blob)
                codes, highest, many = known[stripe]
                at = np.searchsorted(codes, code)
                found = docs, number * highest[at], number * many[at]
                doc, best, total = found if doc is None else (np.r_[x, y] for x, y in zip((doc, best, total), found, strict=True))
        if doc is not None:
            yield flushed()

    def summed(parts: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(zlib.decompress(b), np.int64).reshape(2, -1) for b in parts["blob"]]
        sums = np.zeros((2, max(x.shape[1] for x in each)), np.int64)
        for x in each:
            sums[:, : x.shape[1]] += x
        return pd.DataFrame({"chunk": parts["chunk"].iloc[0], "doc": np.arange(sums.shape[1], dtype=np.int32), "n_best": sums[0], "count_sum": sums[1]})

    grouped = (F.col("stripe") % GROUPS).alias("group")
    ahead = counts.select(grouped, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("counted"), F.lit(0).cast("long").alias("chunk"), "stripe", "blob")
    behind = links.select(grouped, F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"), F.lit(False).alias("counted"), "chunk", "stripe", "blob")
    dealt = ahead.unionByName(behind).repartition("group", "salt").sortWithinPartitions("group", "salt", F.desc("counted"), "chunk")
    return dealt.mapInPandas(of, "chunk long, blob binary").groupBy("chunk").applyInPandas(summed, "chunk long, doc int, n_best long, count_sum long")


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", fixed: bool = False) -> DataFrame:
    """Every row's id with the columns OUTPUTS.

    first: a byte-level vocabulary (.json) that gets the text behind a blank, second:
    a piece model (.model), which adds that blank itself. Both files are read on the driver.
    Null and empty texts, and those whose bytes a side doesn't give back (a second side that
    rewrites characters), have no tokens: zeros and an empty digest. Repeated rows
    count each. One read of the documents; fixed: see base.numbered.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(first, "rb") as a, open(second, "rb") as b:
        contents = a.read(), b.read()
    cutters = Cutters(contents)
    files = spark.sparkContext.broadcast(contents)
    source, inner = renamed(docs)
    rows = numbered(source, "row", fixed).select("row", F.col(inner[id_col]).alias("id"), text_of(inner[text_col]).alias("text"))
    made = settled(_cut(rows, files))
    links = made.where("stripe IS NOT NULL").select("chunk", "stripe", "blob")
    size = links.agg(F.sum(F.octet_length("blob")).alias("n")).first().n or 0
    salts = max(SALTS, -(-size // (GROUPS * SALT_BYTES)))
    counts = settled(_counted(links, len(cutters.a.pieces), len(cutters.b.pieces), salts))
    rated = _rated(links, counts, salts)
    done = made.where("stripe IS NULL").join(rated, ["chunk", "doc"], "left")
    return done.select(F.col("id").alias(id_col), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) if c in ("n_best", "count_sum") else F.col(c) for c in OUTPUTS])


def pair_counts(docs: DataFrame, first: str, second: str, text_col: str = "text") -> DataFrame:
    """a, b, n, best: the ids that overlap anywhere in the texts, how often, and whether a is a best partner of b."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(first, "rb") as a, open(second, "rb") as b:
        contents = a.read(), b.read()
    cutters = Cutters(contents)
    width = len(cutters.a.pieces)
    source, inner = renamed(docs)
    rows = source.select(F.monotonically_increasing_id().alias("row"), F.lit(0).alias("id"), text_of(inner[text_col]).alias("text"))
    links = settled(_cut(rows, spark.sparkContext.broadcast(contents))).where("stripe IS NOT NULL").select("chunk", "stripe", "blob")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stripe, blob in zip(batch["stripe"], batch["blob"], strict=True):
                code, best, n = unpacked(blob)
                yield pd.DataFrame({"a": code % width, "b": code // width * STRIPES + stripe, "n": n, "best": best == 1})

    return _counted(links, width, len(cutters.b.pieces), SALTS).mapInPandas(listed, "a long, b long, n long, best boolean")
