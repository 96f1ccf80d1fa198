"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the tokens on both its sides, by a softmax in three
steps. Words are hashed to BUCKETS numbers whose counts over the whole corpus make
CLASSES: the most frequent buckets are classes of their own, the others share the
rest, by mass. The network gives the class of a token from the classes of SIDE
tokens before and after it (embeddings by place, a hidden layer, a softmax). In a
shared class a second softmax over the same hidden layer gives one of its PARTS
parts, most of them one bucket, as they are cut by mass too. Inside a part a bucket
has its share of the corpus counts, and inside a bucket a word its own, by the
word's true count. A document's score is the sum of its tokens' log conditional
probabilities.

The counts of all words are a distributed table that grows with the corpus. The
most frequent words are sent to the workers; all others are joined to the table by
a shuffle, so no two words share a count.

Training is one pass over all documents in ROUNDS rounds, each over a share of
them. A hash of id and text deals documents to rounds and, inside a round, to shards
of about SHARD tokens: in a round each shard starts from the same parameters and
learns in numpy by masked prediction, its documents in the order of that hash and
every token masked once; the shards' parameters are averaged by the tokens they saw,
FAN of them at a time in a tree, and the next round goes on from the average. So
what is learnt follows from the documents alone, not from how a table is split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from accessio.llm.base import bounded_batches, settled, text_of

BUCKETS = 1 << 15
CLASSES = 128
#: Classes that are single buckets.
SINGLE = 96
#: Parts that a shared class is cut into.
PARTS = 128
SIDE = 2
HIDDEN = 16
RATE = 0.1
STEP = 256
ROUNDS = 4
#: Tokens that learn one after another, about; more input makes more shards.
SHARD = 1 << 21
#: Tokens whose order is drawn at once.
LESSON = 1 << 17
#: Shards whose parameters are averaged at once.
FAN = 16
SEED = 11
#: Tokens scored at once, and those whose classes' probabilities are.
CHUNK, BLOCK = 1 << 14, 1 << 8
#: Words whose counts are sent to the workers, at most; the others' are joined.
FREQUENT = 1 << 18
#: Words that a Python worker holds before it hands on their counts.
HELD = 1 << 21
SHAPES = {"embed": (2 * SIDE, CLASSES + 1, HIDDEN), "hidden": (HIDDEN,), "out": (HIDDEN, CLASSES), "bias": (CLASSES,), "inner": (CLASSES - SINGLE, HIDDEN, PARTS), "inner_bias": (CLASSES - SINGLE, PARTS)}


def buckets_of(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % BUCKETS).astype(np.int32)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and where each text's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    ends = (offsets[1:] - offsets[0]).astype(np.int64)
    filled = np.asarray(pc.binary_length(words)) > 0  # white space at an end leaves an empty one
    if not filled.all():
        words, ends = words.filter(pa.array(filled)), np.concatenate([[0], np.cumsum(filled)])[ends]
    return words, ends


def distinct_words(texts: pd.Series) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(the different words of all texts, the number of each word's, where each text's words end)"""
    words, ends = words_of(pa.array(texts, pa.large_string()))
    found = words.dictionary_encode()
    return found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), ends


def cut(values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [values[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]


class Codes:
    """Codes of words: their places among the frequent ones, or their number plus the bucket."""

    def __init__(self, frequent: list[bytes]):
        self.place = dict(zip(frequent, range(len(frequent)), strict=True)).get
        self.number = len(frequent)

    def of(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """The codes of all texts' words, where each text's end, and each text's words that aren't frequent."""
        words, which, ends = distinct_words(texts)
        codes = np.fromiter(map(self.place, words, repeat(-1)), np.int32, len(words))
        others = np.flatnonzero(codes < 0)
        codes[others] = self.number + buckets_of([words[k] for k in others.tolist()])
        codes = codes[which]
        rare = np.flatnonzero(codes >= self.number)
        named = [words[k] for k in which[rare].tolist()]
        until = np.searchsorted(rare, ends).tolist()
        return codes, ends, [named[i:j] for i, j in zip([0, *until[:-1]], until, strict=False)]


@dataclass(frozen=True)
class Vocabulary:
    """Class of each bucket, the log share of the bucket in its class, the log count of its tokens, its part of the class (0 in a class of one bucket), the log share in the part, and that of each part in its class."""

    class_of: np.ndarray
    log_share: np.ndarray
    log_class: np.ndarray
    log_count: np.ndarray
    part_of: np.ndarray
    log_in_part: np.ndarray
    log_part: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Vocabulary:
        order = np.lexsort((np.arange(BUCKETS), -counts))
        class_of = np.empty(BUCKETS, np.int16)
        class_of[order[:SINGLE]] = np.arange(SINGLE)
        rest = order[SINGLE:]
        mass = np.cumsum(counts[rest] + 1.0)
        class_of[rest] = SINGLE + np.minimum((mass * (CLASSES - SINGLE) / mass[-1]).astype(int), CLASSES - SINGLE - 1)
        smooth = counts + 1.0
        by_class = np.bincount(class_of, smooth, CLASSES)
        by_class = np.maximum(by_class, 1e-9)
        share = smooth / by_class[class_of]
        part_of = np.zeros(BUCKETS, np.int16)
        for c in range(SINGLE, CLASSES):  # by mass, the most frequent first
            own = rest[class_of[rest] == c]
            part_of[own] = np.minimum((np.cumsum(share[own]) - share[own] / 2) * PARTS, PARTS - 1).astype(np.int16)
        part = np.where(class_of < SINGLE, 0, (class_of - SINGLE) * PARTS + part_of)
        by_part = np.bincount(part[class_of >= SINGLE], share[class_of >= SINGLE], (CLASSES - SINGLE) * PARTS)
        in_part = np.where(class_of < SINGLE, 1.0, share / np.maximum(by_part, 1e-30)[part])
        # a part without buckets keeps next to no probability
        return cls(
            class_of, np.log(share).astype(np.float32), np.log(by_class / by_class.sum()).astype(np.float32), np.log(np.maximum(counts, 1)),
            part_of, np.log(in_part).astype(np.float32), np.log(np.maximum(by_part, 1e-12)).astype(np.float32).reshape(CLASSES - SINGLE, PARTS),
        )


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    made = {name: (rng.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in SHAPES.items()}
    made["hidden"][:] = 0
    made["bias"][:] = vocabulary.log_class
    made["inner"][:] = 0
    made["inner_bias"][:] = vocabulary.log_part
    return made


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[name].ravel() for name in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = np.asarray(values[at : at + n], np.float32).reshape(shape)
        at += n
    return out


def windows(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(targets, contexts [token, place]) of all tokens of some documents; beyond their ends stands a class of its own."""
    gap = np.full(SIDE, CLASSES, np.int16)
    line = np.concatenate([x for c in classes for x in (gap, c)] + [gap])
    centre = np.flatnonzero(line != CLASSES)
    places = [p for p in range(-SIDE, SIDE + 1) if p]
    return line[centre], np.stack([line[centre + p] for p in places], axis=1)


def shuffled(n: int) -> np.ndarray:
    return np.random.default_rng(n).permutation(n)


def lessons(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some documents in the order to learn from, each masked once."""
    target, context = windows(classes)
    order = shuffled(len(target))
    return target[order], context[order]


def rows_of(context: np.ndarray) -> np.ndarray:
    """Rows of the places' embeddings one below the other, [place, token]."""
    return np.add(context.T, np.arange(2 * SIDE)[:, None] * (CLASSES + 1), dtype=np.intp, order="C")


def hidden_at(net: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    embed = net["embed"].reshape(-1, HIDDEN)
    hidden = embed.take(rows[0], axis=0)
    for own in rows[1:]:
        hidden += embed.take(own, axis=0)
    hidden += net["hidden"]
    return np.tanh(hidden, out=hidden)


def hidden_of(net: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    return hidden_at(net, rows_of(context))


#: Logits up to this size need no shift before they are exponentiated.
SAFE = 60.0


def highest(weights: np.ndarray, bias: np.ndarray) -> float:
    """A bound of the logits that any hidden layer gives, as it lies between -1 and 1."""
    return float((np.abs(weights).sum(axis=0) + np.abs(bias)).max())


def scaled(logits: np.ndarray, bound: float, spent: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exponentials of logits less a shift, their sums, the shift), by row. spent: in place of the logits."""
    top = 0.0 if bound < SAFE else logits.max(axis=1)
    weights = np.exp(logits if bound < SAFE else logits - top[:, None], out=logits if spent else None)
    return weights, weights @ np.ones(weights.shape[1], weights.dtype), top


def forward(net: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden layer, log probabilities of the classes)"""
    hidden = hidden_of(net, context)
    logits = hidden @ net["out"] + net["bias"]
    _, total, top = scaled(logits, highest(net["out"], net["bias"]))
    return hidden, logits - (top + np.log(total))[:, None]


def column(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Where one column a row stands in values.ravel()."""
    return np.arange(0, values.size, values.shape[1]) + chosen


def chosen_logs(logits: np.ndarray, chosen: np.ndarray, bound: float) -> np.ndarray:
    """The log probability of one column a row; the logits are spent."""
    own = logits.ravel()[column(logits, chosen)]
    _, total, top = scaled(logits, bound, spent=True)
    return own - top - np.log(total)


def errors(logits: np.ndarray, chosen: np.ndarray, bound: float) -> np.ndarray:
    """The gradient of the rows' negative log probabilities by their logits, times RATE; the logits are spent."""
    weights, total, _ = scaled(logits, bound, spent=True)
    weights *= (RATE / STEP * 16 / total)[:, None]
    weights.ravel()[column(weights, chosen)] -= RATE / STEP * 16
    return weights


def learn(net: dict[str, np.ndarray], target: np.ndarray, context: np.ndarray) -> None:
    """One pass of gradient steps over the given tokens, in place."""
    rows, embed = rows_of(context), net["embed"].reshape(-1, HIDDEN)
    hot = np.zeros((len(embed), STEP), np.float32)  # the context's classes, by place
    marks, ones, steps = hot.ravel(), np.ones(STEP, np.float32), np.arange(STEP)
    for at in range(0, len(target), STEP):
        t, c = target[at : at + STEP], rows[:, at : at + STEP]
        n = len(t)
        if at % (64 * STEP) == 0:  # a step changes it by next to nothing
            bound = highest(net["out"], net["bias"]) + 1
        hidden = hidden_at(net, c)
        logits = hidden @ net["out"]
        logits += net["bias"]
        wrong = errors(logits, t, bound)
        back = (wrong @ net["out"].T) * (1 - hidden**2)
        net["out"] -= hidden.T @ wrong
        net["bias"] -= ones[:n] @ wrong
        net["hidden"] -= ones[:n] @ back
        marked = c * STEP + steps[:n]
        marks[marked] = 1
        embed -= hot[:, :n] @ back
        marks[marked] = 0


def by_class(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place among the shared classes, tokens of that class), for those that occur."""
    order = np.argsort(target, kind="stable")
    ends = np.searchsorted(target[order], np.arange(SINGLE, CLASSES + 1))
    for c in np.flatnonzero(np.diff(ends)):
        yield int(c), order[ends[c] : ends[c + 1]]


def part_logits(net: dict[str, np.ndarray], c: int, hidden: np.ndarray) -> np.ndarray:
    logits = hidden @ net["inner"][c]
    logits += net["inner_bias"][c]
    return logits


def learn_parts(net: dict[str, np.ndarray], target: np.ndarray, part: np.ndarray, context: np.ndarray) -> None:
    """One pass of gradient steps of the second softmax over the given tokens, in place; the hidden layer is the first one's."""
    for c, own in by_class(target):
        every, chosen = hidden_of(net, context[own]), part[own]
        bound = highest(net["inner"][c], net["inner_bias"][c])
        for at in range(0, len(own), STEP):
            hidden = every[at : at + STEP]
            wrong = errors(part_logits(net, c, hidden), chosen[at : at + STEP], bound + 1 + at / STEP / 64)
            net["inner"][c] -= hidden.T @ wrong
            net["inner_bias"][c] -= wrong.sum(axis=0)


def token_logs(net: dict[str, np.ndarray], target: np.ndarray, context: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of tokens' classes, and of their parts if given."""
    out = np.empty(len(target), np.float32)
    bound, inner = highest(net["out"], net["bias"]), [highest(w, b) for w, b in zip(net["inner"], net["inner_bias"], strict=True)]
    for at in range(0, len(target), CHUNK):
        here = slice(at, at + CHUNK)
        t, own = target[here], out[here]
        hidden = hidden_of(net, context[here])
        for low in range(0, len(t), BLOCK):
            block = slice(low, low + BLOCK)
            logits = hidden[block] @ net["out"]
            logits += net["bias"]
            own[block] = chosen_logs(logits, t[block], bound)
        if part is not None:
            chosen = part[here]
            for c, mine in by_class(t):
                own[mine] += chosen_logs(part_logits(net, c, hidden[mine]), chosen[mine], inner[c])
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """word, n: the tokens of every word over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            values, n = pa.chunked_array(held).value_counts().flatten()
            return pa.RecordBatch.from_arrays([values.cast(pa.binary()), n], ["word", "n"])

        held, size = [], 0
        for batch in batches:
            held.append(words_of(batch.column(0))[0])
            size += len(held[-1])
            if size > HELD:
                yield handed()
                held, size = [], 0
        if size:
            yield handed()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket_counts(counts: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for row in counts.groupBy((F.crc32("word") % BUCKETS).cast("int").alias("bucket")).agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def frequent_words(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """(words, counts) of at most FREQUENT words, none less frequent than one left out."""
    level = F.floor(F.log2("n") * 8)
    least, kept = None, 0
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        kept += row.words
        if kept > FREQUENT:
            break
        least = row.level
    rows = [] if least is None else counts.where(level >= least).collect()
    return [bytes(r.word) for r in rows], np.array([r.n for r in rows], np.float64)


def averaged(learnt: DataFrame) -> np.ndarray | None:
    """The mean of values (arrays of floats, as bytes) by weight over all shards, FAN at a time, in the order of their numbers; null without rows."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        weight = float(rows["weight"].sum())
        total = sum(np.frombuffer(v, np.float32) * np.float64(w) for v, w in zip(rows["values"], rows["weight"], strict=True))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1] // FAN, "values": [(total / weight).astype(np.float32).tobytes()], "weight": [weight]})

    learnt = settled(learnt)
    left = learnt.agg(F.max("shard")).first()[0]
    while left:
        learnt, left = learnt.groupBy(F.floor(F.col("shard") / FAN)).applyInPandas(mean, "shard long, values binary, weight double"), left // FAN
    found = learnt.collect()  # one row
    return np.frombuffer(found[0]["values"], np.float32) if found else None


def coded(texts: DataFrame, tokens: int) -> DataFrame:
    """round, shard, key, codes: the documents' buckets, dealt out and in the order in which each shard learns them. texts: id, text."""
    shards = max(1, round(tokens / ROUNDS / SHARD))
    key = F.xxhash64("id", "text")

    @pandas_udf("binary")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            words, which, ends = distinct_words(batch)
            yield pd.Series([c.tobytes() for c in cut(buckets_of(words).astype("<u2")[which], ends)], dtype=object)

    dealt = texts.select(key.alias("key"), F.pmod("key", F.lit(ROUNDS)).cast("int").alias("round"), F.pmod(F.shiftright("key", 8), F.lit(shards)).alias("shard"), codes(F.col("text")).alias("codes"))
    return dealt.where(F.octet_length("codes") > 0).repartition("round", "shard").sortWithinPartitions("round", "shard", "key", "codes")


def train(texts: DataFrame, vocabulary: Vocabulary, tokens: int) -> dict[str, np.ndarray]:
    """The network after one pass over all texts. texts: id, text; tokens: how many there are."""
    net, dealt = initial(vocabulary), settled(coded(texts, tokens))
    for number in range(ROUNDS):
        sent = texts.sparkSession.sparkContext.broadcast((vocabulary, net))

        def fit(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known, start = sent.value
            shard, own, seen, held, size = None, None, 0, [], 0

            def lesson() -> None:
                target, context = lessons([known.class_of[b] for b in held])
                learn(own, target, context)
                part = known.part_of[np.concatenate(held)]
                learn_parts(own, target, part[shuffled(len(part))], context)

            def ended() -> pd.DataFrame:
                if held:
                    lesson()
                return pd.DataFrame({"shard": [shard], "values": [flat(own).astype(np.float32).tobytes()], "weight": [float(seen)]})

            for batch in batches:
                for s, codes in zip(batch["shard"], batch["codes"], strict=True):
                    if s != shard:
                        if shard is not None:
                            yield ended()
                        shard, own, seen, held, size = s, {k: v.copy() for k, v in start.items()}, 0, [], 0
                    held.append(np.frombuffer(codes, "<u2").astype(np.int32))
                    size, seen = size + len(held[-1]), seen + len(held[-1])
                    if size >= LESSON:
                        lesson()
                        held, size = [], 0
            if shard is not None:
                yield ended()

        found = averaged(dealt.where(F.col("round") == number).select("shard", "codes").mapInPandas(fit, "shard long, values binary, weight double"))
        net = net if found is None else shaped(found)
        sent.unpersist()
    return net


def learnt(texts: DataFrame) -> tuple[Vocabulary, dict[str, np.ndarray], DataFrame]:
    """Vocabulary, network and word counts of a corpus. texts: id, text."""
    counts = settled(count_words(texts))
    buckets = bucket_counts(counts)
    vocabulary = Vocabulary.from_counts(buckets)
    return vocabulary, train(texts, vocabulary, int(buckets.sum())), counts


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_tokens, log_likelihood, per_token.

    log_likelihood sums the tokens' log conditional probabilities; per_token is
    their mean. Texts without tokens (null too) have log_likelihood 0 and per_token
    null. Tokens are runs of anything but ASCII white space, A-Z in lower case.
    Repeated rows are scored each.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    vocabulary, net, counts = learnt(texts)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, net, *frequent_words(counts)))
    kind = texts.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, model, frequent, times = sent.value
        memo = Codes(frequent)
        bucket_of = np.concatenate([buckets_of(frequent), np.arange(BUCKETS)])
        class_of, part_of = known.class_of[bucket_of], known.part_of[bucket_of]
        # without the words' own counts where these are joined
        share = (known.log_in_part - known.log_count)[bucket_of] + np.concatenate([np.log(times), np.zeros(BUCKETS)])
        for batch in batches:
            every, ends, rare = memo.of(batch["text"])
            target, context = windows(cut(class_of[every], ends))
            logs = np.concatenate([[0.0], np.cumsum(token_logs(model, target, context, part_of[every]) + share[every], dtype=np.float64)])
            n = np.diff(ends, prepend=0)
            yield pd.DataFrame({"id": batch["id"], "n_tokens": n, "log_likelihood": np.where(n > 0, logs[ends] - logs[ends - n], 0.0), "rare": rare})

    partly = settled(texts.mapInPandas(score, f"id {kind}, n_tokens long, log_likelihood double, rare array<binary>").withColumn("row", F.monotonically_increasing_id()))
    joined = partly.select("row", F.explode("rare").alias("word")).join(counts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.log("n")).alias("rest"))
    scored = partly.drop("rare").join(joined, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("rest", F.lit(0.0)))
    return scored.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "log_likelihood",
        F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token"),
    )
