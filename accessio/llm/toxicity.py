"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over all letter triples that occur in both as
subsequences, the decay to the power of the length they span in each: letters
may stand apart, so gapped spellings and inserted characters stay close to the
word they disguise. Landmark words give every word a finite vector (Nyström), a
linear support vector machine is trained on those vectors, and since the kernel's
features are explicit here (triples of 32 letter codes), the landmarks fold into
one weight a triple and scoring a word costs the same for any number of them.

Words begin with a mark that counts as a letter, so how a word starts has a say
beside the letters that it has anywhere.

Labels mark whole documents. A clean document's words are all clean; a toxic
document's words count as toxic where they stand in more toxic documents than
chance explains, or start as several of their words do and those of clean
documents don't, as do the same words with a letter put in. Each round adds the
clean words that the machine scores highest. A document scores what its highest
words score together, each up to a cap, as one word of a long clean document can
start like an insult by chance; and less the more words it has, as chance grows with
them. Machines that have not seen a document judge it: their scores of all learning
documents tell how many words count, one to three, what the cap is, what length
takes off, and at which cut the sum becomes the threshold's probability.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from accessio.llm.base import bounded_batches, carried, renamed, text_of

OUTPUTS = ("score", "predicted")
THRESHOLD = 0.7
#: Labelled documents of each class that are learnt from, at most; chosen by a hash of their ids.
SAMPLE = 3000
#: Characters of each class that are learnt from, at most: documents count in the order of that hash while they fit.
SAMPLE_CHARS = 32 << 20
DECAY = 0.6
LETTERS = 32
#: Longer words are read in windows of this length that overlap by half.
WINDOW = 16
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 128, 64
#: Landmarks are less alike than this.
APART = 0.8
#: Clean words that training starts with, that each round of hard examples adds, and among which it looks for them.
CLEAN_START, CLEAN_MORE, CLEAN_POOL = 8000, 2000, 100_000
ROUNDS = 3
#: Gradient steps of a round.
STEPS = 800
#: Parts of the learning documents, each judged by a machine that learnt from the others.
PARTS = 4
#: Toxic words whose disguises are learnt with them.
DISGUISED = 100
#: Lengths of word starts that are tested for ties, and in how many words of a document one must stand.
STARTS, IN_WORDS = range(3, 9), 2
#: A document is judged by so many of its highest words at most; each counts FLOOR at least and one of CAPS at most.
HIGHEST, FLOOR, CAPS = 3, -0.2, (1.5, 2.0, 3.0)
#: What a document loses for each factor of e that it has more different words than SHORT.
LENGTHS, SHORT = (0.0, 0.2, 0.4, 0.7), 30
#: Clean documents above the cut weigh so much against toxic ones.
CLEAN_COST = 2.0
#: Words whose scores a Python worker remembers; it starts anew when full.
MEMO = 800_000

_word = re.compile(r"[^\W\d_]+")
_spaced = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?!\S)")
_not_letter = re.compile(r"[\W\d_]+")


def units(text: str) -> set[str]:
    """The words of a text: runs of letters, tokens without what stands between their letters, and spaced-out letters."""
    low = text.lower()
    found = set(_word.findall(low))
    found.update(_not_letter.sub("", t) for t in set(low.split()) if not t.isalpha())
    found.update("".join(run.split()) for run in _spaced.findall(low))
    out = set()
    for w in found:
        if len(w) <= WINDOW:
            if len(w) > 2:
                out.add(w)
        else:
            out.update(w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2))
    return out


#: Stands before every word.
START = "\x02"


def codes(words: list[str]) -> np.ndarray:
    """Letter codes of words of one length: a to z, five classes of others, the mark."""
    points = np.array([list(map(ord, w)) for w in words], dtype=np.int64)
    plain = points - ord("a")
    return np.where((plain >= 0) & (plain < 26), plain, np.where(points == ord(START), 31, 26 + points % 5))


def marked(words: Iterable[str]) -> list[str]:
    return [START + w for w in words]


def triples(n: int) -> list[tuple[int, int, int]]:
    return [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]


def self_kernel(c: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself, by the usual recursion over prefixes. c: [word, letter]"""
    rows, n = c.shape
    same = [[c[:, i] == c[:, j] for j in range(n)] for i in range(n)]
    inner = [[np.ones(rows)] * (n + 1) for _ in range(n + 1)]
    square = DECAY**2
    for _ in range(2):
        outer = [[np.zeros(rows)] * (n + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            along = np.zeros(rows)
            for j in range(1, n + 1):
                along = DECAY * along + same[i - 1][j - 1] * (square * inner[i - 1][j - 1])
                outer[i][j] = DECAY * outer[i - 1][j] + along
        inner = outer
    return sum(same[i][j] * (square * inner[i][j]) for i in range(n) for j in range(n))


def by_length(words: Iterable[str]) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    yield from groups.values()


def embedded(word: str) -> np.ndarray:
    """The word's explicit kernel features, of length 1."""
    c = codes([word])[0]
    out = np.zeros(LETTERS**3)
    for i, j, k in triples(len(word)):
        out[c[i] << 10 | c[j] << 5 | c[k]] += DECAY ** (k - i + 1)
    return out / np.linalg.norm(out)


def against(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Products of the words' normed features with weights [triple, column]."""
    out = np.empty((len(words), weights.shape[1]), np.float32)
    at = {w: i for i, w in enumerate(words)}
    for group in by_length(words):
        for low in range(0, len(group), 8192):
            part = group[low : low + 8192]
            c = codes(part)
            total = np.zeros((len(part), weights.shape[1]), np.float32)
            for i, j, k in triples(c.shape[1]):
                total += weights[c[:, i] << 10 | c[:, j] << 5 | c[:, k]] * np.float32(DECAY ** (k - i + 1))
            out[[at[w] for w in part]] = total / np.sqrt(self_kernel(c))[:, None]
    return out


@dataclass(frozen=True)
class Model:
    """A word's margin is its normed features times weights plus bias; slope and intercept make the sum of a document's `count` highest, each up to cap, less what its length takes off, a probability."""

    weights: np.ndarray
    bias: float
    count: int
    slope: float
    intercept: float
    cap: float = np.inf
    length: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        return against(marked(words), self.weights[:, None])[:, 0] + self.bias if words else np.empty(0)

    def probability(self, margins: Iterable[float], words: int) -> float:
        """Of a document with these word margins and so many different words."""
        x = np.minimum(highest(margins)[: self.count], self.cap).sum() - self.length * longer(words)
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -30, 30))))


def highest(margins: Iterable[float]) -> np.ndarray:
    """The HIGHEST highest margins in descending order, FLOOR where they are lower or words are missing."""
    top = heapq.nlargest(HIGHEST, margins)
    return np.maximum(np.array(top + [FLOOR] * (HIGHEST - len(top))), FLOOR)


def longer(words: int | np.ndarray) -> np.ndarray:
    """How much longer a document is than a short one, as a logarithm."""
    return np.log(np.maximum(words, SHORT) / SHORT)


def support_vectors(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, steps: int = STEPS) -> np.ndarray:
    """A linear machine with squared hinge loss, by accelerated gradient steps; the last column of z is 1."""
    u = v = np.zeros(z.shape[1], z.dtype)
    weight = (weight / weight.sum()).astype(z.dtype)
    y = y.astype(z.dtype)
    rate = 1 / (2 * float((weight[:, None] * z * z).sum()) + ridge)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v))
        step = v + rate * (2 * z.T @ (weight * y * slack) - ridge * v)
        u, v = step, step + t / (t + 3) * (step - u)
    return u


def distinct_bags(bags: list[tuple[set[str], int]]) -> list[tuple[set[str], int]]:
    """One of each group of near copies, whose shared words would pass for evidence: no two share three min-hashes of a band."""
    seen: set[tuple] = set()
    out = []
    for words, label in bags:
        if words:
            hashes = np.array([zlib.crc32(w.encode("utf-8")) for w in words], dtype=np.uint64)
            least = [int(((hashes * np.uint64(2 * k + 3) + np.uint64(k * 7919)) * np.uint64(2654435761 + 2 * k) % np.uint64(4294967291)).min()) for k in range(24)]
            bands = {(k, *least[k : k + 3]) for k in range(0, 24, 3)}
            if bands & seen:
                continue
            seen |= bands
        out.append((words, label))
    return out


def ties(a: Counter, b: Counter, toxic: int, clean: int) -> dict[str, float]:
    """Words that stand in more toxic documents than chance explains, with how clearly: likelihood ratio beyond a bound for that many words."""
    bound = 2 * np.log(max(len(a), 2)) + 6
    share = toxic / (toxic + clean)
    out = {}
    for w, n in a.items():
        m = b[w]
        if n < 2 or n * clean <= 4 * m * toxic:
            continue
        g = 2 * (n * np.log(n / ((n + m) * share)) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0))
        if g > bound:
            out[w] = float(g)
    return out


def starts(words: Iterable[str]) -> Counter:
    """Word starts by the number of words of one document that begin so."""
    return Counter(w[:n] for w in words for n in STARTS if n <= len(w))


def tied_starts(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """Starts that stand in IN_WORDS words of more toxic documents than chance explains."""
    a, b = (Counter(s for words in group for s, n in starts(words).items() if n >= IN_WORDS) for group in (toxic, clean))
    return ties(a, b, len(toxic), len(clean))


def disguises(word: str, rng: np.random.Generator, count: int = 4) -> list[str]:
    """The word with one letter put in, at random places."""
    out = []
    for _ in range(count):
        at = int(rng.integers(1, max(2, len(word))))
        out.append((word[:at] + chr(97 + int(rng.integers(26))) + word[at:])[:WINDOW])
    return out


def doubled(word: str) -> list[str]:
    return [(word[: i + 1] + word[i:])[:WINDOW] for i in range(len(word))]


Bags = list[tuple[set[str], int]]


def judged(bags: Bags, part: np.ndarray, k: int, seed: int) -> tuple[Model | None, np.ndarray, np.ndarray]:
    """The machine that learns from all parts but the k-th (from all, if there is none), that part's documents and their highest margins."""
    own = np.flatnonzero(part == k)
    judge = machine([b for b, i in zip(bags, part, strict=True) if i != k], seed) or machine(bags, seed)
    top = np.empty((len(own), HIGHEST))
    if judge is not None and len(own):
        every = sorted({w for i in own for w in bags[i][0]})
        margin = dict(zip(every, judge.margins(every).tolist(), strict=True))
        for row, i in enumerate(own):
            top[row] = highest(margin[w] for w in bags[i][0])
    return judge, own, top


def train(bags: Bags, spark: SparkSession, seed: int = 5) -> Model | None:
    """bags: the words and label of each document. None unless both labels occur.

    The machine for all documents and those for the parts learn in a task each.
    """
    bags = distinct_bags(bags)
    if {label for _, label in bags} != {0, 1}:
        return None
    part = np.random.default_rng(seed).permutation(len(bags)) % PARTS  # labels can follow a pattern of the ids
    sent = spark.sparkContext.broadcast((bags, part))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                judge, own, top = judged(*sent.value, k, seed)
                weights = judge.weights.tobytes() if judge is not None and k == PARTS else b""
                yield pd.DataFrame({"k": [k], "weights": [weights], "bias": [judge.bias if judge is not None else 0.0], "own": [own.tolist()], "top": [top.ravel().tolist()]})

    found = {r.k: r for r in spark.range(0, PARTS + 1, 1, PARTS + 1).mapInPandas(learn, "k long, weights binary, bias double, own array<long>, top array<double>").collect()}
    sent.destroy()
    whole = found[PARTS]
    if not whole["weights"]:
        return None
    top = np.empty((len(bags), HIGHEST))
    for k in range(PARTS):
        top[found[k].own] = np.array(found[k].top).reshape(-1, HIGHEST)
    y, more = np.array([float(label) for _, label in bags]), longer(np.array([len(words) for words, _ in bags]))
    cuts = {(cap, n, length): calibrated(np.minimum(top[:, :n], cap).sum(axis=1) - length * more, y) for cap in CAPS for n in range(1, HIGHEST + 1) for length in LENGTHS}
    cap, count, length = max(cuts, key=lambda c: (cuts[c][0], -c[1], c[0], -c[2]))
    return Model(np.frombuffer(whole["weights"], np.float32), whole["bias"], count, *cuts[cap, count, length][1:], cap, length)


def machine(bags: Bags, seed: int) -> Model | None:
    """A machine for words, not yet for documents. None unless both labels occur."""
    toxic, clean = [w for w, y in bags if y == 1], [w for w, y in bags if y == 0]
    if not toxic or not clean:
        return None
    a, b = Counter(w for words in toxic for w in words), Counter(w for words in clean for w in words)
    tied = ties(a, b, len(toxic), len(clean))
    begun = tied_starts(toxic, clean)
    for w, n in a.items():
        g = max((begun.get(w[:k], 0.0) for k in STARTS), default=0.0)
        if g and w not in tied and n * len(clean) > 4 * b[w] * len(toxic):
            tied[w] = g * n / len(toxic)
    by_tie = sorted(tied, key=lambda w: (-tied[w], w))
    if not by_tie:  # too few documents for any word to stand out: take those of toxic documents alone
        by_tie = sorted((w for w in a if not b[w]), key=lambda w: (-a[w], w))[:TOXIC_LANDMARKS]
    landmarks: list[str] = []
    basis = np.zeros((LETTERS**3, TOXIC_LANDMARKS + CLEAN_LANDMARKS), np.float32)

    def add(candidates: list[str], most: int) -> None:
        end = len(landmarks) + most
        for w in candidates[: 4 * most]:
            e = embedded(START + w)
            if len(landmarks) < end and (not landmarks or (e @ basis[:, : len(landmarks)]).max() < APART):
                basis[:, len(landmarks)] = e
                landmarks.append(w)

    add(by_tie, TOXIC_LANDMARKS)
    add([w for w, _ in sorted(b.items(), key=lambda x: (-x[1], x[0]))], CLEAN_LANDMARKS)
    if not landmarks:
        return None
    basis = basis[:, : len(landmarks)]
    values, vectors = np.linalg.eigh((basis.T @ basis).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    rng = np.random.default_rng(seed)
    every_clean = sorted(b)
    order = rng.permutation(len(every_clean))
    chosen = {every_clean[i] for i in order[:CLEAN_START]}
    pool = [every_clean[i] for i in order[:CLEAN_POOL]]
    positive = {w: a[w] for w in by_tie}
    for _ in range(ROUNDS):
        negative = sorted(chosen - positive.keys())
        disguised = sorted(({d for w in by_tie[:DISGUISED] for d in disguises(w, rng)} | {d for w in by_tie[:DISGUISED] for d in doubled(w)}) - positive.keys() - b.keys())
        words = [*positive, *disguised, *negative]
        z = np.column_stack([against(marked(words), basis) @ whiten, np.ones(len(words))])
        z = np.vstack([z, np.append(np.zeros(z.shape[1] - 1), 1.0)]).astype(np.float32)  # a word like no landmark is clean
        y = np.array([1.0] * (len(positive) + len(disguised)) + [-1.0] * (len(negative) + 1))
        mass = np.sqrt([*positive.values(), *[1.0] * len(disguised)])
        weight = np.concatenate([mass / mass.sum(), np.full(len(negative), 1 / max(1, len(negative))), [0.1]])
        u = support_vectors(z, y, weight)
        model = Model((basis @ (whiten @ u[:-1])).astype(np.float32), float(u[-1]), 1, 1.0, 0.0)
        chosen |= {pool[i] for i in np.argsort(-model.margins(pool), kind="stable")[:CLEAN_MORE]}
    return model


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Gain at the best cut between the classes, and slope and intercept of a probability that reaches THRESHOLD there.

    The best cut has the most toxic documents above it less the clean ones times
    CLEAN_COST; of equal cuts the one in the widest gap, two thirds of the way down
    it, which leaves room for disguises. Labels that no word explains thus don't
    blur the probability, as they would a plain logistic fit.
    """
    order = np.argsort(-x, kind="stable")
    high = x[order]
    gain = np.cumsum(np.where(y[order] > 0, 1.0, -CLEAN_COST))
    gap = np.append(high[:-1] - high[1:], 1.0)
    ends = np.flatnonzero(gap > 0)
    best = max(ends, key=lambda i: (gain[i], gap[i]))
    cut = high[best] - gap[best] * 2 / 3
    above = high[: best + 1]
    slope = 4 / max(0.25, float(above.mean()) - cut)
    return float(gain[best]), slope, float(np.log(THRESHOLD / (1 - THRESHOLD))) - slope * float(cut)


class Scorer:
    """Document scores, with the margins of words met before at hand."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def scores(self, texts: Iterable[str]) -> list[float]:
        bags = [units(t) for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        fresh = list({w for words in bags for w in words} - self.known.keys())
        self.known.update(zip(fresh, self.model.margins(fresh).tolist(), strict=True))
        known = self.known
        return [self.model.probability(map(known.__getitem__, words), len(words)) for words in bags]


#: The scorer of the model used last in this worker.
_latest: list[Scorer] = []


def learnt(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from at most `sample` labelled documents of each class.

    Documents labelled twice count as toxic if any label says so; labels without
    an id or value are left out, and of rows that share an id the least text counts.
    Of the sample only words reach the driver, those of SAMPLE_CHARS characters of
    each class at most.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    order = F.xxhash64(F.lit("toxicity"), "id")
    chosen = [known.where(F.col("label") == y).orderBy(order, "id").limit(sample) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 x sample rows
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(few, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    upto = Window.partitionBy("label").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over 2 x sample rows
    given = given.withColumn("upto", F.sum(F.char_length("text")).over(upto)).where(F.col("upto") <= SAMPLE_CHARS)

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].astype(str), "label": batch["label"].astype("int64"), "words": [" ".join(sorted(units(t))) for t in batch["text"]]})

    rows = given.mapInPandas(words_of, "id string, label long, words string").collect()
    rows.sort(key=lambda r: (r.id, r.words), reverse=True)
    bags = []
    while rows:  # a row's text goes as its words come
        row = rows.pop()
        bags.append((set(map(sys.intern, row.words.split(" "))) - {""}, int(row.label)))  # one string a word, not a document
    return train(bags, docs.sparkSession)


def score_column(docs: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    if model is None:
        return F.lit(0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not _latest or _latest[0].model is not sent.value:
            _latest[:] = [Scorer(sent.value)]
        scorer = _latest[0]
        for texts in batches:
            yield pd.Series(scorer.scores(texts), dtype="float64")

    return scored(text_of(text_col))


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with score (0 to 1, higher: more likely toxic) and predicted (1 from the threshold on).

    Null and empty texts get the score of a text without words. Without a model
    (no labels of one class) every score is 0. Equal texts have equal scores.
    """
    bounded_batches(docs.sparkSession)
    rows, inner = renamed(docs)
    scored = rows.withColumn("score", score_column(rows, model, inner[text_col]))
    return scored.select(*[F.col(inner[c]).alias(c) for c in carried(docs, OUTPUTS)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from. Null ids are not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is under the threshold, with their columns."""
    bounded_batches(docs.sparkSession)
    rows, inner = renamed(docs)
    scored = rows.withColumn("score", score_column(rows, model, inner[text_col]))
    return scored.where(F.col("score") < threshold).select(*[F.col(inner[c]).alias(c) for c in docs.columns])
