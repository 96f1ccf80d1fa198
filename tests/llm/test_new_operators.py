"""SuperMinHash groups, importance resampling, token alignment: against brute force."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from accessio.llm import alignment, base, minhash, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], DOCS)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(n, seed, most=80):
    r = random.Random(seed)
    words = [a + b for a in "ka le mi no pu ra se ti vo wu".split() for b in "ba ce di fo gu he ji ko la mu".split()]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, most))) for _ in range(n)]


def edited(text, seed, changes):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


# SuperMinHash ------------------------------------------------------------------------------------


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def plain_groups(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)), i == least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def near_rows():
    base = prose(60, 1)
    long = prose(1, 2, 1)[0] + " " + " ".join(prose(12, 3))
    crowd = [edited(long, i, i % 40) for i in range(90)]  # from alike to apart
    small = ["", None, " \t", "One", "one", "ONE two", "one TWO", "one two three", "a b a b a b", "É é", "é É", "x\x1cy z", "w " * 3000]
    texts = [*base, *base[:15], *[edited(t, i, 2) for i, t in enumerate(base)], *crowd, *small, base[3].upper()]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base[5]), (None, "lonely text without any number"), (7, base[8])]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_near_duplicates(spark, few, monkeypatch):
    monkeypatch.setattr(base, "BROADCAST_ROWS", few)
    monkeypatch.setattr(minhash, "SLICE", 7)
    rows = near_rows()
    docs = documents(spark, rows).repartition(5).withColumn("Kept", F.lit(1)).withColumn("row", F.lit(2)).withColumn("n_shingles", F.lit(3))
    got = minhash.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_groups(rows)
    assert got[0].asDict().keys() == {"doc_id", "n_shingles", "component_id", "kept"}


def test_one_of_each_group(spark):
    rows = near_rows()
    docs = documents(spark, rows).withColumn("node", F.lit("mine"))
    kept = minhash.deduplicated(docs).collect()
    groups = plain_groups(rows)
    named = {g[2] for g in groups if g[1]} - {None}
    assert {r.doc_id for r in kept if plain_set(r.text)} - {None} == named
    assert len([r for r in kept if plain_set(r.text)]) == len(named) + 1  # and the one without a number
    assert len([r for r in kept if not plain_set(r.text)]) == 3 and kept[0].node == "mine"
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 == minhash.deduplicated(docs.limit(0)).count()


def plain_signature(elements):
    """The definition, one shingle and one draw after the other, without early stopping."""
    bits = (1 << 64) - 1
    least = [1 << 62] * minhash.PLACES
    for e in map(int, elements):
        places = list(range(minhash.PLACES))
        for k in range(minhash.PLACES):
            z = int(minhash.mixed(np.array([(e + 0x9E3779B97F4A7C15 * (k + 1)) & bits], np.uint64))[0])
            turn = k + ((z & 0xFFFFFFFF) * (minhash.PLACES - k) >> 32)
            places[k], places[turn] = places[turn], places[k]
            least[places[k]] = min(least[places[k]], (k << 32) + (z >> 32))
    return least


@pytest.mark.parametrize("n", [1, 2, 30, 900])
def test_signature(n, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 256)
    elements = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    assert minhash.signature(elements).tolist() == plain_signature(elements)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 240).astype(np.uint64)
        a, b = x[:200], x[40:]  # 160 of 240 shared
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - 160 / 240)
    # independent hashes would have a variance of J (1 - J) / places
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.95 * (2 / 9) / minhash.PLACES


# Importance resampling ---------------------------------------------------------------------------


def plain_buckets(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_draw(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(plain_buckets(text)[1])
    for text in target:
        t.update(plain_buckets(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    out = []
    for place, (i, text) in enumerate(rows):
        words, found = plain_buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words), place])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[6]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def draw_rows():
    texts = [*prose(300, 11, 120), "", None, "   ", "É1é ß" * 40, "w" * 200 + " and " * 30, ("x" * 70 + " y ") * 25, "a-b_c\x7f1 " * 30, "one two", "solo"]
    rows = [(3 * i - 200, t) for i, t in enumerate(texts)]
    return [*rows, *[rows[7]] * 80, *[(None, texts[8])] * 3, (-(2**60), texts[9])]


TARGET = [*prose(20, 12, 40), None, ""]


@pytest.mark.parametrize("digit", [12, 3])
def test_resampling(spark, digit, monkeypatch):
    monkeypatch.setattr(resampling, "DIGIT", digit)
    monkeypatch.setattr(resampling, "CHUNK", 50)
    rows = draw_rows()
    docs = documents(spark, rows).coalesce(3).withColumn("Rank", F.lit(1)).withColumn("n", F.lit(2)).withColumn("p0", F.lit(2))
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = resampling.resample(docs, target).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_draw(rows, TARGET)
    assert got[0].asDict().keys() == {"doc_id", "n_features", "weight", "score", "rank"}


def test_resampling_of_little(spark):
    target = spark.createDataFrame([], "text string")
    docs = documents(spark, [(1, "a few words"), (None, None)])
    assert sorted((tuple(r)[:2] for r in resampling.resample(docs, target).collect()), key=str) == [(1, 6), (None, 0)]
    assert resampling.resample(docs.limit(0), target).count() == 0


def test_kth_key(spark):
    r = random.Random(3)
    keys = sorted({(r.randrange(5), r.randrange(1 << 30), r.randrange(2)) for _ in range(500)})
    frame = spark.createDataFrame(r.sample(keys, len(keys)), "p0 long, p1 long, p2 long")
    for k in (1, 2, 250, 499, len(keys)):
        path = resampling.kth_key(frame, k, [3, 30, 1])
        assert sorted(map(tuple, frame.where(resampling.up_to(path)).collect())) == keys[:k]


def test_joined_checksums():
    words = [b"a", b"word", bytes(range(128, 192)), b"x" * 64, b"z"]
    for text in (b" ".join(words), b"one", b"", b"x" * 65 + b" b c d"):
        found = sorted(np.concatenate([np.empty(0, np.uint32), *resampling.buckets(text.decode("latin-1"))]).tolist())
        assert found == sorted(plain_buckets(text.decode("latin-1"))[1])


# Alignment of two tokenizers ---------------------------------------------------------------------

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(FIRST)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
    vocabulary = {i: p for p, i in json.load(open(FIRST))["model"]["vocab"].items()}
    cut, count = [], Counter()
    for _, text in rows:
        groups, links = [], []
        if text:
            a = [(i, bytes(byte[c] for c in vocabulary[i])) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("\u2581", " ").encode()) for i in b_side.encode(text) for p in [b_side.id_to_piece(i)]]
            if b"".join(p for _, p in a) == b"".join(p for _, p in b) == (" " + text).encode():
                spans = [[], []]
                for side, span in zip((a, b), spans):
                    at = 0
                    for i, p in side:
                        span.append((i, at, at + len(p)))
                        at += len(p)
                links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e] if len(spans[0]) < 400 else merged(*spans)
                begin = 0
                for end in sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]}):
                    groups.append([[i for i, s, e in span if begin <= s and e <= end] for span in spans])
                    begin = end
        cut.append((groups, links))
        count.update(links)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (i, _), (groups, links) in zip(rows, cut):
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str), count, best


def merged(a, b):
    out, k = [], 0
    for i, s, e in a:
        while b[k][2] <= s:
            k += 1
        m = k
        while m < len(b) and b[m][1] < e:
            out.append((i, b[m][0]))
            m += 1
    return out


def align_rows():
    texts = [*prose(40, 21), *prose(3, 22), "", None, " ", "\n\n\ta  b", "Größe naïve 数据 🙂 <|endoftext|> <s></s> <0x41>", "bl\u2581ock", "a\x00b\u00a0c\u2028d", "don't we'll 3.14 §§", "x" * 700, "\r\n" * 50, "ﬁ Å ① e\u0301", " ".join(prose(12, 23))]
    return [(i if i != 5 else None, t) for i, t in enumerate([*texts, *texts[:3]])]


def test_alignment(spark, monkeypatch):
    rows = align_rows()
    docs = documents(spark, rows).repartition(3).withColumn("Stripe", F.lit(1)).withColumn("n_a", F.lit(1))
    want, count, best = plain_alignment(rows)
    got = alignment.align(docs, FIRST, SECOND).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(i, *r) for i, *r in want]
    assert list(got[0].asDict()) == ["doc_id", *alignment.OUTPUTS]
    pairs = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(docs, FIRST, SECOND).collect()}
    assert pairs == {k: (n, n == best[k[1]]) for k, n in count.items()}
    assert alignment.align(docs.limit(0), FIRST, SECOND).count() == 0
    assert {tuple(r)[1:] for r in alignment.align(docs.where("text IS NULL"), FIRST, SECOND).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_packed_links():
    code, doc, links = np.array([0, 0, 5, 10**9]), np.array([1, 2, 0, 511]), np.array([1, 2**40, 3, 4])
    assert [x.tolist() for x in alignment.unpacked(alignment.packed(code, doc, links))] == [code.tolist(), doc.tolist(), links.tolist()]


def test_quick_cuts_are_the_librarys():
    cutters = alignment.Cutters(tuple(open(p, "rb").read() for p in (FIRST, SECOND)))
    points = [chr(c) for c in range(0, 0x30000, 7) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 500):
        text = "".join(f"a{c}b {c}1{c}. {c}{c} x" for c in points[at : at + 500])
        assert cutters.quick.encode_ordinary(text) == cutters.first.encode(text, add_special_tokens=False).ids
    for text in ("x" + " " * 1_000_000 + "y", "\n" * 99_999, "ab" * 200_000):  # the first breaks the quick one
        a, b, size = cutters.cut(text)
        assert a.tolist() == cutters.first.encode(" " + text, add_special_tokens=False).ids and size == len(text) + 1
