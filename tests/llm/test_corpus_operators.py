"""Near-duplicates, shards, mixes, tokens, scores, media, toxicity: against brute force and round trips."""

import hashlib
import math
import os
import random
import re
import wave
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from accessio.llm import components, media, mixing, scoring, sharding, simhash, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=("a", "b", None)):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)], None) for i, t in enumerate(texts)], DOCS)


def prose(n, seed):
    r = random.Random(seed)
    ends = "ab ec id of ug ha ke li mo nu py ra se to vu".split()
    return [" ".join(r.choice("one two three four five six seven eight nine ten".split()) + r.choice(ends) + r.choice(ends) for _ in range(r.randint(1, 120))) for _ in range(n)]


# SimHash -----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(values, near):
    par = list(range(len(values)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint():
    for t in ["", " \t\n", "One", "a b", "A b C d É", "x\x1cy z w\x0bv", *prose(20, 1)]:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def test_near_duplicates(spark):
    base = prose(60, 2)
    long = " ".join(prose(30, 9))
    edits = [long.replace("one", f"new{i}", 1) for i in range(15)]
    texts = [*base, *base[:20], base[3].upper(), "", None, "  ", *edits, long, "w " * 50000]
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(0, texts[0], "en", "a", None), (None, base[5], "en", "a", None), (None, "lonely text here", "en", "a", None)], DOCS))
    rows = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect()
    prints = [int(r.fingerprint, 16) for r in rows]
    root = roots(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: None)
    for k, r in zip(root, rows, strict=True):
        if r.doc_id is not None:
            least[k] = r.doc_id if least[k] is None else min(least[k], r.doc_id)
    assert len(rows) == len(texts) + 3
    assert [r.component_id for r in rows] == [least[k] for k in root]
    assert {r.fingerprint for r in rows if r.doc_id in (81, 82, 83)} == {"0" * 16}
    kept = simhash.deduplicated(docs).collect()
    assert len(kept) == len(set(root)) and {"lonely text here"} < {r.text for r in kept}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2, 48])
def test_links_find_all_components(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(4)
    values = {r.getrandbits(64) for _ in range(150)}
    for v in list(values)[:40]:
        for _ in range(4):
            v ^= 1 << r.randrange(64)
            v ^= 1 << r.randrange(64)
            values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = {row.vertex % (1 << 64): row.root % (1 << 64) for row in components.components(simhash.links(nodes, len(values))).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[got.get(v, v)].add(v)
    want = defaultdict(set)
    for k, v in zip(roots(values, lambda a, b: (a ^ b).bit_count() <= 2), values, strict=True):
        want[k].add(v)
    named = {frozenset(g & set(values)) for g in groups.values()}
    assert named == {frozenset(g) for g in want.values()}


def test_thresholds_are_cheapest():
    rng = np.random.default_rng(1)
    for m in (2, 3, 4):
        costs = rng.random((50, m, 3)) * 10
        goal = simhash.RADIUS - m + 1
        t = simhash.thresholds(costs, goal)
        every = [c for c in np.ndindex(*[3] * m) if sum(c) - m == goal]
        for k in range(50):
            assert t[k].sum() == goal
            mine = sum(costs[k, i, t[k, i] + 1] for i in range(m))
            assert mine == pytest.approx(min(sum(costs[k, i, c[i]] for i in range(m)) for c in every))


def test_chain_of_links(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (200, 201), (201, 200)], "u long, v long")
    assert {r.vertex: r.root for r in components.components(links).collect()} == {**{i: 0 for i in range(1, n + 1)}, 201: 200}


# Sharding ----------------------------------------------------------------------------------------


def test_shards(spark):
    texts = [*prose(300, 5), *["same text"] * 150, "x" * 3000, "", None]
    docs = documents(spark, texts).withColumn("Shard", F.lit(9)).unionByName(documents(spark, texts[:1]).withColumn("Shard", F.lit(9)))
    rows = sharding.shard_by_bytes(docs, shards=8).collect()
    assert len(rows) == len(texts) + 1
    size = lambda t: len((t or "").encode()) + 1
    assert all(r["size"] == size(r.text) and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.law == "bytes" for r in rows)
    total = Counter()
    for r in rows:
        total[r.shard] += r["size"]
    assert set(total) <= set(range(8)) and max(total.values()) - min(total.values()) <= 2 * 3001
    for s in total:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    again = {(r.doc_id, r.shard) for r in sharding.shard_by_bytes(docs.repartition(7), shards=8).collect()}
    assert again == {(r.doc_id, r.shard) for r in rows}
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0
    one = sharding.shard_by_bytes(documents(spark, ["a"] * 5).withColumn("doc_id", F.lit(1).cast("long"))).collect()
    assert [r.slot for r in one] == [0] * 5 and len({r.shard for r in one}) == 5  # equal rows are spread like others


def test_equal_rows_are_split(spark):
    """A third of all rows and more alike in id and text: every shard takes its share, and so does every task."""
    rows = [(None, None)] * 4000 + [(i, "t" * (i % 7)) for i in range(600)] + [(7, "copy of one text")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"__key": F.lit(1), "__range": F.lit("clash")})
    sharded = sharding.shard_by_bytes(docs)
    got = sharded.collect()
    total, count = Counter(), Counter()
    for r in got:
        total[r.shard] += r["size"]
        count[r.shard] += 1
    assert len(got) == 5000 and sum(total.values()) == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert set(total) == set(range(8)) and max(total.values()) - min(total.values()) <= 2 * 17
    for s in total:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert all(r["__key"] == 1 and r["__range"] == "clash" for r in got)
    again = sharding.shard_by_bytes(docs.repartition(3).sortWithinPartitions("text")).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.shard, r.slot) for r in got)
    # the ranges that tasks sort
    keyed = spark.createDataFrame([(5, i, 1) for i in range(-3000, 3000)], "__key long, __tie long, __size long").withColumn("__tie", F.xxhash64("__tie"))
    found, ranges, n = sharding.find_splitters(keyed, 8, 0.0005, 32)
    per_range = Counter(r.c for r in keyed.select(sharding._splitters_below(found).alias("c")).collect())
    assert ranges == 32 and n == 6000 and max(per_range.values()) < 2.5 * 6000 / 256
    assert all(x.rows_below == sum(v for k, v in per_range.items() if k <= i) for i, x in enumerate(found) if found.count(x) == 1)


def test_very_long_text_in_a_shard(spark):
    got = sharding.shard_by_bytes(documents(spark, ["x" * 2_000_000, *["y"] * 50, ""])).collect()
    assert sorted(r["size"] for r in got)[-1] == 2_000_001 and len(got) == 52
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_splitters_are_exact(spark):
    r = random.Random(6)
    rows = [(r.getrandbits(63) - (1 << 62), r.randint(1, 500)) for _ in range(3000)]
    found, first, _ = sharding.find_splitters(spark.createDataFrame(rows, "__key long, __size long"), 8, 0.0005)
    total = sum(s for _, s in rows)
    for k, x in enumerate(found, 1):
        below = [s for key, s in rows if key < x.at]
        assert (sum(below), len(below)) == (x.bytes_below, x.rows_below)
        assert abs(x.bytes_below - total * k / 8) <= 500


# Mixing ------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.targets([300, 10, 10], [1, 2, 3])
    assert got == [260, 30, 30] and sum(got) == 320
    assert mixing.targets([0, 5], [1, 2]) == [0, 5] and mixing.targets([], []) == []


def test_draws_fill_quotas():
    sources = mixing.plan_sources({"a": 10_000, "b": 5_000, None: 700, "z": 0})
    drawn = mixing.draw(sources, shards=16)
    assert [sum(k[i] for k in drawn) for i in range(4)] == [s.slots for s in sources]
    assert drawn == mixing.draw(sources, shards=16) and [s.name for s in sources] == ["a", "b", "z", None]


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000)) and abs(np.corrcoef(got, range(1000))[0, 1]) < 0.15


def test_mix(spark):
    texts = [*prose(600, 7), "", None, "w " * 3000, " \t"]
    docs = documents(spark, texts, sources=("a", "a", "a", "b", "c'\\", None)).withColumn("size", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id = 0"))
    rows = mixing.mix(docs, block=16).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    text = dict(enumerate(texts))
    assert len(rows) == len(texts) + 1 and all(r["size"] == n(text[r.doc_id]) and 0 <= r.taken <= 3 * r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source_size].append(r)
    for size, own in by.items():
        target = own[0].target
        assert sum(r["size"] for r in own) == size and {r.target for r in own} == {target}
        assert abs(sum(r.taken for r in own) - target) <= max(0.05 * target, 40)
    again = mixing.mix(docs.repartition(5), block=16).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert mixing.mix(docs.limit(0)).count() == 0
    whole = mixing.mixed_documents(docs, block=16)
    taken = {r.doc_id: r.taken for r in rows if r.doc_id}
    counts = Counter(r.doc_id for r in whole.collect() if r.doc_id)
    assert whole.columns == docs.columns and all(abs(counts[i] - taken[i] / n(text[i])) < 1 for i in taken if n(text[i]))


def test_mix_of_equal_rows(spark):
    """Equal rows come as often as the mix takes them together, those of two sources apart from each other."""
    filler = prose(200, 71)
    rows = [(i, t, "big") for i, t in enumerate(filler)] + [(900, "w " * 50, "big")] * 20 + [(901, "v " * 30, "big")] * 30 + [(901, "v " * 30, "small")] * 25 + [(None, None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit(1), "in0": F.lit(2), "copies": F.lit(3)})
    decided = mixing.mix(docs, block=16).collect()
    got = mixing.mixed_documents(docs, block=16)
    assert len(decided) == len(rows) and got.columns == docs.columns
    seen = Counter((r.doc_id, r.source) for r in got.collect())
    assert seen[None, None] == 40
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("big", "small")}
    for key, source in ((900, "big"), (901, "big"), (901, "small")):
        own = [r for r in decided if r.doc_id == key and r.source_size == sizes[source]]
        assert len(own) == sum(r[0] == key and r[2] == source for r in rows)
        assert abs(seen[key, source] - sum(r.taken for r in own) / own[0]["size"]) <= 4
    again = mixing.mix(docs.repartition(3).sortWithinPartitions("doc_id"), block=16).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, decided))


# Tokens ------------------------------------------------------------------------------------------


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    r = random.Random(8)
    alphabet = [*"abc ABC123'\"  \n\t\r\x0b\x1c\x85\xa0éßñ漢字😀.,;:!?-_", "<|endoftext|>", "'s ", "'ll"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(300)] + [*prose(20, 9), "", None, "a" * 20000]
    library = Tokenizer.from_file(path)
    rows = tokens.count_tokens(documents(spark, texts).withColumn("N_Tokens", F.lit(1)), path, limit=20).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert r.n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), t
        assert r.n_bytes == len((t or "").encode()) and r.over_limit == (r.n_tokens > 20)


def test_merged_count_by_hand():
    merges = tokens.Merges([("a", "b"), ("ab", "ab"), ("b", "c")], [])
    count = lambda s: tokens.merged_count(s, merges.ranks, merges.joined)
    assert [count(s) for s in (b"", b"a", b"ab", b"abab", b"ababab", b"abc", b"bcb")] == [0, 1, 1, 1, 2, 2, 2]


# Pseudo-likelihood -------------------------------------------------------------------------------


def test_scoring(spark):
    usual = [" ".join(["the cat sat on the mat and"] * 12)] * 40
    texts = [*usual, "mat the on and cat the sat " * 12, "", None, "w", *prose(5, 10)]
    rows = scoring.score_documents(documents(spark, texts).withColumn("id", F.lit("clash"))).orderBy("doc_id").collect()
    assert len(rows) == len(texts) and all(math.isfinite(r.log_likelihood) for r in rows)
    assert rows[0].per_token > rows[40].per_token > rows[-1].per_token  # order of words counts, and so do the words
    assert [(rows[k].n_tokens, rows[k].log_likelihood, rows[k].per_token) for k in (41, 42)] == [(0, 0.0, None)] * 2
    assert scoring.score_documents(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [0, 8, 1 << 17])
def test_words_of_one_bucket_have_their_own_counts(spark, monkeypatch, frequent):
    by_bucket = defaultdict(list)
    for k in range(100000):
        by_bucket[zlib.crc32(f"w{k}".encode()) % scoring.BUCKETS].append(f"w{k}")
    common, seldom = next(w for w in by_bucket.values() if len(w) > 1)[:2]
    texts = [common, seldom, *[f"{common} x y"] * 60, "x " * 50, common]
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    rows = scoring.score_documents(documents(spark, texts)).orderBy("doc_id").collect()
    assert rows[0].log_likelihood - rows[1].log_likelihood == pytest.approx(math.log(62), abs=1e-4)
    assert rows[0].log_likelihood == pytest.approx(rows[-1].log_likelihood) and len(rows) == len(texts)


@pytest.mark.parametrize("frequent", [0, 20, 1 << 17])
def test_scores_by_brute_force(spark, monkeypatch, frequent):
    """Each document's score is the sum, token by token, of the log shares of class, part, bucket and word."""
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    texts = [*prose(30, 61), "", None, "Alone", "the cat sat\ton\x0bthe mat " * 4000, *["the end of it"] * 8]
    docs = documents(spark, texts)
    vocabulary, net, counted = scoring.learnt(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    counts = {bytes(r.word): r.n for r in counted.collect()}
    words = [(t or "").lower().encode().split() for t in texts]
    assert counts == Counter(w for ws in words for w in ws)
    by_bucket = Counter()
    for w, n in counts.items():
        by_bucket[zlib.crc32(w) % scoring.BUCKETS] += n
    net = {k: v.astype(np.float64) for k, v in net.items()}

    def log_softmax(x):
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    def score(ws):
        buckets = [zlib.crc32(w) % scoring.BUCKETS for w in ws]
        classes = [scoring.CLASSES] * scoring.SIDE + [int(vocabulary.class_of[b]) for b in buckets] + [scoring.CLASSES] * scoring.SIDE
        total = 0.0
        for i, (w, b) in enumerate(zip(ws, buckets, strict=True)):
            around = classes[i : i + scoring.SIDE] + classes[i + scoring.SIDE + 1 : i + 2 * scoring.SIDE + 1]
            hidden = np.tanh(sum(net["embed"][p][c] for p, c in enumerate(around)) + net["hidden"])
            c = classes[i + scoring.SIDE]
            total += log_softmax(hidden @ net["out"] + net["bias"])[c]
            if c >= scoring.SINGLE:
                c -= scoring.SINGLE
                total += log_softmax(hidden @ net["inner"][c] + net["inner_bias"][c])[vocabulary.part_of[b]]
            total += vocabulary.log_in_part[b] + math.log(counts[w] / by_bucket[b])
        return total

    rows = {r.doc_id: r for r in scoring.score_documents(docs).collect()}
    for i, ws in enumerate(words):
        assert rows[i].n_tokens == len(ws) and rows[i].log_likelihood == pytest.approx(score(ws), rel=1e-4, abs=1e-3)


def test_parts_are_normed_and_learnt():
    counts = np.zeros(scoring.BUCKETS)
    counts[:3000] = np.arange(3000, 0, -1)
    vocabulary = scoring.Vocabulary.from_counts(counts)
    shared = vocabulary.class_of >= scoring.SINGLE
    place = (vocabulary.class_of[shared] - scoring.SINGLE) * scoring.PARTS + vocabulary.part_of[shared]
    sums = np.bincount(place, np.exp(vocabulary.log_in_part[shared]))
    assert sums[np.unique(place)] == pytest.approx(1, abs=1e-3) and np.exp(vocabulary.log_part).sum(axis=1) == pytest.approx(1, abs=1e-3)
    assert (vocabulary.log_in_part[~shared] == 0).all()
    r = np.random.default_rng(4)
    target = r.integers(scoring.SINGLE, scoring.SINGLE + 3, 600).astype(np.int16)
    context = r.integers(0, 5, (600, 2 * scoring.SIDE)).astype(np.int16)
    part = (context[:, 0] * 7 % scoring.PARTS).astype(np.int16)  # the context tells the part
    net = scoring.initial(vocabulary)
    before = scoring.token_logs(net, target, context, part).sum()
    for _ in range(60):
        scoring.learn_parts(net, target, part, context)
    assert scoring.token_logs(net, target, context, part).sum() > before + 200


def test_averages_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FAN", 2)
    rows = spark.range(23, numPartitions=7).rdd.map(lambda r: (r.id, bytearray(np.array([r.id, 1.0], np.float32).tobytes()), float(r.id))).toDF("shard long, values binary, weight double")
    assert scoring.averaged(rows).tolist() == pytest.approx([sum(k * k for k in range(23)) / sum(range(23)), 1.0])
    assert scoring.averaged(rows.limit(0)) is None


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """What is learnt follows from the documents: shards, their order and their averages are the same for any split."""
    monkeypatch.setattr(scoring, "SHARD", 1500)
    monkeypatch.setattr(scoring, "LESSON", 400)
    monkeypatch.setattr(scoring, "FAN", 2)
    texts = [*prose(250, 71), "", None, *["the same text again and again"] * 40]
    docs = documents(spark, texts)
    one, many = (
        {r.doc_id: (r.n_tokens, r.log_likelihood) for r in scoring.score_documents(df).collect()} for df in (docs.coalesce(1), docs.orderBy(F.rand(3)).repartition(8))
    )
    tokens = sum(n for n, _ in one.values())
    assert tokens > 4 * scoring.ROUNDS * scoring.SHARD / 2  # several shards a round
    assert one.keys() == many.keys() and all(one[k][0] == many[k][0] and one[k][1] == pytest.approx(many[k][1], rel=1e-5, abs=1e-5) for k in one)


def test_every_token_is_learnt_from():
    classes = [np.arange(k, dtype=np.int16) for k in (0, 1, 5, 100)]
    target, context = scoring.lessons(classes)
    plain, around = scoring.windows(classes)
    assert sorted([t, *c] for t, c in zip(target.tolist(), context.tolist(), strict=True)) == sorted([t, *c] for t, c in zip(plain.tolist(), around.tolist(), strict=True))


def test_network_is_normed_and_sees_both_sides():
    counts = np.zeros(scoring.BUCKETS)
    counts[:500] = np.arange(500, 0, -1)
    vocabulary = scoring.Vocabulary.from_counts(counts)
    assert np.bincount(vocabulary.class_of, np.exp(vocabulary.log_share), scoring.CLASSES) == pytest.approx(1, abs=1e-3)
    target, context = scoring.windows([np.array([1, 2, 3], np.int16), np.array([], np.int16), np.array([4], np.int16)])
    end = scoring.CLASSES
    assert target.tolist() == [1, 2, 3, 4] and context.tolist() == [[end, end, 2, 3], [end, 1, 3, end], [1, 2, end, end], [end] * 4]
    net = scoring.initial(vocabulary)
    _, logs = scoring.forward(net, context)
    assert np.exp(logs).sum(axis=1) == pytest.approx(1, abs=1e-4)
    before = scoring.token_logs(net, target, context).sum()
    for _ in range(50):
        scoring.learn(net, target, context)
    assert scoring.token_logs(net, target, context).sum() > before
    assert scoring.flat(scoring.shaped(scoring.flat(net))).tolist() == scoring.flat(net).tolist()


# Media -------------------------------------------------------------------------------------------


def test_media(spark):
    texts = [*prose(10, 11), "", None, "é" * 96, "z" * 192, "long " * 120000, prose(1, 11)[0]]
    rows = media.media_column(documents(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        with wave.open(BytesIO(r.media)) as sound:
            assert sound.readframes(sound.getnframes()) == payload and sound.getsampwidth() == 1
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.times) == len(r.codes) and r.times == sorted(r.times)
    assert rows[0][1:] == rows[-1][1:]


def test_fingerprint_hears_all_of_a_payload():
    def feature(data):
        return [x.tolist() for x in media.fingerprint(np.frombuffer(media.padded(data), np.uint8))]

    texts = [t.encode() for t in prose(60, 12)]
    texts = [t[: len(t) // 192 * 192] for t in texts if len(t) >= 192]
    for place in (0, -1):  # the first byte, the last
        changed = 0
        for data in texts:
            others = [data[: place % len(data)] + bytes([v]) + data[place % len(data) + 1 :] for v in range(33, 127)]
            changed += any(feature(o) != feature(data) for o in others)
        assert changed > len(texts) / 5
    short = [t.encode()[:n] for t in prose(20, 13) for n in (60, 120, 192) if len(t) >= n]
    assert all(feature(t)[1] for t in [*short, b"A.", b"w"])
    assert feature(b"") == [[], []] == feature(b"z" * 192)
    for n in (1, 95, 96, 97, 192, 1000):  # frames end behind the last sample, whatever the length
        made = media.surrounded(np.arange(n).astype(np.uint8))
        assert (len(made) - media.FRAME) % media.HOP == 0 and len(made) >= n + media.FRAME - media.HOP + 1


def test_peaks_find_a_tone(monkeypatch):
    t = np.arange(96 * 40 + 128)
    loud = np.where((t // 960) % 2, 100, 20) * np.sin(2 * np.pi * t * 16 / 128) + 128
    samples = loud.astype(np.uint8)
    frame, band = media.peaks(samples)
    assert len(frame) and set(band) == {16}
    whole = media.fingerprint(samples)
    monkeypatch.setattr(media, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.fingerprint(samples), strict=True))


def plain_feature(samples):
    """Peaks and pairs by the definition, sample by sample, in doubles."""
    n, hop, frame = len(samples), media.HOP, media.FRAME
    count = -(-n // hop) + 1
    line = [float(round(float(np.mean(samples))))] * ((count - 1) * hop + frame)
    line[frame - hop : frame - hop + n] = [float(x) for x in samples]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (frame - 1)) for i in range(frame)]
    turns = np.exp(-2j * np.pi * np.outer(np.arange(frame // 2 + 1), np.arange(frame)) / frame)
    power = []
    for k in range(count):
        part = [x - 128 for x in line[k * hop : k * hop + frame]]
        mean = sum(x * w for x, w in zip(part, window)) / sum(window)
        power.append([0.0, *np.abs(turns @ [(x - mean) * w for x, w in zip(part, window)])[1:]])
    found = []
    for k, p in enumerate(power):
        band = max(range(len(p)), key=lambda b: (p[b], -b))
        before, after = (power[j][band] if 0 <= j < count else 0.0 for j in (k - 1, k + 1))
        if p[band] > media.QUIET and p[band] >= before and p[band] > after:
            found.append((k, band))
    if len(found) == 1:
        found *= 2
    pairs = [(t, a << 12 | b << 5 | u - t) for i, (t, a) in enumerate(found) for u, b in found[i + 1 : i + 1 + media.FAN] if u - t <= media.SPAN]
    return [list(x) for x in zip(*sorted(pairs))] or [[], []]


def test_fingerprint_by_brute_force(spark):
    texts = [*prose(25, 14), "", "A.", "w" * 200 + "?", "é ü" * 100, *["".join(chr(c) for c in np.random.default_rng(k).integers(33, 127, 700)) for k in range(5)]]
    rows = media.media_column(documents(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert [r.times, r.codes] == plain_feature(list(media.padded(t.encode()))), t


def test_empty_tables_alone(spark):
    docs = documents(spark, ["x"]).limit(0)
    import public_tokenizers

    from accessio.llm import pii

    assert tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    assert media.media_column(docs).collect() == [] == pii.find_private(docs).collect()
    assert simhash.near_duplicates(docs).collect() == [] == scoring.score_documents(docs).collect()


# Toxicity ----------------------------------------------------------------------------------------


def test_kernel_by_brute_force():
    def plain(a, b):
        def features(w):
            out = Counter()
            for i, j, k in toxicity.triples(len(w)):
                out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        x, y = features(a), features(b)
        dot = lambda p, q: sum(v * q[u] for u, v in p.items())
        return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))

    words = ["idiot", "idxiot", "moron", "banana", "aaa", "station"]
    basis = np.column_stack([toxicity.embedded(w) for w in words]).astype(np.float32)
    got = toxicity.against(words, basis)
    for i, a in enumerate(words):
        assert got[i] == pytest.approx([plain(a, b) for b in words], abs=1e-4)


def test_units():
    assert {"idiot"} <= toxicity.units("such an i d i o t") and {"idiot"} <= toxicity.units("an i.d-i_o*t!")
    assert toxicity.units("") == set() == toxicity.units("a 12 ..")
    assert "x" * 16 in toxicity.units("x" * 100)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(12)
    insults = ["idiot", "moron", "scumbag", "pathetic"]
    texts, labels = [], []
    for i in range(900):
        w = prose(1, 100 + i)[0].split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w) + 1), r.choice(insults))
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    texts += ["", None, "what an i d i o t you are", "just some scummbag", "y " * 50000, "sevenraab ninetolike"]
    docs = documents(spark, texts)
    return docs, spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.learnt(docs, labels.where(~held))
    rows = toxicity.score_toxicity(docs.withColumn("score", F.lit("clash")), model).select("doc_id", "score", "predicted", held.alias("h")).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {i: int(i % 5 == 0) for i in range(900)}
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.h and r.doc_id < 900]
    assert len(judged) > 200 and all(p == t for p, t in judged)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].predicted for i in range(900, 906)] == [0, 0, 1, 1, 0, 0]
    assert {r.doc_id for r in rows if r.h} == {i for i in range(906) if zlib.crc32(str(i).encode()) % 3 == 1}
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in rows)


def test_scores_of_documents_by_brute_force(spark, labelled):
    """A document's score from its words' margins, each the sum over the word's letter triples."""
    docs, labels = labelled
    model = toxicity.learnt(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()

    def margin(word):
        c = [ord(x) - 97 if "a" <= x <= "z" else 31 if x == toxicity.START else 26 + ord(x) % 5 for x in toxicity.START + word]
        features = Counter()
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, len(c)):
                    features[c[i] << 10 | c[j] << 5 | c[k]] += toxicity.DECAY ** (k - i + 1)
        length = math.sqrt(sum(v * v for v in features.values()))
        return sum(float(model.weights[f]) * v / length for f, v in features.items()) + model.bias

    known = {}
    for r in rows[:60]:
        for w in toxicity.units(r.text or ""):
            known[w] = known[w] if w in known else margin(w)
        top = sorted((known[w] for w in toxicity.units(r.text or "")), reverse=True)[: model.count]
        top = [min(max(x, toxicity.FLOOR), model.cap) for x in top] + [min(toxicity.FLOOR, model.cap)] * (model.count - len(top))
        long = model.length * math.log(max(len(toxicity.units(r.text or "")), toxicity.SHORT) / toxicity.SHORT)
        x = min(30, max(-30, model.slope * (sum(top) - long) + model.intercept))
        assert r.score == pytest.approx(1 / (1 + math.exp(-x)), rel=1e-3, abs=1e-6) and r.predicted == int(r.score >= 0.7)


def test_inflected_insults(spark):
    """Insults that share a start only, none frequent enough as a word; one such word in a clean document is chance."""
    r = random.Random(31)
    ends = [x + y for x in "bdfgklmnprst" for y in ("a", "e", "i", "o", "u", "an", "er", "ol")]
    bags = []
    for i in range(800):
        words = set(prose(1, 5000 + i)[0].lower().split())
        toxic = r.random() < 0.125
        hits = r.sample(ends, 4) if toxic else r.sample(ends, 1) if r.random() < 0.125 else []
        bags.append((words | {"zolvu" + e for e in hits}, int(toxic)))
    learn, held = bags[:600], bags[600:]
    assert "zolvu" in toxicity.tied_starts([w for w, y in learn if y], [w for w, y in learn if not y])
    model = toxicity.train(learn, spark)
    got = []
    for words, _ in held:
        ordered = sorted(words)
        got.append(model.probability(model.margins(ordered), len(words)) >= toxicity.THRESHOLD)
    truth = [y == 1 for _, y in held]
    assert sum(g and t for g, t in zip(got, truth)) >= 0.9 * sum(truth)
    assert not any(g and not t for g, t in zip(got, truth))


def test_highest_and_cut():
    assert toxicity.highest([]).tolist() == [toxicity.FLOOR] * toxicity.HIGHEST
    assert toxicity.highest([3.0, -9.0, 1.0, 2.0, 5.0]).tolist() == [5.0, 3.0, 2.0]
    gain, slope, intercept = toxicity.calibrated(np.array([2.0, 1.5, -1.0, -2.0]), np.array([1.0, 1.0, 0.0, 0.0]))
    p = 1 / (1 + np.exp(-(slope * np.array([1.5, -1.0]) + intercept)))
    assert gain == 2.0 and p[0] >= toxicity.THRESHOLD > p[1]
    # one toxic document isn't worth the clean one above it
    assert toxicity.calibrated(np.array([3.0, 2.0, 1.0]), np.array([1.0, 0.0, 1.0]))[0] == 1.0


def test_without_labels(spark, labelled):
    docs, labels = labelled
    assert toxicity.learnt(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), None).count() == 0


# Pipeline ----------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path, labelled):
    import corpus_pipeline

    docs, labels = labelled
    leak = prose(1, 90001)[0] + " " + prose(1, 90002)[0]
    extra = documents(spark, [prose(1, 101)[0], f"start {leak} end"]).withColumn("doc_id", F.col("doc_id") + 5000)
    docs.unionByName(extra).withColumn("text", F.coalesce("text", F.lit(None))).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns, before = docs.columns, spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        assert before.columns[: len(columns)] == columns
        seen.append({r.doc_id for r in before.select("doc_id").collect()})
    assert all(i not in seen[0] for i in range(0, 900, 5)) and 5001 in seen[0]
    assert 5000 not in seen[1] and 1 in seen[1] and 5001 in seen[1]
    assert seen[1] - seen[2] == {5001} and seen[3] <= seen[2] and seen[4] == seen[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == before.count() and {"shard", "slot"} <= set(whole.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert os.path.exists(corpus_pipeline.__file__)


def test_forgotten_files_are_gone(spark):
    from accessio.llm import base

    df = base.settled(spark.range(10))
    where = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    folder = where.removeprefix("file:")
    assert os.path.isdir(folder) and df.count() == 10
    base.forget(df)
    assert not os.path.exists(folder)


def test_pipeline_stages_take_odd_tables(spark, tmp_path, labelled):
    """Empty tables, null ids and texts, repeated rows and extra columns with inner names, through every stage."""
    import corpus_pipeline

    docs, labels = labelled
    odd = [(None, None), (None, ""), (1, "w " * 30000), (1, "w " * 30000), (2, "a text of some words"), (2, "a text of some words"), (3, None)]
    made = spark.createDataFrame([(i, t, "en", None, 1, "x", "y") for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long, row string, `__key` string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, table in (("odd", made), ("none", made.limit(0))):
        sf = tmp_path / name
        table.write.parquet(str(sf / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(sf / f"{t}.parquet"))
        before = spark.read.parquet(str(sf / "documents.parquet"))
        for stage_name, stage in corpus_pipeline.STAGES:
            stage(spark, before, str(sf)).write.parquet(str(sf / stage_name))
            before = spark.read.parquet(str(sf / stage_name))
            assert before.columns[: len(made.columns)] == made.columns
        assert corpus_pipeline.run(spark, str(sf)).count() == before.count() and (before.count() > 0) == (name == "odd")


def test_words_of_many_texts():
    """Words are cut and numbered for all texts of a batch at once, as each text's own."""
    import pandas as pd

    texts = ["", " \t", "a", " A b\x0b", "x\x00y \x1c\x85z \xa0q", "Ä straße\ra", "b b c"]
    words, which, ends = scoring.distinct_words(pd.Series(texts))
    assert len(set(words)) == len(words) and [[words[k] for k in c] for c in scoring.cut(which, ends)] == [t.encode().lower().split() for t in texts]
    codes, ends, rare = scoring.Codes([b"b", b"a"]).of(pd.Series(texts))
    assert codes[ends[1] : ends[3]].tolist() == [1, 1, 0] and codes[-1] == 2 + zlib.crc32(b"c") % scoring.BUCKETS and rare[-1] == [b"c"] and rare[3] == []
    assert scoring.Codes([]).of(pd.Series([], dtype=object))[2] == []
