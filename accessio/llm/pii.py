"""Personal data: generators propose spans, boosted trees choose among them.

Base spans follow four fixed patterns and are always kept. Wider generators
propose more spans: other separators, spelled-out signs, missing prefixes. They
overlap each other and the base. Gradient boosted trees score each proposal by
its format (digits, groups, check sums, separators) and its context (cue words
before it, the characters beside it); the scores are calibrated on held-out
sentences, and each kind has the lowest threshold at which calibrated precision
holds. Patterns are written so that no text makes them backtrack far: leading
runs are possessive and start only where a run starts, which leaves the leftmost
non-overlapping matches as they are.

Training sentences are made from a rule with a fixed seed; their features come
from the same expressions as those of the corpus, and only they reach the driver.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accessio.llm.base import carried, renamed, text_of

#: Order in which kinds go where spans start together.
KINDS = ("email", "ip", "card", "phone")
OUTPUTS = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans")

_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    # \G: a match may also begin where the last one ended, inside a run
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
BASE_NEEDS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,4})",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?\[?\.\]?\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])",
}
WIDE_NEEDS = {"email": r"[(\[](?:at|dot)[)\]]|@\x20|\x20@|\x20dot\x20|@[A-Za-z0-9.-]*+(?:\x20\.|(?<=\.)\x20[A-Za-z0-9-])", "ip": r"[0-9]\x20?\[?\.\]?\x20?[0-9]", "card": r"[0-9][\x20./-]{0,2}[0-9]", "phone": r"[0-9]\)?[\x20./-]"}
CUES = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|pay", "phone": r"phone|\btel\b|call|mobile|fax"}
FEATURES = ("kind", "length", "digits", "letters", "groups", "blanks", "dots", "dashes", "brackets", "plus", "luhn", "largest", "even_groups", "cue", "other_cue", "before", "after")
CONTEXT = 40
PRECISION = 0.99


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits' check sum is right."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0)


def largest_part(c: Column) -> Column:
    """The largest number between dots, whatever its leading zeros; 1000 stands for those of more than nine digits."""
    parts = F.transform(F.split(F.regexp_replace(c, "[^0-9.]", ""), r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.coalesce(F.array_max(F.transform(parts, lambda p: F.coalesce(F.when(F.length(p) < 10, p).otherwise("1000").try_cast("int"), F.lit(0)))), F.lit(0))


def valid(kind: str, match: Column) -> Column:
    """What a base match must satisfy."""
    n = F.length(digits_of(match))
    return {
        "email": F.lit(True),
        "ip": largest_part(match) <= 255,
        "card": n.between(14, 19) & luhn(digits_of(match)),
        "phone": n.between(10, 15),
    }[kind]


def found(text: Column, pattern: str, needs: str) -> Column:
    """Array of (start, end, text) of all matches; code points, end exclusive."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,text:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["piece"])
        end = start + F.char_length(pair["match"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("text"))).alias("spans"))

    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("match"))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(needs), walked).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end) of valid base spans, by start and kind."""

    def of(rank: int, kind: str) -> Column:
        kept = F.filter(found(text, BASE[kind], BASE_NEEDS[kind]), lambda m: valid(kind, m["text"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def features(text: Column, rank: int, m: Column) -> Column:
    """The features of a proposal, as doubles in the order of FEATURES."""
    t = m["text"]
    before = F.lower(F.substr(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT))))
    after = F.substr(text, m["end"] + 1, F.lit(1))
    others = "|".join(c for k, c in CUES.items() if k != KINDS[rank])
    groups = F.filter(F.split(t, "[^0-9A-Za-z]+"), lambda g: g != "")

    def side(c: Column) -> Column:
        return F.when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike(r"[-/_#=$.]"), 1).otherwise(0)

    values = (
        F.lit(rank),
        F.char_length(t),
        _count(t, "[0-9]"),
        _count(t, "[A-Za-z]"),
        F.size(groups),
        _count(t, " "),
        _count(t, r"\."),
        _count(t, "-"),
        _count(t, r"[()\[\]]"),
        F.when(t.startswith("+"), 2).when(t.startswith("00"), 1).otherwise(0),
        luhn(digits_of(t)).cast("int"),
        largest_part(t),
        (F.size(F.array_distinct(F.transform(groups, lambda g: F.length(g)))) == 1).cast("int"),
        before.rlike(CUES[KINDS[rank]]).cast("int"),
        before.rlike(others).cast("int"),
        side(F.right(before, F.lit(1))),
        side(after),
    )
    return F.array(*[v.cast("double") for v in values])


def proposals(text: Column) -> Column:
    """Array of (start, rank, end, features) of the wider generators' spans; they may overlap."""

    def of(rank: int, kind: str) -> Column:
        return F.transform(
            found(text, WIDE[kind], WIDE_NEEDS[kind]),
            lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), features(text, rank, m).alias("x")),
        )

    return F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)])


# Boosted trees -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, cut, low, high) with leaf numbers, slope and intercept of the calibration, thresholds by kind."""

    trees: tuple
    slope: float
    intercept: float
    thresholds: tuple[float, ...]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0):
    leaf = float(-g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 10:
        return leaf
    best, base = (1e-6, None, None), g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        levels = np.unique(x[:, f])
        if len(levels) > 32:
            levels = np.unique(np.quantile(levels, np.linspace(0, 1, 33)))
        for cut in (levels[1:] + levels[:-1]) / 2:
            low = x[:, f] <= cut
            if low.any() and not low.all():
                gain = g[low].sum() ** 2 / (h[low].sum() + ridge) + g[~low].sum() ** 2 / (h[~low].sum() + ridge) - base
                if gain > best[0]:
                    best = (gain, f, float(cut))
    if best[1] is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _leaf(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def margin(trees: tuple, x: np.ndarray) -> np.ndarray:
    return np.array([sum(_leaf(t, row) for t in trees) for row in x])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 16, depth: int = 3, rate: float = 0.4) -> Model:
    """Boosting on half of the rows, calibration on a quarter, thresholds on another."""
    part = np.arange(len(y)) % 4
    grown = part < 2
    raw, trees = np.zeros(grown.sum()), []
    for _ in range(rounds):
        p = _sigmoid(raw)
        tree = _grow(x[grown], p - y[grown], p * (1 - p), depth)
        tree = _scaled(tree, rate)
        trees.append(tree)
        raw += np.array([_leaf(tree, row) for row in x[grown]])
    z, t = margin(tuple(trees), x[part == 2]), y[part == 2]
    slope, intercept = 1.0, 0.0
    for _ in range(200):
        p = _sigmoid(slope * z + intercept)
        slope -= 0.5 * float(((p - t) * z).mean() + 1e-3 * (slope - 1))
        intercept -= 0.5 * float((p - t).mean())
    unseen = part == 3
    p, t, kinds = _sigmoid(slope * margin(tuple(trees), x[unseen]) + intercept), y[unseen], x[unseen][:, 0]
    thresholds = []
    for rank in range(len(KINDS)):
        own = kinds == rank
        good = [c for c in np.linspace(0.5, 0.995, 100) if (chosen := own & (p >= c)).any() and t[chosen].mean() >= PRECISION]
        thresholds.append(max(0.9, float(good[0])) if good else 2.0)
    return Model(tuple(trees), slope, intercept, tuple(thresholds))


def _scaled(tree, rate: float):
    return (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def probability(model: Model, x: Column) -> Column:
    """The calibrated probability of a proposal with features x, as one expression."""

    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(F.get(x, F.lit(tree[0])) <= tree[1], of(tree[2])).otherwise(of(tree[3]))

    total = sum((of(t) for t in model.trees), F.lit(0.0))
    return 1 / (1 + F.exp(-(total * model.slope + model.intercept)))


# Training sentences ------------------------------------------------------------------------------


def _check_digit(digits: str) -> str:
    return next(d for d in "0123456789" if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits + d))) % 10 == 0)


def sentences(n: int = 3000, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with the (start, rank, end) of the personal data in them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "re", "st", "le", "ou"]) for _ in range(r.randint(1, 3)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        kind, private = i % 4, i // 4 % 2 == 0
        sep = r.choice([" ", "-", ".", "/"])
        if kind == 0:
            at, dot = r.choice([("(at)", "."), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "(dot)"), (" @ ", "."), ("@", "[dot]"), ("@", "(dot)"), (" @", ".")])
            item, cue = f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}", ["mail", "contact", "write to"]
            if not private:
                item = r.choice([f"{word()} @ {word()}. {word()}", f"{word()}@ {word()} . {word()}"])
        elif kind == 1:
            dot = r.choice(["[.]", " . ", ". "])
            item, cue = dot.join(str(r.randint(0, 255)) for _ in range(4)), ["host", "server", "ip"]
            if not private:
                item = r.choice([". ".join(str(r.randint(0, 40)) for _ in range(4)), r.choice([".", ". "]).join(str(r.randint(256, 999)) for _ in range(4))])
        elif kind == 2:
            digits = number(r.choice([15, 15, 15, 13]))
            check = _check_digit(digits)
            digits += check if private else r.choice("0123456789".replace(check, ""))
            item, cue = sep.join(digits[k : k + 4] for k in range(0, len(digits), 4)), ["card", "visa", "credit"]
        else:
            shape = r.choice([(3, 3, 4), (2, 4, 4), (3, 4, 4)])
            groups = [number(k) for k in shape]
            item, cue = sep.join(groups), ["call", "phone", "tel", "mobile"]
            if r.random() < 0.5:
                item = f"({groups[0]}) {groups[1]}-{groups[2]}"
            if not private:
                item = r.choice([f"{r.randint(1, 28):02d}{sep}{r.randint(1, 12):02d}{sep}{r.randint(1900, 2030)}", sep.join(number(r.choice([2, 3, 4])) for _ in range(3))])
        lead = f"{r.choice(cue)} " if private and (r.random() < 0.9 or kind in (1, 3)) else r.choice(["", "version ", "page ", "total ", "on ", "see "])
        before = f"{word()} {word()} {lead}"
        text = f"{before}{item} {word()}. {word()}"
        out.append((text, [(len(before), kind, len(before) + len(item))] if private else []))
    return out


@cache
def _trained(spark: SparkSession) -> Model:
    made = sentences()
    rows = ",".join(f"({i},'{t}')" for i, (t, _) in enumerate(made))
    texts = spark.sql(f"SELECT * FROM VALUES {rows} AS t(i, text)")
    got = texts.select("i", F.inline(proposals(F.col("text")))).orderBy("i", "start", "rank", "end").collect()
    x = np.array([row.x for row in got])
    y = np.array([float((row.start, row.rank, row.end) in made[row.i][1]) for row in got])
    return fit(x, y)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_rank(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def find_private(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with n_email .. n_phone, base_spans and spans.

    base_spans and spans are arrays of (start, rank, end) by start and kind, rank
    being the place in KINDS; the counts are those of base spans. spans has the
    base spans and the proposals that the model chooses: of those that overlap
    each other the most probable, and none that overlaps a base span. A null or
    empty text has no spans.
    """
    model = _trained(docs.sparkSession)
    text = F.col("__text")
    rows, inner = renamed(docs)
    names = carried(docs, OUTPUTS)
    staged = rows.select(*[inner[c] for c in names], text_of(inner[text_col]).alias("__text"))
    staged = staged.withColumns({"__base": base_spans(text), "__wide": proposals(text)})
    threshold = F.array(*[F.lit(t) for t in model.thresholds])
    scored = F.transform("__wide", lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), probability(model, c["x"]).alias("p")))
    likely = F.filter(scored, lambda c: (c["p"] >= F.get(threshold, c["rank"])) & ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    def sweep(kept: Column, c: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        clash = F.coalesce(c["start"] < last["end"], F.lit(False))
        without = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(~clash, F.array_append(kept, c)).when(c["p"] > last["p"], F.array_append(without, c)).otherwise(kept)

    none = F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,end:int,p:double>>")
    added = F.aggregate(F.array_sort(likely), none, sweep)
    bare = F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))
    chosen = F.when(F.size("__wide") == 0, F.col("__base")).otherwise(F.array_sort(F.concat(F.col("__base"), bare)))
    return staged.select(
        *[F.col(inner[c]).alias(c) for c in names],
        *[_of_rank(F.col("__base"), rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)],
        F.col("__base").alias("base_spans"),
        chosen.alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[{}]") -> Column:
    """The text with each span replaced by its kind's mark."""
    names = F.array(*[F.lit(mark.format(k.upper())) for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        free = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], free, F.get(names, s["rank"]))).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
