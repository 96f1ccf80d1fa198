"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessio.llm import alignment, chat, decontamination, media, minhash, mixing, pii, resampling, scoring, sharding, simhash, tokens, toxicity
from accessio.llm.base import table

#: A conversation that holds control strings; added to the table.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8, fixed=True)
    return placed.select("doc_id", *sharding.OUTPUTS)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), fixed=True).drop("key")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT -1L AS conv_id, * FROM VALUES (0L, 'user', '{CONTROL_TEXT}'), (1L, 'assistant', '{CONTROL_TEXT}') AS t(turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_chats(rows)
    turns = F.transform(chat.parsed_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select("conv_id", "valid", "formatted", turns.alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", *tokens.OUTPUTS)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.find_private(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        *[f"n_{kind}" for kind in pii.KINDS],
        F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.media_column(table(spark, sf_dir, "documents"))
    coded = F.transform(F.arrays_zip("times", "codes"), lambda p: F.concat_ws(":", p["times"].cast("string"), F.lower(F.hex(p["codes"]))))
    return made.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(coded, ",").alias("feature"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), fixed=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("component_fp", "row_key")


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.learnt(docs, labels.where(~held))
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), fixed=True)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), fixed=True)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), fixed=True)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op5_chat": op5_chat,
    "op4_tokens": op4_tokens,
    "op6_scoring": op6_scoring,
    "op7_pii": op7_pii,
    "op8_media": op8_media,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment,
    "op12_resampling": op12_resampling,
    "op13_minhash": op13_minhash,
}

ORACLES = {
    "op5_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), linked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(replace(replace(text, '\', '\b'), '<|', '<\p')) + 11) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(before, 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM linked GROUP BY conv_id
""",
    "op12_resampling": r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))),
texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', 0, text FROM benchmark),
worded AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM worded),
counted AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT f, list_transform(range(len(hex(f)) // 2), lambda i: strpos('0123456789ABCDEF', substr(hex(f), 2 * i + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(hex(f), 2 * i + 2, 1)) - 17) AS b FROM (SELECT DISTINCT f FROM counted)),
bucketed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM counted JOIN bucketed USING (f) GROUP BY 1),
alls AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM totals),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM totals, alls),
weighed AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE side = 's' GROUP BY 1),
scored AS (SELECT id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS score FROM worded LEFT JOIN weighed USING (id) WHERE side = 's'),
drawn AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, 5 * count(*) OVER () // 100 AS most FROM scored WHERE n_words >= 20)
SELECT s.id AS doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= most THEN rank END AS rank FROM scored s LEFT JOIN drawn d ON s.id = d.id
""",
    "op13_minhash": r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM docs),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
classes AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS d, min(doc_id) AS doc_id FROM sets WHERE len(s) > 0 GROUP BY 1),
few AS (SELECT i.* FROM items i JOIN classes USING (doc_id)),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS shared FROM few a JOIN few b ON a.item = b.item AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT u, v FROM pairs WHERE 100 * shared >= 80 * (nu + nv - shared)),
sides AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS root FROM classes UNION SELECT s.v, r.root FROM reach r JOIN sides s ON s.u = r.u WHERE r.root < s.v),
roots AS (SELECT u, min(root) AS root FROM reach GROUP BY 1),
of_class AS (SELECT d, root FROM classes JOIN roots ON u = doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM sets LEFT JOIN of_class ON d = md5(array_to_string(list_sort(s), chr(10))) AND len(s) > 0
""",
}
