"""The numbered operators as queries over the driver tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import byte_pairs, codes, contamination, dialogues, hard_negatives, lines, packing, page_text, resampling, retrieval, simhash, token_counts, toxicity
from cliploom.llm.common import read
from cliploom.session import durable_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op4_line_dedup", r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS newest FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.newest AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_decontamination", r"""
WITH norm AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
worded AS (
  SELECT side, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM norm),
sized AS (SELECT *, least(10, len(words)) AS size FROM worded WHERE side = 1 AND len(words) > 0),
windows AS (
  SELECT DISTINCT id AS item_id, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT id AS doc_id, size, i, array_to_string(list_slice(words, i, i + size - 1), ' ') AS win
  FROM (SELECT w.id, w.words, s.size, unnest(range(1, len(w.words) - s.size + 2)) AS i
        FROM worded w, sizes s WHERE w.side = 0 AND len(w.words) >= s.size)),
found AS (SELECT g.doc_id, g.i, g.size, w.item_id FROM grams g JOIN windows w ON g.win = w.win AND g.size = w.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT w.id AS doc_id, len(w.words) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM worded w LEFT JOIN hit h ON w.id = h.doc_id LEFT JOIN items i ON w.id = i.doc_id WHERE w.side = 0
""")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contaminated_words(
        read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark").select("item_id", "text"))
    n_hit = contamination.hit_words(F.col("hits"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_token_codes")
def op1_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{durable_dir(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    codes.write_codes(read(spark, folder, "documents").select("doc_id", "text"), path)
    return codes.read_documents(spark, path, checksums=True)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_pieces(read(spark, folder, "documents").select("doc_id", "text")))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read(spark, folder, "documents").select("doc_id", "text"))


@query("op8_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""")
def op8_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("bands"))
    return retrieval.top_products(vectors, k=20, every=20).withColumnRenamed("frame_id", "vec_id")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_documents(docs, read(spark, folder, "labels").select("doc_id", "toxic"))
    scored = model.score(docs)
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_page_text")
def op5_page_text(spark: SparkSession, folder: str) -> DataFrame:
    found = page_text.page_texts(read(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op7_chat_rotation", """
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS said, CAST(floor(turn / 512) AS BIGINT) AS part FROM conversations),
views AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
pieces AS (
  SELECT s.conv_id, v.speaker, s.part, s.turn, s.role, s.said, s.role = v.speaker AS own,
         CASE WHEN s.role = v.speaker THEN '<|im_start|>assistant' || chr(10)
              WHEN s.role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || s.role || chr(10) END AS head,
         s.said || '<|im_end|>' || chr(10) AS body
  FROM said s JOIN views v ON s.conv_id = v.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER w - length(body) AS b, sum(length(head) + length(body)) OVER w AS e
  FROM pieces
  WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn, role, said ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn, role, said) AS text,
       coalesce(string_agg(CAST(b AS VARCHAR) || ':' || CAST(e - 1 AS VARCHAR), ',' ORDER BY turn, role, said) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
""")
def op7_chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    found = dialogues.rotate(read(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"]))
    return found.select("conv_id", "speaker", "part", "n_turns", "text", F.array_join(spans, ",").alias("mask"))


@query("op11_byte_pairs")
def op11_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    coded = byte_pairs.encode(read(spark, folder, "documents").select("doc_id", "text"))
    return byte_pairs.decode(coded).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_importance_resampling", r"""
WITH steps AS (
  SELECT list(list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS tab FROM range(0, 256) r(i)),
worded AS (
  SELECT side, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
grams AS (
  SELECT side, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS gram
  FROM worded WHERE len(words) > 0),
distinct_grams AS (SELECT DISTINCT gram FROM grams),
hexed AS (SELECT gram, hex(encode(gram)) AS h FROM distinct_grams),
summed AS (
  SELECT gram, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) % 10000 AS bucket
  FROM hexed, steps),
placed AS (SELECT g.side, g.id, s.bucket FROM grams g JOIN summed s USING (gram)),
counts AS (
  SELECT b AS bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t
  FROM range(0, 10000) r(b) LEFT JOIN placed ON bucket = b GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                                 / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (
  SELECT id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT w.id AS doc_id, len(w.words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM worded w LEFT JOIN weights x ON w.id = x.id WHERE w.side = 0),
ready AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= (25 * n) // 100 THEN place END AS rank
FROM scored s LEFT JOIN ready r ON s.doc_id = r.doc_id
""")
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT n.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY n.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM near n JOIN scored s ON n.anchor_id = s.anchor_id AND NOT s.same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("frame_id"), label.alias("clip_id"), F.col("embedding").alias("bands"))
    return hard_negatives.hard_negatives(vectors).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
