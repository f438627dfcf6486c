"""Registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmetrics.llm import chat, decontaminate, directcodes, langid, licenses, negatives, packing, secrets, simhash, sketches, toxicity, turns, warc
from groundmetrics.llm.common import shared_folder

try:
    import public_tokenizers

    TOKENIZER, WORD_TOKENIZER = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
except ImportError:
    TOKENIZER, WORD_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark, sf_dir):
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_licenses(spark, sf_dir):
    return licenses.of_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


def op9_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return decontaminate.search(docs, decontaminate.build(docs, table(spark, sf_dir, "benchmark")))


def op11_hard_negatives(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(e.select(F.col("vec_id").alias("id"), label.alias("label"), (F.col("vec_id") % 50 == 0).alias("anchor"), F.col("embedding").alias("vector")))


def op12_token_codes(spark, sf_dir):
    folder = shared_folder(spark)
    directcodes.write(table(spark, sf_dir, "documents"), WORD_TOKENIZER, folder, end_id=2)
    return directcodes.read_documents(spark, folder)


def op13_turn_repair(spark, sf_dir):
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_secrets, op3_fingerprints, op4_packing, op5_licenses, op6_simhash, op7_toxicity, op8_chat, op9_language, op10_decontamination, op11_hard_negatives, op12_token_codes, op13_turn_repair, pipeline)}

ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
g AS (SELECT d, max(page_id) AS top FROM q WHERE n >= 1000 GROUP BY d)
SELECT q.page_id, q.n AS payload_bytes, q.d AS payload_digest,
       CASE WHEN q.n >= 1000 AND q.page_id < g.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN q.n >= 1000 AND q.page_id < g.top THEN g.top END AS refers_to
FROM q LEFT JOIN g USING (d)""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
