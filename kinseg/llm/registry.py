"""The queries of this subpackage by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as vocabulary

from kinseg.llm import align, balls, brown, chat, counts, exact, fertility, mixing, packing, pages, pieces, simhash, toxicity, wordids
from kinseg.llm.shared import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of conversation -1, read back from their formatted strings."""
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.digests(chat.render(chat.fold(chat.as_events(rows.unionByName(tricky)))))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\b'), '<|', '\l'), '|>', '\r'),
    '<s>', '\s'), '</s>', '\e'), '[INST]', '\i'), '[/INST]', '\j'), '<<SYS>>', '\y'), '<</SYS>>', '\z') AS escaped
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(escaped) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scores(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), kept=wordids.ALONE)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.links(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op13_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.ball_clusters(table(spark, sf_dir, "embeddings"))


def clusters_sql(rounds: int) -> str:
    """Plain k-means over all pairs of vectors and centroids, one pair of steps a round."""
    steps = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64)""", """e AS MATERIALIZED (SELECT r, unnest(generate_series(1, 64)) AS i, unnest(x) AS x FROM v)""", """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT x, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v) ORDER BY h, x LIMIT 8)"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT e.r, c.k, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN (SELECT k, unnest(generate_series(1, 64)) AS i, unnest(x) AS x FROM c{n}) c USING (i) GROUP BY ALL) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
  SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM e JOIN a{n} USING (r) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN c{rounds} c USING (k)"""


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


OPERATORS = [op1_simhash_dedup, op2_main_text, op3_quality_rules, op4_toxicity, op5_chat_format, op6_lm_scores, op7_packing, op8_exact_dedup, op9_sentencepiece, op10_token_counts, op11_token_alignment, op12_source_mixing, op13_ball_clusters]


def queries():
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in OPERATORS}


def oracles():
    return {"op5_chat_format": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op13_ball_clusters": clusters_sql(balls.ROUNDS)}
