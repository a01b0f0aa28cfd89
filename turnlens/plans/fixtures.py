"""Domain views over the driver tables: sentences, speaker turns, voice segments and an event log.

Each view is one SQL text that Spark and DuckDB read alike, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENTENCES = """
sentences AS (
  SELECT conv_id AS job_id, turn AS ord, role, text, CAST(turn % 3 AS INT) AS speaker, start_ms, start_ms + dur AS end_ms
  FROM (
    SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
    FROM (SELECT conv_id, turn, role, text, CAST(length(text) * 10 AS BIGINT) AS dur,
        CAST((turn * turn * 137) % 900 AS BIGINT) AS gap FROM conversations) AS c) AS d)"""

DIAR = """
cuts AS (
  SELECT *, CAST((ord * 53) % 240 AS BIGINT) AS sh,
    CAST(floor((end_ms - start_ms) * ((ord * 37 + job_id * 11) % 60 + 20) / 100.0e0) AS BIGINT) AS cut
  FROM sentences),
diar AS (
  SELECT * FROM (
    SELECT job_id, CAST(2 * ord AS BIGINT) AS seg_ord, greatest(start_ms - sh, 0) AS start_ms, start_ms + cut AS end_ms,
      CAST(ord % 3 AS INT) AS speaker FROM cuts
    UNION ALL
    SELECT job_id, CAST(2 * ord + 1 AS BIGINT), start_ms + cut, greatest(start_ms + cut, end_ms - sh * ((job_id + ord) % 5)),
      CAST((ord + (job_id + ord) % 2) % 3 AS INT) FROM cuts WHERE (job_id + ord) % 7 <> 0) AS u
  WHERE start_ms < end_ms)"""

VAD = """
vad AS (
  SELECT job_id, ord, start_ms + (ord * 71) % 400 AS start_ms, end_ms + (ord * 89) % 700 AS end_ms
  FROM sentences WHERE (job_id + ord) % 3 <> 0)"""

#: Jobs of 120 vectors (three minutes, one for each 1.5 s), so that more data are more jobs, not longer ones.
EMBEDDED = """
embedded AS (SELECT vec_id, CAST(vec_id // 120 AS BIGINT) AS job_id, CAST(vec_id % 120 AS BIGINT) AS ord, label, embedding FROM embeddings)"""

#: Voice probabilities, one frame of 100 ms after another, eight to a sentence.
FRAMES = """
frames AS (
  SELECT job_id, CAST(ord * 8 + k AS BIGINT) AS frame, (((job_id * 13 + (ord * 8 + k) * (ord * 8 + k) * 7 + k) % 100) / 100.0e0 + role_bias) / 2 AS prob
  FROM (SELECT job_id, ord, CASE WHEN ord % 3 = 2 THEN 0.05e0 ELSE 0.95e0 END AS role_bias FROM sentences) AS s
  CROSS JOIN (SELECT unnest(range(8)) AS k) AS t)"""


def with_views(*views: str) -> str:
    """The head of a statement that defines the views."""
    return "WITH " + ",".join(views)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return spark.sql(with_views(SENTENCES.replace("FROM conversations", "FROM {conversations}")) + " SELECT * FROM sentences", conversations=conversations)


def diar(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return spark.sql(with_views(SENTENCES.replace("FROM conversations", "FROM {conversations}"), DIAR) + " SELECT * FROM diar", conversations=conversations)


def vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return spark.sql(with_views(SENTENCES.replace("FROM conversations", "FROM {conversations}"), VAD) + " SELECT * FROM vad", conversations=conversations)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    text = FRAMES.replace("unnest(range(8))", "explode(sequence(0, 7))")
    return spark.sql(with_views(SENTENCES.replace("FROM conversations", "FROM {conversations}"), text) + " SELECT * FROM frames", conversations=conversations)


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(vec_id div 120 AS BIGINT) AS job_id", "CAST(vec_id % 120 AS BIGINT) AS ord", "label", "embedding")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")
