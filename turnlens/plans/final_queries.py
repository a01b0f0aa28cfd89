"""Queries over finalising, audio and persistence operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audio as A
from ..operators import finalize as Z
from ..operators import intervals as I
from . import fixtures as X
from .interval_queries import _DUR, _I15, _J6, _MERGE6, _OV, _PLAN, _SPK, _durations

_S, _D, _V, _E = X.SENTENCES, X.DIAR, X.VAD, X.EMBEDDED
Q = {}


def _records(spark, sf_dir):
    return X.vad(spark, sf_dir).filter("ord % 4 <> 1").select("job_id", "ord", "start_ms", "end_ms", (F.col("ord") % 5).cast("int").alias("speaker"))


_REC = "rec AS (SELECT job_id, ord, start_ms, end_ms, CAST(ord % 5 AS INT) AS speaker FROM vad WHERE ord % 4 <> 1)"
_BEST = """bst AS (SELECT * FROM (SELECT s.job_id, s.ord, r.ord AS record, s.end_ms - s.start_ms AS len, least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) AS ov,
    row_number() OVER (PARTITION BY s.job_id, s.ord ORDER BY least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) DESC, r.start_ms, r.ord) AS rn
  FROM sentences s JOIN rec r ON s.job_id = r.job_id AND s.start_ms < r.end_ms AND r.start_ms < s.end_ms) AS t WHERE rn = 1),
mt AS (SELECT s.job_id, s.ord, s.speaker, CASE WHEN CAST(ov AS DOUBLE) / len >= 0.8e0 THEN record END AS record FROM sentences s LEFT JOIN bst USING (job_id, ord))"""
Q["J7_best_covered_record"] = (
    lambda spark, sf_dir: Z.best_covered(X.sentences(spark, sf_dir), _records(spark, sf_dir)),
    X.with_views(_S, _V, _REC, _BEST) + " SELECT job_id, ord, record FROM mt",
)
Q["J8_merge_fallback_transcript"] = (
    lambda spark, sf_dir: Z.merge_fallback(X.sentences(spark, sf_dir), _records(spark, sf_dir)),
    X.with_views(_S, _V, _REC, _BEST) + """ SELECT job_id, 'new' AS origin, ord, speaker FROM mt WHERE record IS NULL UNION ALL
    SELECT r.job_id, 'kept', r.ord, CASE WHEN u.job_id IS NULL THEN r.speaker ELSE u.speaker END FROM rec r LEFT JOIN (SELECT job_id, record, max_by(speaker, ord) AS speaker FROM mt WHERE record IS NOT NULL GROUP BY job_id, record) AS u ON r.job_id = u.job_id AND r.ord = u.record""",
)


def _candidates(spark, sf_dir):
    s = X.sentences(spark, sf_dir)
    return s.select("job_id", "ord", F.col("end_ms").alias("start_ms"), (F.col("end_ms") + F.expr("(ord * 131) % 700") + 1).alias("end_ms"), F.when(F.col("ord") % 5 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.concat(F.lit("extra "), F.col("ord").cast("string"))).alias("text"))


Q["I19_trim_boundary_word"] = (
    lambda spark, sf_dir: X.sentences(spark, sf_dir).withColumn("head", F.concat(F.lit("«"), F.regexp_extract("text", r"\S+\s*$", 0), F.lit(" and more"))).select("job_id", "ord", F.when(F.col("ord") % 2 == 0, Z.trim_boundary_word("text", "head")).otherwise(F.col("text")).alias("text")),
    X.with_views(_S) + r" SELECT job_id, ord, CASE WHEN ord % 2 = 0 THEN regexp_replace(regexp_replace(text, '\S+\s*$', ''), '\s+$', '') ELSE text END AS text FROM sentences",
)
Q["I21_finalize_realtime"] = (
    lambda spark, sf_dir: Z.finalize_realtime(X.sentences(spark, sf_dir), X.diar(spark, sf_dir)),
    X.with_views(_S, _D, _OV, _SPK, _I15) + " SELECT job_id, ord, kind, CASE WHEN kind = 'single' THEN d_spk END AS speaker FROM cls",
)


def _tried(spark, sf_dir):
    turns = I.plan_turns(X.sentences(spark, sf_dir), X.diar(spark, sf_dir))
    return turns.withColumn("text", F.when((F.col("start_ms") + F.col("ord")) % 7 == 0, " ").otherwise("words"))


_TRIED = "tr AS (SELECT m6.*, CASE WHEN (m6.start_ms + m6.ord) % 7 = 0 THEN ' ' ELSE 'words' END AS text FROM m6 JOIN plan p ON m6.job_id = p.job_id AND m6.ord = p.ord AND p.action = 'retranscribe'), tg AS (SELECT job_id, ord, bool_and(trim(text) <> '') AS ok, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM tr GROUP BY job_id, ord), rs AS (SELECT p.job_id, p.ord, action, CASE WHEN action <> 'retranscribe' THEN action WHEN coalesce(ok, FALSE) THEN 'replaced' ELSE 'fallback' END AS outcome, CASE WHEN action = 'retranscribe' AND coalesce(ok, FALSE) THEN n ELSE 1 END AS n_rows, CASE WHEN action = 'retranscribe' THEN coalesce(ms, 0) ELSE 0 END AS asr_ms FROM plan p LEFT JOIN tg USING (job_id, ord))"
_ALL = (_S, _D, _DUR, _OV, _SPK, _I15, _J6, _MERGE6, _PLAN, _TRIED)
_resolved = lambda spark, sf_dir: Z.resolve_retranscription(I.retranscription_plan(X.sentences(spark, sf_dir), X.diar(spark, sf_dir)).select("job_id", "ord", "action"), _tried(spark, sf_dir))
Q["I17_resolve_retranscription"] = (_resolved, X.with_views(*_ALL) + " SELECT * FROM rs")
Q["G9_resolution_stats"] = (
    lambda spark, sf_dir: Z.resolution_stats(_resolved(spark, sf_dir), _durations(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6)),
    X.with_views(*_ALL) + """ SELECT job_id, count(*) FILTER (WHERE action = 'keep') AS kept, count(*) FILTER (WHERE action = 'retranscribe') AS targeted, count(*) FILTER (WHERE outcome = 'replaced') AS replaced,
    count(*) FILTER (WHERE outcome = 'fallback') AS fallback, CAST(sum(asr_ms) AS BIGINT) AS asr_ms, round(CAST(sum(asr_ms) AS DOUBLE) / max(duration_ms), 6) AS ratio FROM rs JOIN dur USING (job_id) GROUP BY job_id""",
)
Q["I7_quietest_cut"] = (
    lambda spark, sf_dir: A.quietest_cut(X.frames(spark, sf_dir).select("job_id", F.expr("frame div 20").alias("turn"), (F.col("frame") * 100).alias("cut_ms"), (F.expr("frame div 20") * 2000 + 1500).alias("target_ms"), F.col("prob").alias("rms")), ["job_id", "turn"]),
    X.with_views(_S, X.FRAMES) + " SELECT job_id, frame // 20 AS turn, min_by(frame * 100, row(prob, abs(frame // 20 * 2000 + 1500 - frame * 100), -frame)) AS cut_ms FROM frames GROUP BY job_id, frame // 20",
)
Q["F15_rms_normalize"] = (
    lambda spark, sf_dir: X.embedded(spark, sf_dir).select("vec_id", F.posexplode(A.rms_normalize("embedding", 0.3)).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")),
    """WITH f AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), g AS (SELECT vec_id, sqrt(avg(v * v)) AS rms, max(abs(v)) AS top FROM f GROUP BY vec_id)
    SELECT vec_id, pos, round(v * CASE WHEN rms <= 1e-6 OR rms >= 0.3e0 THEN 1.0e0 ELSE least(0.3e0 / rms, 3.0e0, CASE WHEN top > 0 THEN 0.99e0 / top ELSE 3.0e0 END) END, 6) AS x FROM f JOIN g USING (vec_id)""",
)
Q["S15_resample"] = (
    lambda spark, sf_dir: A.resample(X.embedded(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples")), 48, 32).select("id", F.posexplode("samples").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")),
    """WITH k AS (SELECT vec_id AS id, embedding, unnest(range(len(embedding) * 32 // 48)) AS pos FROM embeddings), p AS (SELECT id, pos, embedding, pos * 48 / 32.0e0 AS place, CAST(floor(pos * 48 / 32.0e0) AS INT) AS low FROM k)
    SELECT id, pos, round(CAST(embedding[low + 1] AS DOUBLE) + (CAST(embedding[CAST(least(low + 2, len(embedding)) AS INT)] AS DOUBLE) - CAST(embedding[low + 1] AS DOUBLE)) * (place - low), 6) AS x FROM p""",
)
def _partials(spark, sf_dir):
    s = X.sentences(spark, sf_dir).withColumn("w", F.split(T.strip("text"), r"\s+"))
    step = s.select((F.col("job_id") * 1000 + F.col("ord")).alias("utterance"), "w", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return step.select("utterance", F.col("k").cast("long").alias("seq"), (F.col("k") * 600).cast("long").alias("start_ms"), (F.col("k") * 600 + 2000).cast("long").alias("end_ms"), F.array_join(F.slice("w", F.col("k") * 2 + 1, F.lit(8)), " ").alias("text"))


Q["W10_compose_partials"] = (lambda spark, sf_dir: Z.compose_partials(_partials(spark, sf_dir)), None)
Q["T6_partial_requests"] = (
    lambda spark, sf_dir: Z.partial_requests(X.sentences(spark, sf_dir).select((F.col("job_id") * 1000 + F.col("ord")).alias("utterance"), "start_ms", F.explode(F.sequence("start_ms", "end_ms", F.lit(100).cast("long"))).alias("now_ms"))),
    "WITH RECURSIVE " + _S + """, f AS (SELECT job_id * 1000 + ord AS utterance, start_ms, end_ms AS fin, start_ms + 400 AS due FROM sentences WHERE end_ms >= start_ms + 400
      UNION ALL SELECT utterance, start_ms, fin, due + 600 FROM f WHERE due + 600 <= fin) SELECT utterance, greatest(start_ms, due - 5000) AS from_ms, due AS end_ms FROM f""",
)
Q["T10_clip_requests"] = (
    lambda spark, sf_dir: X.sentences(spark, sf_dir).select("job_id", "ord", F.greatest("start_ms", F.lit(2000).cast("long")).alias("start_ms"), F.least("end_ms", F.lit(9000).cast("long")).alias("end_ms")).filter("end_ms > start_ms"),
    X.with_views(_S) + " SELECT * FROM (SELECT job_id, ord, greatest(start_ms, 2000) AS start_ms, least(end_ms, 9000) AS end_ms FROM sentences) AS t WHERE end_ms > start_ms",
)
Q["T13_compact_job_log"] = (
    lambda spark, sf_dir: Z.compact_log(X.events(spark, sf_dir).selectExpr("user_id AS job", "event_id AS seq", "CASE WHEN event_id % 53 = 0 THEN 'snapshot' ELSE 'upsert' END AS kind", "event_id % 6 AS id", "value")),
    """WITH l AS (SELECT user_id AS job, event_id AS seq, CASE WHEN event_id % 53 = 0 THEN 'snapshot' ELSE 'upsert' END AS kind, event_id % 6 AS id, value FROM events), c AS (SELECT job, max(seq) AS cut FROM l WHERE kind = 'snapshot' GROUP BY job)
    SELECT l.job, id, max_by(value, seq) AS value FROM l LEFT JOIN c ON l.job = c.job WHERE kind = 'upsert' AND (cut IS NULL OR seq > cut) GROUP BY l.job, id""",
)
_PRIORITY = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 4 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 10 ELSE 15 END"
Q["C6_split_long_lines"] = (lambda spark, sf_dir: Z.split_long_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), 300), None)
Q["C8_bounded_join"] = (
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", Z.bounded_join(F.split("text", "\n", -1), 400).alias("joined")),
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS c FROM documents),
    q AS (SELECT *, array_to_string(c, chr(10) || chr(10)) AS w, greatest(1, greatest(1, 400 - 2 * (len(c) - 1)) // greatest(len(c), 1)) AS share FROM p)
    SELECT doc_id, CASE WHEN length(w) <= 400 THEN w ELSE left(array_to_string(list_transform(c, lambda x: CASE WHEN length(x) <= share THEN x ELSE left(x, share - 1) || '…' END), chr(10) || chr(10)), 400) END AS joined FROM q""",
)
Q["G11_processing_count"] = (
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.count_if(F.col("o_orderstatus") != "F").alias("processing")),
    "SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS processing FROM orders",
)
Q["L4_timeline_sort"] = (
    lambda spark, sf_dir: X.diar(spark, sf_dir).withColumn("place", F.expr("row_number() over (partition by job_id order by start_ms, end_ms, seg_ord)").cast("long")).select("job_id", "seg_ord", "place"),
    X.with_views(_S, _D) + " SELECT job_id, seg_ord, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, seg_ord) AS place FROM diar",
)
Q["C11_normalize_title"] = (
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(F.slice(F.split(T.strip("text"), r"\s+"), 1, 14), " ").alias("title")),
    r"SELECT doc_id, array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:14], ' ') AS title FROM documents",
)
