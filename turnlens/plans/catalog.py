"""All queries of the library proper, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.endpointing import Endpointing, endpoints
from . import fixtures as X
from . import final_queries, interval_queries, live_queries, models, record_queries, transcript_queries

_T3 = """
o AS (SELECT job_id, frame, prob, row_number() OVER (PARTITION BY job_id ORDER BY frame) AS rn FROM frames),
f AS (
  SELECT job_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS now, CAST(0 AS BIGINT) AS run, CAST(0 AS BIGINT) AS quiet, CAST(0 AS BIGINT) AS st, FALSE AS speaking,
    CAST(NULL AS BIGINT) AS o_start, CAST(NULL AS BIGINT) AS o_end, CAST(NULL AS VARCHAR) AS reason FROM o WHERE rn = 1
  UNION ALL
  SELECT job_id, rn, now, CASE WHEN ends THEN 0 ELSE run END, CASE WHEN ends THEN 0 ELSE quiet END,
    CASE WHEN ends THEN least(now, now - quiet + 100) WHEN speaking AND now - st >= 15000 THEN now ELSE st END, speaking AND NOT ends,
    CASE WHEN ends OR (speaking AND now - st >= 15000) THEN st END, CASE WHEN ends THEN least(now, now - quiet + 100) WHEN speaking AND now - st >= 15000 THEN now END,
    CASE WHEN ends THEN 'speech_end' WHEN speaking AND now - st >= 15000 THEN 'max_window' END
  FROM (
    SELECT job_id, rn, now, run, CASE WHEN was THEN quiet ELSE 0 END AS quiet, speaking, was AND quiet >= 600 AS ends,
      CASE WHEN speaking AND NOT was THEN greatest(st, now - run - 300, 0) ELSE st END AS st
    FROM (
      SELECT o.job_id, o.rn, f.now + 100 AS now, f.speaking AS was, f.st,
        CASE WHEN f.speaking THEN f.run WHEN o.prob >= 0.5e0 THEN f.run + 100 ELSE 0 END AS run,
        CASE WHEN f.speaking AND o.prob < 0.35e0 THEN f.quiet + 100 ELSE 0 END AS quiet,
        f.speaking OR (CASE WHEN o.prob >= 0.5e0 THEN f.run + 100 ELSE 0 END) >= 250 AS speaking
      FROM f JOIN o ON o.job_id = f.job_id AND o.rn = f.rn + 1) AS a) AS b)
SELECT job_id, o_start AS start_ms, o_end AS end_ms, reason FROM f WHERE reason IS NOT NULL
UNION ALL
SELECT job_id, CASE WHEN speaking THEN st ELSE greatest(st, now - run - 300, 0) END, now, 'session_stop'
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) AS back FROM f) AS z
WHERE back = 1 AND ((speaking AND now > st) OR (NOT speaking AND run > 0))"""

Q = dict(interval_queries.Q) | dict(transcript_queries.Q) | dict(final_queries.Q) | dict(record_queries.Q) | dict(live_queries.Q)
Q["T3_streaming_vad_endpoints"] = (
    lambda spark, sf_dir: endpoints(X.frames(spark, sf_dir), Endpointing()),
    "WITH RECURSIVE " + X.SENTENCES + "," + X.FRAMES + "," + _T3,
)
Q["M1_model_seam_punctuation"] = (
    lambda spark, sf_dir: models.apply_model(X.sentences(spark, sf_dir).select("job_id", "ord", "text"), "punc", "full-stop", "text", "punctuated", "string").select("job_id", "ord", F.col("punctuated")),
    X.with_views(X.SENTENCES) + " SELECT job_id, ord, CASE WHEN regexp_matches(text, '[.!?。！？…]$') THEN text ELSE text || '.' END AS punctuated FROM sentences",
)


def queries():
    return {name: fn for name, (fn, _sql) in Q.items()}


def oracle_sql():
    return {name: sql for name, (_fn, sql) in Q.items() if sql}
