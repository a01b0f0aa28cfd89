"""Queries over voice detections, latencies and growing records, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audio as A
from ..operators import finalize as Z
from ..operators import records as R
from ..operators import vectors as V
from . import fixtures as X
from . import models
from .interval_queries import _I15, _OV, _SPK

_S, _D, _V, _E = X.SENTENCES, X.DIAR, X.VAD, X.EMBEDDED
Q = {}

Q["P1_shift_char_times"] = (
    lambda spark, sf_dir: X.sentences(spark, sf_dir)
    .select("job_id", "ord", "start_ms", F.transform(F.sequence(F.lit(0), F.length("text")), lambda k: F.struct((k * 10).cast("long").alias("s"), (k * 10 + 9).cast("long").alias("e"))).alias("ts"))
    .select("job_id", "ord", F.explode(T.shifted_times("ts", F.col("start_ms"))).alias("t")).select("job_id", "ord", "t.s", "t.e"),
    X.with_views(_S) + """, t AS (SELECT job_id, ord, start_ms, unnest(range(length(text) + 1)) AS k FROM sentences)
    SELECT job_id, ord, start_ms + 10 * k AS s, start_ms + 10 * k + 9 AS e FROM t""",
)


def _detections(spark, sf_dir):
    v = X.vad(spark, sf_dir)
    raw = v.select("job_id", (F.col("start_ms") * 16 - 3000 + F.col("ord")).alias("start"), (F.col("end_ms") * 16 + F.col("ord") % 7).alias("end"))
    audio = X.sentences(spark, sf_dir).groupBy("job_id").agg((F.max("end_ms") * 16 - 1001).alias("n_samples"))
    return A.sample_segments(raw, audio, least_ms=250)


Q["P5_sample_segments"] = (
    _detections,
    X.with_views(_S, _V) + """, a AS (SELECT job_id, max(end_ms) * 16 - 1001 AS n FROM sentences GROUP BY job_id),
    c AS (SELECT v.job_id, n, greatest(0, start_ms * 16 - 3000 + ord) AS s, least(n, end_ms * 16 + ord % 7) AS e FROM vad v JOIN a USING (job_id)),
    m AS (SELECT job_id, s * 1000 // 16000 AS start_ms, CAST(least(ceil(n / 16.0e0), ceil(e / 16.0e0)) AS BIGINT) AS end_ms FROM c WHERE e > s)
    SELECT * FROM m WHERE end_ms - start_ms >= 250""",
)
Q["P5_raw_segments"] = (
    lambda spark, sf_dir: A.raw_segments(X.vad(spark, sf_dir).select("job_id", F.when(F.col("ord") % 6 == 5, F.array(F.col("start_ms") + 0.7)).otherwise(F.array(F.col("start_ms") + 0.7, F.col("end_ms") - 100.2)).alias("pair"))),
    X.with_views(_S, _V) + """, p AS (SELECT job_id, start_ms, CAST(trunc(end_ms - 100.2e0) AS BIGINT) AS end_ms FROM vad WHERE ord % 6 <> 5)
    SELECT * FROM p WHERE end_ms > start_ms AND end_ms - start_ms >= 200""",
)
_NUMBERS = ("peak", "rms", "dc", "clip_ratio", "silence_ratio")
Q["G4_waveform_profile"] = (
    lambda spark, sf_dir: A.waveform_profile(X.embedded(spark, sf_dir).select("job_id", F.explode("embedding").alias("x")).select("job_id", (F.col("x").cast("double") * 4).alias("x")), ["job_id"])
    .select("job_id", *[F.round(c, 6).alias(c) for c in _NUMBERS]),
    X.with_views(_E) + """, x AS (SELECT job_id, CAST(unnest(embedding) AS DOUBLE) * 4 AS x FROM embedded)
    SELECT job_id, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(avg(x), 6) AS dc,
      round(avg(CAST(abs(x) >= 0.999e0 AS DOUBLE)), 6) AS clip_ratio, round(avg(CAST(abs(x) < 0.001e0 AS DOUBLE)), 6) AS silence_ratio FROM x GROUP BY job_id""",
)
Q["I21_failed_diarization"] = (
    lambda spark, sf_dir: Z.finalize_realtime(X.sentences(spark, sf_dir), X.diar(spark, sf_dir), X.sentences(spark, sf_dir).filter("job_id % 4 = 1").select("job_id").distinct()),
    X.with_views(_S, _D, _OV, _SPK, _I15) + """ SELECT job_id, ord, CASE WHEN job_id % 4 = 1 THEN 'uncertain' ELSE kind END AS kind,
      CASE WHEN kind = 'single' AND job_id % 4 <> 1 THEN d_spk END AS speaker FROM cls""",
)
_EMITTED = """SELECT user_id AS session_id, event_id AS seq, event_id // 64 * 500 AS utterance_start_ms, event_id // 64 * 500 + 400 + event_id % 64 * 7 AS end_ms,
  event_id * 20 AS requested_ms, event_id * 20 + event_id % 13 AS started_ms, event_id * 20 + event_id % 13 + 40 + event_id % 101 AS emitted_ms,
  CASE WHEN user_id % 5 <> 0 THEN user_id END AS first_audio_ms FROM events"""


def _latency(spark, sf_dir):
    text = _EMITTED.replace("event_id // 64", "event_id div 64").replace("FROM events", "FROM {events}")
    return R.emission_latency(spark.sql(text, events=X.events(spark, sf_dir)))


_LATENCY = "WITH e AS (" + _EMITTED + """), r AS (SELECT *, sum(CASE WHEN utterance_start_ms IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, lag(utterance_start_ms) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM e) AS b),
  l AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS count, row_number() OVER w AS utterance_count,
    started_ms - requested_ms AS worker_wait_ms, emitted_ms - requested_ms AS request_to_emit_ms, coalesce(emitted_ms - first_audio_ms, -1) AS first_audio_to_partial_ms,
    coalesce(emitted_ms - first_audio_ms - utterance_start_ms, -1) AS utterance_to_partial_ms, coalesce(emitted_ms - first_audio_ms - end_ms, -1) AS audio_end_to_emit_ms,
    coalesce(requested_ms - first_audio_ms - end_ms, -1) AS audio_end_to_request_ms, coalesce(emitted_ms - lag(emitted_ms) OVER w, -1) AS update_interval_ms
    FROM r WINDOW w AS (PARTITION BY session_id, run ORDER BY seq))"""
Q["T20_emission_latency"] = (_latency, _LATENCY + " SELECT * FROM l")
_MEASURES = ["request_to_emit_ms", "utterance_to_partial_ms", "update_interval_ms"]
Q["T20_latency_percentiles"] = (
    lambda spark, sf_dir: R.latency_percentiles(_latency(spark, sf_dir), _MEASURES).withColumns({c: F.round(c, 6) for c in ("p50", "p95")}),
    _LATENCY + ", m AS (" + " UNION ALL ".join(f"SELECT session_id, '{m}' AS measure, CAST({m} AS DOUBLE) AS v FROM l" for m in _MEASURES) + """)
    SELECT session_id, measure, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM m WHERE v >= 0 GROUP BY session_id, measure""",
)


def _growing(spark, sf_dir):
    s = X.sentences(spark, sf_dir)
    again = s.unionByName(s.filter("ord % 2 = 0").withColumns({"ord": F.col("ord") + 1000, "start_ms": F.col("start_ms") + 30}))
    return Z.merge_growing(again, s.filter("ord % 3 = 0").select("job_id", "ord", "start_ms", "end_ms", F.lit(None).cast("int").alias("speaker")))


Q["J7_growing_records"] = (_growing, None)
Q["M1_speaker_moments"] = (
    lambda spark, sf_dir: models.apply_model(X.embedded(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "spk", "moments", "x", "m", "array<double>")
    .select("vec_id", F.round(F.col("m")[0], 6).alias("mean"), F.round(F.col("m")[1], 6).alias("power")),
    "SELECT vec_id, round(list_avg(CAST(embedding AS DOUBLE[])), 6) AS mean, round(list_avg(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS power FROM embeddings",
)
Q["E5_average_linkage"] = (lambda spark, sf_dir: V.average_linkage(X.embedded(spark, sf_dir).select("job_id", "ord", "embedding")), None)
