"""Endpointing: hand-worked cases, and the stream against the batch."""

import pytest

from turnlens.plans import fixtures as X
from turnlens.streaming.endpointing import Endpointing, endpoints, stream_endpoints
from turnlens.streaming.sinks import start

SCHEMA = "job_id long, frame long, prob double"


def run(spark, probs, config):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate(probs)], SCHEMA)
    return sorted((r["start_ms"], r["end_ms"], r["reason"]) for r in endpoints(df, config).collect())


def test_hysteresis(spark):
    soft = Endpointing(min_speech=200, min_silence=300, pre_roll=100, post_roll=100)
    assert run(spark, [0.1, 0.8, 0.8, 0.9, 0.9, 0.1, 0.1, 0.1], soft) == [(0, 600, "speech_end")]
    cut = Endpointing(min_speech=100, pre_roll=0, max_window=500)
    assert run(spark, [0.9] * 8, cut) == [(0, 500, "max_window"), (500, 800, "session_stop")]
    assert run(spark, [0.1, 0.9], Endpointing()) == [(0, 200, "session_stop")]
    assert run(spark, [0.1, 0.1], Endpointing()) == []


def test_configuration():
    with pytest.raises(ValueError):
        Endpointing(start_prob=0.2, end_prob=0.5)
    with pytest.raises(ValueError):
        Endpointing(frame=0)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    frames = X.frames(spark, sf_dir).filter("job_id < 4").select("job_id", "frame", "prob").cache()
    want = sorted(tuple(r) for r in endpoints(frames).collect())
    frames.createOrReplaceTempView("frames_now")
    stops = spark.sql("SELECT job_id, max(frame) + 1 AS frame, CAST(NULL AS DOUBLE) AS prob FROM frames_now GROUP BY job_id")
    everything = frames.unionByName(stops)
    for part, rule in enumerate(("frame < 9", "frame >= 9 AND frame < 30", "frame >= 30")):
        everything.filter(rule).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={part}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    start(stream_endpoints(stream), str(tmp_path / "out"), ["job_id", "start_ms"], str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("job_id", "start_ms", "end_ms", "reason").collect())
    assert got == want
