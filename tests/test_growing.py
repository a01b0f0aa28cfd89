"""Growing records, linkage in rounds, detections and stand-ins against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.operators import audio as A
from turnlens.operators import finalize as Z
from turnlens.operators import vectors as V
from turnlens.plans import models

SEGMENTS = "job_id long, ord long, start_ms long, end_ms long, speaker int, text string"


@pytest.mark.parametrize("seed", range(3))
def test_growing_records(spark, seed):
    draw, records, given = random.Random(seed), [], []
    for job in range(6):
        for n in range(draw.choice([0, 1, 12])):
            a = draw.randrange(0, 4000, 50)
            records.append((job, n, a, a + draw.randrange(0, 900, 50), draw.choice([None, 1, 2]), "r"))
        for n in range(draw.choice([0, 2, 30])):
            a = draw.randrange(0, 6000, 50)
            given.append((job, n, a, a + draw.choice([0, 50, 200, 400, 900]), draw.choice([None, 3, 4]), draw.choice(["t", "t", "t", " "])))
    want = []
    for job in range(6):
        known = [[a, b, "kept", n, x] for j, n, a, b, x, _ in sorted(records, key=lambda r: (r[0], r[2], r[1])) if j == job]
        for j, n, a, b, x, t in given:
            if j != job or not t.strip():
                continue
            best, most = None, 0
            for r in known:
                if min(b, r[1]) - max(a, r[0]) > most:
                    best, most = r, min(b, r[1]) - max(a, r[0])
            if best and most / (b - a) >= 0.8:
                best[4] = x
            else:
                known.append([a, b, "new", n, x])
        want += [(job, *r[2:]) for r in known]
    got = [tuple(r) for r in Z.merge_growing(spark.createDataFrame(given, SEGMENTS), spark.createDataFrame(records, SEGMENTS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_islands_are_folded_in_batches(spark):
    """40,000 islands: one call of Python each took minutes."""
    rows = spark.range(40_000).selectExpr("id % 7 AS job_id", "id AS ord", "id * 100 AS start_ms", "id * 100 + 50 AS end_ms", "cast(id % 3 AS int) AS speaker", "'t' AS text")
    made = Z.merge_growing(rows, rows.filter("ord % 2 = 0").drop("text").withColumn("speaker", F.lit(None).cast("int")))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    assert {(r["origin"], r["n"], r["s"]) for r in made.groupBy("origin").agg(F.count("*").alias("n"), F.sum("speaker").alias("s")).collect()} == {("kept", 20_000, sum(k % 3 for k in range(0, 40_000, 2))), ("new", 20_000, sum(k % 3 for k in range(1, 40_000, 2)))}


def test_linkage_in_rounds(spark):
    rng, rows = np.random.default_rng(3), []
    for job, n in enumerate((1, 2, 25, 60)):
        centres = rng.normal(size=(5, 8))
        rows += [(job, k, (centres[k % 5] + rng.normal(size=8) * 0.7).tolist()) for k in range(n)]
    got = {}
    for r in V.average_linkage(spark.createDataFrame(rows, "job_id long, ord long, embedding array<double>")).collect():
        got.setdefault(r["job_id"], {})[r["ord"]] = r["cluster"]
    for job, n in enumerate((1, 2, 25, 60)):
        x = np.array([v for j, _, v in rows if j == job])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = V._average_linkage(x @ x.T, 0.4)
        assert [got[job][k] for k in range(n)] == [int(np.flatnonzero(label == c)[0]) for c in label]


def test_detections(spark):
    raw = spark.createDataFrame([(1, -5, 8000), (1, 15, 17), (1, 100, 100), (1, 16_000, 99_999), (1, None, 5), (2, 0, 10)], "job_id long, start long, end long")
    audio = spark.createDataFrame([(1, 32_001)], "job_id long, n_samples long")
    assert sorted(tuple(r) for r in A.sample_segments(raw, audio).collect()) == [(1, 0, 2), (1, 0, 500), (1, 1000, 2001)]
    assert sorted(tuple(r) for r in A.sample_segments(raw, audio, least_ms=501).collect()) == [(1, 1000, 2001)]
    text = spark.createDataFrame([(1, "16", "32000"), (1, "x", "5")], "job_id long, start string, end string")
    assert [tuple(r) for r in A.sample_segments(text, audio).collect()] == [(1, 1, 2000)]
    pairs = spark.createDataFrame([(1, [0.9, 300.2]), (1, [5.0]), (1, [9.0, 9.0]), (1, [0.0, 199.0]), (1, None)], "job_id long, pair array<double>")
    assert [tuple(r) for r in A.raw_segments(pairs).collect()] == [(1, 0, 300)]


def test_stand_ins(spark):
    assert models.registered("asr") and models.registered("spk")
    rows = spark.createDataFrame([(1, [0.0] * 100 + [0.5] * 50), (2, [])], "id long, x array<double>")
    assert {r["id"]: r["t"] for r in models.apply_model(rows, "asr", "loud", "x", "t", "string").collect()} == {1: "la", 2: ""}
