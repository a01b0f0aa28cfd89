"""Streams against the batch forms, over micro-batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from turnlens.operators import finalize as Z
from turnlens.operators import transcripts as P
from turnlens.streaming import live as V
from turnlens.streaming import sessions as L


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs rows (sorted by arrival) through a stream in four files; it is stopped and started again after every two."""

    def run(rows, schema, made, mode):
        table, out = spark.createDataFrame(rows, schema), str(tmp_path / "out")
        size = -(-len(rows) // 4)
        for k in range(4):
            spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
            if k % 2:
                source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
                keep = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/e={epoch}")
                query = made(source).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
                query.awaitTermination(120)
        return table, spark.read.parquet(f"{out}/*").drop("epoch").collect()

    return run


def same(rows, table):
    return sorted(map(tuple, rows), key=str) == sorted(map(tuple, table.collect()), key=str)


def test_requests(streamed):
    draw, rows = random.Random(1), []
    for t in sorted(draw.sample(range(30_000), 500)):
        u = draw.randrange(3)
        rows.append((u, 100 * u, t))
    table, got = streamed(rows, "utterance long, start_ms long, now_ms long", V.stream_requests, "append")
    assert same([(r["utterance"], r["from_ms"], r["end_ms"]) for r in got], Z.partial_requests(table))


def test_confirmations(streamed):
    draw = random.Random(2)
    rows = [(draw.randrange(3), k, draw.randrange(9000), draw.random() < 0.7) for k in range(200)]
    table, got = streamed(rows, "session_id long, seq long, end_ms long, ok boolean", V.stream_confirmations, "append")
    assert same(got, L.confirmations(table))


def test_current_work(streamed):
    draw = random.Random(3)
    rows = [(draw.randrange(3), k, k // 20 + draw.randrange(3)) for k in range(200)]
    table, got = streamed(rows, "key long, seq long, generation long", V.stream_current_work, "append")
    assert same([r[:3] for r in got], L.current_work(table))
    last = max((r for r in got if r["key"] == 1), key=lambda r: r["seq"])
    assert last["dropped"] == sum(r[0] == 1 and r[1] < last["seq"] for r in rows) - sum(r["key"] == 1 and r["seq"] < last["seq"] for r in got)


def test_tail(spark, streamed):
    draw = random.Random(4)
    rows = [(draw.randrange(4), k, "done" if k in (90, 150, 160) else "upsert", draw.randrange(5)) for k in range(200)]
    people = spark.createDataFrame([(j, s, s * 40 + j) for j in range(4) for s in (0, 1, 2, 4)], "job long, subscriber long, since long")
    table, got = streamed(rows, "job long, seq long, kind string, id long", lambda s: V.stream_tail(s, people), "append")
    want = L.replayed(table, people).filter("part = 'tail'").select("job", "subscriber", "seq", "kind", "id")
    assert same(got, want) and got


def newest(rows, keys):
    best = {}
    for r in rows:
        k = tuple(r[c] for c in keys)
        if k not in best or r["seq"] > best[k]["seq"] or (r["seq"] == best[k]["seq"] and not r["live"]):
            best[k] = r
    return [r for r in best.values() if r["live"]]


def test_log(streamed):
    draw = random.Random(5)
    rows = [(draw.randrange(3), k, "snapshot" if draw.random() < 0.05 else "upsert", draw.randrange(6), float(k)) for k in range(200)]
    table, got = streamed(rows, "job long, seq long, kind string, id long, value double", V.stream_log, "update")
    assert same([(r["job"], r["id"], r["value"]) for r in newest(got, ["job", "id"])], Z.compact_log(table))


def test_transcripts(streamed):
    draw, rows = random.Random(6), []
    for k in range(200):
        start = draw.randrange(0, 4000, 100)
        rows.append((draw.randrange(3), k, draw.choice(["delta", "partial", "partial"]), start, start + draw.randrange(50, 900)))
    table, got = streamed(rows, "session_id long, seq long, kind string, start_ms long, end_ms long", V.stream_transcripts, "update")
    final = [(r["session_id"], r["seq"], r["kind"], r["start_ms"], r["end_ms"]) for r in newest(got, ["session_id", "kind", "start_ms"])]
    assert same(final, P.reduce_transcripts(table).select("session_id", "seq", "kind", "start_ms", "end_ms"))


def test_buffers(spark, streamed):
    draw, rows = random.Random(7), []
    for k in range(120):
        start = 50 * k
        rows.append((k % 3, k, "confirm", None, start - 900) if draw.random() < 0.15 else (k % 3, k, "buffer", start, start + draw.randrange(10, 400)))
    table, got = streamed(rows, "session_id long, seq long, kind string, start_ms long, end_ms long", V.stream_buffers, "update")
    last = {s: max(r["version"] for r in got if r["session_id"] == s) for s in range(3)}
    kept = [(r["session_id"], r["start_ms"], r["end_ms"]) for r in got if r["version"] == last[r["session_id"]] and r["end_ms"] is not None]
    marks = table.filter("kind = 'confirm'").groupBy("session_id").agg(F.max("end_ms").alias("confirmed_end_ms"))
    assert same(kept, L.evicted(table.filter("kind = 'buffer'").select("session_id", "start_ms", "end_ms"), marks))
