"""Scans over blocks against plain loops, and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from turnlens.functions import text as T
from turnlens.operators import documents as D
from turnlens.operators import finalize as Z
from turnlens.operators import scans
from turnlens.operators import transcripts as P
from turnlens.streaming.endpointing import _FRESH, Endpointing, endpoints
from turnlens.streaming.sessions import accepted_packets


def test_fixed_equals_python(spark):
    table = spark.range(-300, 100_000).withColumnRenamed("id", "ms").unionByName(spark.range(10**10 + 5, 10**10 + 50_000, 10).withColumnRenamed("id", "ms"))
    for r in table.select("ms", T.fixed("ms", 1).alias("one"), T.fixed("ms", 2).alias("two")).collect():
        assert (r["one"], r["two"]) == (f"{r['ms'] / 1000:.1f}", f"{r['ms'] / 1000:.2f}")


def test_numbers_and_searches(spark):
    draw = random.Random(1)
    rows = sorted({(draw.randrange(3), draw.randrange(-50, 4000)) for _ in range(900)})
    table = spark.createDataFrame(rows, "k long, v long")
    want = {(k, v): sum(1 for a, b in rows if a == k and b < v) for k, v in rows}
    assert {(r["k"], r["v"]): r["place"] for r in scans.numbered(table, ["k"], "v", width=16).collect()} == want
    asked = [(draw.randrange(4), draw.randrange(-100, 5000)) for _ in range(300)]
    got = scans.counted_upto(table, spark.createDataFrame(asked, "k long, v long"), ["k"], "v", "n", width=64).collect()
    assert sorted((r["k"], r["v"], r["n"]) for r in got) == sorted((k, v, sum(1 for a, b in rows if a == k and b <= v)) for k, v in asked)


@pytest.mark.parametrize("width", [4, 64, 1024])
def test_chain(spark, width):
    draw, links, want = random.Random(2), [], set()
    for k in range(3):
        n = (1, 40, 500)[k]
        nexts = [min(i + draw.randrange(1, 5), n) for i in range(n)]
        links += [(k, i, nexts[i] if nexts[i] < n else None, i == 0) for i in range(n)]
        i = 0
        while i < n:
            want.add((k, i))
            i = nexts[i]
    got = scans.chain(spark.createDataFrame(links, "k long, place long, next long, first boolean"), ["k"], width).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_queue(spark, limit):
    """Thousands of events of one session, over several levels of blocks of blocks, with holes in their numbers."""
    draw, events, want = random.Random(limit), [], set()
    for s, n in ((0, 1), (1, 300), (2, 40_000)):
        depth, rate = 0, 0.5
        for k in range(n):
            rate = draw.choice([0.2, 0.5, 0.8]) if k % 500 == 0 else rate
            put = draw.random() < rate
            seq = 3 * k + draw.randrange(3)
            events.append((s, seq, "put" if put else "get"))
            if put and depth < limit:
                want.add((s, seq))
            depth = min(limit, depth + 1) if put else max(0, depth - 1)
    draw.shuffle(events)
    got = accepted_packets(spark.createDataFrame(events, "session_id long, seq long, kind string"), limit).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("config", [Endpointing(), Endpointing(min_speech=100, min_silence=100, pre_roll=0, post_roll=0), Endpointing(frame=70, min_speech=200, min_silence=330, pre_roll=510, post_roll=290, max_window=1234), Endpointing(pre_roll=5000, post_roll=5000, max_window=900), Endpointing(min_speech=90_000, min_silence=120_000, max_window=700)])
def test_endpoints_equal_the_state_machine(spark, config):
    draw, rows, want = random.Random(7), [], []
    for job, n in enumerate((1, 2, 3, 9, 60, 900, 7000)):
        state, level = _FRESH, 0.5
        for k in range(n):
            level = draw.choice([0.05, 0.4, 0.6, 0.95]) if draw.random() < 0.1 else level
            p = min(1.0, max(0.0, level + draw.uniform(-0.2, 0.2)))
            rows.append((job, k, p))
            state, done = config.step(state, p)
            want += [(job, *done)] if done else []
        last = config.stop(state)
        want += [(job, *last)] if last else []
    draw.shuffle(rows)
    got = sorted(tuple(r) for r in endpoints(spark.createDataFrame(rows, "job_id long, frame long, prob double"), config).collect())
    assert got == sorted(want)


def packed(sizes, limit, overlap):
    """(first, last, beginning) of each chunk, by trying."""
    out, i = [], 0
    while i < len(sizes):
        low, end = max(0, i - overlap), i
        while end < len(sizes):
            said = [x for x in sizes[low : end + 1] if x is not None]
            if max(1, (sum(said) + max(0, len(said) - 1) + 3) // 4) > limit:
                break
            end += 1
        if end > i:
            out.append((low, end - 1))
        i = max(end, i + 1)
    return out


@pytest.mark.parametrize(("limit", "overlap"), [(20, 3), (8, 1), (200, 0), (3, 3)])
def test_packing(spark, limit, overlap):
    draw, rows, want = random.Random(limit), [], []
    for job, n in ((1, 1), (2, 50), (3, 1500)):
        said = ["x" * draw.choice([1, 5, 9, 30]) if draw.random() < 0.9 else " " for _ in range(n)]
        places = sorted(draw.sample(range(3 * n), n))
        rows += [(job, places[k], 10 * (k // 2), 10 * k + 9, t, t) for k, t in enumerate(said)]
        want += [(job, c, places[a], 10 * (a // 2), 10 * b + 9, b - a + 1) for c, (a, b) in enumerate(packed([None if t == " " else len(t) for t in said], limit, overlap))]
    table = spark.createDataFrame(rows, "job_id long, ord long, start_ms long, end_ms long, text string, line string")
    assert sorted(tuple(r) for r in P.pack_sentences(table, limit, overlap).collect()) == want


def test_chunks_of_sentences_that_start_together(spark):
    rows = [(1, 0, 0, 1, "a"), (1, 4, 0, 2, "b"), (1, 5, 7, 9, " "), (1, 9, 9, 11, "c")]
    table = spark.createDataFrame(rows, "job_id long, ord long, start_ms long, end_ms long, text string").withColumn("line", F.when(T.strip("text") != "", F.col("text")))
    got = D.chunk_lines(P.pack_sentences(table, 1, 0), table).collect()
    assert [(r["chunk"], r["markdown"]) for r in sorted(got, key=lambda r: r["chunk"])] == [(0, "a\nb"), (1, "c")]
    assert D.chunks_markdown(D.chunk_lines(P.pack_sentences(table, 1500, 3), table)).first()["markdown"] == "## CHUNK 0 [0.00 → 0.01]\na\nb\nc\n---"


def test_requests(spark):
    draw, rows, want = random.Random(3), [], []
    for u in range(5):
        ticks = sorted({draw.randrange(0, 20_000) for _ in range(draw.choice([0, 3, 400]))})
        rows += [(u, 100, t) for t in ticks]
        last = None
        for t in ticks:
            if t - 100 >= 400 and (last is None or t - last >= 600):
                want.append((u, max(100, t - 5000), t))
                last = t
    got = Z.partial_requests(spark.createDataFrame(rows + rows[:3], "utterance long, start_ms long, now_ms long")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_best_rows(spark):
    rows = [("a", None, 1, 5), ("a", None, 2, 5), ("b", "x", 3, 1), (None, None, 4, 0), (None, None, 5, -1)]
    got = P.best_rows(spark.createDataFrame(rows, "p string, q string, id long, size long"), ["p", "q"], F.struct("size", "id")).collect()
    assert {r["id"] for r in got if r["kept"]} == {2, 3, 4} and len(got) == 5
