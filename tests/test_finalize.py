"""Finalising, audio, sources and model seams: small cases worked out by hand."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.operators import audio as A
from turnlens.operators import finalize as Z
from turnlens.operators import records as R
from turnlens.operators import vectors as V
from turnlens.plans import models
from turnlens.sources import media

SEG = "job_id long, ord long, start_ms long, end_ms long, speaker int, text string"


def segs(spark, *rows):
    return spark.createDataFrame([(1, k, a, b, s, t) for k, (a, b, s, t) in enumerate(rows)], SEG)


def test_rescued(spark):
    base = segs(spark, (0, 1000, 0, "Mot"), (5000, 6000, 0, "Ba"))
    more = segs(spark, (1100, 4900, None, "Giua"), (5100, 5800, None, "ba"), (8000, 8500, None, "  mOT "))
    assert [r["text"] for r in Z.rescued(base, more).collect()] == ["Giua"]


@pytest.mark.parametrize(("text", "following", "want"), [("Qua nha", "Nha truong", "Qua"), ("Qua nha,", "(nha) x", "Qua"), ("Qua", "Nha", "Qua"), ("nha", "nha", ""), ("a", None, "a"), ("Đã xong", "XONG rồi", "Đã")])
def test_trim_boundary_word(spark, text, following, want):
    df = spark.createDataFrame([(text, following)], "a string, b string")
    assert df.select(Z.trim_boundary_word("a", "b")).first()[0] == want


def test_best_covered_and_merge(spark):
    records = segs(spark, (0, 1000, 1, "x"), (1000, 3000, 2, "y"))
    given = segs(spark, (100, 900, 7, "a"), (2500, 5000, 8, "b"), (900, 1900, 9, "c"))
    got = {r["ord"]: r["record"] for r in Z.best_covered(given, records).collect()}
    assert got == {0: 0, 1: None, 2: 1}
    rows = sorted((r["origin"], r["ord"], r["speaker"]) for r in Z.merge_fallback(given, records).collect())
    assert rows == [("kept", 0, 7), ("kept", 1, 9), ("new", 1, 8)]


def test_resolution_is_all_or_nothing(spark):
    plan = spark.createDataFrame([(1, 0, "keep"), (1, 1, "retranscribe"), (1, 2, "retranscribe"), (1, 3, "fallback")], "job_id long, ord long, action string")
    turns = spark.createDataFrame([(1, 1, 0, 500, "a"), (1, 1, 500, 900, "b"), (1, 2, 0, 100, "a"), (1, 2, 100, 300, " ")], "job_id long, ord long, start_ms long, end_ms long, text string")
    rows = {r["ord"]: (r["outcome"], r["n_rows"], r["asr_ms"]) for r in Z.resolve_retranscription(plan, turns).collect()}
    assert rows == {0: ("keep", 1, 0), 1: ("replaced", 2, 900), 2: ("fallback", 1, 300), 3: ("fallback", 1, 0)}


def test_priority_order(spark):
    kinds = {"confirmed": 0, "partial": 4, "fallback": 5, "targeted": 7, "upload": 10, "finalize": 15}
    asked = ["partial", "confirmed", "fallback", "targeted", "upload", "finalize", "partial"]
    rows = [(1, k, kinds[kind]) for k, kind in enumerate(asked)]
    out = R.pending_order(spark.createDataFrame(rows, "coordinator long, seq long, priority long")).orderBy("turn").collect()
    assert [r["seq"] for r in out] == [1, 0, 6, 2, 3, 4, 5]


def test_partial_requests_and_texts(spark):
    ticks = spark.createDataFrame([(1, 0, t) for t in range(0, 2000, 100)], "utterance long, start_ms long, now_ms long")
    assert sorted(r["end_ms"] for r in Z.partial_requests(ticks).collect()) == [400, 1000, 1600]
    windows = spark.createDataFrame([(1, 0, 0, 1000, "one two three four"), (1, 1, 500, 1500, "three four five"), (1, 2, 500, 1600, "three four five six")], "utterance long, seq long, start_ms long, end_ms long, text string")
    assert [r["text"] for r in Z.compose_partials(windows).orderBy("seq").collect()] == ["one two three four", "one two three four five", "one two three four five six"]


def test_compact_log(spark):
    log = spark.createDataFrame([(1, 0, "upsert", 5, "a"), (1, 1, "snapshot", None, None), (1, 2, "upsert", 6, "b"), (1, 3, "upsert", 6, "c")], "job long, seq long, kind string, id long, value string")
    assert [(r["id"], r["value"]) for r in Z.compact_log(log).collect()] == [(6, "c")]


def test_long_lines_and_bounded_join(spark):
    df = spark.createDataFrame([(1, "aa bb. cc dd! ee"), (2, "x" * 25), (3, "p, q, r" + "s" * 9), (4, "ok")], "doc_id long, text string")
    got = {}
    for r in Z.split_long_lines(df, 10).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[2] == ["x" * 10, "x" * 10, "x" * 5] and got[4] == ["ok"] and all(len(p) <= 10 for x in got.values() for p in x)
    assert got[1] == ["aa bb.", "cc dd! ee"]
    parts = spark.createDataFrame([(["aaaaaaaaaa", " ", "bb"],)], "p array<string>")
    assert parts.select(Z.bounded_join("p", 10)).first()[0] == "aaa…\n\nbb"


def test_bounded_join_strips_a_part_once(spark):
    """20,000 parts: stripping all of them for each took the square."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda k: F.concat(F.lit(" p"), k.cast("string"), F.lit("\n"))).alias("p"))
    assert df.select(Z.bounded_join("p", 45_000)).first()[0].startswith("…\n\n…\n\n")
    assert df.select(Z.bounded_join("p", 10**6)).first()[0] == "\n\n".join(f"p{k}" for k in range(1, 20_001))
    odd = spark.createDataFrame([([],), (None,), ([" ", None, "a"],)], "p array<string>")
    assert [r[0] for r in odd.select(Z.bounded_join("p", 9)).collect()] == ["", None, "a"]


def test_alignment_leaves_times_with_spark(spark):
    pairs = spark.createDataFrame([(1, "ab", "Ab.", [1, 2]), (2, None, "x", [3]), (3, "a", None, [1]), (4, "a", "b", None)], "id long, old string, new string, ts array<long>")
    made = Z.align_punctuated(pairs)
    assert {r["id"]: r["ts"] for r in made.collect()} == {1: [1, 2, 2], 2: [3], 3: [], 4: []}
    assert "MapInPandas" not in made._jdf.queryExecution().executedPlan().toString()


ALIGN = [
    ("ab cd", "Ab, cd.", [10, 20, 30, 40, 50], [10, 20, 20, 30, 40, 50, 50]),
    ("hello world", "hello World", list(range(11)), list(range(11))),
    ("ab", "(ab", [5, 6], [5, 5, 6]),
    ("abcd", "aXYZd", [1, 2, 3, 4], [1, 2, 2, 3, 4]),  # three characters over the two that they replace
    ("abc", "abcd", [1, 2], [1, 2, 2, 2]), ("abc", "a", [1, 2], [1]), ("", "x", [], []), ("ab", "", [1, 2], []),
]


def test_align_punctuated(spark):
    pairs = spark.createDataFrame([(k, o, n, t) for k, (o, n, t, _) in enumerate(ALIGN)], "id long, old string, new string, ts array<long>")
    assert {r["id"]: r["ts"] for r in Z.align_punctuated(pairs).collect()} == {k: w for k, (*_, w) in enumerate(ALIGN)}


def test_rescues_in_order(spark):
    """Touching candidates: the earliest goes in; a word that the next sentence repeats goes, with its time."""
    base = segs(spark, (0, 1000, 0, "Mot"), (1500, 2000, 0, "Ba bon"))
    rows = [(1, 0, 1000, 1450, "hai la ba", [(1000 + 50 * k, 1050 + 50 * k) for k in range(9)]), (1, 1, 1300, 1340, "nua", None), (1, 2, 1360, 1400, "nua", None), (1, 3, 1390, 1450, "khac", None), (1, 4, 2100, 2200, "NUA", None)]
    more = spark.createDataFrame(rows, "job_id long, ord long, start_ms long, end_ms long, text string, ts array<struct<s:long,e:long>>")
    got = [(r["ord"], r["end_ms"], r["text"]) for r in Z.rescued(base, more).orderBy("ord").collect()]
    assert got == [(0, 1300, "hai la"), (1, 1340, "nua"), (3, 1450, "khac")]
    none = Z.rescued(base, more.filter("false"))
    assert none.count() == 0 and none.columns == more.columns


def test_rescue_gaps(spark):
    base = segs(spark, (0, 1000, 0, "dau"), (6000, 7000, 0, "cuoi"))
    vad = spark.createDataFrame([(1, 2000, 4000)], "job_id long, start_ms long, end_ms long")
    durations = spark.createDataFrame([(1, 7000)], "job_id long, duration_ms long")
    decoded = spark.createDataFrame([(1, 1000, 6000, 0, " giua cuoi", [(1500 + 500 * k, 2000 + 500 * k) for k in range(10)]), (1, 8000, 9000, 1, "khong", [(8000, 8100)] * 5)], "job_id long, gap_start_ms long, gap_end_ms long, ord long, text string, ts array<struct<s:long,e:long>>")
    rows = {r["text"]: (r["start_ms"], r["end_ms"], r["origin"]) for r in Z.rescue_gaps(base, vad, durations, decoded).collect()}
    # characters whose middle lies after 6000 go: " giua cuo", of which the word after the gap differs
    assert rows == {"dau": (0, 1000, "kept"), "cuoi": (6000, 7000, "kept"), "giua cuo": (2000, 6000, "rescued")}


def test_quiet_cuts(spark):
    """Equal energy: the limit itself; else the middle of the quietest frame. A short rest stays with the part before."""
    turns = spark.createDataFrame([(1, 0, 20_000), (2, 0, 20_000), (3, 0, 15_500), (4, 0, 900)], "job_id long, start_ms long, end_ms long")
    loud = [1.0] * 20_000
    quiet = list(loud)
    quiet[14_000:14_040] = [0.0] * 40
    audio = spark.createDataFrame([(1, [0.0] * 20_000), (2, quiet), (3, loud)], "job_id long, samples array<double>")
    got = {}
    for r in A.split_at_quiet(turns, audio, rate=1000).collect():
        got.setdefault(r["job_id"], []).append((r["start_ms"], r["end_ms"]))
    assert got[1] == [(0, 15_000), (15_000, 20_000)] and got[2] == [(0, 14_020), (14_020, 20_000)] and got[4] == [(0, 900)]
    assert got[3] == [(0, 14_500), (14_500, 15_500)]  # cut so that a second is left


def test_quiet_cuts_stream_audio(spark):
    """Audio is on the streamed side, however small it is thought to be: it is neither broadcast nor sorted."""
    turns = spark.createDataFrame([(k % 5, k, 900 * k, 900 * k + 2500 - k) for k in range(40)], "job_id long, ord long, start_ms long, end_ms long")
    audio = turns.groupBy("job_id").agg(F.max("end_ms").alias("n")).select("job_id", F.transform(F.sequence(F.lit(0), "n"), lambda k: F.sin(k * 0.7)).alias("samples"))
    cut = A.split_at_quiet(turns, audio, rate=1000, most=1500, search=400, least=200)
    rows = cut.collect()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" not in plan and "BuildLeft" in plan
    assert {r["ord"] for r in rows} == set(range(40)) and all(r["end_ms"] - r["start_ms"] <= 1700 for r in rows)
    by = {k: sorted((r["start_ms"], r["end_ms"]) for r in rows if r["ord"] == k) for k in range(40)}
    assert all(x[0][0] == 900 * k and x[-1][1] == 900 * k + 2500 - k and all(a[1] == b[0] for a, b in zip(x, x[1:])) for k, x in by.items())


def test_log_mel_against_plain_sums(spark):
    import cmath
    import math

    rate, n, hop, mels = 8000, 32, 10, 6
    x = [math.sin(k / 3) + 0.2 * math.cos(k) for k in range(75)]
    rows = {(r["t"]): r["v"] for r in A.log_mel(spark.createDataFrame([(1, x), (2, [])], "id long, samples array<double>"), rate, n, hop, mels).collect()}
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)
    to_hz = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    edges = [to_hz(to_mel(rate / 2) * k / (mels + 1)) for k in range(mels + 2)]
    wide = [0.0] * (n // 2) + x + [0.0] * (n // 2)
    assert sorted(rows) == list(range(1 + 75 // hop))
    for t, got in rows.items():
        frame = [wide[t * hop + k] * (0.5 - 0.5 * math.cos(2 * math.pi * k / n)) for k in range(n)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * f * k / n) for k, v in enumerate(frame))) ** 2 for f in range(n // 2 + 1)]
        for m in range(mels):
            a, b, c = edges[m : m + 3]
            tri = [max(0.0, min((f * rate / n - a) / (b - a), (c - f * rate / n) / (c - b))) * 2 / (c - a) for f in range(n // 2 + 1)]
            assert got[m] == pytest.approx(math.log(max(sum(p * w for p, w in zip(power, tri, strict=True)), 1e-10)), abs=1e-6)


def test_audio(spark, tmp_path):
    def wav(name, samples, rate=16_000, channels=1):
        data = io.BytesIO()
        with wave.open(data, "wb") as f:
            f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate), f.writeframes((np.array(samples) * 32767).astype("<i2").tobytes())
        (tmp_path / name).write_bytes(data.getvalue())

    wav("mono.wav", [0.5] * 100)
    wav("stereo.wav", [0.5, -0.5] * 50, channels=2)
    wav("fast.wav", [0.25] * 480, rate=48_000)
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    rows = {r["path"].rpartition("/")[2]: r for r in media.load_audio(spark, str(tmp_path)).collect()}
    assert {k: r["n_samples"] for k, r in rows.items()} == {"mono.wav": 100, "stereo.wav": 50, "fast.wav": 160, "bad.wav": 0}
    assert max(map(abs, rows["stereo.wav"]["samples"])) < 1e-4 and rows["bad.wav"]["error"]
    pcm = spark.createDataFrame([(bytes([0, 128, 255, 127, 0, 0]),), (b"\1",), (b"",)], "b binary").select(media.pcm_to_float("b").alias("x")).collect()
    assert pcm[0]["x"] == pytest.approx([-1.0, 32767 / 32768, 0.0]) and pcm[1]["x"] is None and pcm[2]["x"] == []
    quiet = spark.createDataFrame([(1, [0.01, -0.01]), (2, [0.0]), (3, [0.5])], "id long, samples array<double>")
    got = {r["id"]: r["y"] for r in quiet.select("id", A.rms_normalize("samples").alias("y")).collect()}
    assert got[1] == pytest.approx([0.03, -0.03]) and got[2] == [0.0] and got[3] == [0.5]
    tone = spark.createDataFrame([(1, np.sin(np.arange(1600) / 5).tolist())], "id long, samples array<double>")
    assert A.log_mel(tone).count() == 11
    assert len(A.resample(tone, 48, 16).first()["samples"]) == 533


def test_quietest_cut(spark):
    df = spark.createDataFrame([(1, 100, 500, 0.2), (1, 480, 500, 0.1), (1, 520, 500, 0.1), (1, 900, 500, 0.1)], "turn long, cut_ms long, target_ms long, rms double")
    assert A.quietest_cut(df, ["turn"]).first()["cut_ms"] == 520


def test_sources(spark, tmp_path):
    (tmp_path / "a.scp").write_text("k1  /x/one.wav\n\n  k2\tb c.wav \nlonely\n")
    assert sorted(tuple(r) for r in media.read_scp(spark, str(tmp_path / "a.scp")).collect()) == [("k1", "/x/one.wav"), ("k2", "b c.wav")]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert sorted(r["a"] for r in media.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a long").collect()) == [1, 2]


def test_model_registry(spark):
    assert "full-stop" in models.registered("punc")
    with pytest.raises(ValueError):
        models.register("nothing", "x")
    df = spark.createDataFrame([(1, "hello"), (2, "done."), (3, None)], "id long, t string")
    assert [r["o"] for r in models.apply_model(df, "punc", "full-stop", "t", "o", "string").orderBy("id").collect()] == ["hello.", "done.", ""]


def test_clusters(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(3, 16))
    rows = [(1, k, (centres[k % 3] + draw.normal(size=16) * 0.05).tolist()) for k in range(30)] + [(2, k, (centres[k % 2] + draw.normal(size=16) * 0.05).tolist()) for k in range(60)] + [(3, 0, centres[0].tolist())]
    df = spark.createDataFrame(rows, "job_id long, ord long, embedding array<double>").withColumn("embedding", F.col("embedding"))
    got = {}
    for r in V.cluster_speakers(df).collect():
        got.setdefault(r["job_id"], {})[r["ord"]] = r["cluster"]
    assert got[3] == {0: 0}
    for job, n in ((1, 3), (2, 2)):
        assert len(set(got[job].values())) == n and all(got[job][k] == got[job][k % n] for k in got[job])


def test_minor_clusters_are_dissolved(spark):
    """Three vectors apart from nine others are too few for a speaker of their own; five are enough."""
    rows = []
    for job, few in ((1, 3), (2, 5), (3, 2)):
        many = 9 if job < 3 else 2
        rows += [(job, k, [1.0, 0.001 * k, 0.0]) for k in range(many)] + [(job, many + k, [0.0, 0.001 * k, 1.0]) for k in range(few)]
    got = {}
    for r in V.cluster_speakers(spark.createDataFrame(rows, "job_id long, ord long, embedding array<double>")).collect():
        got.setdefault(r["job_id"], []).append((r["ord"], r["cluster"]))
    names = {job: [c for _, c in sorted(x)] for job, x in got.items()}
    assert names[1] == [0] * 12 and names[3] == [0] * 4
    assert len(set(names[2][:9])) == 1 and len(set(names[2][9:])) == 1 and names[2][0] != names[2][9]


def test_preassigned_turns_keep_their_speakers(spark):
    rows = [(1, 0, 3, "x" * 79), (2, 0, 1, "x" * 40), (2, 1, 2, " " + "y" * 39), (3, 0, 1, "z" * 239 + "."), (4, 0, 1, "z" * 240 + "."), (5, 0, None, None), (6, 0, 2, "")]
    s = spark.createDataFrame(rows, "job_id long, ord long, speaker long, text string")
    mark = lambda d: d.withColumn("text", F.concat("text", F.lit("!")))
    got = {(r["job_id"], r["ord"]): (r["speaker"], r["text"]) for r in Z.finalize_preassigned(s, mark, native=True).collect()}
    changed = {(2, 0), (2, 1), (4, 0)}
    assert got == {(j, o): (p, t + "!" if (j, o) in changed else t) for j, o, p, t in rows}
    assert all(r["text"] is None or r["text"].endswith("!") for r in Z.finalize_preassigned(s, mark, native=False).collect())
