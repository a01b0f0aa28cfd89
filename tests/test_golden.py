"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from turnlens.functions import text as T
from turnlens.operators import intervals as I
from turnlens.operators import transcripts as R

SEG = "job_id long, ord long, start_ms long, end_ms long"


def segs(spark, *spans):
    return spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(spans)], SEG)


def diar(spark, *turns):
    return spark.createDataFrame([(1, k, a, b, s) for k, (a, b, s) in enumerate(turns)], "job_id long, seg_ord long, start_ms long, end_ms long, speaker int")


def spans(df, *more):
    return sorted(tuple(r) for r in df.select("start_ms", "end_ms", *more).collect())


@pytest.mark.parametrize(
    ("given", "gap", "most", "want"),
    [
        ([(0, 1000), (1200, 2500)], 300, 60_000, [(0, 2500)]),
        ([(0, 1000), (5000, 6000)], 300, 60_000, [(0, 1000), (5000, 6000)]),
        ([(0, 50_000), (50_200, 60_000)], 500, 60_000, [(0, 50_000), (50_200, 60_000)]),
    ],
)
def test_merge_segments(spark, given, gap, most, want):
    assert spans(I.merge_segments(segs(spark, *given), gap, most)) == want


def test_speech_gaps(spark):
    vad = segs(spark, (300, 1500), (4500, 5800))
    dur = spark.createDataFrame([(1, 6000)], "job_id long, duration_ms long")
    assert spans(I.speech_gaps(segs(spark, (2000, 4000)), vad, dur)) == [(0, 2000), (4000, 6000)]
    assert spans(I.speech_gaps(segs(spark, (0, 1000), (5000, 6000)), segs(spark, (1800, 4500)), dur)) == [(1000, 5000)]
    assert spans(I.speech_gaps(segs(spark, (0, 0)), vad, dur)) == [(0, 6000)]  # no sentence: the whole recording


@pytest.mark.parametrize(
    ("sentence", "turns", "kind", "speaker"),
    [
        ((0, 5000), [(0, 4700, 3), (4700, 5000, 3)], "single", 3),
        ((0, 1000), [(0, 850, 0), (850, 950, 1), (950, 1000, 0)], "single", 0),
        ((0, 10_000), [(0, 4800, 0), (4800, 5200, 1), (5200, 10_000, 0)], "mixed", None),
        ((1000, 2000), [(5000, 6000, 1)], "uncertain", None),
    ],
)
def test_classify(spark, sentence, turns, kind, speaker):
    row = I.classify_speaker_overlap(segs(spark, sentence), diar(spark, *turns)).first()
    assert (row["kind"], row["speaker"]) == (kind, speaker)


def test_plan(spark):
    rows = I.retranscription_plan(segs(spark, (0, 2000), (2000, 6000)), diar(spark, (0, 2000, 7), (2000, 4000, 7), (4000, 6000, 3))).orderBy("ord").collect()
    assert [(r["action"], r["kind"], r["speaker"]) for r in rows] == [("keep", "single", 7), ("retranscribe", "mixed", None)]
    assert I.retranscription_plan(segs(spark, (0, 4000)), diar(spark, (0, 1000, 0))).first()["action"] == "fallback"
    turns = I.plan_turns(segs(spark, (0, 3000)), diar(spark, (0, 1000, 0), (1450, 2000, 0), (2000, 2400, 1), (2400, 3000, 0)))
    assert spans(turns, "speaker") == [(0, 2000, 0), (2000, 2400, 1), (2400, 3000, 0)]
    merged = I.retranscription_plan(segs(spark, (0, 4000)), diar(spark, (0, 1000, 0), (1590, 2000, 0)))
    assert merged.first()["action"] == "fallback"  # merging must not raise the coverage


def test_speaker_turns(spark):
    dur = spark.createDataFrame([(1, 4000)], "job_id long, duration_ms long")
    turns = I.speaker_turns(diar(spark, (0, 1000, 3), (1200, 3000, 3), (3000, 4000, 8)), dur)
    assert spans(turns, "speaker") == [(0, 3000, 0), (3000, 4000, 1)]


def test_sliding_chunk_of_a_short_segment(spark):
    assert [tuple(r)[2:] for r in I.sliding_chunks(segs(spark, (1000, 1400))).collect()] == [(1000, 1400)]


def test_char_speakers_and_groups(spark):
    chars = spark.createDataFrame([(1, 0, k, 500 * k, 500 * k + 500) for k in range(5)], "job_id long, ord long, pos long, start_ms long, end_ms long")
    got = I.map_chars_to_speakers(chars, diar(spark, (0, 1000, 0), (1000, 3000, 1))).orderBy("pos").collect()
    assert [r["speaker"] for r in got] == [0, 0, 1, 1, 1]
    lone = I.map_chars_to_speakers(chars, diar(spark, (9000, 9500, 0))).collect()
    assert {r["speaker"] for r in lone} == {None}

    def groups(*runs):
        flat = [(1, 0, k, s) for k, s in enumerate(s for n, s in runs for _ in range(n))]
        df = I.speaker_groups(spark.createDataFrame(flat, "job_id long, ord long, pos long, speaker int"), 3)
        return [tuple(r) for r in df.orderBy("grp").select("from_pos", "to_pos", "speaker").collect()]

    assert groups((5, 0), (2, 1), (5, 0)) == [(0, 7, 0), (7, 12, 0)]
    assert groups((2, 0), (2, 1), (1, 0)) == [(0, 5, 0)]


def test_char_speakers_of_whole_sentences(spark):
    """The same as by rows: overlapping turns, gaps at the start, inside and at the end, sentences without turns or text."""
    shape = "job_id long, ord long, start_ms long, n_chars int, char_ms int"
    told = spark.createDataFrame([(1, 0, 0, 12, 100), (1, 1, 5000, 4, 100), (1, 2, 6000, 0, 100), (1, 3, 6000, 9, 7), (1, 4, 90_000, 1, 100)], shape)
    turns = diar(spark, (150, 420, 0), (380, 600, 1), (600, 640, 2), (800, 1010, 2), (6010, 6030, 1), (29_000, 95_000, 5))
    chars = told.filter("n_chars > 0").selectExpr("job_id", "ord", "explode(sequence(0L, n_chars - 1L)) AS pos", "start_ms AS s", "char_ms AS c").selectExpr("job_id", "ord", "pos", "s + pos * c AS start_ms", "s + pos * c + c AS end_ms")
    rows = lambda df: sorted(map(tuple, df.select("job_id", "ord", "pos", "speaker").collect()))
    pieces, single = I.speaker_pieces(told, turns), I.map_chars_to_speakers(chars, turns)
    each = lambda df: rows(df.selectExpr("job_id", "ord", "explode(sequence(from_pos, to_pos - 1)) AS pos", "speaker"))
    assert each(pieces) == rows(single) and pieces.filter("ord = 4").count() == 1
    assert [r[3] for r in rows(single) if r[1] == 0] == [None, 0, 0, 0, 1, 1, 2, None, 2, 2, 2, None]
    filled = I.fill_gaps(pieces, "from_pos")
    assert each(filled) == rows(I.fill_gaps(single))
    assert [r[3] for r in rows(I.fill_gaps(single)) if r[1] == 0] == [0, 0, 0, 0, 1, 1, 2, 2, 2, 2, 2, 2]
    groups = lambda df: sorted(map(tuple, df.select("job_id", "ord", "grp", "from_pos", "to_pos", "speaker").collect()))
    assert groups(I.grouped_pieces(filled, 3)) == groups(I.speaker_groups(single, 3))


def test_char_times_of_long_texts(spark):
    """4,000 words: each was looked for from the start of the text, and all times so far were copied."""
    df = spark.range(1).selectExpr("concat('  ', repeat('ab\u00e9 ', 4000)) AS text", "transform(sequence(0L, 3999L), k -> named_struct('text', 'ab\u00e9', 's', k * 10, 'e', k * 10 + 8)) AS w")
    got = df.select(T.chars_of_aligned("text", F.col("w")).alias("c")).selectExpr("size(c) AS n", "c[2].e AS a", "element_at(c, -1).s AS z").first()
    assert got[:] == (16_002, 8, 39_990)
    words = F.transform("w", lambda w: F.struct(F.concat(F.lit(" "), w["text"], F.lit("\t")).alias("text"), w["s"], w["e"]))
    said = df.select(T.chars_of_words(words).alias("c")).selectExpr("size(c) AS n", "c[0].c AS a", "c[0].s AS s", "element_at(c, -1).c AS z").first()
    assert said[:] == (19_998, "a", 0, "\u00e9")
    blank = spark.sql("SELECT array(named_struct('text', ' \t', 's', 1L, 'e', 2L), named_struct('text', '', 's', 1L, 'e', 2L)) AS w")
    assert blank.select(T.chars_of_words(F.col("w")).alias("c")).first()["c"] == []


def test_long_gaps_are_filled_in_one_pass(spark):
    """A sentence of 200,000 characters: a frame that starts anew at every row took the square of it."""
    told = spark.range(1).selectExpr("1L AS job_id", "0L AS ord", "transform(sequence(0, 199999), k -> if(k % 1000 = 999, k div 1000, null)) AS speakers")
    rows = I.fill_gaps(told.selectExpr("job_id", "ord", "posexplode(speakers) AS (pos, speaker)"))
    assert rows.agg(F.sum("speaker"), F.count("*")).first()[:] == (sum(k * 1000 for k in range(199)) + 199, 200_000)


def test_coverage(spark):
    speech, confirmed = segs(spark, (0, 1000), (1500, 2600)), segs(spark, (0, 1000))
    assert spans(I.missing_ranges(speech, confirmed)) == [(1500, 2600)]
    assert spans(I.missing_ranges(segs(spark, (0, 2000)), segs(spark, (0, 1000), (1000, 2000)))) == []


def test_compress_shrinks_and_cuts(spark):
    rows = I.compress_segments(diar(spark, (0, 1000, 0), (900, 950, 0), (940, 1500, 1)))
    assert spans(rows, "speaker") == [(0.0, 945.0, 0), (945.0, 1500.0, 1)]


def test_reduce_transcripts(spark):
    def final(*log):
        df = spark.createDataFrame([("s", k, *x) for k, x in enumerate(log)], "session_id string, seq long, kind string, start_ms long, end_ms long")
        return sorted((r["start_ms"], r["end_ms"], r["kind"]) for r in R.reduce_transcripts(df).collect())

    assert final(("partial", 100, 700), ("partial", 100, 1300), ("partial", 2000, 2500)) == [(100, 1300, "partial"), (2000, 2500, "partial")]
    assert final(("partial", 100, 1300), ("partial", 100, 900)) == [(100, 1300, "partial")]
    assert final(("partial", 100, 1800), ("partial", 2200, 2800), ("delta", 250, 1700), ("partial", 100, 1900)) == [(250, 1700, "delta"), (2200, 2800, "partial")]
    assert final(("delta", 0, 1000), ("partial", 1000, 1500)) == [(0, 1000, "delta"), (1000, 1500, "partial")]


def test_stack_frames(spark):
    rows = spark.createDataFrame([("a", t, [float(t + 1), 10.0 * (t + 1)]) for t in range(4)], "key string, t long, v array<double>")
    got = [r["v"] for r in R.stack_frames(rows, 3, 2).orderBy("i").collect()]
    assert got == [[1, 10, 1, 10, 2, 20], [2, 20, 3, 30, 4, 40]]


def test_split_punctuated(spark):
    df = spark.createDataFrame([(1, 0, 0, 10_000, "Alo alo. Hôm nay mình họp. Chốt việc nhé.")], "job_id long, ord long, start_ms long, end_ms long, text string")
    rows = I.split_punctuated(df).orderBy("part").collect()
    assert len(rows) == 3 and rows[0]["start_s"] == 0 and rows[-1]["end_s"] == 10.0


def test_overlap_join_over_many_bins(spark):
    a, b = segs(spark, (0, 95_000), (100_000, 100_010)), segs(spark, (10, 99_000), (94_999, 100_005))
    got = sorted((r["l"]["ord"], r["r"]["ord"], r["overlap_ms"]) for r in I.overlap_join(a, b, 1000).collect())
    assert got == [(0, 0, 94_990), (0, 1, 1), (1, 1, 5)]


def test_text_functions(spark):
    row = spark.createDataFrame([("1h2m59.56s", " CON .txt", "x" * 90, 3_725_004)], "d string, f string, t string, ms long").select(
        T.duration_seconds("d").alias("d"), T.sanitize_filename(F.lit("CON.txt")).alias("f"), F.length(T.representative_sample("t", 50)).alias("n"), T.srt_time("ms").alias("s"), T.seconds_to_human("ms").alias("h")
    ).first()
    assert row["d"] == pytest.approx(3779.56) and row["f"] == "_CON.txt" and row["n"] == 50
    assert (row["s"], row["h"]) == ("01:02:05,004", "1:02:05")


def test_detections_become_segments(spark):
    samples = [(8000, 16000), (160, 3360), (-100, 100), (1000, 1000), (None, 5), (0, None)]
    rows = spark.createDataFrame([(1, k, s, e) for k, (s, e) in enumerate(samples)] + [(2, 9, 0, 9000), (3, 0, 0, 99_999)], "job_id int, ord int, start int, end int")
    lengths = spark.createDataFrame([(1, 16000), (3, 4001), (4, None)], "job_id int, samples int")
    got = sorted((r["job_id"], r["start_ms"], r["end_ms"], r["ord"]) for r in I.segments_of_samples(rows, lengths, least_ms=200).collect())
    assert got == [(1, 10, 210, 1), (1, 500, 1000, 0), (3, 0, 251, 0)]
    assert I.segments_of_samples(rows.filter("false"), lengths).count() == 0
    ms = spark.createDataFrame([(1, s, e) for s, e in (("1200", "1600"), ("0", "100"), ("500", "900"), ("2000", "2000"), ("bad", "7"), (None, "9"))], "job_id int, start string, end string")
    assert sorted((r["start_ms"], r["end_ms"]) for r in I.segments_of_ms(ms).collect()) == [(500, 900), (1200, 1600)]
    whole = spark.createDataFrame([(1, 0.9, 200.2), (1, 0.0, float("nan"))], "job_id int, start double, end double")
    assert [(r["start_ms"], r["end_ms"]) for r in I.segments_of_ms(whole).collect()] == [(0, 200)]


def test_character_times_are_shifted(spark):
    rows = spark.createDataFrame([(1, [(0, 10), None, (10, 25)], 1000), (2, [], 5), (3, None, 5)], "id int, times array<struct<s:long,e:long>>, offset long")
    got = {r["id"]: r["x"] and [t and tuple(t) for t in r["x"]] for r in rows.select("id", T.shift_times("times", "offset").alias("x")).collect()}
    assert got == {1: [(1000, 1010), None, (1010, 1025)], 2: [], 3: None}
