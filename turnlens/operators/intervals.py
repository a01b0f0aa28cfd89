"""Interval algebra on integer milliseconds, per job: overlap joins, islands, gaps, splits and coverage.

Inputs are DataFrames with job_id, an order column and start_ms, end_ms (half-open). Nothing is collected; folds run
over islands, whose size a job's pauses bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN_MS = 30_000


def _binned(df: DataFrame, bin_ms: int) -> DataFrame:
    last = F.greatest(F.col("start_ms"), F.col("end_ms") - 1)
    return df.withColumn("first_bin", F.expr(f"start_ms div {bin_ms}")).withColumn(
        "bin", F.explode(F.sequence(F.col("first_bin"), F.floor(last / bin_ms).cast("long")))
    )


def overlap_join(left: DataFrame, right: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Pairs of one job that overlap, as (job_id, l: struct, r: struct, overlap_ms).

    Both sides are dealt to time bins and joined on (job, bin), so a long job spreads over many tasks; a pair is kept
    in the first bin that both sides touch."""
    a = _binned(left, bin_ms).select("job_id", "bin", F.struct(*left.columns, "first_bin").alias("l"))
    b = _binned(right, bin_ms).select("job_id", "bin", F.struct(*right.columns, "first_bin").alias("r"))
    overlap = F.least("l.end_ms", "r.end_ms") - F.greatest("l.start_ms", "r.start_ms")
    once = F.col("bin") == F.greatest("l.first_bin", "r.first_bin")
    return a.join(b, ["job_id", "bin"]).filter(once & (overlap > 0)).select("job_id", "l", "r", overlap.alias("overlap_ms"))


def segments_of_samples(detections: DataFrame, lengths: DataFrame, rate: int = 16_000, least_ms: int = 250) -> DataFrame:
    """P5: detections in samples (job_id, start, end, ...) as start_ms, end_ms; ``lengths``: job_id, samples of the audio.

    Detections are clipped to the audio; the start is rounded down and the end up, so that no speech is cut. What is null,
    not an integer, empty or shorter than ``least_ms`` goes, and so does a job without a length. Rows keep their other
    columns; their order is (start_ms, end_ms)."""
    first, last = F.greatest(F.lit(0).cast("long"), F.col("start").try_cast("long")), F.least("_n", F.col("end").try_cast("long"))
    known = detections.filter(F.col("start").try_cast("long").isNotNull() & F.col("end").try_cast("long").isNotNull())
    known = known.join(lengths.select("job_id", F.col("samples").cast("long").alias("_n")).filter("_n is not null"), "job_id").withColumns({"_a": first, "_b": last}).filter("_b > _a")
    ms = known.withColumns({"start_ms": F.expr(f"_a * 1000 div {rate}"), "end_ms": F.expr(f"(_b * 1000 + {rate - 1}) div {rate}")})
    return ms.filter(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("start", "end", "_a", "_b", "_n")


def segments_of_ms(detections: DataFrame, least_ms: int = 200) -> DataFrame:
    """P5: detections in milliseconds (job_id, start, end, ...), cut to whole ones, as start_ms, end_ms. What is null, not
    a number, empty or shorter than ``least_ms`` goes; nothing is clipped. The order of rows is start_ms."""
    ms = detections.withColumns({"start_ms": F.col("start").try_cast("long"), "end_ms": F.col("end").try_cast("long")})
    return ms.filter((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") >= least_ms)).drop("start", "end")


def speaker_overlaps(sentences: DataFrame, diar: DataFrame) -> DataFrame:
    """G1: summed and longest overlap of each sentence with each speaker, and the speaker's first turn."""
    return (
        overlap_join(sentences, diar)
        .groupBy("job_id", F.col("l.ord").alias("ord"), F.col("r.speaker").alias("speaker"))
        .agg(F.sum("overlap_ms").alias("overlap_ms"), F.max("overlap_ms").alias("longest_ms"), F.min("r.seg_ord").alias("first_seg"))
    )


def classify_speaker_overlap(
    sentences: DataFrame, diar: DataFrame, dominant: float = 0.80, secondary: float = 0.15,
    meaningful_ms: int = 400, jitter_ms: int = 150, coverage: float = 0.50,
) -> DataFrame:
    """Single, mixed or uncertain for every sentence, with the ratios that decide it.

    Speakers rank by summed overlap, then by the smaller id. Sentences without any overlap are uncertain."""
    ranked = (
        speaker_overlaps(sentences, diar)
        .groupBy("job_id", "ord")
        .agg(
            F.sum("overlap_ms").alias("total"),
            F.sort_array(F.collect_list(F.struct((-F.col("overlap_ms")).alias("minus"), "speaker", "longest_ms"))).alias("rank"),
        )
    )
    one, two = F.col("rank").getItem(0), F.get("rank", F.lit(1))
    duration = (F.col("end_ms") - F.col("start_ms")).cast("double")
    joined = sentences.join(ranked, ["job_id", "ord"], "left").withColumns(
        {
            "coverage_ratio": F.least(F.lit(1.0), F.coalesce("total", F.lit(0)) / duration),
            "dominant_ratio": -one["minus"] / F.col("total"),
            "secondary_ratio": -two["minus"] / F.col("total"),
            "secondary_turn_ms": two["longest_ms"],
        }
    )
    covered = F.col("total").isNotNull() & (F.col("coverage_ratio") >= coverage)
    meaningful = (F.col("secondary_turn_ms") >= meaningful_ms) | ((F.col("secondary_turn_ms") >= jitter_ms) & (F.col("secondary_ratio") >= secondary))
    kind = (
        F.when(~covered, "uncertain")
        .when(F.col("secondary_turn_ms").isNull(), "single")
        .when(meaningful, "mixed")
        .when(F.col("dominant_ratio") >= dominant, "single")
        .otherwise("uncertain")
    )
    known = joined.withColumn("kind", kind)
    keep = lambda c, other: F.when(covered, F.coalesce(c, F.lit(other))).otherwise(F.lit(other))
    return known.select(
        "job_id", "ord", "start_ms", "end_ms", "kind", F.when(F.col("kind") == "single", one["speaker"]).alias("speaker"),
        keep("dominant_ratio", 0.0).alias("dominant_ratio"), keep("secondary_ratio", 0.0).alias("secondary_ratio"),
        keep("secondary_turn_ms", 0).cast("long").alias("secondary_turn_ms"), "coverage_ratio",
    )


def assign_speakers(sentences: DataFrame, diar: DataFrame) -> DataFrame:
    """The speaker with the most summed overlap (the first in turn order on a tie); without one, the speaker of the
    sentence before, 0 at the start of a job."""
    best = speaker_overlaps(sentences, diar).groupBy("job_id", "ord").agg(F.max_by("speaker", F.struct("overlap_ms", -F.col("first_seg"))).alias("own"))
    back = W.partitionBy("job_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    found = F.coalesce(F.last("own", ignorenulls=True).over(back), F.lit(0))
    return sentences.join(best, ["job_id", "ord"], "left").select("job_id", "ord", found.cast("int").alias("speaker"))


def _with_turns(spans: DataFrame, diar: DataFrame) -> DataFrame:
    """(job_id, ord, turns): the turns that overlap a span (job_id, ord, start_ms, end_ms) somewhere."""
    turn = F.struct("r.start_ms", "r.end_ms", "r.seg_ord", "r.speaker")
    return overlap_join(spans, diar).groupBy("job_id", F.col("l.ord").alias("ord")).agg(F.collect_list(turn).alias("turns"))


def _speaker_of(start: Column, end: Column) -> Column:
    """The speaker of the one of ``turns`` that overlaps (start, end) most, the first on a tie; null without one."""
    overlap = lambda t: F.least(end, t["end_ms"]) - F.greatest(start, t["start_ms"])
    return F.array_max(F.transform("turns", lambda t: F.when(overlap(t) > 0, F.struct(overlap(t).alias("most"), (-t["seg_ord"]).alias("first"), t["speaker"].alias("speaker")))))["speaker"]


def map_chars_to_speakers(chars: DataFrame, diar: DataFrame) -> DataFrame:
    """The speaker of the single turn that overlaps a character most (the first on a tie), null without one.
    ``chars``: job_id, ord, pos, start_ms, end_ms. Turns are looked up once a sentence, so characters are shuffled once."""
    spans = chars.groupBy("job_id", "ord").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    joined = chars.join(_with_turns(spans, diar), ["job_id", "ord"], "left")
    return joined.select("job_id", "ord", "pos", _speaker_of(F.col("start_ms"), F.col("end_ms")).alias("speaker"))


def speaker_pieces(sentences: DataFrame, diar: DataFrame) -> DataFrame:
    """J3 for whole sentences of ``n_chars`` characters that last ``char_ms`` each from ``start_ms`` on: pieces (job_id,
    ord, from_pos, to_pos, speaker) of neighbours with one speaker. No row a character is made.

    The speaker can change only where a turn starts or ends: characters that hold such a place are pieces of their own, and
    so are the stretches between them."""
    at = lambda k: F.col("start_ms") + k * F.col("char_ms")
    some = sentences.filter("n_chars > 0").select("job_id", "ord", "start_ms", F.col("n_chars").cast("long"), F.col("char_ms").cast("long"))
    joined = some.join(_with_turns(some.select("job_id", "ord", "start_ms", at(F.col("n_chars")).alias("end_ms")), diar), ["job_id", "ord"], "left")
    place = lambda ms: F.floor((ms - F.col("start_ms")) / F.col("char_ms"))
    marks = F.flatten(F.transform("turns", lambda t: F.array(place(t["start_ms"]), place(t["start_ms"]) + 1, place(t["end_ms"]), place(t["end_ms"]) + 1)))
    inside = F.filter(F.coalesce(marks, F.array().cast("array<bigint>")), lambda k: (k > 0) & (k < F.col("n_chars")))
    cut = joined.withColumn("cuts", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), inside))))
    until = lambda i: F.coalesce(F.get("cuts", i + 1), F.col("n_chars"))
    return cut.select("job_id", "ord", F.inline(F.transform("cuts", lambda k, i: F.struct(k.alias("from_pos"), until(i).alias("to_pos"), _speaker_of(at(k), at(k + 1)).alias("speaker")))))


def speech_gaps(sentences: DataFrame, vad: DataFrame, durations: DataFrame, min_gap_ms: int = 1000) -> DataFrame:
    """Stretches of at least ``min_gap_ms`` between consecutive sentences (and at both ends of the job) that
    overlap a voice segment. ``durations``: job_id, duration_ms."""
    rows = durations.join(sentences.select("job_id", "start_ms", "end_ms"), "job_id", "left").select(
        "job_id", "duration_ms", F.greatest(F.lit(0), "start_ms").alias("s"), F.least("duration_ms", "end_ms").alias("e")
    )
    order = W.partitionBy("job_id").orderBy("s", "e")
    real = rows.filter("e > s").select("job_id", "duration_ms", F.coalesce(F.lag("e").over(order), F.lit(0)).alias("a"), F.col("s").alias("b"), "e", F.lead("s").over(order).alias("next"))
    gaps = real.select("job_id", "duration_ms", "a", "b").unionByName(real.filter("next is null").select("job_id", "duration_ms", F.col("e").alias("a"), F.col("duration_ms").alias("b")))
    bare = durations.join(real.select("job_id").distinct(), "job_id", "left_anti").select("job_id", "duration_ms", F.lit(0).cast("long").alias("a"), F.col("duration_ms").alias("b"))
    wide = gaps.unionByName(bare).select("job_id", F.greatest(F.lit(0), "a").alias("start_ms"), F.least("duration_ms", "b").alias("end_ms")).filter(F.col("end_ms") - F.col("start_ms") >= min_gap_ms)
    return overlap_join(wide, vad).select("job_id", "l.start_ms", "l.end_ms").distinct()


def project_speakers(sentences: DataFrame, diar: DataFrame) -> DataFrame:
    """The speaker of the single most overlapping turn, first of equals; unmatched sentences keep their own."""
    best = overlap_join(sentences, diar).groupBy("job_id", F.col("l.ord").alias("ord")).agg(F.max_by("r.speaker", F.struct("overlap_ms", -F.col("r.seg_ord"))).alias("found"))
    return sentences.join(best, ["job_id", "ord"], "left").select("job_id", "ord", F.coalesce("found", "speaker").alias("speaker"))


def intersect_turns(sentences: DataFrame, diar: DataFrame, min_turn_ms: int = 150) -> DataFrame:
    """J6, first half: turns clipped to each sentence, those under ``min_turn_ms`` left out."""
    return overlap_join(sentences, diar).filter(F.col("overlap_ms") >= min_turn_ms).select(
        "job_id", F.col("l.ord").alias("ord"), F.greatest("l.start_ms", "r.start_ms").alias("start_ms"),
        F.least("l.end_ms", "r.end_ms").alias("end_ms"), F.col("r.speaker").alias("speaker"), F.col("r.seg_ord").alias("seg_ord"),
    )


def merge_same_speaker(turns: DataFrame, keys: list[str], gap_ms: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """J6 and I5, second half: neighbours of one speaker at most ``gap_ms`` apart become one turn.

    A turn joins the one before if that has the same speaker and the latest end of its run is near enough."""
    order = W.partitionBy(*keys).orderBy("start_ms", "end_ms", *ties)
    changed = F.coalesce(F.lag("speaker").over(order) != F.col("speaker"), F.lit(True))
    runs = turns.withColumn("_run", F.sum(changed.cast("long")).over(order))
    inner = W.partitionBy(*keys, "_run").orderBy("start_ms", "end_ms", *ties)
    reach = F.max("end_ms").over(inner.rowsBetween(W.unboundedPreceding, -1))
    new = runs.withColumn("_new", F.coalesce(F.col("start_ms") - reach > gap_ms, F.lit(True)).cast("long"))
    islands = new.withColumn("_island", F.sum("_new").over(inner))
    return islands.groupBy(*keys, "_run", "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker")).drop("_run", "_island")


def retranscription_plan(sentences: DataFrame, diar: DataFrame, coverage: float = 0.50, min_turn_ms: int = 150) -> DataFrame:
    """I16: keep (single), retranscribe (turns cover enough) or fallback for every sentence."""
    covered = intersect_turns(sentences, diar, min_turn_ms).groupBy("job_id", "ord").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))
    made = classify_speaker_overlap(sentences.filter("end_ms > start_ms"), diar).select("job_id", "ord", "kind", F.col("speaker").alias("found"))
    joined = sentences.select("job_id", "ord", "start_ms", "end_ms").join(made, ["job_id", "ord"], "left").join(covered, ["job_id", "ord"], "left")
    enough = F.col("covered_ms") / (F.col("end_ms") - F.col("start_ms")) >= coverage
    action = F.when(F.col("kind").isNull(), "fallback").when(F.col("kind") == "single", "keep").when(F.coalesce(enough, F.lit(False)), "retranscribe").otherwise("fallback")
    return joined.select("job_id", "ord", action.alias("action"), F.coalesce("kind", F.lit("uncertain")).alias("kind"), F.col("found").alias("speaker"), F.coalesce("covered_ms", F.lit(0)).cast("long").alias("covered_ms"))


def plan_turns(sentences: DataFrame, diar: DataFrame, gap_ms: int = 600) -> DataFrame:
    """I16: the merged turns of the sentences to transcribe again."""
    again = retranscription_plan(sentences, diar).filter("action = 'retranscribe'").select("job_id", "ord")
    return merge_same_speaker(intersect_turns(sentences, diar).join(again, ["job_id", "ord"], "left_semi"), ["job_id", "ord"], gap_ms, ("seg_ord",))


def islands(df: DataFrame, gap: Column, order: list[str], name: str = "island") -> DataFrame:
    """Numbers the runs of a job between rows where ``gap`` holds."""
    return df.withColumn(name, F.sum(F.coalesce(gap, F.lit(True)).cast("long")).over(W.partitionBy("job_id").orderBy(*order)))


def merge_segments(segments: DataFrame, gap_ms: int = 300, max_ms: int = 60_000) -> DataFrame:
    """Neighbours at most ``gap_ms`` apart merge while the result stays under ``max_ms``.

    A merged segment ends where its last part ends, so pauses longer than ``gap_ms`` cut a job into islands by
    neighbours alone; only the cap needs a fold, over one island."""
    order = W.partitionBy("job_id").orderBy("start_ms", "end_ms")
    rows = islands(segments, F.col("start_ms") - F.lag("end_ms").over(order) > gap_ms, ["start_ms", "end_ms"])
    parts = rows.groupBy("job_id", "island").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms"))).alias("parts"))
    empty = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")

    def step(done, part):
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start_ms"].alias("start_ms"), part["end_ms"].alias("end_ms"))))
        fits = (F.size(done) > 0) & (part["end_ms"] - last["start_ms"] < max_ms)
        return F.when(fits, joined).otherwise(F.concat(done, F.array(part)))

    return parts.select("job_id", F.inline(F.aggregate("parts", empty, step)))


def limit_duration(segments: DataFrame, max_ms: int, min_ms: int) -> DataFrame:
    """Segments cut every ``max_ms``; a piece under ``min_ms`` that touches the piece before is joined to it."""
    pieces = segments.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(0, (end_ms - start_ms - 1) div {max_ms})")))).select(
        "job_id", (F.col("start_ms") + F.col("piece") * max_ms).alias("s"), F.least("end_ms", F.col("start_ms") + (F.col("piece") + 1) * max_ms).alias("e")
    )
    order = W.partitionBy("job_id").orderBy("s", "e")
    tail = (F.col("e") - F.col("s") < min_ms) & F.coalesce(F.lag("e").over(order) == F.col("s"), F.lit(False))
    numbered = pieces.withColumn("tail", tail).withColumn("kept", F.sum((~F.col("tail")).cast("long")).over(order))
    return numbered.groupBy("job_id", "kept").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms")).drop("kept")


def sliding_chunks(segments: DataFrame, dur_ms: int = 1500, step_ms: int = 750) -> DataFrame:
    """Windows of ``dur_ms`` every ``step_ms``, the last clipped; a segment too short for one is its own window."""
    last = F.col("end_ms") + step_ms - dur_ms
    starts = F.when(last >= F.col("start_ms"), F.sequence("start_ms", last, F.lit(step_ms).cast("long"))).otherwise(F.array("start_ms"))
    return segments.filter("end_ms > start_ms").select("job_id", "ord", F.explode(starts).alias("sub_start"), "end_ms").select("job_id", "ord", "sub_start", F.least(F.col("sub_start") + dur_ms, "end_ms").alias("sub_end"))


def compress_segments(diar: DataFrame) -> DataFrame:
    """I4: touching neighbours of one speaker join (the end is the last one's); overlapping neighbours of different
    speakers meet in the middle of the overlap. Milliseconds, halves included (double)."""
    order = W.partitionBy("job_id").orderBy("start_ms", "end_ms", "seg_ord")
    rows = diar.withColumns({"pe": F.lag("end_ms").over(order), "ps": F.lag("speaker").over(order)})
    joins = (F.col("ps") == F.col("speaker")) & (F.col("start_ms") <= F.col("pe"))
    cut = F.when((F.col("ps") != F.col("speaker")) & (F.col("start_ms") < F.col("pe")), (F.col("pe") + F.col("start_ms")) / 2.0)
    rows = rows.withColumns({"cut": cut, "grp": F.sum((~F.coalesce(joins, F.lit(False))).cast("long")).over(order)})
    rows = rows.withColumn("next_cut", F.lead("cut").over(order))
    return rows.groupBy("job_id", "grp").agg(
        F.min_by(F.coalesce("cut", F.col("start_ms").cast("double")), F.struct("start_ms", "end_ms", "seg_ord")).alias("start_ms"),
        F.max_by(F.coalesce("next_cut", F.col("end_ms").cast("double")), F.struct("start_ms", "end_ms", "seg_ord")).alias("end_ms"),
        F.first("speaker").alias("speaker"),
    ).withColumnRenamed("grp", "seg")


def first_appearance(rows: DataFrame, order: list[str]) -> DataFrame:
    """Speakers renumbered from 0 by their first appearance in a job; null stays null."""
    first = rows.filter("speaker is not null").groupBy("job_id", "speaker").agg(F.min(F.struct(*order)).alias("at"))
    ids = first.select("job_id", "speaker", (F.row_number().over(W.partitionBy("job_id").orderBy("at")) - 1).cast("int").alias("new_speaker"))
    return rows.join(ids, ["job_id", "speaker"], "left")


def speaker_turns(diar: DataFrame, durations: DataFrame, gap_ms: int = 300) -> DataFrame:
    """Turns clamped to the recording, empty ones dropped, speakers renumbered, near neighbours merged."""
    clamped = diar.join(durations, "job_id").select(
        "job_id", "seg_ord", "speaker", F.greatest(F.lit(0), F.least("duration_ms", "start_ms")).alias("start_ms"), F.least("duration_ms", "end_ms").alias("end_ms")
    )
    named = first_appearance(clamped.filter("end_ms > start_ms"), ["start_ms", "end_ms", "seg_ord"])
    return merge_same_speaker(named.drop("speaker").withColumnRenamed("new_speaker", "speaker"), ["job_id"], gap_ms, ("seg_ord",))


def missing_ranges(speech: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Distinct speech ranges that do not lie inside one island of the confirmed ranges (touching ones join)."""
    order = W.partitionBy("job_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = islands(confirmed.select("job_id", "start_ms", "end_ms").distinct().withColumn("reach", reach), F.col("start_ms") > F.col("reach"), ["start_ms", "end_ms"])
    whole = runs.groupBy("job_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    ranges = speech.select("job_id", "start_ms", "end_ms").distinct()
    inside = overlap_join(ranges, whole).filter("r.start_ms <= l.start_ms and r.end_ms >= l.end_ms").select("job_id", "l.start_ms", "l.end_ms").distinct()
    return ranges.filter("end_ms > start_ms").join(inside, ["job_id", "start_ms", "end_ms"], "left_anti")


def normalize_sentences(sentences: DataFrame, durations: DataFrame) -> DataFrame:
    """Times clamped, sentences that overlap the run before merged: texts joined by spaces in order, the first
    known speaker name."""
    clean = sentences.join(durations, "job_id").select(
        "job_id", F.col("start_ms").alias("raw"), "ord", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"), "speaker",
        F.least(F.greatest("start_ms", F.lit(0)), "duration_ms").alias("start_ms"), F.least(F.greatest("end_ms", F.lit(0)), "duration_ms").alias("end_ms"),
    )
    order = W.partitionBy("job_id").orderBy("raw", "ord")
    reach = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = islands(clean.withColumn("reach", reach), F.col("start_ms") >= F.col("reach"), ["raw", "ord"])
    parts = F.sort_array(F.collect_list(F.struct("raw", "ord", "text", "speaker")))
    merged = rows.groupBy("job_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), parts.alias("parts"))
    texts = F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != "")
    named = F.filter(F.transform("parts", lambda p: p["speaker"]), lambda s: s.isNotNull())
    return merged.select("job_id", "island", "start_ms", "end_ms", F.array_join(texts, " ").alias("text"), F.get(named, F.lit(0)).alias("speaker"))


def fill_gaps(chars: DataFrame, by: str = "pos") -> DataFrame:
    """Null speakers take the one before, at the start the one after (the first one known). ``chars``: characters, or
    pieces by ``from_pos``."""
    order = W.partitionBy("job_id", "ord").orderBy(by)
    before = F.last("speaker", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    known = F.first("speaker", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return chars.withColumn("speaker", F.coalesce(before, known))


def speaker_groups(chars: DataFrame, min_chars: int = 3) -> DataFrame:
    """Runs of one speaker over a sentence's characters; a run under ``min_chars`` joins the group before,
    except the first. Equal neighbours that arise so stay apart. Returns (job_id, ord, grp, from_pos, to_pos, speaker)."""
    return grouped_pieces(fill_gaps(chars).select("job_id", "ord", F.col("pos").alias("from_pos"), (F.col("pos") + 1).alias("to_pos"), "speaker"), min_chars)


def grouped_pieces(parts: DataFrame, min_chars: int = 3) -> DataFrame:
    """``speaker_groups`` of the filled pieces of a sentence (job_id, ord, from_pos, to_pos, speaker)."""
    order = W.partitionBy("job_id", "ord").orderBy("from_pos")
    changed = F.coalesce(F.lag("speaker").over(order) != F.col("speaker"), F.lit(True))
    runs = parts.filter("speaker is not null").withColumn("run", F.sum(changed.cast("long")).over(order))
    runs = runs.groupBy("job_id", "ord", "run").agg(F.min("from_pos").alias("a"), F.max("to_pos").alias("b"), F.first("speaker").alias("speaker"))
    opens = (F.col("run") == 1) | (F.col("b") - F.col("a") >= min_chars)
    grouped = runs.withColumn("grp", F.sum(opens.cast("long")).over(W.partitionBy("job_id", "ord").orderBy("run")))
    return grouped.groupBy("job_id", "ord", "grp").agg(F.min("a").alias("from_pos"), F.max("b").alias("to_pos"), F.min_by("speaker", "run").alias("speaker"))


def split_punctuated(sentences: DataFrame, min_ms: int = 3000) -> DataFrame:
    """Sentences of ``min_ms`` and more are split after sentence marks; parts share the time by their visible
    characters, and the last part ends where the sentence ends. Seconds, two decimals."""
    marks = r"[^.!?。！？…]+(?:[.!?。！？…]+|$)"
    raw = F.transform(F.regexp_extract_all("text", F.lit(marks), F.lit(0)), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    rows = sentences.withColumn("parts", F.filter(raw, lambda p: p != ""))
    whole = (F.col("end_ms") - F.col("start_ms") < min_ms) | (F.size("parts") <= 1)
    parts = rows.select("job_id", "ord", "start_ms", "end_ms", whole.alias("whole"), F.posexplode(F.when(whole, F.array("text")).otherwise(F.col("parts"))).alias("part", "text"))
    weight = F.length(F.regexp_replace("text", r"\s+", "")).cast("long")
    inner = W.partitionBy("job_id", "ord")
    order = inner.orderBy("part")
    rows = parts.withColumn("w", weight).withColumns({"sum_w": F.sum("w").over(order), "all_w": F.sum("w").over(inner)})
    at = lambda w: F.col("start_ms") / 1000.0 + (F.col("end_ms") - F.col("start_ms")) / 1000.0 * w / F.col("all_w")
    cents = lambda x: F.floor(x * 100 + 0.5) / 100.0
    start = F.when(F.col("whole"), F.col("start_ms") / 1000.0).otherwise(cents(at(F.col("sum_w") - F.col("w"))))
    end = F.when(F.col("whole") | (F.col("sum_w") == F.col("all_w")), F.col("end_ms") / 1000.0).otherwise(cents(at(F.col("sum_w"))))
    return rows.select("job_id", "ord", F.col("part").cast("long").alias("part"), "text", start.alias("start_s"), end.alias("end_s"))
