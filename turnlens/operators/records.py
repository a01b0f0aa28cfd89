"""Stored records: reports as tables, updates, replacements, upserts, status and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from .transcripts import as_of


def report_tables(reports: DataFrame, lists: list[str]) -> dict[str, DataFrame]:
    """K1: a nested report (meeting_id, scalars, arrays of structs) as tables: meetings, and one for each list with
    meeting_id, place (from 0) and the fields of its rows."""
    scalars = [c for c in reports.columns if c not in lists]
    tables = {"meetings": reports.select(*scalars)}
    for name in lists:
        rows = reports.select("meeting_id", F.posexplode(name).alias("place", "row"))
        tables[name] = rows.select("meeting_id", F.col("place").cast("long").alias("place"), "row.*")
    return tables


def write_report(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """K1: writes all tables of one run, each to <path>/<table>/run=<run_id>, then the run itself to <path>/runs; a run
    that is not there did not end, and its rows are not read."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/run={run_id}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(run_id).alias("run")).write.mode("overwrite").parquet(f"{path}/runs/{run_id}")


def read_report(spark: SparkSession, path: str, name: str) -> DataFrame:
    """K1: the rows of one table of the runs that ended."""
    runs = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/runs").select(F.col("run").cast("string"))
    rows = spark.read.parquet(f"{path}/{name}").withColumn("run", F.col("run").cast("string"))
    return rows.join(F.broadcast(runs) if runs.count() < 100_000 else runs, "run", "left_semi")


def update_by_id(records: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """K3: ``records`` (job_id, key, column, ...) with the values of ``updates`` (job_id, key, column), and applied. A job
    is updated as a whole, only if each of its records has exactly one update and there is no other; else it stays."""
    new = updates.select("job_id", key, F.col(column).alias("_new"), F.lit(1).alias("_u"))
    both = records.select("job_id", key, F.lit(1).alias("_r")).join(new, ["job_id", key], "full_outer")
    bad = both.groupBy("job_id", key).agg(F.count("*").alias("n"), F.count("_r").alias("r"), F.count("_u").alias("u")).filter("r <> n or u <> n or n > 1")
    joined = records.join(new, ["job_id", key], "left").join(bad.select("job_id", F.lit(False).alias("_ok")).distinct(), "job_id", "left")
    ok = F.coalesce("_ok", F.lit(True))
    return joined.select(*[F.when(ok, F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else c for c in records.columns], ok.alias("applied"))


def replace_segments(records: DataFrame, outputs: DataFrame) -> DataFrame:
    """K4: records (job_id, ord, start_ms, end_ms, speaker, text) after a second pass. ``outputs``: job_id, ord (of the
    record), place, start_s, end_s, speaker, text, replaced. A replaced record gives way to its outputs, clipped to it
    (seconds are rounded half to even); any other has one output and takes its speaker.

    A job changes as a whole: if an output is blank or empty after clipping, a record has no output, an output no
    record, or a record that stays several, the job keeps its records. Returns the rows with origin (kept, new) and
    applied."""
    base = records.select("job_id", "ord", F.col("start_ms").alias("low"), F.col("end_ms").alias("high"), F.lit(True).alias("known"))
    joined = base.join(outputs, ["job_id", "ord"], "full_outer")
    ms = lambda c: F.bround(F.col(c) * 1000, 0).cast("long")
    start = F.greatest("low", F.least("high", ms("start_s")))
    clipped = joined.withColumns({"text": strip("text"), "start": start, "end": F.greatest(start, F.least("high", ms("end_s"))), "n": F.count("place").over(W.partitionBy("job_id", "ord"))})
    wrong = F.col("known").isNull() | F.col("place").isNull() | F.when(F.col("replaced"), (F.col("text") == "") | (F.col("end") <= F.col("start"))).otherwise(F.col("n") != 1)
    bad = clipped.filter(F.coalesce(wrong, F.lit(True))).select("job_id", F.lit(False).alias("ok")).distinct()
    good = clipped.join(bad, "job_id", "left_anti")
    new = good.filter("replaced").select("job_id", "ord", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "speaker", "text", F.lit("new").alias("origin"), F.lit(True).alias("applied"))
    stay = records.join(bad, "job_id", "left_anti").join(good.filter("not replaced").select("job_id", "ord", F.col("speaker").alias("_s")), ["job_id", "ord"])
    stay = stay.select("job_id", "ord", "start_ms", "end_ms", F.col("_s").alias("speaker"), "text", F.lit("kept").alias("origin"), F.lit(True).alias("applied"))
    old = records.join(bad, "job_id", "left_semi").select("job_id", "ord", "start_ms", "end_ms", "speaker", "text", F.lit("kept").alias("origin"), F.lit(False).alias("applied"))
    return new.unionByName(stay).unionByName(old)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """K6: ``table`` with ``changes``: of the rows of a key the one of the greatest version stays, a change before a row
    of the table of the same version. Rows are compared where they meet, once a key."""
    rows = table.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_side")).alias("r")).select(*keys, "r.*")


def report(meetings: DataFrame, children: dict[str, DataFrame], order: str = "place") -> DataFrame:
    """Each meeting with one list a child table (in order; empty where it has no rows). Children are gathered
    before they are joined, so that rows of different tables are never multiplied."""
    out = meetings
    for name, child in children.items():
        rest = [c for c in child.columns if c not in ("meeting_id", order)]
        lists = child.groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))
        empty = F.array().cast(lists.schema[name].dataType)
        out = out.join(lists, "meeting_id", "left").withColumn(name, F.coalesce(name, empty))
    return out


def pair_results(results: DataFrame, segments: DataFrame) -> DataFrame:
    """Recognised texts (job_id, ord, text, ts: array of (s, e) in ms) zipped with their segments (job_id, ord,
    start_ms, end_ms, offset_ms) by place; what the longer list has more is left out, and so are blank texts. A sentence
    runs from its first to its last character time, else over its segment; the offset is added."""
    place = lambda df: df.withColumn("_n", F.row_number().over(W.partitionBy("job_id").orderBy("ord"))).drop("ord")
    joined = place(results).join(place(segments), ["job_id", "_n"]).withColumn("text", strip("text")).filter("text <> ''")
    timed = F.size("ts") > 0
    start = F.when(timed, F.get("ts", 0)["s"]).otherwise(F.col("start_ms"))
    end = F.when(timed, F.element_at("ts", -1)["e"]).otherwise(F.col("end_ms"))
    return joined.select("job_id", (F.col("_n") - 1).cast("long").alias("ord"), (start + F.col("offset_ms")).alias("start_ms"), (end + F.col("offset_ms")).alias("end_ms"), "text")


def fallback_segment(jobs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences that are not blank; a job (job_id, text, duration_ms) without any, but with a text, gives one
    segment of that text over its whole length, without a speaker."""
    good = sentences.filter(strip("text") != "").select("job_id", "ord", "start_ms", "end_ms", "speaker", "text")
    bare = jobs.join(good.select("job_id").distinct(), "job_id", "left_anti").withColumn("text", strip("text")).filter("text <> ''")
    none = bare.select("job_id", F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("start_ms"), F.greatest(F.lit(0).cast("long"), "duration_ms").alias("end_ms"), F.lit(None).cast(good.schema["speaker"].dataType).alias("speaker"), "text")
    return good.unionByName(none)


def source_status(sources: DataFrame, jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Each source (source_id) with its status (no job or a failed one: failed; done; else processing), the modes of
    its visible documents but the live one, and how many are visible. A document is visible if it is live or not blank."""
    seen = documents.filter((F.col("mode") == "live") | (strip("markdown") != ""))
    shown = seen.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("mode") != "live", F.col("mode")))), ",").alias("docs"), F.count("*").alias("n_visible"))
    status = F.when(F.col("status").isNull() | (F.col("status") == "failed"), "failed").when(F.col("status") == "done", "done").otherwise("processing")
    joined = sources.join(jobs.select("source_id", "status"), "source_id", "left").join(shown, "source_id", "left")
    return joined.select("source_id", status.alias("status"), F.coalesce("docs", F.lit("")).alias("docs"), F.coalesce("n_visible", F.lit(0)).cast("long").alias("n_visible"))


def payload_errors(segments: DataFrame) -> DataFrame:
    """One row per rule that a payload row breaks: end before start, negative start, negative speaker."""
    rules = {"end_before_start": F.col("end_ms") < F.col("start_ms"), "start_negative": F.col("start_ms") < 0, "speaker_negative": F.col("speaker") < 0}
    found = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return segments.select("job_id", "ord", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def media_type(content_type, name) -> Column:
    """Video by content type or file extension, else audio."""
    by_name = F.lower(name).rlike(r"\.(mp4|mkv|webm|mov|avi)$")
    return F.when(F.coalesce(F.startswith(content_type, F.lit("video")), F.lit(False)) | F.coalesce(by_name, F.lit(False)), "video").otherwise("audio")


def playing_segment(ticks: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment that plays at each tick (job_id, at_ms): the last that starts at or before it, if the tick is no
    later than the segment's end or the start of the next one."""
    order = W.partitionBy("job_id").orderBy("start_ms", "ord")
    until = F.greatest("end_ms", F.coalesce(F.lead("start_ms").over(order), "end_ms"))
    known = segments.select("job_id", F.col("start_ms").alias("at_ms"), F.struct("ord", until.alias("until")).alias("seg"))
    last = known.groupBy("job_id", "at_ms").agg(F.max("seg").alias("seg"))
    found = as_of(ticks, last, ["job_id"], "at_ms", "seg")
    return found.select(*ticks.columns, F.when(F.col("at_ms") <= F.col("seg.until"), F.col("seg.ord")).alias("ord"))


def covered_partials(partials: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Partial ranges (job_id, ord, start_ms, end_ms) in which a confirmed segment starts (ends included). By the
    next confirmed start at or after each partial's start: one sort a job, no range join."""
    a = partials.select("job_id", "ord", F.col("start_ms").alias("_t"), "end_ms", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_c"))
    b = confirmed.select("job_id", F.lit(None).cast("long").alias("ord"), F.col("start_ms").alias("_t"), F.lit(None).cast("long").alias("end_ms"), F.lit(1).alias("_side"), F.col("start_ms").alias("_c"))
    order = W.partitionBy("job_id").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_n", F.last("_c", ignorenulls=True).over(order)).filter("_side = 0 and _n <= end_ms").select("job_id", "ord")


def same_members(left: DataFrame, right: DataFrame, keys: list[str], group: str) -> DataFrame:
    """For each group, whether both sides have the same set of keys."""
    a, b = (df.select(group, *keys).distinct().withColumn(f"_{n}", F.lit(1)) for df, n in ((left, "a"), (right, "b")))
    return a.join(b, [group, *keys], "full_outer").groupBy(group).agg((F.count("_a") == F.count("*")).alias("x"), (F.count("_b") == F.count("*")).alias("y")).select(group, (F.col("x") & F.col("y")).alias("same"))


def inference_metrics(requests: DataFrame) -> DataFrame:
    """By coordinator, of requests (coordinator, kind, submitted_ms, started_ms, ended_ms, outcome: completed, failed
    or dropped): counts, mean wait and run over those executed (completed or failed), and the deepest queue (those
    submitted and not started yet, at any time; starts before submissions of the same moment)."""
    ran = F.col("outcome") != "dropped"
    wait, run = F.col("started_ms") - F.col("submitted_ms"), F.col("ended_ms") - F.col("started_ms")
    mean = lambda c: F.coalesce(F.avg(F.when(ran, c)), F.lit(0.0))
    sums = requests.groupBy("coordinator").agg(
        F.count_if(F.col("outcome") == "completed").alias("completed"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(~ran).alias("dropped"),
        mean(wait).alias("average_wait_ms"), mean(run).alias("average_run_ms"),
    )
    waited = requests.filter(ran)
    steps = waited.select("coordinator", F.explode(F.array(F.struct(F.col("submitted_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("started_ms").alias("t"), F.lit(-1).alias("d")))).alias("s")).select("coordinator", "s.*")
    # all steps of one moment and kind are one row, so a busy coordinator's sort is over moments
    moments = steps.groupBy("coordinator", "t", "d").agg(F.sum("d").alias("by"))
    depth = moments.withColumn("depth", F.sum("by").over(W.partitionBy("coordinator").orderBy("t", "d"))).groupBy("coordinator").agg(F.greatest(F.max("depth"), F.lit(0)).alias("max_depth"))
    return sums.join(depth, "coordinator", "left").withColumn("max_depth", F.coalesce("max_depth", F.lit(0)))


def metrics_by_kind(requests: DataFrame) -> DataFrame:
    """By coordinator, maps from kind to mean wait, mean run and completed count (kinds that ran)."""
    kinds = requests.filter("outcome <> 'dropped'").groupBy("coordinator", "kind").agg(
        F.avg(F.col("started_ms") - F.col("submitted_ms")).alias("wait"), F.avg(F.col("ended_ms") - F.col("started_ms")).alias("run"), F.count_if(F.col("outcome") == "completed").alias("n"))
    as_map = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", c))))
    return kinds.groupBy("coordinator").agg(as_map("wait").alias("wait_by_kind"), as_map("run").alias("run_by_kind"), as_map("n").alias("completed_by_kind"))


def latency_metrics(partials: DataFrame, finals: DataFrame) -> DataFrame:
    """By session: mean first-partial latency (first partial of an utterance after its start), mean interval between
    partials of an utterance, and mean final latency (final after the utterance's end). ``partials``: session_id,
    utterance, start_ms, at_ms; ``finals``: session_id, utterance, end_ms, at_ms."""
    order = W.partitionBy("session_id", "utterance").orderBy("at_ms")
    gaps = partials.withColumn("gap", F.col("at_ms") - F.lag("at_ms").over(order)).groupBy("session_id").agg(F.avg("gap").alias("partial_interval_ms"))
    first = partials.groupBy("session_id", "utterance", "start_ms").agg(F.min("at_ms").alias("first")).groupBy("session_id").agg(F.avg(F.col("first") - F.col("start_ms")).alias("first_partial_ms"))
    last = finals.groupBy("session_id").agg(F.avg(F.col("at_ms") - F.col("end_ms")).alias("final_ms"))
    return first.join(gaps, "session_id", "full_outer").join(last, "session_id", "full_outer")


def emission_latency(emissions: DataFrame) -> DataFrame:
    """What each emitted partial took. ``emissions``: session_id, seq, utterance_start_ms, end_ms (of its window),
    requested_ms, started_ms, emitted_ms, first_audio_ms (null: unknown). An utterance's count and interval start anew
    when the session comes to another utterance; unknown times are -1."""
    order = W.partitionBy("session_id").orderBy("seq")
    other = ~F.col("utterance_start_ms").eqNullSafe(F.lag("utterance_start_ms").over(order))
    rows = emissions.withColumn("run", F.sum(other.cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    same = W.partitionBy("session_id", "run").orderBy("seq")
    since = lambda c, less: F.coalesce(F.col(c) - F.col("first_audio_ms") - less, F.lit(-1).cast("long"))
    return rows.select(
        "session_id", "seq", F.row_number().over(order).cast("long").alias("count"), F.row_number().over(same).cast("long").alias("utterance_count"),
        (F.col("started_ms") - F.col("requested_ms")).alias("worker_wait_ms"), (F.col("emitted_ms") - F.col("requested_ms")).alias("request_to_emit_ms"),
        since("emitted_ms", F.lit(0)).alias("first_audio_to_partial_ms"), since("emitted_ms", F.col("utterance_start_ms")).alias("utterance_to_partial_ms"),
        since("emitted_ms", F.col("end_ms")).alias("audio_end_to_emit_ms"), since("requested_ms", F.col("end_ms")).alias("audio_end_to_request_ms"),
        F.coalesce(F.col("emitted_ms") - F.lag("emitted_ms").over(same), F.lit(-1).cast("long")).alias("update_interval_ms"),
    )


def latency_percentiles(latencies: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """By session and measure (session_id, measure, n, p50, p95) the exact percentiles of the known values."""
    rows = latencies.select("session_id", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])))
    each = [F.percentile("v", share).alias(f"p{round(100 * share)}") for share in shares]
    return rows.filter("v >= 0").groupBy("session_id", "measure").agg(F.count("*").alias("n"), *each)


def framed(packets: DataFrame, size: int) -> DataFrame:
    """Frames of ``size`` samples from packets (session_id, seq, n_samples) in order: session_id, frame, and the packet
    in which it is full. A rest that fills no frame waits."""
    order = W.partitionBy("session_id").orderBy("seq")
    total = F.sum("n_samples").over(order)
    rows = packets.withColumns({"_to": F.floor(total / size), "_from": F.floor((total - F.col("n_samples")) / size)}).filter("_to > _from")
    return rows.select("session_id", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("frame"), "seq")


def pending_order(requests: DataFrame) -> DataFrame:
    """The order in which waiting requests (coordinator, seq, priority) are taken: the smallest priority first, then
    by arrival. Ranks of a table at hand; nothing is simulated."""
    return requests.withColumn("turn", F.row_number().over(W.partitionBy("coordinator").orderBy("priority", "seq")).cast("long"))
