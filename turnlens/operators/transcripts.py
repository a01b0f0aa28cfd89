"""Transcript operators: windows, boundaries, chunking, documents, persistence rules and event-log reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lines import line_pieces
from .scans import chain, counted_upto, cut_lineage, numbered, running

#: Positions of one block of a fold.
BLOCK = 256


def sentence_windows(sentences: DataFrame, size: int = 3) -> DataFrame:
    """Sliding windows of ``size`` sentences (full ones only) with their merged text."""
    order = W.partitionBy("job_id").orderBy("ord")
    said = F.concat(F.coalesce(F.col("name"), F.lit("UNKNOWN")), F.lit(": "), "text")
    span = order.rowsBetween(0, size - 1)
    rows = sentences.withColumn("said", said).select(
        "job_id", (F.row_number().over(order) - 1).cast("long").alias("start_idx"), "start_ms",
        F.last("end_ms").over(span).alias("end_ms"), F.collect_list("said").over(span).alias("parts"),
    )
    return rows.filter(F.size("parts") == size).select("job_id", "start_idx", "start_ms", "end_ms", F.array_join("parts", " ").alias("merged_text"))


def consecutive_similarity(embedded: DataFrame) -> DataFrame:
    """Cosine similarity of each vector with the one before, null for the first of a job."""
    before = F.lag("embedding").over(W.partitionBy("job_id").orderBy("ord"))
    return embedded.withColumn("prev", before).select("job_id", "ord", F.when(F.col("prev").isNotNull(), T.cosine("embedding", "prev")).alias("sim"))


def boundaries(embedded: DataFrame, threshold: float = 0.75) -> DataFrame:
    """0, the positions whose similarity with the one before is under ``threshold``, and the job's length."""
    rows = consecutive_similarity(embedded)
    inner = rows.filter(F.col("sim") < threshold).select("job_id", F.col("ord").alias("boundary"))
    ends = rows.groupBy("job_id").agg(F.count("*").alias("n")).select("job_id", F.explode(F.array(F.lit(0).cast("long"), "n")).alias("boundary"))
    return inner.union(ends).distinct()


def smooth(embedded: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Exponential moving average of the similarities, in order within a job.

    x(n) = alpha * s(n) + (1 - alpha) * x(n - 1). A job is cut into blocks of BLOCK positions; each is folded from zero,
    and the value before a block counts with (1 - alpha) to the power of the place in it. The values at the ends of
    blocks are folded the same way, so no array is longer than a block or the number of blocks."""
    sims = consecutive_similarity(embedded).filter("sim is not null")
    place = F.row_number().over(W.partitionBy("job_id").orderBy("ord")) - 1
    rows = sims.withColumn("n", place).withColumns({"b": F.expr(f"n div {BLOCK}"), "x": F.when(F.col("n") == 0, F.col("sim")).otherwise(alpha * F.col("sim"))})
    per = rows.groupBy("job_id", "b").agg(F.sort_array(F.collect_list(F.struct("n", "ord", "x"))).alias("s"))

    def fold(upto):
        return F.aggregate(F.slice("s", 1, upto), F.lit(0.0), lambda a, v: (1 - alpha) * a + v["x"])

    own = per.withColumns({"own": F.transform("s", lambda v, k: F.struct(v["ord"].alias("ord"), k.alias("k"), fold(k + 1).alias("v")))})
    ends = own.select("job_id", "b", F.element_at("own", -1)["v"].alias("v"), F.size("s").alias("m"))
    chain = ends.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("b", "v", "m"))).alias("e"))
    before = F.transform("e", lambda e, k: F.struct(e["b"].alias("b"), F.aggregate(F.slice("e", 1, k), F.lit(0.0), lambda a, v: F.pow(F.lit(1 - alpha), v["m"]) * a + v["v"]).alias("carry")))
    carried = chain.select("job_id", F.inline(before))
    rows = own.join(carried, ["job_id", "b"]).select("job_id", "carry", F.inline("own"))
    return rows.select("job_id", "ord", (F.col("v") + F.pow(F.lit(1 - alpha), F.col("k") + 1) * F.col("carry")).alias("ema"))


def adaptive_threshold(sims: DataFrame) -> DataFrame:
    """Mean minus half a population standard deviation."""
    return sims.groupBy("job_id").agg((F.avg("sim") - 0.5 * F.stddev_pop("sim")).alias("threshold"))


def ordered_join(rows: DataFrame, value: Column, separator: str, name: str, by: str = "ord") -> DataFrame:
    """One text a job from its rows in order; null values are left out."""
    parts = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(by).alias("o"), value.alias("v")))))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(parts, lambda p: p["v"]), separator).alias(name))


def pack_sentences(sentences: DataFrame, limit: int = 1500, overlap: int = 3) -> DataFrame:
    """Chunks of consecutive sentences under ``limit`` tokens of markdown, each led by the ``overlap`` sentences
    before it: job_id, chunk, first (the ord of the first one), start_ms, end_ms, n_sentences. A sentence that does not fit
    even alone with its overlap starts no chunk and is skipped as a start.

    Greedy and in order. Four characters are a token, and lines are joined by one character, so a chunk ends where the
    running length passes that before its overlap by 4 * limit + 1: a range search. Each sentence thus knows where the chunk
    ends that it would start, and the chunks are the chain from the first sentence on (``scans``): one long job needs no
    group of its own."""
    size = F.when(T.strip("text") == "", 0).otherwise(F.length("line") + 1).cast("long")
    rows = numbered(sentences.select("job_id", "ord", "start_ms", "end_ms", size.alias("size")), ["job_id"], "ord")
    rows = cut_lineage(running(rows, ["job_id"], "place", F.col("size"), "w"))
    head = rows.select("job_id", F.col("place").alias("low"), (F.col("w") - F.col("size")).alias("w0"), "start_ms", F.col("ord").alias("first"))
    starts = rows.select("job_id", "place", F.greatest(F.lit(0), F.col("place") - overlap).alias("low")).join(head, ["job_id", "low"])
    starts = counted_upto(rows, starts.withColumn("w", F.col("w0") + 4 * limit + 1), ["job_id"], "w", "end", width=4 * limit + 2)
    last = rows.groupBy("job_id").agg(F.max("place").alias("last"))
    starts = starts.join(last, "job_id").withColumn("fits", F.col("end") > F.col("place"))
    after = F.when(F.col("fits"), F.col("end")).otherwise(F.col("place") + 1)
    starts = cut_lineage(starts.withColumn("next", F.when(after <= F.col("last"), after)))
    found = chain(starts.select("job_id", "place", "next", (F.col("place") == 0).alias("first")), ["job_id"])
    made = numbered(starts.filter("fits").join(found, ["job_id", "place"]), ["job_id"], "place", "chunk")
    ends = rows.select("job_id", (F.col("place") + 1).alias("end"), "end_ms")
    return made.join(ends, ["job_id", "end"]).select("job_id", "chunk", "first", "start_ms", "end_ms", (F.col("end") - F.col("low")).alias("n_sentences"))


def pack_lines(docs: DataFrame, limit: int) -> DataFrame:
    """Chunks of at most ``limit`` characters: a text's lines (over-long ones in the pieces of C6), packed greedily,
    newlines counted. An empty text is one empty chunk. Returns doc_id, chunk, text."""
    pieces = line_pieces(limit)
    parts = F.flatten(F.transform(pieces(F.split("text", "\n", -1)), lambda p: p))
    none = F.struct(F.lit(-1).alias("now"), F.array().cast("array<int>").alias("starts"))

    def step(s, x):
        """Where chunks start, by the lengths of the pieces."""
        joins = (s["now"] >= 0) & (s["now"] + 1 + x["n"] <= limit)
        return F.struct(F.when(joins, s["now"] + 1 + x["n"]).otherwise(x["n"]).alias("now"), F.when(joins, s["starts"]).otherwise(F.array_append(s["starts"], x["k"])).alias("starts"))

    made = docs.filter("text is not null").select("doc_id", parts.alias("p"))
    sizes = F.transform("p", lambda x, k: F.struct(F.length(x).alias("n"), k.alias("k")))
    cut = made.select("doc_id", "p", F.aggregate(sizes, none, step)["starts"].alias("starts"))
    ends = F.transform("starts", lambda a, i: F.coalesce(F.get("starts", i + 1), F.size("p")) - a)
    rows = cut.select("doc_id", "p", F.posexplode(F.arrays_zip(F.col("starts").alias("a"), ends.alias("n"))).alias("chunk", "x"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.slice("p", F.col("x.a") + 1, F.col("x.n")), "\n").alias("text"))


def best_versions(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """K5, K6, K7: rank of each row among those of its key; 1 is the one to keep, the rest are to archive."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def best_rows(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """K7: each row with ``kept``: whether it is the first of its key by the greatest ``order`` (a struct that tells all rows
    of a key apart). The maxima are combined before the shuffle, so a key may hold any part of the rows."""
    best = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(order).alias("_best"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(best, same).select(*rows.columns, order.eqNullSafe(F.col("_best")).alias("kept"))


def violations(sentences: DataFrame, durations: DataFrame) -> DataFrame:
    """P10: one row per rule that a sentence breaks."""
    joined = sentences.join(durations, "job_id", "left")
    rules = {
        "start_negative": F.col("start_ms") < 0,
        "end_before_start": F.col("end_ms") < F.col("start_ms"),
        "end_after_duration": F.col("end_ms") > F.col("duration_ms"),
        "text_blank": T.strip("text") == "",
        "duration_not_positive": F.coalesce(F.col("duration_ms") <= 0, F.lit(True)),
    }
    found = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return joined.select("job_id", "ord", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The last right row at or before each left row, by a union and a running last value (one sort a key)."""
    a = left.withColumns({"_side": F.lit(1), "_found": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, at, F.lit(0).alias("_side"), F.col(value).alias("_found"))
    order = W.partitionBy(*keys).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_found", ignorenulls=True).over(order)).filter("_side = 1").drop("_side", "_found")


def reduce_transcripts(log: DataFrame) -> DataFrame:
    """Final state of a realtime log (session_id, seq, kind, start_ms, end_ms): the last confirmed row of each start;
    the partial with the latest end (then arrival) of each start, unless a confirmed row starts inside its range."""
    by = W.partitionBy("session_id", "kind", "start_ms")
    delta = log.filter("kind = 'delta'").withColumn("rn", F.row_number().over(by.orderBy(F.desc("seq")))).filter("rn = 1").drop("rn")
    partial = log.filter("kind = 'partial'").withColumn("rn", F.row_number().over(by.orderBy(F.desc("end_ms"), F.desc("seq")))).filter("rn = 1").drop("rn")
    # the next confirmed start at or after each partial's start, by a union and one sort a session: no range join
    starts = delta.select("session_id", "start_ms", F.lit(1).alias("_side"), F.col("start_ms").alias("_c"))
    order = W.partitionBy("session_id").orderBy(F.desc("start_ms"), F.desc("_side")).rowsBetween(W.unboundedPreceding, 0)
    both = partial.withColumns({"_side": F.lit(0), "_c": F.lit(None).cast(delta.schema["start_ms"].dataType)}).unionByName(starts, allowMissingColumns=True)
    open_ = both.withColumn("_n", F.last("_c", ignorenulls=True).over(order)).filter("_side = 0 and (_n is null or _n > end_ms)").drop("_side", "_c", "_n")
    return delta.unionByName(open_)


def sessionize(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Numbers the sessions of a key: a pause longer than ``gap_seconds`` opens one."""
    order = W.partitionBy(key).orderBy(at)
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(order).cast("timestamp"))
    return events.withColumn("session", F.sum(F.coalesce(pause > gap_seconds * 1_000_000, F.lit(True)).cast("long")).over(order))


def stack_frames(frames: DataFrame, m: int = 7, n: int = 6) -> DataFrame:
    """Low-frame-rate stacking of (key, t, v: array): output i holds frames i*n - (m-1)//2 .. of m, edges repeated."""
    total = F.count("*").over(W.partitionBy("key"))
    rows = frames.withColumn("total", total)
    heads = rows.filter(F.col("t") % n == 0).select("key", "total", F.expr(f"t div {n}").alias("i"))
    wanted = heads.select("key", "i", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.greatest(F.lit(0).cast("long"), F.least(F.col("total") - 1, F.col("i") * n - (m - 1) // 2 + k)))).alias("k", "t"))
    parts = wanted.join(frames, ["key", "t"]).groupBy("key", "i").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("p"))
    return parts.select("key", "i", F.flatten(F.transform("p", lambda x: x["v"])).alias("v"))
