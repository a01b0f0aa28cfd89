"""Rules of live sessions on their event logs: bounded queues, accounting, eviction, stale work, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scans import carried, numbered

#: Events folded at once.
RUN = 256


def accepted_packets(events: DataFrame, limit: int) -> DataFrame:
    """The packets (session_id, seq) that a queue of ``limit`` takes: ``events`` (session_id, seq, kind: put or get) in
    order; a put on a full queue is dropped (the newest goes), a get on an empty one does nothing.

    Each event maps the depth x to min(max(x + a, lo), hi), and such maps are closed under composition. Blocks of RUN
    events are folded to one map each, the maps are scanned, and each block is then run from its own depth."""
    shift = lambda a, lo, hi: F.named_struct(F.lit("a"), a.cast("long"), F.lit("lo"), lo.cast("long"), F.lit("hi"), hi.cast("long"))
    clamp = lambda x, m: F.least(F.greatest(x, m["lo"]), m["hi"])
    then = lambda f, g: shift(f["a"] + g["a"], clamp(f["lo"] + g["a"], g), clamp(f["hi"] + g["a"], g))
    none, full = F.lit(0), F.lit(limit)
    rows = numbered(events.select("session_id", "seq", (F.col("kind") == "put").alias("put")), ["session_id"], "seq")
    e = F.sort_array(F.collect_list(F.struct("place", "seq", "put")))
    blocks = rows.groupBy("session_id", F.expr(f"place div {RUN}").alias("block")).agg(e.alias("e"))
    whole = F.aggregate("e", shift(none, none, full), lambda m, x: then(m, shift(F.when(x["put"], 1).otherwise(-1), none, full)))
    carry = carried(blocks.select("session_id", "block", whole.alias("value")), ["session_id"], "block", shift(none, none, full), then)

    def step(s, x):
        takes = x["put"] & (s["depth"] < limit)
        depth = F.when(x["put"], F.least(s["depth"] + 1, full)).otherwise(F.greatest(none, s["depth"] - 1))
        return F.named_struct(F.lit("depth"), depth.cast("long"), F.lit("out"), F.when(takes, F.array_append(s["out"], x["seq"])).otherwise(s["out"]))

    start = F.named_struct(F.lit("depth"), clamp(F.col("carry.a"), F.col("carry")), F.lit("out"), F.array().cast("array<bigint>"))
    return blocks.join(carry, ["session_id", "block"]).select("session_id", F.explode(F.aggregate("e", start, step)["out"]).alias("seq"))


def recognition_windows(endpoints: DataFrame) -> DataFrame:
    """The windows to recognise, numbered in order in their session, with their length."""
    order = W.partitionBy("job_id").orderBy("start_ms", "end_ms")
    return endpoints.filter("end_ms > start_ms").select("job_id", (F.row_number().over(order) - 1).cast("long").alias("window"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "reason")


def confirmations(results: DataFrame) -> DataFrame:
    """After each result (session_id, seq, end_ms, ok): how many are confirmed and failed so far, and the latest end
    confirmed, which never goes back."""
    order = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    count = lambda c: F.sum(c.cast("long")).over(order)
    return results.select("session_id", "seq", count(F.col("ok")).alias("confirmed"), count(~F.col("ok")).alias("failed"), F.max(F.when(F.col("ok"), F.col("end_ms"))).over(order).alias("confirmed_end_ms"))


def evicted(buffers: DataFrame, confirmed: DataFrame) -> DataFrame:
    """What is left of buffered ranges (session_id, start_ms, end_ms) after all up to the session's confirmed end is
    let go (``confirmed``: session_id, confirmed_end_ms): later ranges stay, one across it loses its beginning."""
    joined = buffers.join(confirmed, "session_id", "left")
    return joined.filter(F.coalesce(F.col("end_ms") > F.col("confirmed_end_ms"), F.lit(True))).select("session_id", F.greatest("start_ms", "confirmed_end_ms").alias("start_ms"), "end_ms")


def current_work(requests: DataFrame) -> DataFrame:
    """The partial requests (key, seq, generation) that are not stale when they come: none of a later generation has
    come before in the key's order."""
    before = F.max("generation").over(W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return requests.withColumn("_b", before).filter("_b is null or generation >= _b").drop("_b")


def replayed(log: DataFrame, subscribers: DataFrame) -> DataFrame:
    """What a subscriber (job, subscriber, since) sees of a job's log (job, seq, kind, id): a snapshot, the last event
    of each id up to ``since``, then every later event up to the first terminal one (done, failed)."""
    end = log.filter(F.col("kind").isin("done", "failed")).groupBy("job").agg(F.min("seq").alias("last"))
    joined = log.join(subscribers, "job").join(end, "job", "left").filter("last is null or seq <= last")
    newest = F.max("seq").over(W.partitionBy("job", "subscriber", "id", F.col("seq") <= F.col("since")))
    return joined.withColumn("_n", newest).filter("seq > since or seq = _n").select("job", "subscriber", "seq", "kind", "id", F.when(F.col("seq") <= F.col("since"), "snapshot").otherwise("tail").alias("part"))
