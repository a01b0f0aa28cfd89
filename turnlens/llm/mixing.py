"""Mixing sources to target weights (operator 1): Pfair block scheduling, on DataFrame functions only.

In the ideal (fluid) stream every source that still has blocks is served at all times, at its weight's share. Block k
of a source is served there in a stretch of time; the slots that this stretch touches are the block's window, from its
release to its deadline. Each slot goes to the released block of earliest deadline, so that every source is always less
than one block away from the fluid stream of the exact weights. The schedule is cut into frames: the blocks done before
a frame are settled beforehand (see ``frame_starts``), so that frames are scheduled side by side.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import checkpoint

#: Rows of one numbering bucket, buckets of one sum of buckets, slots of a frame at least, frames at most.
BUCKET_ROWS, BUCKET_SUM, FRAME, FRAMES = 4096, 4096, 4096, 256
#: A time so close to a whole number is that number.
_NEAR = 1e-6


class Fluid:
    """The ideal stream: after time t, sources are at the virtual time v where the sum of min(weight * v, blocks) is t."""

    def __init__(self, blocks: list[int], weights: list[float]):
        self.blocks, self.weights = blocks, weights
        order = sorted(range(len(blocks)), key=lambda i: blocks[i] / weights[i])
        self.ends = [blocks[i] / weights[i] for i in order]
        self.done = [0, *accumulate(blocks[i] for i in order)]
        rest = [*accumulate(weights[i] for i in reversed(order))]
        self.rates = [*reversed(rest), 0.0]
        self.times = [self.done[k] + end * self.rates[k] for k, end in enumerate(self.ends)]

    def time(self, v: float) -> float:
        k = bisect_left(self.ends, v)
        return self.done[k] + v * self.rates[k]

    def virtual(self, t: float) -> float:
        k = min(bisect_left(self.times, t), len(self.times) - 1)
        return (t - self.done[k]) / self.rates[k]

    def window(self, i: int, k: int) -> tuple[int, int]:
        start, end = (self.time(x / self.weights[i]) for x in (k, k + 1))
        return floor(start + _NEAR), ceil(end - _NEAR)


def frame_starts(fluid: Fluid, t: int) -> list[int]:
    """By source: its blocks that are done before slot ``t``.

    These are the blocks that the fluid stream has finished by then, and as many of those it is serving as make ``t``.
    The m-th of these is taken from the shortest prefix, by release, of which the fluid has served m blocks' worth, and
    is the one of earliest deadline there. So enough early releases are taken for the slots before ``t``, and enough
    early deadlines for those after: the frames on both sides can meet every window."""
    v = fluid.virtual(t)
    served = [min(w * v, float(n)) for w, n in zip(fluid.weights, fluid.blocks, strict=True)]
    done = [floor(x + _NEAR) for x in served]
    under = [(*fluid.window(i, done[i]), i, served[i] - done[i]) for i in range(len(done)) if served[i] - done[i] > _NEAR]
    under.sort()
    ready: list[tuple[int, int]] = []
    at, part = 0, 0.0
    for m in range(1, t - sum(done) + 1):
        while at < len(under) and (part + _NEAR < m or not ready):
            _release, due, i, share = under[at]
            heapq.heappush(ready, (due, i))
            at, part = at + 1, part + share
        done[heapq.heappop(ready)[1]] += 1
    return done


def _schedule(spark: SparkSession, blocks: list[int], weights: list[float]) -> DataFrame:
    """(i, block, slot): the slot of every block of every source i."""
    fluid, total = Fluid(blocks, weights), sum(blocks)
    # a frame is longer than two windows, so that no block spans it
    size = max(FRAME, ceil(2 * sum(weights) / min(weights)) + 2, -(-total // FRAMES))
    cuts = [*range(0, total, size), total]
    starts = [[0] * len(blocks), *(frame_starts(fluid, t) for t in cuts[1:-1]), blocks]
    plan = [{"first": a, "stop": b, "k": s, "last": e} for a, b, s, e in zip(cuts[:-1], cuts[1:], starts[:-1], starts[1:], strict=True)]
    kind = "array<struct<first:bigint,stop:bigint,k:array<bigint>,last:array<bigint>>>"
    frames = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), kind))).repartition(len(plan), "first")
    sources = F.from_json(F.lit(json.dumps([{"w": w, "n": n} for w, n in zip(weights, blocks, strict=True)])), "array<struct<w:double,n:double>>")
    frames = frames.withColumn("sources", sources)

    def time(v):
        return F.aggregate("sources", F.lit(0.0), lambda a, s: a + F.least(s["w"] * v, s["n"]))

    def opened(i, k):
        """Block k of source i with its window."""
        w = F.get("sources", i)["w"]
        release, due = F.floor(time(k / w) + _NEAR), F.ceil(time((k + 1) / w) - _NEAR)
        return F.struct(i.alias("i"), k.alias("k"), release.alias("release"), F.least(due, "stop").alias("due"))

    def least(blocks):
        return F.array_min(F.transform(blocks, lambda o: F.struct(o["due"], o["i"], o["k"])))

    def step(state, slot):
        left = F.filter(state["open"], lambda o: o["k"] < F.get("last", o["i"]))
        pick = F.coalesce(least(F.filter(left, lambda o: o["release"] <= slot)), least(left))
        after = lambda p: F.transform(state["open"], lambda o: F.when(o["i"] == p["i"], opened(o["i"], o["k"] + 1)).otherwise(o))
        made = lambda p: F.concat(state["out"], F.array(F.struct(p["i"].alias("i"), p["k"].alias("block"))))
        return F.transform(F.array(pick), lambda p: F.struct(after(p).alias("open"), made(p).alias("out")))[0]

    none = F.array().cast("array<struct<i:int,block:bigint>>")

    def run(state, first):
        """A stretch of slots at a time, so that no long array is copied for every slot."""
        slots = F.sequence(first, F.least(first + 255, F.col("stop") - 1))
        made = F.aggregate(slots, F.struct(state["open"].alias("open"), none.alias("out")), step)
        return F.transform(F.array(made), lambda m: F.struct(m["open"].alias("open"), F.concat(state["parts"], F.array(m["out"])).alias("parts")))[0]

    opening = F.transform("k", lambda k, i: opened(i, k))
    start = F.struct(opening.alias("open"), F.array().cast("array<array<struct<i:int,block:bigint>>>").alias("parts"))
    parts = F.aggregate(F.sequence(F.col("first"), F.col("stop") - 1, F.lit(256).cast("long")), start, run)["parts"]
    return frames.select("first", F.posexplode(F.flatten(parts)).alias("at", "b")).select("b.i", "b.block", (F.col("first") + F.col("at")).alias("slot"))


def schedule(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """(source, block, slot) for sources of so many blocks (1 or more) and weights above 0."""
    names = sorted(blocks)
    if bad := [s for s in names if not 0 < weights[s] < float("inf")]:
        raise ValueError(f"weights must be above 0: {bad[:5]}")
    table = F.from_json(F.lit(json.dumps(names)), "array<string>")
    found = _schedule(spark, [blocks[s] for s in names], [float(weights[s]) for s in names])
    return found.select(F.get(table, F.col("i")).alias("source"), "block", "slot")


def temper(counts: dict[str, int], alpha: float) -> dict[str, float]:
    """Target weights from sizes: size to the power alpha (1: as it is, 0: all alike)."""
    return {s: float(max(n, 1)) ** alpha for s, n in counts.items()}


def _bucket_offsets(counted: DataFrame) -> DataFrame:
    """(s, b, n, o): o rows of the source come before the bucket. Sums of buckets are added up first, so that no task
    holds all buckets of a source."""
    wide = counted.withColumn("g", F.expr(f"b div {BUCKET_SUM}"))
    sums = wide.groupBy("s", "g").agg(F.sum("n").alias("m"))
    before = sums.select("s", "g", (F.sum("m").over(W.partitionBy("s").orderBy("g")) - F.col("m")).alias("p"))
    inside = F.sum("n").over(W.partitionBy("s", "g").orderBy("b")) - F.col("n")
    return wide.withColumn("q", inside).join(before, ["s", "g"]).select("s", "b", "n", (F.col("p") + F.col("q")).alias("o"))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block_rows: int = 64,
    key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """``docs`` with block, slot and position (bigint): the order of a stream that mixes the sources by weight.

    Every row comes out once. Rows of a source are numbered in a fixed shuffled order (hash of key and row) and cut
    into blocks of ``block_rows``; the last block of a source may be shorter. position is slot * block_rows + place in
    the block, unique, growing in stream order. Weights (above 0) are per source, or size ** alpha where None or a
    source is not named; null sources are one source "". At every slot each source is less than one block away from
    its share by the exact weights; when a source runs out, the others share its part by their weights. Columns named
    block, slot or position are replaced, all other names stay; rows that are equal in all columns are interchangeable,
    and null keys are told apart by the other columns. An empty table gives an empty result.

    No source is ever gathered in one task: numbering works in hash buckets of about BUCKET_ROWS rows, whose offsets
    come from a table of bucket counts, and each bucket carries the slots of its own blocks. The driver gets one count
    for each source, and settles the starts of at most FRAMES frames.
    """
    spark = docs.sparkSession
    base = docs.drop("block", "slot", "position")
    named = F.coalesce(F.col(source).cast("string"), F.lit("")) if source in base.columns else F.lit("")
    plain = [f.name for f in base.schema.fields if f.dataType.typeName() not in ("map", "variant") and f.name != key]
    hashed = F.xxhash64(*plain) if plain else F.lit(0).cast("long")
    sizes = {r[0]: r[1] for r in base.groupBy(named.alias("s")).agg(F.count("*").alias("n")).collect()}
    # the whole row travels as one column, so that no name of it is taken
    told = F.when(F.col(key).isNull(), hashed).otherwise(F.xxhash64(key))
    bucket = F.pmod(told, F.lit(max(1, -(-sum(sizes.values()) // BUCKET_ROWS))))
    rows = base.select(F.struct(*base.columns).alias("row"), named.alias("s"), bucket.alias("b"), F.col(key).alias("k"), hashed.alias("h"))
    if not sizes:
        none = F.lit(None).cast("long")
        return rows.select("row.*", none.alias("block"), none.alias("slot"), none.alias("position"))
    counted = checkpoint(base.groupBy(named.alias("s"), bucket.alias("b")).agg(F.count("*").alias("n")))
    plan = schedule(spark, {s: -(-n // block_rows) for s, n in sizes.items()}, temper(sizes, alpha) | {s: w for s, w in (weights or {}).items() if s in sizes})
    offsets = _bucket_offsets(counted)
    touched = offsets.select("s", "b", "o", F.explode(F.expr(f"sequence(o div {block_rows}, (o + n - 1) div {block_rows})")).alias("block"))
    slots = touched.join(plan.withColumnRenamed("source", "s"), ["s", "block"]).groupBy("s", "b", "o").agg(F.sort_array(F.collect_list(F.struct("block", "slot"))).alias("slots"))
    order = W.partitionBy("s", "b").orderBy(F.xxhash64("k", "h"), "k", "h")
    numbered = rows.join(checkpoint(slots), ["s", "b"]).withColumn("n", F.col("o") + F.row_number().over(order) - 1)
    block = F.expr(f"n div {block_rows}")
    slot = F.expr(f"get(slots, cast(n div {block_rows} - o div {block_rows} as int)).slot")
    return numbered.select("row.*", block.alias("block"), slot.alias("slot"), (slot * block_rows + F.expr(f"n % {block_rows}")).alias("position"))
