"""Scans that need no group of a key's own: numbering, running sums, range searches, folds of blocks, successor chains.

Rows of a key are cut into blocks or bins; what goes on inside a block is a window or a fold over that block, and only one
summary a block is carried on. A key that holds a third of all rows is as many blocks as it needs.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows or values of a block.
BLOCK = 1024


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir, which all executors share; only where that is unset and
    the master is local, as in tests, in a local one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def _before(blocks: DataFrame, keys: list[str], block: str, value: str) -> Column:
    """The sum of ``value`` over the earlier blocks of the key (one row a block)."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def running(rows: DataFrame, keys: list[str], by: str, value: Column, name: str, width: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to and with each row, by the integer ``by``. Blocks are ranges of
    ``width`` of it."""
    dealt = rows.withColumns({"_b": F.floor(F.col(by) / width), "_v": value})
    sums = dealt.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    sums = sums.select(*keys, "_b", _before(sums, keys, "_b", "_s").alias("_c"))
    here = W.partitionBy(*keys, "_b").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    return dealt.withColumn("_v", F.sum("_v").over(here)).join(sums, [*keys, "_b"]).withColumn(name, F.col("_c") + F.col("_v")).drop("_b", "_v", "_c")


def numbered(rows: DataFrame, keys: list[str], by: str, name: str = "place", width: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: their numbers from 0 within the key, by the integer ``by``."""
    return running(rows, keys, by, F.lit(1).cast("long"), name, width).withColumn(name, F.col(name) - 1)


def counted_upto(values: DataFrame, queries: DataFrame, keys: list[str], at: str, name: str, width: int = BLOCK) -> DataFrame:
    """``queries`` (keys, at, ...) with ``name``: how many of ``values`` (keys, at) are at or below ``at``. Both are dealt
    to bins of ``width``; a bin is one sort, and lower bins count as a whole."""
    bin_ = F.floor(F.col(at) / width)
    sides = values.select(*keys, at).withColumns({"_q": F.lit(0), "_n": F.lit(1)}).unionByName(queries.withColumns({"_q": F.lit(1), "_n": F.lit(0)}), allowMissingColumns=True).withColumn("_b", bin_)
    sums = sides.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"))
    sums = sums.select(*keys, "_b", _before(sums, keys, "_b", "_s").alias("_c"))
    here = W.partitionBy(*keys, "_b").orderBy(at, "_q").rowsBetween(W.unboundedPreceding, 0)
    found = sides.withColumn("_n", F.sum("_n").over(here)).filter("_q = 1").join(sums, [*keys, "_b"])
    return found.withColumn(name, F.col("_c") + F.col("_n")).drop("_q", "_n", "_b", "_c")


def carried(blocks: DataFrame, keys: list[str], block: str, start: Column, combine: Callable[[Column, Column], Column], width: int = 64) -> DataFrame:
    """(keys, block, carry): for each block the combination of the ``value`` of all earlier ones, by the associative
    ``combine``, from ``start``. Blocks (numbered from 0) are folded in runs of ``width``, runs of runs likewise, so no
    array is longer than ``width``."""
    most = blocks.agg(F.max(block)).first()[0] or 0
    runs = blocks.groupBy(*keys, F.expr(f"{block} div {width}").alias("_up")).agg(F.sort_array(F.collect_list(F.struct(F.col(block).alias("at"), "value"))).alias("_r"))
    if most >= width:
        sums = runs.select(*keys, F.col("_up").alias(block), F.aggregate("_r", start, lambda s, x: combine(s, x["value"])).alias("value"))
        above = carried(sums, keys, block, start, combine, width).withColumnsRenamed({block: "_up", "carry": "_in"})
        runs = runs.join(above, [*keys, "_up"])
    else:
        runs = runs.withColumn("_in", start)
    upto = F.transform("_r", lambda x, k: F.named_struct(F.lit(block), x["at"], F.lit("carry"), F.aggregate(F.slice("_r", 1, k), F.col("_in"), lambda s, y: combine(s, y["value"]))))
    return runs.select(*keys, F.inline(upto))


def chain(links: DataFrame, keys: list[str], width: int = BLOCK) -> DataFrame:
    """(keys, place): the places on the way from the first one of each key. ``links``: keys, place, next (null at the end; a
    later place), first.

    Places are cut into blocks of ``width``. Where a way can enter a block, at a place that another block leads to, it is
    walked to where it leaves: one link over the block. These links are doubled: after k rounds the first 2 ** k entries
    are known and each link spans as many blocks, so the rounds are the logarithm of the blocks on the longest way. The
    blocks with a known entry are then walked side by side."""
    block = lambda c: F.expr(f"{c} div {width}")
    rows = links.select(*keys, "place", "next", "first", block("place").alias("block"))
    blocks = rows.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("place", "next"))).alias("p"))
    crossing = rows.filter(block("next") > F.col("block")).select(*keys, F.col("next").alias("place"), F.lit(False).alias("first"))
    entries = rows.filter("first").select(*keys, "place", "first").unionByName(crossing).groupBy(*keys, "place").agg(F.bool_or("first").alias("first"))
    walked = entries.withColumn("block", block("place")).join(blocks, [*keys, "block"])
    leaves = F.aggregate("p", F.col("place"), lambda at, x: F.when(x["place"] == at, x["next"]).otherwise(at))
    over = cut_lineage(walked.select(*keys, "place", "first", leaves.alias("next")))
    known = over.filter("first").select(*keys, "place")
    jump = over.filter("next is not null").select(*keys, "place", "next")
    while True:
        more = cut_lineage(known.join(jump, [*keys, "place"]).select(*keys, F.col("next").alias("place")))
        if more.isEmpty():
            break
        known = cut_lineage(known.unionByName(more))
        further = jump.select(*keys, F.col("place").alias("next"), F.col("next").alias("_far"))
        jump = cut_lineage(jump.join(further, [*keys, "next"]).select(*keys, "place", F.col("_far").alias("next")))
    start = F.named_struct(F.lit("at"), F.col("place"), F.lit("out"), F.array().cast("array<bigint>"))

    def step(s, x):
        here = x["place"] == s["at"]
        return F.named_struct(F.lit("at"), F.when(here, x["next"]).otherwise(s["at"]), F.lit("out"), F.when(here, F.array_append(s["out"], x["place"])).otherwise(s["out"]))

    seen = known.withColumn("block", block("place")).join(blocks, [*keys, "block"])
    return seen.select(*keys, F.explode(F.aggregate("p", start, step)["out"]).alias("place"))
