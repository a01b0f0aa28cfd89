"""Voice endpointing (T3, T4, T5): hysteresis over frames, in batch by marks, in Structured Streaming as a state machine."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import BLOCK, numbered

OUTPUT = "job_id long, start_ms long, end_ms long, reason string"
_STATE = "now long, run long, quiet long, start long, speaking boolean"


@dataclass(frozen=True)
class Endpointing:
    """Times in milliseconds. Speech starts after ``min_speech`` of frames at ``start_prob`` or more and ends after
    ``min_silence`` of frames under ``end_prob``; utterances keep ``pre_roll`` before and ``post_roll`` after it and are
    cut at ``max_window``."""

    frame: int = 100
    start_prob: float = 0.5
    end_prob: float = 0.35
    min_speech: int = 250
    min_silence: int = 600
    pre_roll: int = 300
    post_roll: int = 100
    max_window: int = 15_000

    def __post_init__(self):
        if min(self.frame, self.min_speech, self.min_silence, self.max_window) <= 0 or min(self.pre_roll, self.post_roll) < 0:
            raise ValueError("times must be positive, rolls not negative")
        if not 0 <= self.end_prob <= self.start_prob <= 1:
            raise ValueError("0 <= end_prob <= start_prob <= 1 must hold")

    def step(self, state: tuple, prob: float) -> tuple[tuple, tuple | None]:
        """State after one frame, and the utterance (start, end, reason) that it ends, if any.

        State: time so far, length of the run of speech frames, length of the run of quiet frames, utterance start (or
        the end of the last utterance, before which no pre-roll reaches), and whether speech is on."""
        now, run, quiet, start, speaking = state
        now += self.frame
        if not speaking:
            run = run + self.frame if prob >= self.start_prob else 0
            if run < self.min_speech:
                return (now, run, 0, start, False), None
            start, speaking, quiet = max(start, now - run - self.pre_roll, 0), True, 0
        else:
            quiet = quiet + self.frame if prob < self.end_prob else 0
        if quiet >= self.min_silence:
            end = min(now, now - quiet + self.post_roll)
            return (now, 0, 0, end, False), (start, end, "speech_end")
        if now - start >= self.max_window:
            return (now, run, quiet, now, True), (start, now, "max_window")
        return (now, run, quiet, start, speaking), None

    def stop(self, state: tuple) -> tuple | None:
        """The utterance that is open when the session stops; an unconfirmed run of speech counts."""
        now, run, _quiet, start, speaking = state
        if speaking:
            return (start, now, "session_stop") if now > start else None
        return (max(start, now - run - self.pre_roll, 0), now, "session_stop") if run else None


_FRESH = (0, 0, 0, 0, False)


def _marks(frames: DataFrame, config: Endpointing, on: int, off: int) -> DataFrame:
    """(job_id, place, speech): where speech starts and ends, in turn. Speech is on after the last place of ``on`` frames of
    speech in a row unless one of ``off`` quiet frames in a row follows. Blocks of frames, each with the end of the one
    before, are searched side by side; of a block only its changes go on to the job's order."""
    width = max(BLOCK, 4 * max(on, off))
    place = F.col("place")
    again = F.pmod(place, F.lit(width)) >= width - max(on, off) + 1
    blocks = F.array_compact(F.array(F.lit(0).cast("bigint"), F.when(again, F.lit(1).cast("bigint"))))
    dealt = frames.select("job_id", "place", "prob", F.explode(blocks).alias("next")).withColumn("b", F.floor(place / width) + F.col("next"))
    order = W.partitionBy("job_id", "b").orderBy("place")
    row = lambda c, n: F.count_if(c).over(order.rowsBetween(1 - n, 0)) == n
    found = dealt.withColumns({"speech": row(F.col("prob") >= config.start_prob, on), "quiet": row(F.col("prob") < config.end_prob, off)})
    found = found.filter("next = 0 and (speech or quiet)").select("job_id", "b", "place", "speech")
    changes = found.withColumn("was", F.lag("speech").over(order)).filter("was is null or was <> speech").drop("was")
    was = F.coalesce(F.lag("speech").over(W.partitionBy("job_id").orderBy("place")), F.lit(False))
    return changes.select("job_id", "place", "speech", was.alias("was")).filter("was <> speech").drop("was")


def endpoints(frames: DataFrame, config: Endpointing = Endpointing()) -> DataFrame:
    """T3 over complete sessions (job_id, frame, prob), in frame order; frames count from the first one on.

    The state machine of ``Endpointing`` without its groups: utterances are what lies between the marks of ``_marks``, and
    cuts at the longest window are counted from an utterance's start. A null probability is neither speech nor quiet."""
    step = config.frame
    on, off, window = (-(-x // step) for x in (config.min_speech, config.min_silence, config.max_window))
    rows = numbered(frames.select("job_id", "frame", "prob"), ["job_id"], "frame")
    order = W.partitionBy("job_id").orderBy("place")
    marks = _marks(rows, config, on, off).withColumn("until", F.lead("place").over(order)).filter("speech")
    now = (F.col("place") + 1) * step
    quiet = (F.col("until") + 1) * step
    said = marks.withColumns({"now": now, "quiet": quiet, "end": F.least(quiet, quiet - off * step + config.post_roll)})
    start = F.greatest(F.coalesce(F.lag("end").over(order), F.lit(0)), F.col("now") - on * step - config.pre_roll, F.lit(0))
    total = rows.groupBy("job_id").agg((F.max("place") + 1).alias("n"))
    said = said.withColumn("start", start).join(total, "job_id")
    first = F.greatest("now", F.ceil((F.col("start") + config.max_window) / step) * step)
    limit = F.coalesce(F.col("quiet") - step, F.col("n") * step)
    cuts = F.when(first <= limit, F.sequence(first, limit, F.lit(window * step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    said = said.withColumn("cuts", cuts)
    ends = F.concat("cuts", F.array(F.coalesce("end", F.col("n") * step)))
    last = F.when(F.col("end").isNull(), "session_stop").otherwise("speech_end")
    reason = F.concat(F.array_repeat(F.lit("max_window"), F.size("cuts")), F.array(last))
    pieces = F.arrays_zip(F.concat(F.array("start"), "cuts").alias("start_ms"), ends.alias("end_ms"), reason.alias("reason"))
    made = said.select("job_id", F.inline(pieces)).filter("reason <> 'session_stop' or end_ms > start_ms")
    # a run of speech that is not confirmed when the session stops counts, unless speech is on
    tail = rows.join(total, "job_id").filter(F.col("place") >= F.col("n") - on)
    tail = tail.groupBy("job_id", "n").agg(F.max(F.when(F.col("prob") >= config.start_prob, F.lit(None)).otherwise(F.col("place"))).alias("other"))
    tail = tail.withColumn("run", F.col("n") - 1 - F.coalesce("other", F.lit(-1))).filter("run > 0")
    done = said.groupBy("job_id").agg(F.max("end").alias("ended"), F.bool_or(F.col("end").isNull()).alias("open"))
    tail = tail.join(done, "job_id", "left").filter("not coalesce(open, false)")
    begun = F.greatest(F.coalesce("ended", F.lit(0)), F.col("n") * step - F.col("run") * step - config.pre_roll, F.lit(0))
    stops = tail.select("job_id", begun.alias("start_ms"), (F.col("n") * step).alias("end_ms"), F.lit("session_stop").alias("reason"))
    return made.unionByName(stops)


class EndpointProcessor(StatefulProcessor):
    """T3 over a stream: the state machine's five values are the state of a session. A null probability is the stop mark."""

    def __init__(self, config: Endpointing = Endpointing()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("endpointing", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.state.get()) if self.state.exists() else _FRESH
        for pdf in rows:
            out = []
            for prob in pdf.sort_values("frame")["prob"]:
                if pd.isna(prob):
                    out.append(self.config.stop(state))
                    state = _FRESH
                    continue
                state, done = self.config.step(state, prob)
                out.append(done)
            if out := [x for x in out if x]:
                made = pd.DataFrame(out, columns=["start_ms", "end_ms", "reason"])
                made.insert(0, "job_id", key[0])
                yield made
        self.state.update(state)

    def close(self) -> None:
        pass


def stream_endpoints(frames: DataFrame, config: Endpointing = Endpointing()) -> DataFrame:
    """T3 on a streaming DataFrame. Frames of a session must arrive in order from batch to batch (any order inside one);
    needs the RocksDB state store provider."""
    return frames.groupBy("job_id").transformWithStateInPandas(EndpointProcessor(config), OUTPUT, "append", "none")
