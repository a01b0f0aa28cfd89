"""Rules of live sessions on streams (T6, T8, T9, T11, T12, T13, T21), with the rows that the batch forms give.

A key's events arrive in order from batch to batch (any order inside one). What a rule must remember is a state of its
own: one value, or a map of what may still change. Streams need the RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> list:
    """The rows of a key in one micro-batch."""
    found = list(rows)
    return list(pd.concat(found).sort_values(order).itertuples(index=False)) if found else []


def _made(key: tuple, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Output rows, led by the key."""
    made = pd.DataFrame([(*key, *r) for r in rows], columns=names)
    return made.astype({c: "Int64" for c in names if len(made) and made[c].map(lambda x: x is None or (isinstance(x, int) and not isinstance(x, bool))).all()})


class Fold(StatefulProcessor):
    """A rule whose state is one tuple: ``step(state, row)`` gives the next state and the rows that come out."""

    def __init__(self, state: str, start: tuple, order: list[str], step: Callable, names: list[str]):
        self.schema, self.start, self.order, self.step, self.names = state, start, order, step, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.state.get()) if self.state.exists() else self.start
        out = []
        for row in _in_order(rows, self.order):
            state, more = self.step(state, row)
            out += more
        self.state.update(state)
        if out:
            yield _made(key, out, self.names)

    def close(self) -> None:
        pass


def _fold(rows: DataFrame, keys: list[str], schema: str, processor: StatefulProcessor, mode: str = "append") -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "none")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def stream_requests(ticks: DataFrame, least: int = 400, every: int = 600, most: int = 5000) -> DataFrame:
    """T6 on a stream of ticks (utterance, start_ms, now_ms): the latest request is the state."""
    schema = "utterance long, start_ms long, from_ms long, end_ms long"

    def step(state, row):
        now, begun = int(row.now_ms), int(row.start_ms)
        if now - begun < least or (state[0] is not None and now - state[0] < every):
            return state, []
        return (now,), [(max(begun, now - most), now)]

    return _fold(ticks, ["utterance", "start_ms"], schema, Fold("last long", (None,), ["now_ms"], step, _names(schema)))


def stream_confirmations(results: DataFrame) -> DataFrame:
    """T8 on a stream of results (session_id, seq, end_ms, ok): counts and the latest confirmed end, which never goes back."""
    schema = "session_id long, seq long, confirmed long, failed long, confirmed_end_ms long"

    def step(state, row):
        good, bad, end = state
        good, bad = good + bool(row.ok), bad + (not row.ok)
        end = max(end if end is not None else int(row.end_ms), int(row.end_ms)) if row.ok else end
        return (good, bad, end), [(int(row.seq), good, bad, end)]

    return _fold(results, ["session_id"], schema, Fold("good long, bad long, end long", (0, 0, None), ["seq"], step, _names(schema)))


def stream_current_work(requests: DataFrame) -> DataFrame:
    """T11 on a stream of requests (key, seq, generation): those that are not stale, with how many of the key were dropped
    before."""
    schema = "key long, seq long, generation long, dropped long"

    def step(state, row):
        newest, dropped = state
        if newest is not None and row.generation < newest:
            return (newest, dropped + 1), []
        return (int(row.generation), dropped), [(int(row.seq), int(row.generation), dropped)]

    return _fold(requests, ["key"], schema, Fold("newest long, dropped long", (None, 0), ["seq"], step, _names(schema)))


def stream_tail(log: DataFrame, subscribers: DataFrame) -> DataFrame:
    """The live tail of a job's log (job, seq, kind, id) for subscribers (job, subscriber, since; a stored table): every
    event after ``since`` once, in order, up to the first terminal one. Together with the stored snapshot up to ``since``
    (``sessions.replayed``) nothing is lost or doubled: what has been delivered is the state."""
    schema = "job long, subscriber long, seq long, kind string, id long"

    def step(state, row):
        last, ended = state
        if ended or row.seq <= max(last, row.since) and row.kind not in ("done", "failed") or row.seq <= last:
            return state, []
        ended = row.kind in ("done", "failed")
        return (int(row.seq), ended), [(int(row.seq), row.kind, int(row.id))] if row.seq > row.since else []

    fold = Fold("last long, ended boolean", (-1, False), ["seq"], step, _names(schema))
    return _fold(log.join(subscribers, "job"), ["job", "subscriber"], schema, fold)


class Log(StatefulProcessor):
    """The live rows of a job's log are a map by id, which a snapshot clears."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "id long", "value double")

    def handleInputRows(self, key, rows, timerValues):
        out: dict[int, tuple] = {}
        for row in _in_order(rows, ["seq"]):
            if row.kind == "snapshot":
                out |= {k[0]: (int(row.seq), None, False) for k in list(self.live.keys())}
                self.live.clear()
            else:
                self.live.updateValue((int(row.id),), (float(row.value),))
                out[int(row.id)] = (int(row.seq), float(row.value), True)
        yield pd.DataFrame([(key[0], i, *x) for i, x in out.items()], columns=["job", "id", "seq", "value", "live"])

    def close(self) -> None:
        pass


def stream_log(log: DataFrame) -> DataFrame:
    """T13 on a stream (job, seq, kind: snapshot or upsert, id, value: double), in update mode: the rows (job, id) that a
    batch changed, with the seq that did it; ``live`` is false where a snapshot cleared it."""
    return _fold(log, ["job"], "job long, id long, seq long, value double, live boolean", Log(), "update")


class Transcripts(StatefulProcessor):
    """Confirmed rows by start; partial ones by start with the best end, and whether a confirmed one hides them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sure = handle.getMapState("sure", "start long", "end long, seq long")
        self.open = handle.getMapState("open", "start long", "end long, seq long, hidden boolean")

    def handleInputRows(self, key, rows, timerValues):
        out: dict[tuple, tuple] = {}
        for row in _in_order(rows, ["seq"]):
            start, end, seq = int(row.start_ms), int(row.end_ms), int(row.seq)
            if row.kind == "delta":
                self.sure.updateValue((start,), (end, seq))
                out["delta", start] = (end, seq, True)
                for (at,), (last, n, hidden) in list(self.open.iterator()):
                    if not hidden and at <= start <= last:
                        self.open.updateValue((at,), (last, n, True))
                        out["partial", at] = (last, n, False)
            elif row.kind == "partial":
                best = self.open.getValue((start,)) if self.open.containsKey((start,)) else None
                if best is None or (end, seq) > tuple(best[:2]):
                    hidden = any(start <= at <= end for (at,) in list(self.sure.keys()))
                    self.open.updateValue((start,), (end, seq, hidden))
                    out["partial", start] = (end, seq, not hidden)
        yield pd.DataFrame([(key[0], kind, at, *x) for (kind, at), x in out.items()], columns=["session_id", "kind", "start_ms", "end_ms", "seq", "live"])

    def close(self) -> None:
        pass


def stream_transcripts(log: DataFrame) -> DataFrame:
    """T12 on a stream (session_id, seq, kind: delta or partial, start_ms, end_ms), in update mode: the rows (session_id,
    kind, start_ms) that a batch changed; ``live`` is false where a confirmed row hides a partial one."""
    return _fold(log, ["session_id"], "session_id long, kind string, start_ms long, end_ms long, seq long, live boolean", Transcripts(), "update")


class Buffers(StatefulProcessor):
    """A session's buffered ranges, and the confirmed end below which nothing is kept."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getListState("ranges", "start long, end long", self.keep_ms)
        self.mark = handle.getValueState("mark", "at long, version long")

    def handleInputRows(self, key, rows, timerValues):
        at, version = tuple(self.mark.get()) if self.mark.exists() else (None, 0)
        ranges = [tuple(x) for x in self.ranges.get()]
        for row in _in_order(rows, ["seq"]):
            if row.kind == "confirm":
                at = int(row.end_ms) if at is None else max(at, int(row.end_ms))
            else:
                ranges.append((int(row.start_ms), int(row.end_ms)))
        ranges = [(a if at is None else max(a, at), b) for a, b in ranges if at is None or b > at]
        self.ranges.clear()
        if ranges:
            self.ranges.put(ranges)
        self.mark.update((at, version + 1))
        yield _made(key, [(version + 1, a, b) for a, b in ranges] or [(version + 1, None, None)], ["session_id", "version", "start_ms", "end_ms"])

    def close(self) -> None:
        pass


def stream_buffers(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """T9 on a stream (session_id, seq, kind: buffer or confirm, start_ms, end_ms), in update mode: after each batch what is
    kept of the sessions it touched, as rows of a new version (nulls: nothing). Ranges that nobody confirms go after
    ``keep_ms`` of processing time."""
    kind = "processingTime" if keep_ms else "none"
    schema = "session_id long, version long, start_ms long, end_ms long"
    return events.groupBy("session_id").transformWithStateInPandas(Buffers(keep_ms), schema, "update", kind)
