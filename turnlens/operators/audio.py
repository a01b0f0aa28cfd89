"""Waveform operators on arrays of samples: gain, resampling, log-mel features, quiet cuts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y


def rms_normalize(samples, target: float = 0.05, most: float = 3.0, peak: float = 0.99, least: float = 1e-6) -> F.Column:
    """quiet audio is raised to ``target`` RMS by a gain of at most ``most`` without passing ``peak``; silent and
    loud audio stays."""
    x = F.col(samples)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rms = F.sqrt(total / F.greatest(F.size(x), F.lit(1)))
    top = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    gain = F.when((rms <= least) | (rms >= target), 1.0).otherwise(F.least(target / rms, F.lit(most), F.when(top > 0, peak / top).otherwise(most)))
    return F.transform(x, lambda v: v.cast("double") * gain)


def resample(audio: DataFrame, have: int, want: int) -> DataFrame:
    """Linear interpolation of (id, samples) from ``have`` to ``want`` samples a second, by index."""
    n = F.floor(F.size("samples") * F.lit(want) / have).cast("int")
    last = F.size("samples") - 1

    def at(k):
        place = k * F.lit(have) / want
        low = F.floor(place).cast("int")
        a = F.get("samples", low).cast("double")
        b = F.get("samples", F.least(low + 1, last)).cast("double")
        return a + (b - a) * (place - low)

    return audio.select("id", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>")).alias("samples"))


def quietest_cut(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Of the candidate cuts (keys, cut_ms, target_ms, rms) the quietest, then the nearest to the target, then the
    latest."""
    return frames.groupBy(*keys).agg(F.min_by("cut_ms", F.struct("rms", F.abs(F.col("target_ms") - F.col("cut_ms")), -F.col("cut_ms"))).alias("cut_ms"))


def mel_bank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters of equal area on the mel scale that is linear up to 1 kHz (three mels for 200 Hz) and
    logarithmic above (27 mels for a factor of 6.4)."""
    knee, per = 1000.0, np.log(6.4) / 27
    mel = lambda f: 3 * f / 200 if f < knee else 15 + np.log(f / knee) / per
    marks = np.linspace(mel(0.0), mel(rate / 2), n_mels + 2)
    edges = np.where(marks < 15, 200 * marks / 3, knee * np.exp(per * (np.maximum(marks, 15) - 15)))
    freqs = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (freqs[None] - edges[:-2, None]) / (edges[1:-1, None] - edges[:-2, None])
    down = (edges[2:, None] - freqs[None]) / (edges[2:, None] - edges[1:-1, None])
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(audio: DataFrame, rate: int = 16_000, n_fft: int = 400, hop: int = 160, n_mels: int = 80) -> DataFrame:
    """(id, t, v): log mel energies of (id, samples), floored at 1e-10. Frames are centred: half a window of zeros
    is put before and after the samples, and a periodic Hann window is used. Without samples there are no frames."""
    bank = mel_bank(rate, n_fft, n_mels)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)

    def work(batches):
        for pdf in batches:
            for key, samples in zip(pdf["id"], pdf["samples"], strict=True):
                if samples is None or not len(samples):
                    continue
                x = np.pad(np.asarray(samples, float), n_fft // 2)
                cut = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * window
                v = np.log(np.maximum((np.abs(np.fft.rfft(cut)) ** 2) @ bank.T, 1e-10))
                yield pd.DataFrame({"id": key, "t": np.arange(len(v)), "v": v.tolist()})

    return audio.select("id", "samples").mapInPandas(work, "id long, t long, v array<double>")


def split_at_quiet(turns: DataFrame, audio: DataFrame, rate: int = 16_000, most: int = 15_000, search: int = 2_000, least: int = 1_000) -> DataFrame:
    """Speaker turns (job_id, start_ms, end_ms, ...) of more than ``most`` ms cut at the quietest frame (40 ms, every
    10 ms) of the last ``search`` ms before the limit, then the nearest to it, then the latest. A rest under ``least`` ms
    stays with the part before. ``audio``: job_id, samples. Each long turn gets its own samples only.

    The turns, which are small, are the hashed side of the join, so that audio is neither broadcast nor sorted; it streams
    by, and only slices of it go on."""
    frame = 40 * rate // 1000

    def cuts(start: int, end: int, x: np.ndarray) -> list[list[int]]:
        sums = np.concatenate(([0.0], np.cumsum(np.asarray(x, float) ** 2)))
        parts, now = [], start
        while end - now > most:
            target = now + most
            low, high = max(now + least, target - search), min(target, end - least)
            best = (0.0, 0, -target)
            if high > low:
                at = np.arange(low, high + 1, 10)
                head = np.minimum((at - start) * rate // 1000, len(x))
                tail = np.minimum(head + frame, len(x))
                cut = np.minimum(high, at + 20)[tail > head]
                if len(cut):
                    rms = np.sqrt(((sums[tail] - sums[head]) / np.maximum(tail - head, 1))[tail > head])
                    best = min(zip(rms.tolist(), np.abs(target - cut).tolist(), (-cut).tolist(), strict=True))
            cut = -best[2] if -best[2] > now else target
            parts.append([now, cut])
            now = cut
        if parts and end - now < least:
            parts[-1][1] = end
        elif end > now:
            parts.append([now, end])
        return parts

    def split(batches):
        for batch in batches:
            rows, found, own = [], [], batch.column("own")
            for k, (a, b) in enumerate(zip(batch.column("start_ms").to_pylist(), batch.column("end_ms").to_pylist(), strict=True)):
                if a is not None and b is not None:
                    x = own[k].values
                    parts = cuts(a, b, np.zeros(0) if x is None else x.to_numpy(zero_copy_only=False))
                    rows += [k] * len(parts)
                    found += parts
            kept = batch.select(rest).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([p[n] for p in found], pa.int64()) for n in (0, 1))], [*rest, "start_ms", "end_ms"])

    at = lambda c: (F.col(c) * rate / 1000).cast("int")
    own = F.slice("samples", at("start_ms") + 1, F.greatest(at("end_ms") - at("start_ms"), F.lit(0)))
    joined = turns.hint("shuffle_hash").join(audio.select("job_id", "samples"), "job_id", "left")
    rest = [c for c in turns.columns if c not in ("start_ms", "end_ms")]
    schema = Y.StructType([turns.schema[c] for c in rest] + [Y.StructField(c, Y.LongType()) for c in ("start_ms", "end_ms")])
    long = F.col("end_ms") - F.col("start_ms") > most
    return joined.select(*rest, F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), F.when(long, own).alias("own")).mapInArrow(split, schema)


def sample_segments(raw: DataFrame, audio: DataFrame, rate: int = 16_000, least_ms: int = 0) -> DataFrame:
    """P5: voice segments in milliseconds of detections in samples (job_id, start, end), clipped to the audio (``audio``:
    job_id, n_samples). Starts are rounded down and ends up, so that no speech is cut; empty and unreadable ones and those
    under ``least_ms`` go."""
    whole = lambda c: F.try_to_number(F.col(c).cast("string"), F.lit("S999999999999999")).cast("long") if dict(raw.dtypes)[c] == "string" else F.col(c).cast("long")
    clipped = raw.join(audio, "job_id").select("job_id", F.greatest(F.lit(0).cast("long"), whole("start")).alias("a"), F.least("n_samples", whole("end")).alias("b"), "n_samples", whole("start").alias("s"), whole("end").alias("e"))
    up = lambda c: F.expr(f"cast(ceil({c} * 1000 / {rate}) as bigint)")
    rows = clipped.filter("s is not null and e is not null and b > a").select("job_id", F.expr(f"a * 1000 div {rate}").alias("start_ms"), F.least(up("n_samples"), up("b")).alias("end_ms"))
    return rows.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def raw_segments(raw: DataFrame, least_ms: int = 200) -> DataFrame:
    """P5: voice segments of pairs of milliseconds (job_id, pair: array), parts cut off; those of fewer than two numbers,
    empty ones and those under ``least_ms`` go."""
    rows = raw.filter(F.size("pair") >= 2).select("job_id", F.col("pair")[0].cast("long").alias("start_ms"), F.col("pair")[1].cast("long").alias("end_ms"))
    return rows.filter((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") >= least_ms))


def waveform_profile(samples: DataFrame, keys: list[str], clip: float = 0.999, quiet: float = 0.001) -> DataFrame:
    """Peak, root mean square, mean, and the shares of clipped and of quiet samples, of rows (keys, x: double)."""
    share = lambda c: F.avg(c.cast("double"))
    return samples.groupBy(*keys).agg(
        F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.avg("x").alias("dc"),
        share(F.abs("x") >= clip).alias("clip_ratio"), share(F.abs("x") < quiet).alias("silence_ratio"),
    )
