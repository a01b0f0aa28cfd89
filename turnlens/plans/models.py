"""Model seams (reference registries): named factories of Arrow functions, loaded once a worker, with plain stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("vad", "asr", "punc", "spk", "llm")
_MODELS: dict[tuple[str, str], Callable[[], Callable[[pd.Series], pd.Series]]] = {}


def register(kind: str, name: str):
    """Decorator: registers a function without arguments that loads a model and returns Series -> Series."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")

    def keep(load):
        if (kind, name) in _MODELS:
            raise ValueError(f"{kind} {name} is registered already")
        _MODELS[kind, name] = load
        return load

    return keep


def registered(kind: str) -> list[str]:
    return sorted(n for k, n in _MODELS if k == kind)


@lru_cache(maxsize=8)
def _loaded(load):
    return load()


def apply_model(df: DataFrame, kind: str, name: str, column: str, out: str, out_type: str) -> DataFrame:
    """``df`` with the model's answer for ``column``; the model loads lazily, once a Python worker."""
    load = _MODELS[kind, name]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{out: _loaded(load)(pdf[column])})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(out).schema.fields)
    return df.drop(out).mapInPandas(work, f"{schema}, `{out}` {out_type}")


@register("punc", "full-stop")
def _full_stop():
    """A stand-in: ends a text with a full stop if it has no end mark."""
    return lambda s: s.fillna("").map(lambda t: t if t[-1:] in ".!?。！？…" else f"{t}.")


@register("llm", "first-sentence")
def _first_sentence():
    """A stand-in summary: the first sentence."""
    return lambda s: s.fillna("").map(lambda t: t.split(".")[0].strip())


@register("vad", "energy")
def _energy():
    """A stand-in voice probability from a mean square."""
    return lambda s: s.map(lambda e: min(1.0, float(e) * 50))


@register("asr", "loud")
def _loud():
    """A stand-in recogniser of samples: a syllable for each stretch of 100 samples that is loud."""
    return lambda s: s.map(lambda x: " ".join("la" for k in range(0, len(x), 100) if max(map(abs, x[k : k + 100])) > 0.1))


@register("spk", "moments")
def _moments():
    """A stand-in speaker embedding of samples: mean, mean square and the share of sign changes."""
    return lambda s: s.map(lambda x: [float(sum(x)) / max(len(x), 1), float(sum(v * v for v in x)) / max(len(x), 1), sum(a * b < 0 for a, b in zip(x, x[1:])) / max(len(x), 1)])
