"""Sources: lists of files, JSON lines and PCM audio."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def read_scp(spark: SparkSession, path: str) -> DataFrame:
    """(key, path) of the lines with two parts."""
    return scp_entries(spark.read.text(path), "value").drop("value")


def scp_entries(lines: DataFrame, column: str) -> DataFrame:
    """``lines`` with key and path, those without two parts left out."""
    line = F.regexp_replace(column, r"^\s+|\s+$", "")
    part = lambda k: F.regexp_extract(line, r"^(\S+)\s+(.*)$", k)
    return lines.withColumns({"key": part(1), "path": part(2)}).filter("key <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the well-formed lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def json_entries(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """``lines`` with the fields of ``schema``, malformed and blank lines left out."""
    rows = lines.withColumn("_v", F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.filter((F.trim(column) != "") & F.col("_v._bad").isNull()).select(*lines.columns, "_v.*").drop("_bad")


def _decode(content: bytes, rate: int) -> np.ndarray:
    with wave.open(io.BytesIO(content)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("16-bit PCM only")
        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32).reshape(-1, f.getnchannels()).mean(axis=1) / 32768
        have = f.getframerate()
    if have == rate or not len(x):
        return x
    n = int(len(x) * rate / have)
    return np.interp(np.arange(n) * have / rate, np.arange(len(x)), x).astype(np.float32)


def load_audio(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(path, n_samples, samples, error) of WAV files: channels averaged, linearly resampled. A file that
    cannot be decoded gives no samples and its error."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), "content")
    return decode_audio(files, rate).withColumnRenamed("id", "path")


def decode_audio(files: DataFrame, rate: int = 16_000) -> DataFrame:
    """Samples of WAV contents at hand: ``files`` (id, content) gives (id, n_samples, samples, error)."""

    def work(frames):
        for pdf in frames:
            out = []
            for name, content in zip(pdf["id"], pdf["content"], strict=True):
                try:
                    x = _decode(bytes(content), rate)
                    out.append((name, len(x), x.tolist(), None))
                except Exception as error:  # noqa: BLE001
                    out.append((name, 0, [], str(error)))
            yield pd.DataFrame(out, columns=["id", "n_samples", "samples", "error"])

    kind = files.schema["id"].dataType.simpleString()
    return files.select("id", "content").mapInPandas(work, f"id {kind}, n_samples long, samples array<float>, error string")


def pcm_to_float(content) -> F.Column:
    """Little-endian 16-bit PCM as floats in [-1, 1); null for an odd number of bytes."""

    @F.pandas_udf(ArrayType(FloatType()))
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None or len(b) % 2 else np.frombuffer(b, "<i2").astype(np.float32) / 32768)

    return decode(content)


def pad_batch(rows: DataFrame, key: str, samples: str) -> DataFrame:
    """``rows`` with padded (samples filled up with zeros to the longest of the batch ``key``) and length."""
    longest = rows.groupBy(key).agg(F.max(F.size(samples)).alias("_most"))
    zero = F.lit(0.0).cast(rows.schema[samples].dataType.elementType)
    padded = F.concat(samples, F.array_repeat(zero, F.col("_most") - F.size(samples)))
    return rows.join(longest, key).withColumns({"padded": padded, "length": F.size(samples)}).drop("_most")
