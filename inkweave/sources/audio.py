"""WAV files as rows of samples, and back; other formats need a decoder that isn't here."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {1: np.uint8, 2: np.int16, 4: np.int32}
COLUMNS = "path string, rate int, samples array<float>, error string"


def decoded(data: bytes) -> tuple[int, np.ndarray]:
    """The rate and the samples of a WAV file, between -1 and 1, its channels averaged; 8, 16 or 32 bits, else ValueError."""
    with wave.open(io.BytesIO(data)) as f:
        rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
        if width not in _KINDS:
            raise ValueError(f"samples of {8 * width} bits")
        raw = np.frombuffer(f.readframes(f.getnframes()), _KINDS[width]).astype(np.float64)
    raw = (raw - 128) / 128 if width == 1 else raw / float(1 << (8 * width - 1))
    return rate, raw[: len(raw) // channels * channels].reshape(-1, channels).mean(axis=1)


def encoded(samples: np.ndarray, rate: int) -> bytes:
    """Samples between -1 and 1 as a WAV file of one channel and 16 bits; larger ones are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.round(np.asarray(samples, np.float64) * 32_767), -32_768, 32_767).astype(np.int16).tobytes())
    return out.getvalue()


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, by straight lines between them."""
    count = int(len(samples) * to / rate)
    return np.interp(np.arange(count) * rate / to, np.arange(len(samples)), samples) if len(samples) else samples


def decoded_rows(files: DataFrame, to: int | None = None) -> DataFrame:
    """``path, rate, samples`` of ``path, content`` and, for what can't be read, ``error``; with ``to`` all at that rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.path, batch.content):
                try:
                    rate, samples = decoded(data or b"")
                    if to:
                        samples, rate = resampled(samples, rate, to), to
                    rows.append((name, rate, samples.astype(np.float32).tolist(), None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((name, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "error"]).astype({"rate": "Int32"})

    return files.select("path", "content").mapInPandas(run, COLUMNS)


def read_wav(spark: SparkSession, path: str, to: int | None = None) -> DataFrame:
    """The recordings below a path, by :func:`decoded_rows`."""
    return decoded_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), to)


def wav_bytes(df: DataFrame, samples: str, rate: str, name: str = "content") -> DataFrame:
    """Rows with their samples as the bytes of a WAV file, for a binary sink; null samples give null."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[name] = [None if s is None else encoded(s, int(r)) for s, r in zip(batch[samples], batch[rate])]
            yield batch

    return df.mapInPandas(run, schema)


def chunked(recordings: DataFrame, seconds: int = 60, overlap: int = 0) -> DataFrame:
    """Recordings in chunks of some seconds: ``path, rate, chunk, offset`` (seconds) and ``samples``."""
    size = (F.col("rate") * seconds).cast("long")
    count = F.greatest(F.ceil(F.size("samples") / size), F.lit(0)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    rows = recordings.where("samples is not null").select("path", "rate", "samples", F.explode(starts).alias("chunk"))
    piece = F.slice("samples", (F.col("chunk") * size + 1).cast("int"), (size + F.col("rate") * overlap).cast("int"))
    return rows.select("path", "rate", "chunk", (F.col("chunk") * seconds).cast("double").alias("offset"), piece.alias("samples"))
