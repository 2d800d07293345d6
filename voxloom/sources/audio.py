"""Audio files as rows of samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Takes a file's bytes, gives samples in [-1, 1] (channels averaged) and the sampling rate.
Decoder = Callable[[bytes], tuple[np.ndarray, int]]
AUDIO = "filename string, array array<float>, sampling_rate int, error string"


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """PCM of 8, 16 or 32 bits."""
    with wave.open(io.BytesIO(data)) as f:
        kind, offset, top = {1: ("u1", 128, 128.0), 2: ("<i2", 0, 32768.0), 4: ("<i4", 0, 2147483648.0)}[f.getsampwidth()]
        samples = (np.frombuffer(f.readframes(f.getnframes()), kind).astype(np.float64) - offset) / top
        return samples.reshape(-1, f.getnchannels()).mean(axis=1).astype(np.float32), f.getframerate()


def resample(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Linear interpolation at another rate; as it is at its own."""
    if rate == wanted or not len(samples):
        return samples
    at = np.arange(int(len(samples) * wanted / rate)) * (rate / wanted)
    return np.interp(at, np.arange(len(samples)), samples).astype(np.float32)


def load_audio(spark: SparkSession, folder: str, pattern: str = "*.wav", decoder: Decoder = decode_wav, rate: int | None = 16_000) -> DataFrame:
    """(filename, array, sampling_rate, error) of files; one that can't be decoded has an error and null samples."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return decode_audio(files.select(F.substring_index("path", "/", -1).alias("filename"), "content"), decoder, rate)


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of one channel, samples beyond [-1, 1] clipped."""
    data = io.BytesIO()
    with wave.open(data, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2").tobytes())
    return data.getvalue()


def decode_audio(files: DataFrame, decoder: Decoder = decode_wav, rate: int | None = 16_000) -> DataFrame:
    """As :func:`load_audio`, of (filename, content)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                try:
                    samples, own = decoder(content)
                    out.append((name, resample(samples, own, rate or own), rate or own, None))
                except Exception as e:  # noqa: BLE001
                    out.append((name, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["filename", "array", "sampling_rate", "error"]).astype({"sampling_rate": "Int32"})

    return files.select("filename", "content").mapInPandas(decode, AUDIO)
