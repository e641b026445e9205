"""SRC17: recordings: PCM WAV files with what their paths say, and the correlation of their log-mel bands."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.sources.readers import path_metadata


def samples_of(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples from -1 to 1 of a WAV file with 8, 16, 24 or 32 bit integers; channels are averaged."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    elif width == 3:
        x = np.zeros((len(raw) // 3, 4), np.uint8)
        x[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (x.view("<i4").ravel() >> 8).astype(float)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float)
    return rate, (x / float(1 << (8 * width - 1))).reshape(-1, channels).mean(axis=1)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A mono file of 16 bit integers."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, data in zip(frame["path"], frame["content"], strict=True):
            rate, x = samples_of(data)
            yield pd.DataFrame({"path": [path], "rate": [rate], "samples": [x.tolist()]})


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, machine, rate, samples) of the WAV files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path).select("path", "content")
    kind, machine = path_metadata(F.col("path"))
    return files.mapInPandas(_decoded, "path string, rate int, samples array<double>").select("path", kind.alias("kind"), machine.alias("machine"), "rate", "samples")


def mel(hertz: np.ndarray) -> np.ndarray:
    """The mel scale that is linear up to 1000 Hz (15 mels) and logarithmic above, 27 mels for a factor of 6.4."""
    hertz = np.asarray(hertz, float)
    return np.where(hertz < 1000, hertz * 3 / 200, 15 + np.log(np.maximum(hertz, 1000) / 1000) * 27 / np.log(6.4))


def hertz(mels: np.ndarray) -> np.ndarray:
    mels = np.asarray(mels, float)
    return np.where(mels < 15, mels * 200 / 3, 1000 * np.exp((np.maximum(mels, 15) - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=4)
def mel_filters(rate: int, n_fft: int, bands: int, low: float, high: float) -> np.ndarray:
    """(bands, frequencies): triangles between neighbouring band edges, each of area 1 over the frequencies in Hertz."""
    edges = hertz(np.linspace(mel(low), mel(high), bands + 2))
    at = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (at[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - at[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray, rate: int, n_fft: int = 1024, hop: int = 512, bands: int = 128, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """(frames, bands) in decibels under the loudest, 80 at most: centred frames of a Hann window, zeros beyond the ends."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    padded = np.pad(x, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2 @ mel_filters(rate, n_fft, bands, low, high or rate / 2).T
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(power.max(initial=0.0), 1e-10))
    return np.maximum(db, db.max(initial=-np.inf) - 80) if db.size else db


def _correlated(frames: Iterator[pd.DataFrame], n_fft: int, hop: int, bands: int, eps: float) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, rate, samples in zip(frame["path"], frame["rate"], frame["samples"], strict=True):
            x, reason, a = np.asarray(samples, float), None, None
            if len(x) < n_fft:
                reason = "too short"
            else:
                y = log_mel(x, int(rate), n_fft, hop, bands)
                y = y - y.mean(axis=0)
                size = (y * y).sum(axis=0)
                if len(y) <= bands:
                    reason = "too few frames"
                elif (size <= eps).any():
                    reason = "constant band"
                else:
                    a = y.T @ y / np.sqrt(np.outer(size, size))
                    a = (a + a.T) / 2
                    np.fill_diagonal(a, 1.0)
            yield pd.DataFrame({"path": [path], "n": [bands], "a": [None if a is None else a.ravel().tolist()], "reason": [reason]})


def band_correlation(recorded: DataFrame, n_fft: int = 1024, hop: int = 512, bands: int = 128, eps: float = 1e-12) -> DataFrame:
    """(path, n, a, reason): a recording's packed correlation matrix of its log-mel bands over time, or the reason why there is none."""
    return recorded.select("path", "rate", "samples").mapInPandas(partial(_correlated, n_fft=n_fft, hop=hop, bands=bands, eps=eps), "path string, n int, a array<double>, reason string")
