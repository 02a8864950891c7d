"""WAV files: the one place where bytes are taken apart in Python, by Arrow batches."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _samples(content: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """Samples scaled to 1, or what keeps a file from being read."""
    try:
        with wave.open(io.BytesIO(content or b""), "rb") as w:
            if w.getnchannels() != 1 or w.getsampwidth() != 2:
                return None, f"{w.getnchannels()} channels of {8 * w.getsampwidth()} bits, wanted 1 of 16"
            raw = w.readframes(w.getnframes())
            return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float64) / 32768.0, None
    except (wave.Error, EOFError) as e:
        return None, f"not a WAV file: {e}"


def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [_samples(c) for c in b["content"]]
        yield pd.DataFrame({"clip": b["path"], "pcm": [x for x, _ in got], "fault": [why for _, why in got]})


def wav_clips(spark: SparkSession, path: str) -> DataFrame:
    """(clip, pcm array<double>, fault) of 16-bit mono files, scaled to 1. Other files have a null pcm and the fault that says why; the source passes over empty ones."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content").mapInPandas(decode, "clip string, pcm array<double>, fault string")


def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for samples in b["samples"]:
            f = io.BytesIO()
            with wave.open(f, "wb") as w:
                w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
                w.writeframes(np.asarray(samples, "<i2").tobytes())
            out.append(f.getvalue())
        yield pd.DataFrame({"name": b["name"], "content": out})


def wav_files(clips: DataFrame) -> DataFrame:
    """Files (name, content) of clips (name, samples array<int>): 16 bits, mono, 16 kHz."""
    return clips.select("name", "samples").mapInPandas(encode, "name string, content binary")
