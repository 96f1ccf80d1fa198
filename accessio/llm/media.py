"""Media columns: texts as WAV sounds, and fingerprints from pairs of spectral peaks.

A payload is stored as 8-bit mono samples in a WAV file, read back through the
wave module, put between silence and cut into overlapping frames that cover all of it. The short-time Fourier transform's
strongest bins that stand out against the frames beside them are its peaks; each
peak is paired with the next few, and a pair's two bins and distance make a code
that is stored with its time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessio.llm.base import bounded_batches, text_of

#: A payload is filled with blanks to a positive multiple of this.
UNIT = 192
RATE = 8000
FRAME = 128
HOP = 96
#: Each peak is paired with so many of those that follow, at most SPAN frames away.
FAN = 3
SPAN = 31
#: Frames transformed at once, which bounds memory on very long payloads.
CHUNK = 4096
#: Levels up to this are rounding.
QUIET = 0.01
SCHEMA = "row_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, times array<int>, codes array<int>"
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * (-len(data) % unit if data else unit)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(1)
        sound.setframerate(RATE)
        sound.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as sound:
        return sound.readframes(sound.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks: a frame's strongest bin, no weaker than that bin in the frames beside it."""
    count = 1 + max(0, len(samples) - FRAME) // HOP
    loudest, level, left, right = (np.empty(count, t) for t in (np.int64, np.float32, np.float32, np.float32))
    for at in range(0, count, CHUNK):
        low, high = max(0, at - 1), min(count, at + CHUNK + 1)
        part = samples[low * HOP : (high - 1) * HOP + FRAME].astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        frames = frames - (frames @ _WINDOW / _WINDOW.sum())[:, None]  # the mean is no sound; under the window it would fill the bin beside it too
        power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)
        power[:, 0] = 0
        own = np.arange(at, min(count, at + CHUNK)) - low
        best = power[own].argmax(axis=1)
        edge = np.zeros((1, power.shape[1]), np.float32)
        around = np.concatenate([edge, power, edge])
        here = slice(at, at + len(own))
        loudest[here], level[here] = best, power[own, best]
        left[here], right[here] = around[own, best], around[own + 2, best]
    frame = np.flatnonzero((level > QUIET) & (level >= left) & (level > right))
    return frame, loudest[frame]


def surrounded(samples: np.ndarray) -> np.ndarray:
    """The samples between silence (their mean), so that every one stands where some frame's window isn't zero."""
    count = -(-len(samples) // HOP) + 1
    before = FRAME - HOP
    out = np.full((count - 1) * HOP + FRAME, round(float(samples.mean())), samples.dtype)
    out[before : before + len(samples)] = samples
    return out


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes (first bin, second bin, distance), by time. A peak that is the only one is paired with itself."""
    frame, band = peaks(surrounded(samples))
    if len(frame) == 1:
        frame, band = frame.repeat(2), band.repeat(2)
    times, codes = [], []
    for step in range(1, FAN + 1):
        gap = frame[step:] - frame[:-step]
        near = gap <= SPAN
        times.append(frame[:-step][near])
        codes.append((band[:-step] << 12 | band[step:] << 5 | gap)[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def stored(text: str) -> tuple:
    data = text.encode("utf-8")
    media = to_wav(padded(data))
    payload = from_wav(media)
    times, codes = fingerprint(np.frombuffer(payload, np.uint8))
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), media, times, codes


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media, times, codes.

    payload_sha256, tail_crc32 (of the last 16 bytes), times and codes come from
    the bytes read back out of media, the WAV file. A null or empty text is one
    unit of blanks. Equal texts have equal values; payloads of one byte
    repeated and those whose several peaks are all out of each other's reach have
    empty arrays.
    """
    bounded_batches(docs.sparkSession)
    schema = SCHEMA.format(id_type=docs.select(id_col).schema[0].dataType.simpleString())
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [stored(text) for text in batch["text"]]
            yield pd.DataFrame({"row_id": batch["row_id"]} | dict(zip(names[1:], map(list, zip(*rows, strict=True)), strict=True))) if rows else pd.DataFrame(columns=names)

    given = docs.select(F.col(id_col).alias("row_id"), text_of(text_col).alias("text"))
    return given.mapInPandas(encode, schema).withColumnRenamed("row_id", id_col)
