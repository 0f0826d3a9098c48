"""Media columns: WAV bytes, their short-time Fourier transform, and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

UNIT, RATE, HOP, BANDS, REACH = 192, 8000, 96, ((2, 12), (12, 32), (32, 97)), 3
_PORTION = 2 << 20


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono samples in a WAV container."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


_WINDOW = np.hanning(UNIT).astype(np.float32)


def peaks(samples: np.ndarray) -> np.ndarray:
    """Strongest bin of each band in each frame, where it is no weaker than in the frames before and after; else -1."""
    x = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, UNIT)[::HOP] * _WINDOW
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    power = power.astype(np.float32)
    out = np.full((len(power), len(BANDS)), -1, np.int64)
    rows = np.arange(len(power))
    for k, (lo, hi) in enumerate(BANDS):
        best = power[:, lo:hi].argmax(1) + lo
        own = power[rows, best]
        before = np.where(rows > 0, power[np.maximum(rows - 1, 0), best], 0)
        after = np.where(rows < len(rows) - 1, power[np.minimum(rows + 1, len(rows) - 1), best], 0)
        out[:, k] = np.where((own > 0) & (own >= before) & (own >= after), best, -1)
    return out


def pair_codes(found: np.ndarray) -> np.ndarray:
    """Time-coded pairs: frame << 24 | bin << 16 | later bin << 8 | frames between, in order of time."""
    t, k = np.nonzero(found >= 0)
    f = found[t, k]
    codes = []
    for dt in range(1, REACH + 1):
        for j in range(len(BANDS)):
            ok = t + dt < len(found)
            later = np.where(ok, found[np.minimum(t + dt, len(found) - 1), j], -1)
            take = ok & (later >= 0)
            codes.append((t[take] << 24) | (f[take] << 16) | (later[take] << 8) | dt)
    return np.sort(np.concatenate(codes))


def pairs_of(samples: np.ndarray) -> np.ndarray:
    """pair_codes of samples of any length: long ones go in portions that overlap by the frames a peak or a pair looks at."""
    step, found = _PORTION // HOP * HOP, []
    for lo in range(0, len(samples), step):
        first = max(0, lo - HOP)
        part = peaks(samples[first : lo + step + UNIT])
        own = (lo - first) // HOP
        found.append(part[own : own + step // HOP])
    return pair_codes(np.concatenate(found))


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_HELD = 8 << 20  # bytes of media that are gathered before they go on


def _rows(batches, full: bool):
    rows, media, codes, held = [], [], [], 0

    def made():
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)]
        if full:
            ends = np.cumsum([0] + [len(c) for c in codes])
            columns += [pa.array(media, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(codes)))]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES + ["media", "pairs"] * full)

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n, payload = padded(text)
            wav = to_wav(payload)
            back = from_wav(wav)
            found = pairs_of(np.frombuffer(back, np.uint8))
            digest = hashlib.sha256(found.astype("<i8").tobytes()).hexdigest()
            rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), f"{len(found)}:{digest}"))
            media.append(wav)
            codes.append(found)
            held += len(wav)
            if held >= _HELD:
                yield made()
                rows, media, codes, held = [], [], [], 0
    if rows:
        yield made()


DIGESTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_column(docs: DataFrame, full: bool = True) -> DataFrame:
    """Digest columns and, if full, media (WAV bytes) and pairs (time-coded array) for each row of docs.

    The text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the samples; null counts as empty.
    feature holds how many pairs there are and their SHA-256. Null and repeated doc_ids keep their rows, an empty table
    gives none, other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lambda batches: _rows(batches, full), DIGESTS + ", media binary, pairs array<bigint>" * full)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents"))
