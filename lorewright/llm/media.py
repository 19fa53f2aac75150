"""Operator 1, media columns: WAV samples through the wave module, short-time Fourier transforms, peak-pair fingerprints.

Each row is worked on alone and in blocks of frames, so memory follows one text, and nothing is shuffled.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lists, map_text, read_table

RATE, PAD = 8000, 64
FRAME, HOP = 256, 128
#: Frequency bins of the bands that each have one peak per frame at most.
BANDS = ((1, 16), (16, 48), (48, 129))
#: Later peaks that a peak is paired with, and how many frames later they may be.
FAN, SPAN = 3, 31
BLOCK_FRAMES = 4096
_WINDOW = np.hanning(FRAME)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with one 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a mono file of 8-bit ones; ``ValueError`` for any other bytes."""
    try:
        return _samples(media)
    except (wave.Error, EOFError, struct.error) as e:
        raise ValueError(f"not a WAV file: {e}") from e


def _samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if f.getsampwidth() != 1 or f.getnchannels() != 1:
            raise ValueError("not a mono file of 8-bit samples")
        return f.readframes(f.getnframes())


def _spectra(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Power spectra of overlapping frames, the last one filled up with silence, in blocks of frames."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    for a in range(0, n, BLOCK_FRAMES):
        frames = min(BLOCK_FRAMES, n - a)
        said = samples[a * HOP : (a + frames - 1) * HOP + FRAME]
        x = np.zeros((frames - 1) * HOP + FRAME)
        x[: len(said)] = said.astype(float) - 128.0
        s = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _WINDOW, axis=1)
        yield s.real**2 + s.imag**2


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each spectral peak: the largest bin of its band, no smaller than the band in the frames beside it."""
    tops, bins = [], []
    for power in _spectra(samples):
        best = [lo + np.argmax(power[:, lo:hi], axis=1) for lo, hi in BANDS]
        rows = np.arange(len(power))
        bins.append(np.stack(best, axis=1))
        tops.append(np.stack([power[rows, b] for b in best], axis=1))
    top, at = np.concatenate(tops), np.concatenate(bins)
    beside = np.zeros_like(top)
    beside[1:] = top[:-1]
    beside[:-1] = np.maximum(beside[:-1], top[1:])
    frame, band = np.nonzero((top >= beside) & (top > 1e-6))
    return frame, at[frame, band]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Peak pairs as numbers: frame << 19 | bin << 12 | other bin << 5 | frames between (bins less one), in time order."""
    t, f = peaks(samples)
    found = []
    for k in range(1, FAN + 1):
        apart = t[k:] - t[:-k]
        use = (apart > 0) & (apart <= SPAN)
        found.append((t[:-k][use] << 19) | ((f[:-k][use] - 1) << 12) | ((f[k:][use] - 1) << 5) | apart[use])
    return np.sort(np.concatenate(found)).astype(np.int64)


def _rows(array: pa.Array) -> list[bytes]:
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def encode_wav(docs: DataFrame, *, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes`` (of the UTF-8 text) and ``media``: a WAV file of the text's bytes, zeros appended up to a
    positive multiple of 64.

    A null text is stored like an empty one: 64 zero samples. Other columns are carried; ``n_bytes`` and ``media`` of
    the input are replaced.
    """

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            rows = _rows(texts)
            media = [to_wav(r.ljust(max(PAD, -(-len(r) // PAD) * PAD), b"\0")) for r in rows]
            return [pa.array([len(r) for r in rows], pa.int64()), pa.array(media, pa.binary())]

        return work

    return map_text(docs, text, make, T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]), carry_text)


def wav_features(rows: DataFrame, *, media: str = "media") -> DataFrame:
    """``rows`` with ``payload`` (the samples read back from the WAV column) and ``fingerprint`` (see :func:`fingerprint`).

    A media value that is null, empty, or no mono WAV file of 8-bit samples has a null payload and an empty fingerprint.
    Other columns are carried; those two of the input are replaced.
    """

    def read(file: bytes) -> bytes | None:
        try:
            return from_wav(file) if file else None
        except ValueError:
            return None

    def make():
        def work(files: pa.Array) -> list[pa.Array]:
            payloads = [read(m) for m in _rows(files)]
            found = [fingerprint(np.frombuffer(p, np.uint8)) if p else np.zeros(0, np.int64) for p in payloads]
            return [pa.array(payloads, pa.binary()), lists(np.concatenate([*found, np.zeros(0, np.int64)]), np.array([len(x) for x in found], np.int64), pa.int64())]

        return work

    return map_text(rows, media, make, T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("fingerprint", T.ArrayType(T.LongType()))]), True, binary=True)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = wav_features(encode_wav(docs, carry_text=False))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint"), F.sha2(F.array_join("fingerprint", ","), 256)).alias("feature"),
    )
