"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

A media column holds whole WAV files (one channel, 8-bit samples).  The fingerprint of a file pairs
spectral peaks that follow one another; each pair is a code of both frequencies and their distance,
stored with its time, so equal passages give equal codes at shifted times.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.llm.common import clear_text, documents, freed, groups, stored

RATE, UNIT = 8000, 64
WINDOW, HOP = 256, 128
#: Frequency bins of the bands whose strongest bin may be a peak.
BANDS = ((1, 9), (9, 33), (33, 129))
#: A peak must exceed its frame's mean magnitude so many times; a pair spans so many frames at most.
LOUD, REACH = 2.0, 3
#: Frames that are transformed at once.
FRAMES = 1 << 14


def wav_bytes(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of each spectral peak, by frame and bin."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    x = np.append(x, np.zeros(max(0, WINDOW - len(x)) or -(len(x) - WINDOW) % HOP, np.float32))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    shape = np.hanning(WINDOW).astype(np.float32)
    at, bins = [], []
    for first in range(0, len(frames), FRAMES):
        size = np.abs(np.fft.rfft(frames[first : first + FRAMES] * shape, axis=1))
        floor = LOUD * size.mean(axis=1)
        for a, b in BANDS:
            top = size[:, a:b].argmax(axis=1) + a
            loud = np.flatnonzero(size[np.arange(len(size)), top] > floor)
            at.append(loud + first)
            bins.append(top[loud])
    at, bins = np.concatenate(at), np.concatenate(bins)
    order = np.lexsort((bins, at))
    return at[order], bins[order]


def peak_pairs(at: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the pairs of peaks 1 to REACH frames apart (next few peaks only)."""
    times, codes = [], []
    for step in range(1, len(BANDS) * (REACH + 1)):
        if step >= len(at):
            break
        gap = at[step:] - at[:-step]
        ok = np.flatnonzero((gap >= 1) & (gap <= REACH))
        times.append(at[ok])
        codes.append(bins[ok] << 10 | bins[ok + step] << 2 | gap[ok])
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def media_column(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``n_bytes`` and ``media``: its UTF-8 bytes as an 8-bit WAV file.

    Bytes 0 fill the payload up to a positive multiple of 64.  Null counts as empty; repeated rows
    give equal files as often as they occur; very long texts are one file each; an empty table gives
    an empty result.  Other columns stay, whatever their names; those named ``n_bytes`` or ``media`` are replaced.
    """
    kept = [c for c in df.columns if c not in (text, "n_bytes", "media")]
    rows = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(df[text], F.lit("")).alias("__text"))

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "__text"):
                data = [t.encode() for t in part.column("__text").to_pylist()]
                columns = [part.column(c) for c in part.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(d) for d in data], pa.int64()), pa.array([wav_bytes(padded(d)) for d in data], pa.binary())], names=[*[c for c in part.schema.names if c != "__text"], "n_bytes", "media"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text"], "n_bytes bigint, media binary"])
    return rows.mapInArrow(run, schema).toDF(*kept, "n_bytes", "media")


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` without ``media``, with what its stored bytes hold.

    New columns: ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (last 64 samples),
    ``media_bytes``, ``media_sha256``, ``times`` and ``codes`` (the time-coded fingerprint).  Bytes
    that are no WAV file, and null, give nulls and empty arrays.  Other columns stay, whatever their names; those named like
    a new one are replaced; an empty table gives an empty result.
    """
    new = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes")
    kept = [c for c in df.columns if c not in (*new, media)]
    rows = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(kept)], df[media].alias("__media"))

    def of(data: bytes | None) -> dict:
        if data is None:
            return dict.fromkeys(new) | {"times": [], "codes": []}
        own = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            payload = read_wav(data)
        except (wave.Error, EOFError):
            return dict.fromkeys(new) | own | {"times": [], "codes": []}
        times, codes = peak_pairs(*peaks(payload))
        return own | {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "times": times, "codes": codes}

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "__media"):
                made = [of(x) for x in part.column("__media").to_pylist()]
                columns = [part.column(c) for c in part.schema.names if c != "__media"]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([m[c] for m in made], k) for c, k in zip(new, kinds, strict=True)]], names=[*[c for c in part.schema.names if c != "__media"], *new])

    own = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, times array<int>, codes array<int>"
    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__media"], own])).toDF(*kept, *new)


def feature() -> F.Column:
    """Number and digest of the pairs in ``times`` and ``codes``; the products are 64-bit, for texts of any length."""
    digest = F.md5(F.concat_ws(",", F.zip_with("times", "codes", lambda t, c: t.cast("bigint") * 65536 * 4 + c).cast("array<string>")))
    return F.concat_ws(":", F.size("codes").cast("string"), digest)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of every document, stored as a Parquet column and read back; the feature names the pairs and their digest."""
    media = stored(media_column(documents(spark, sf_dir).select("doc_id", clear_text().alias("text"))), "media")
    return media_features(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature().alias("feature"))
