"""Metrics of PCM frames: as array expressions, and over WAV bytes in Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds and flags of the quality analysis (fixed values).
SILENT_FRAME, CLIPPED = 0.001, 1.0
SILENCE_RATIO, CLIPPING_RATIO, LOW_RMS = 0.95, 0.001, 0.01
METRICS = "decoded boolean, sample_rate int, channels int, bits int, duration_ms long, silence_ratio double, clipping_ratio double, rms double, peak double, flags array<string>"


def frame_metrics(samples: Column, silence: float = SILENT_FRAME, clipping: float = CLIPPED) -> Column:
    """peak, rms, silence_ratio and clipping_ratio of an array of samples; zeros for an empty one."""
    x = F.transform(F.coalesce(samples, F.array().cast("array<double>")), lambda v: F.abs(v.cast("double")))
    n = F.greatest(F.size(x), F.lit(1)).cast("double")
    return F.struct(
        F.coalesce(F.array_max(x), F.lit(0.0)).alias("peak"),
        F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n).alias("rms"),
        (F.size(F.filter(x, lambda v: v <= silence)) / n).alias("silence_ratio"),
        (F.size(F.filter(x, lambda v: v >= clipping)) / n).alias("clipping_ratio"),
    )


def read_wav(data: bytes | None) -> tuple[int, int, int, np.ndarray] | None:
    """Rate, channels, bits and samples (frames by channels, in -1 to 1) of PCM WAV bytes; None on any defect.

    A size that reaches beyond the file is a defect; bytes after the last whole frame are left out.
    """
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE" or int.from_bytes(data[4:8], "little") + 8 > len(data):
        return None
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if size > len(data) - at - 8:
            return None
        chunk = data[at + 8 : at + 8 + size]
        if data[at : at + 4] == b"fmt " and size >= 16:
            form = chunk
        elif data[at : at + 4] == b"data" and body is None:
            body = chunk
        at += 8 + size + size % 2
    if form is None or not body:
        return None
    kind, channels, rate, bits = (int.from_bytes(form[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
    width = channels * bits // 8
    if kind != 1 or not rate or not channels or bits not in (8, 16, 24, 32) or len(body) < width:
        return None
    body = body[: len(body) // width * width]
    if bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        whole = (raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8
        samples = whole / float(1 << 23)
    elif bits == 8:
        samples = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    else:
        samples = np.frombuffer(body, f"<i{bits // 8}") / float(1 << (bits - 1))
    return rate, channels, bits, samples.reshape(-1, channels)


def analyze(data: bytes | None, expected_ms: int | None = None) -> dict:
    wav, flags = read_wav(data), []
    if wav is None:
        return {"decoded": False, "sample_rate": 0, "channels": 0, "bits": 0, "duration_ms": 0, "silence_ratio": 0.0, "clipping_ratio": 0.0, "rms": 0.0, "peak": 0.0, "flags": ["quality-decode-failed"]}
    rate, channels, bits, samples = wav
    loud = np.abs(samples)
    frames = loud.max(axis=1)
    duration, peak, rms = len(frames) * 1000 // rate, float(loud.max()), float(np.sqrt((samples**2).mean()))
    silence, clipping = float((frames <= SILENT_FRAME).mean()), float((loud >= CLIPPED).mean())
    if duration <= 0 or peak <= 0:
        flags.append("quality-empty-audio")
    else:
        flags += [f for f, on in (("quality-silent", silence >= SILENCE_RATIO), ("quality-clipping", clipping > CLIPPING_RATIO), ("quality-low-level", rms < LOW_RMS)) if on]
    if expected_ms is not None and (duration < expected_ms // 2 or duration > 2 * expected_ms):
        flags.append("quality-duration-mismatch")
    return {"decoded": True, "sample_rate": rate, "channels": channels, "bits": bits, "duration_ms": duration, "silence_ratio": silence, "clipping_ratio": clipping, "rms": rms, "peak": peak, "flags": flags}


def wav_metrics(wav: Column, expected_ms: Column) -> Column:
    """The struct METRICS of WAV bytes."""
    kind = pa.struct([("decoded", pa.bool_()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("duration_ms", pa.int64()), *[(n, pa.float64()) for n in ("silence_ratio", "clipping_ratio", "rms", "peak")], ("flags", pa.list_(pa.string()))])

    @F.arrow_udf(METRICS)
    def measure(data: pa.Array, expected: pa.Array) -> pa.Array:
        return pa.array([analyze(d, e) for d, e in zip(data.to_pylist(), expected.to_pylist())], kind)

    return measure(wav, expected_ms)


def header_facts(stream: BinaryIO, length: int) -> dict | None:
    """What a WAV's chunks say without their bodies: format, bytes of all data chunks, frames and duration; None on any defect.

    The stream is read at the chunks' heads only. The frame's width is that of the format's block align, whatever the channels
    and bits are, and bytes after the last whole frame don't count.
    """
    head = stream.read(12)
    if length < 12 or len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE" or int.from_bytes(head[4:8], "little") + 8 > length:
        return None
    at, form, body = 12, None, 0
    while at + 8 <= length:
        stream.seek(at)
        head = stream.read(8)
        size = int.from_bytes(head[4:8], "little")
        if len(head) < 8 or size > length - at - 8:
            return None
        if head[:4] == b"fmt ":
            if not 16 <= size <= 1 << 20:
                return None
            form = stream.read(16)
        elif head[:4] == b"data":
            body += size
        at += 8 + size
        at += size % 2 if at < length else 0
    if form is None or len(form) < 16:
        return None
    kind, channels, rate, align, bits = (int.from_bytes(form[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (12, 14), (14, 16)))
    if kind != 1 or not channels or not rate or not align or bits not in (8, 16, 24, 32) or not body:
        return None
    return {"sample_rate": rate, "channels": channels, "bits": bits, "block_align": align, "data_bytes": body, "frames": body // align, "duration_ms": body // align * 1000 // rate}


FACTS = "sample_rate long, channels int, bits int, block_align int, data_bytes long, frames long, duration_ms long"
_FACTS = pa.struct([("sample_rate", pa.int64()), ("channels", pa.int32()), ("bits", pa.int32()), *[(n, pa.int32() if n == "block_align" else pa.int64()) for n in ("block_align", "data_bytes", "frames", "duration_ms")]])


def wav_facts(wav: Column) -> Column:
    """The struct FACTS of WAV bytes, or null on any defect."""

    @F.arrow_udf(FACTS)
    def facts(data: pa.Array) -> pa.Array:
        return pa.array([header_facts(io.BytesIO(d), len(d)) if (d := x.as_py()) else None for x in data], _FACTS)

    return facts(wav)


def wav_duration_ms(wav: Column) -> Column:
    """Duration by all data chunks and the block align, or null on any defect."""
    return wav_facts(wav)["duration_ms"]


def file_facts(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """``files`` with the struct ``facts`` (FACTS) of each WAV file, null on any defect. A task opens a file and seeks from chunk
    to chunk, so audio bodies, of any size, are never read. Paths are URIs of file systems that Arrow opens."""
    from pyspark.sql import types as T

    out = T.StructType([*files.schema.fields, T.StructField("facts", T._parse_datatype_string(FACTS))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri, size in zip(batch[path].to_pylist(), batch[length].to_pylist()):
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as stream:
                    found.append(header_facts(stream, size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FACTS)], [*batch.schema.names, "facts"])

    return files.mapInArrow(walk, out)


def mono(samples: np.ndarray, bits: int) -> np.ndarray:
    """16-bit mono: channels averaged, truncated toward zero, clamped."""
    scaled = np.round(samples * (1 << 15)) if bits != 16 else samples * (1 << 15)
    return np.clip(np.trunc(scaled.sum(axis=1) / samples.shape[1]), -32768, 32767).astype("<i2")


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 44-byte header and mono 16-bit samples."""
    body = samples.astype("<i2").tobytes()
    header = b"RIFF" + (36 + len(body)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little")
    header += (1).to_bytes(2, "little") * 2 + rate.to_bytes(4, "little") + (rate * 2).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little")
    return header + b"data" + len(body).to_bytes(4, "little") + body


class SegmentCutter:
    """Table function of a recording's bytes and its plan (array of segment, start, length): a row for each segment with its WAV
    bytes, null if the recording is unreadable. A recording is decoded once, whatever the number of its segments."""

    def eval(self, wav: bytes | None, plan: list) -> Iterator[tuple]:
        found = read_wav(wav)
        for s in plan or []:
            yield s["segment"], None if found is None else wav_bytes(mono(found[3][s["start"] : s["start"] + s["length"]], found[2]), found[0])


def cut_segments(recordings: DataFrame, wav: str, plan: Column) -> DataFrame:
    """A row for each segment of each recording: all its columns but the bytes, ``segment`` and ``segment_wav``. The bytes go to
    the table function once and are not repeated with the segments."""
    cutter = F.udtf(SegmentCutter, returnType="segment int, segment_wav binary")
    thin = F.transform(plan, lambda s: F.struct(s["segment"].alias("segment"), s["start"].alias("start"), s["length"].alias("length")))
    planned = recordings.withColumn("_plan", thin)
    return planned.lateralJoin(cutter(F.col(wav).outer(), F.col("_plan").outer())).drop(wav, "_plan")
