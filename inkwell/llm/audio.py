"""Media columns: lossless 8-bit audio and its features as fixed-shape tensors with time spans.

A payload is stored as a WAV file of unsigned 8-bit samples. Its features come from the file read back: samples go through a
polyphase resampler, overlapped frames through a log-mel filterbank, and frame energies through a two-threshold
(hysteresis) segmenter. Each file is worked on by itself, so equal payloads have equal features in whatever batch they are.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, stash, text_bytes

RATE = 16_000
#: Resampling by UP / DOWN, with TAPS filter taps for each of the UP phases.
UP, DOWN, TAPS = 2, 5, 24
FRAME, HOP, FFT = 160, 64, 256
MELS, STEPS = 20, 16
#: A segment opens above the file's mean energy by OPEN dB and closes below it by CLOSE dB.
OPEN, CLOSE = 1.0, 1.0
UNIT, PAD = 576, 255
#: Values computed at a time, which bounds memory for files of any length.
BLOCK = 1 << 15

MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "tensor array<float>, duration double, segments array<struct<start double, end double>>"
)


def padded(data: bytes, unit: int = UNIT, pad: int = PAD) -> bytes:
    """data and `pad` bytes up to a positive multiple of unit."""
    return data + bytes([pad]) * (max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(samples) % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media)) as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes()), w.getframerate()


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass filter, a row per phase, in the order in which samples are laid out."""
    n = up * taps
    x = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(x) * np.kaiser(n, 6.0)
    return np.ascontiguousarray((h * up / h.sum()).reshape(taps, up).T[:, ::-1], np.float32)


def resampled(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up / down times its rate: output n takes the filter phase (n * down) % up at input (n * down) // up."""
    phases = _phases(up, down, taps)
    size = max(1, len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)]), taps)
    out = np.empty(size, np.float32)
    for phase in range(up):
        first = next(n for n in range(up) if n * down % up == phase)
        for at in range(first, size, BLOCK * up):
            n = np.arange(at, min(size, at + BLOCK * up), up)
            start = at * down // up
            out[n] = windows[start : start + (len(n) - 1) * down + 1 : down] @ phases[phase]
    return out


@cache
def _mel(rate: float) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, FFT bins by bands."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


_HANN = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """frames x MELS of log filterbank energies, and each frame's energy in dB."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mel, energy = [], []
    for at in range(0, len(frames), BLOCK // 8):
        some = frames[at : at + BLOCK // 8] * _HANN
        spectrum = np.fft.rfft(some, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel.append(np.log(power @ _mel(rate) + np.float32(1e-6)))
        energy.append(10 * np.log10(np.einsum("ij,ij->i", some, some) / FRAME + np.float32(1e-10)))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, rate: float) -> list[tuple[float, float]]:
    """Spans in seconds that open above one threshold and close below a lower one."""
    mean = energy.mean()
    turn = np.where(energy > mean + OPEN, 1, np.where(energy < mean - CLOSE, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
    on = np.append((last >= 0) & (turn[last] > 0), False)
    edges = np.flatnonzero(np.diff(np.append(False, on).astype(np.int8)))
    return [(round(a * HOP / rate, 4), round(((b - 1) * HOP + FRAME) / rate, 4)) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def features(samples: bytes, rate: int = RATE) -> dict:
    """tensor (STEPS x MELS: means over equal parts of the frames), duration, segments, feature (a short text of them)."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    to = rate * UP / DOWN
    mel, energy = log_mel(resampled(x), to)
    edges = np.linspace(0, len(mel), STEPS + 1).astype(int)
    starts = np.minimum(edges[:-1], len(mel) - 1)
    widths = np.maximum(edges[1:] - edges[:-1], 1)
    tensor = np.add.reduceat(mel, starts, axis=0) if len(mel) >= STEPS else mel[starts]
    tensor = (tensor / (widths[:, None] if len(mel) >= STEPS else 1)).astype(np.float32)
    spans = segments(energy, to)
    held = sum(b - a for a, b in spans)
    mean = ",".join(str(int(v)) for v in np.rint(mel.mean(0) * 10))
    return {"tensor": tensor.ravel(), "duration": len(samples) / rate, "segments": spans, "feature": f"frames={len(mel)};segments={len(spans)};held={held:.3f};mel={mean}"}


def encoded(docs: DataFrame, rate: int = RATE) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded, as a WAV file. Null is empty; every row gives a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                texts = [t or b"" for t in text_bytes(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(padded(t), rate) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, MEDIA)


def described(media: DataFrame) -> DataFrame:
    """Reads each file of encoded() back: payload and file digests, feature text, tensor, duration, segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                rows = []
                for doc_id, n, file in zip(*(c.to_pylist() for c in whole.slice(at, 500).columns)):  # the files are read already; a row adds 2 KB
                    samples, rate = from_wav(file)
                    f = features(samples, rate)
                    rows.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(file), hashlib.sha256(file).hexdigest(), f["feature"], f["tensor"], f["duration"], f["segments"]))
                columns = [*zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    out = arrow_map(media, run, FEATURES)
    return out.withMetadata("tensor", SHAPE)


#: What the stored schema says of the tensor column.
SHAPE = {"shape": [STEPS, MELS], "dim_names": ["time", "mel"], "value_type": "float32"}

_SPAN = pa.struct([("start", pa.float64()), ("end", pa.float64())])
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor", "duration", "segments"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float32()), pa.float64(), pa.list_(_SPAN)]


def audio_features(docs: DataFrame, rate: int = RATE) -> DataFrame:
    """One row per document: its text stored as audio, read back and described.

    Null and empty texts are files of UNIT bytes of PAD. Ids, null or not, are passed on; repeated rows are described each, alike;
    an empty table gives no rows; columns besides doc_id and text are not read. The tensor column's schema states its shape.
    """
    return described(encoded(docs, rate))


TENSOR = pa.fixed_shape_tensor(pa.float32(), (STEPS, MELS), dim_names=("time", "mel"))


def as_tensors(table: pa.Table) -> pa.Table:
    """The tensor column of described(), as Arrow, as an Arrow fixed-shape tensor of STEPS x MELS."""
    flat = table["tensor"].combine_chunks()
    storage = pa.FixedSizeListArray.from_arrays(flat.flatten() if len(flat) else pa.array([], pa.float32()), STEPS * MELS)
    return table.set_column(table.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(TENSOR, storage))


def write_tensors(described: DataFrame, path: str) -> DataFrame:
    """Stores doc_id, tensor (an Arrow fixed-shape tensor), duration and segments as Parquet files in a shared folder, by the workers.

    path is any that pyarrow opens by URI. A task writes its file under a name of its own and then gives it the partition's, so one that runs
    again replaces it by the same rows. Returns a row per file, file and rows, after all are written.
    """
    columns = ["doc_id", "tensor", "duration", "segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        name, own = f"{base}/part-{task.partitionId():05d}.parquet", f"{base}/_task-{task.taskAttemptId()}"
        writer, rows = None, 0
        for b in batches:
            table = as_tensors(pa.Table.from_batches([b]))
            writer = writer or parquet.ParquetWriter(own, table.schema, filesystem=system)
            writer.write_table(table)
            rows += len(b)
        if writer:
            writer.close()
            system.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], ["file", "rows"])

    return stash(arrow_map(described.select(*columns), run, "file string, rows long"), "files")
