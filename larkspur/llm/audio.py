"""Media columns: texts' bytes as 8-bit audio, with log-mel features in fixed-shape Arrow tensors, and segments.

A payload is stored as an 8-bit mono WAV file, losslessly, and everything below is computed from the samples
that are read back from the stored bytes: polyphase resampling by a rational factor, log-mel filterbanks over
overlapping frames, and segments of high energy found with two thresholds (a segment begins where the level
rises over the upper one and ends where it falls under the lower one).

Features are cut into tensors of one fixed shape (FRAMES x BANDS, the last one padded with the floor value), each with its
time span. A document's tensors are stored as an Arrow stream of one record batch with the columns first_ms, last_ms and tensor, whose
type is Arrow's fixed-shape tensor; ``read_tensors`` gives them back, and features that describe a text are taken from the tensors as
read back. Everything happens within the row and a bounded number of samples is held at a time, so there is no shuffle. Long
payloads are filtered in parts that overlap by the filter's reach, so where a part ends makes no difference.

Defined cases: null and empty texts give one block of zero bytes; equal texts give equal values; other columns pass
through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import output_schema

#: Samples a second as stored and after resampling by UP / DOWN.
RATE, UP, DOWN = 16_000, 1, 4
#: Frame and step in resampled samples, bands, and frames of a tensor.
FRAME, STEP, BANDS, FRAMES = 256, 128, 24, 64
#: Block that payloads are padded to.
BLOCK = 64
#: Level over a text's mean, in decibels, that begins a segment, and under which it ends.
BEGIN_DB, END_DB = 2.0, 0.5
#: Stored samples that are processed at a time: a multiple of DOWN * STEP.
CHUNK = 1 << 20
FLOOR = -12.0

SEGMENTS = "array<struct<first_ms:bigint,last_ms:bigint>>"
OUTPUTS = {"media": "binary", "tensors": "binary", "segments": SEGMENTS, "n_tensors": "bigint", "tensors_sha256": "string", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS))


def payload(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    size = max(-(-len(data) // BLOCK), 1) * BLOCK
    return data.ljust(size, b"\0"), len(data)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono WAV file; a chunk of odd length is padded, as the format asks."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono WAV file; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


@lru_cache
def low_pass(up: int = UP, down: int = DOWN, half: int = 8) -> np.ndarray:
    """Windowed sinc at the lower of the two rates, in ``up`` phases: row p holds what output phase p takes."""
    taps = 2 * half * max(up, down)
    t = np.arange(-taps // 2, taps // 2 + up * 0)
    h = np.sinc((t + 0.5) / max(up, down)) * np.hanning(taps + 2)[1:-1]
    h *= up / h.sum()
    h = np.r_[h, np.zeros(-len(h) % up)]
    return np.ascontiguousarray(h.reshape(-1, up).T).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: output n takes phase (n * down) % up of the filter at input (n * down) // up."""
    phases = low_pass(up, down)
    width = phases.shape[1]
    n = -(-len(x) * up // down)
    padded = np.r_[np.zeros(width // 2, np.float32), x, np.zeros(width, np.float32)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    if up == 1:
        return windows[: n * down : down] @ phases[0][::-1]
    at = np.arange(n) * down
    out = np.empty(n, np.float32)
    for p in range(up):
        own = np.flatnonzero(at % up == p)
        out[own] = windows[at[own] // up] @ phases[p][::-1]
    return out


@lru_cache
def filterbank(rate: int = RATE * UP // DOWN) -> np.ndarray:
    """Triangles at equal steps of the mel scale, FRAME // 2 + 1 rows by BANDS columns."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@lru_cache
def window() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype(np.float32)


def frames_of(samples: int) -> int:
    """Frames of so many resampled samples: they overlap, and the last one may be padded."""
    return -(-max(samples - FRAME, 0) // STEP) + 1


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values of overlapping frames, and each frame's energy; the last frame is padded with zeros."""
    n = frames_of(len(y))
    padded = np.zeros((n - 1) * STEP + FRAME, np.float32)
    padded[: len(y)] = y[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::STEP]
    spectrum = np.fft.rfft(frames * window(), axis=1)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    return np.log10(np.maximum(power @ filterbank(), 10.0**FLOOR)).astype(np.float32), (frames**2).mean(axis=1)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each run that rises over the upper threshold, up to where it falls under the lower one."""
    level = 10 * np.log10(np.maximum(energy, 1e-12))
    mean = level.mean()
    state = np.where(level >= mean + BEGIN_DB, 1, np.where(level < mean + END_DB, 0, -1))
    # between the thresholds the last decided state holds
    decided = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(decided >= 0, state[np.maximum(decided, 0)], 0) == 1
    edges = np.flatnonzero(np.diff(np.r_[False, on, False]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and segments (in frames) of 8-bit samples, part by part. Frames are numbered over the whole."""
    x = np.frombuffer(samples, np.uint8)
    reach = -(-low_pass().shape[1] // DOWN) * DOWN
    total, part = frames_of(-(-len(x) * UP // DOWN)), CHUNK // DOWN * UP // STEP
    mels, energies = [], []
    for first in range(0, total, part):
        a = first * STEP * DOWN // UP
        # a part sees what the filter reaches before it, and as far into the next one as its last frame and the filter reach
        before = min(a, reach)
        piece = (x[a - before : a + CHUNK + FRAME * DOWN + reach].astype(np.float32) - 128) / 128
        mel, energy = log_mel(resample(piece)[before * UP // DOWN :])
        own = min(part, total - first)
        mels.append(mel[:own])
        energies.append(energy[:own])
    return np.concatenate(mels), segments(np.concatenate(energies))


def describe(mel: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """Frames, segments, frames within them, and each band's mean, to two decimals."""
    inside = sum(b - a + 1 for a, b in spans)
    return f"{len(mel)}:{len(spans)}:{inside}:" + ",".join(f"{v:.2f}" for v in mel.mean(axis=0, dtype=np.float64) + 0.0)


def _ms(frame: int, rate: int = RATE * UP // DOWN) -> int:
    return frame * STEP * 1000 // rate


def store_tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of the frames as fixed-shape tensors, each with its time span."""
    n = -(-len(mel) // FRAMES)
    padded = np.full((n * FRAMES, BANDS), FLOOR, np.float32)
    padded[: len(mel)] = mel
    first = [_ms(i * FRAMES) for i in range(n)]
    last = [_ms(min((i + 1) * FRAMES, len(mel)) - 1) + FRAME * 1000 * DOWN // (RATE * UP) for i in range(n)]
    flat = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), FRAMES * BANDS)
    tensors = pa.ExtensionArray.from_storage(tensor_type(), flat)
    frames = pa.array([min(FRAMES, len(mel) - i * FRAMES) for i in range(n)], pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64()), frames, tensors], names=["first_ms", "last_ms", "frames", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """first_ms, last_ms, frames (that are not padding) and tensor (FRAMES x BANDS) of a document."""
    with pa.ipc.open_stream(stored) as stream:
        return stream.read_all()


def frames_in(table: pa.Table) -> np.ndarray:
    """The log-mel frames of stored tensors, without the padding."""
    tensors = table.column("tensor").combine_chunks()
    values = (tensors.chunk(0) if isinstance(tensors, pa.ChunkedArray) else tensors).to_numpy_ndarray()
    return values.reshape(-1, BANDS)[: sum(table.column("frames").to_pylist())]


def media_columns(df: DataFrame, text: str = "text", outputs: tuple[str, ...] = ("media", "tensors", "segments")) -> DataFrame:
    """df without its text, with the stored media and what is read back and computed from it."""
    outputs = tuple(outputs)
    kept = [c for c in df.columns if c != text and c.lower() not in outputs]
    source = df.select(*kept, text)
    schema = output_schema(source, (text,), ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs))
    span = pa.struct([("first_ms", pa.int64()), ("last_ms", pa.int64())])
    types = {"media": pa.binary(), "tensors": pa.binary(), "segments": pa.list_(span), "n_tensors": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
    heard = {"tensors", "tensors_sha256", "n_tensors", "segments", "feature"} & set(outputs)

    def row(t: str | None) -> dict:
        data, n = payload(t)
        media = to_wav(data)
        back, _ = from_wav(media)
        out = {
            "media": media, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-BLOCK:]),
            "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        }
        if heard:
            mel, spans = features(back)
            stored = store_tensors(mel)
            table = read_tensors(stored)
            out |= {"tensors": stored, "tensors_sha256": hashlib.sha256(stored).hexdigest(), "n_tensors": table.num_rows, "feature": describe(frames_in(table), spans)}
            out["segments"] = [{"first_ms": _ms(a), "last_ms": _ms(b) + FRAME * 1000 * DOWN // (RATE * UP)} for a, b in spans]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                rows = [row(t) for t in batch.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array([r[o] for r in rows], types.get(o, pa.string())) for o in outputs)], names=[*kept, *outputs])

    return source.mapInArrow(run, schema)
