"""Media columns: documents' bytes as audio, and its features as tensors of a fixed shape."""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch, documents, partitions, steps, stored


@dataclass(frozen=True)
class AudioParams:
    """rate: of the stored samples; up / down: the resampling ratio; taps: a filter branch's length; frame, hop: of the resampled signal; mels: filters; on, off: standard deviations above the mean log energy at which a segment opens and closes; span: frames in a tensor; block: frames that are worked on at once."""

    rate: int = 16_000
    up: int = 2
    down: int = 3
    taps: int = 16
    frame: int = 256
    hop: int = 128
    mels: int = 20
    on: float = 0.5
    off: float = 0.0
    span: int = 64
    block: int = 4096


def to_wav(payload: bytes, rate: int) -> bytes:
    """8-bit unsigned PCM, one channel: each byte is a sample, so nothing is lost."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit samples of one channel are expected")
        return w.readframes(w.getnframes())


def padded(data: bytes, block: int = 64) -> bytes:
    """Bytes 0 up to a positive multiple of block."""
    return data + bytes(-len(data) % block if data else block)


class Features:
    """Resampler, filterbank and segmenter of one set of parameters. Each signal is worked on alone, so equal signals have equal features."""

    def __init__(self, p: AudioParams):
        self.p = p
        half = p.taps * p.up // 2
        n = np.arange(-half, half)
        width = 1 / max(p.up, p.down)
        low = np.sinc(n * width) * width * p.up * np.hamming(len(n))
        #: branch k makes the outputs whose phase is k
        self.branches = [np.ascontiguousarray(low[k :: p.up][::-1], np.float32) for k in range(p.up)]
        self.window = np.hanning(p.frame).astype(np.float32)
        top = 2595 * np.log10(1 + p.rate * p.up / p.down / 2 / 700)
        edges = 700 * (10 ** (np.linspace(0, top, p.mels + 2) / 2595) - 1)
        at = np.fft.rfftfreq(p.frame, p.down / (p.rate * p.up))
        rise, fall = ((at[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - at[:, None]) / (edges[2:] - edges[1:-1]))
        self.bank = np.maximum(0, np.minimum(rise, fall)).astype(np.float32)

    def resampled(self, x: np.ndarray, a: int, z: int) -> np.ndarray:
        """Outputs a .. z - 1 of the polyphase resampler over 8-bit samples x; silence lies around x."""
        p, out = self.p, np.empty(z - a, np.float32)
        for first in range(min(p.up, z - a)):
            k = (a + first) * p.down
            branch, start = k % p.up, k // p.up - p.taps // 2
            count = -(-(z - a - first) // p.up)
            stop = start + (count - 1) * p.down + p.taps
            own = np.zeros(stop - start, np.float32)
            lo, hi = max(start, 0), min(stop, len(x))
            if hi > lo:
                own[lo - start : hi - start] = (x[lo:hi].astype(np.float32) - 128) / 128
            out[first :: p.up] = np.lib.stride_tricks.sliding_window_view(own, p.taps)[:: p.down][:count] @ self.branches[branch]
        return out

    def frames(self, n: int) -> int:
        long = -(-n * self.p.up // self.p.down)
        return 1 + max(0, -(-(long - self.p.frame) // self.p.hop))

    def blocks(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First frame, log-mel rows and log energies, block by block: memory doesn't grow with the signal."""
        p, total = self.p, self.frames(len(x))
        for f in range(0, total, p.block):
            g = min(total, f + p.block)
            y = self.resampled(x, f * p.hop, (g - 1) * p.hop + p.frame)
            own = np.lib.stride_tricks.sliding_window_view(y, p.frame)[:: p.hop] * self.window
            power = np.square(np.abs(np.fft.rfft(own, axis=1))).astype(np.float32)
            yield f, np.log(power @ self.bank + 1e-6), np.log(np.square(own).sum(axis=1) + 1e-6)

    def segments(self, energy: np.ndarray) -> np.ndarray:
        """Frame ranges of sound: open at mean + on * deviation, and close below mean + off * deviation."""
        mean, dev = energy.mean(), energy.std()
        mark = np.where(energy >= mean + self.p.on * dev, 1, np.where(energy < mean + self.p.off * dev, 0, -1))
        mark[0] = max(mark[0], 0)
        at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), 0))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mark[at], [0]])))
        return edges.reshape(-1, 2)


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_TENSORS = pa.schema([("doc_id", pa.int64()), ("span", pa.int32()), ("spans", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("sound", pa.float32()), ("marks", pa.binary()), ("tensor", pa.list_(pa.float32()))])
_CHECKS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary())]
_SPANS = pa.schema([("row", pa.int64()), ("span", pa.int32()), ("start_s", pa.float64()), ("marks", pa.binary()), ("sums", pa.binary()), ("units", pa.binary()), ("feature", pa.string()), *_CHECKS])
_SPANS_SQL = "row long, span int, start_s double, marks binary, sums binary, units binary, feature string, doc_id long, n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def audio_column(docs: DataFrame, params: AudioParams = AudioParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, as a WAV file of 8-bit samples.

    A null text counts as empty (64 samples); repeated rows each give a row; an empty table
    gives no rows; other columns are ignored.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text"), 8 << 20):
                own = [t.as_buffer() if t.is_valid else b"" for t in b.column("text")[i:j]]
                yield batch(_STORED, b.column("doc_id")[i:j], [len(x) for x in own], [to_wav(padded(bytes(x)), params.rate) for x in own])

    return documents(docs, id_col, text_col).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def audio_tensors(media: DataFrame, params: AudioParams = AudioParams()) -> DataFrame:
    """A row for each `span` frames of each signal: (doc_id, span, spans, start_s, end_s, frames, sound, marks, tensor).

    tensor has the fixed shape (params.span, params.mels), row by row, the last one filled with
    zeros; spans says how many rows the signal has, frames how many of a tensor's are real; sound is the share of them that lie in a
    segment, marks a byte 1 or 0 for each. as_tensors() gives the column as Arrow's fixed-shape tensor type.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features(params)
        seconds = params.hop * params.down / (params.rate * params.up)
        for b in batches:
            for doc, m in zip(b.column("doc_id").to_pylist(), b.column("media"), strict=True):
                x = np.frombuffer(from_wav(m.as_py()), np.uint8)
                energy = np.concatenate([e for _, _, e in feats.blocks(x)])
                on = np.zeros(len(energy), np.uint8)
                for a, z in feats.segments(energy):
                    on[a:z] = 1
                for f, mel, _ in feats.blocks(x):
                    n = -(-len(mel) // params.span)
                    full = np.zeros((n * params.span, params.mels), np.float32)
                    full[: len(mel)] = mel
                    real = np.minimum(params.span, len(mel) - np.arange(n) * params.span)
                    first = f + np.arange(n) * params.span
                    marks = [on[a : a + k].tobytes() for a, k in zip(first, real, strict=True)]
                    sound = [on[a : a + k].mean() for a, k in zip(first, real, strict=True)]
                    tensor = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (params.span * params.mels), pa.array(full.ravel()))
                    yield batch(_TENSORS, [doc] * n, (first // params.span).astype(np.int32), [-(-len(energy) // params.span)] * n, first * seconds, (first + real) * seconds, real.astype(np.int32), np.array(sound, np.float32), marks, tensor)

    return media.select("doc_id", "media").mapInArrow(compute, "doc_id long, span int, spans int, start_s double, end_s double, frames int, sound float, marks binary, tensor array<float>")


def as_tensors(column: pa.ChunkedArray | pa.Array, params: AudioParams = AudioParams()) -> pa.ExtensionArray:
    """A tensor column that was read back from Parquet, as pyarrow.FixedShapeTensorArray; its values are not copied."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = params.span * params.mels
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (params.span, params.mels)), pa.FixedSizeListArray.from_arrays(column.flatten(), size))


class Summary:
    """The feature of one signal, from its spans in their order."""

    def __init__(self, p: AudioParams):
        self.seconds = p.hop * p.down / (p.rate * p.up)
        self.total, self.frames, self.segments, self.sound, self.crc, self.before = np.zeros(p.mels), 0, 0, 0, 0, 0
        self.first = self.last = 0.0

    def add(self, start: float, marks: bytes, sums: bytes, units: bytes) -> None:
        on = np.frombuffer(marks, np.uint8)
        at = np.flatnonzero(on)
        if len(at):
            self.first = self.first if self.segments else start + at[0] * self.seconds
            self.last = start + (at[-1] + 1) * self.seconds
        self.segments += int(np.count_nonzero(on > np.concatenate([[self.before], on[:-1]])))
        self.total, self.frames, self.sound = self.total + np.frombuffer(sums), self.frames + len(on), self.sound + len(at)
        self.crc, self.before = zlib.crc32(units, self.crc), on[-1]

    def text(self) -> str:
        mean = ",".join(map(str, np.rint(self.total / self.frames * 10).astype(int)))
        return f"{self.frames};{self.segments};{self.sound};{f'{self.first:.3f}-{self.last:.3f}' if self.segments else '-'};{mean};{self.crc:08x}"


def audio_digests(docs: DataFrame, params: AudioParams = AudioParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every document as audio and its features as tensors in the shared folder, read both back, and give a row of checks and features for each.

    feature, from the tensors: frames, segments, frames of sound, the first and last sound in
    seconds, the mean log-mel row in tenths, and a CRC-32 of all log-mel values in whole units.
    A signal whose tensors are read together is summed up where they are read; of others the
    spans travel.
    """

    def checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, doc, n, m in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "n_bytes")), b.column("media"), strict=True):
                media = m.as_py()
                payload = from_wav(media)
                out.append((row, -1, None, None, None, None, None, doc, n, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).digest()))
            if out:
                yield batch(_SPANS, *map(list, zip(*out, strict=True)))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            tensors = as_tensors(b.column("tensor"), params).to_numpy_ndarray()
            units = [np.rint(t[:k]).astype(np.int8).tobytes() for t, k in zip(tensors, b.column("frames").to_pylist(), strict=True)]
            sums = [x.tobytes() for x in tensors.sum(axis=1, dtype=np.float64)]
            row, span, many, start, marks = (b.column(c).to_pylist() for c in ("row", "span", "spans", "start_s", "marks"))
            out, i = [], 0
            while i < len(row):
                j = i + many[i]
                if span[i] == 0 and row[i:j] == [row[i]] * many[i] and span[i:j] == list(range(many[i])):  # all of a signal
                    own = Summary(params)
                    for k in range(i, j):
                        own.add(start[k], marks[k], sums[k], units[k])
                    out.append((row[i], 0, None, None, None, None, own.text()))
                    i = j
                else:
                    out.append((row[i], span[i], start[i], marks[i], sums[i], units[i], None))
                    i += 1
            yield batch(_SPANS, *map(list, zip(*out, strict=True)), *(pa.nulls(len(out), f.type) for f in list(_SPANS)[7:]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of documents and spans, the checks first."""
        row, own, told, parts, done = None, None, None, Summary(params), []

        def close() -> None:
            if row is not None:
                doc, n, size, payload, tail, stored_size, media = own
                done.append((doc, n, size, payload.hex(), tail, stored_size, media.hex(), told or parts.text()))

        for b in batches:
            for r, span, start, marks, sums, units, feature, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != row:
                    close()
                    row, own, told, parts = r, rest, None, Summary(params)
                if feature is not None:
                    told = feature
                elif span >= 0:
                    parts.add(start, marks, sums, units)
            if done:
                yield batch(_DIGESTS, *map(list, zip(*done, strict=True)))
                done.clear()
        close()
        if done:
            yield batch(_DIGESTS, *map(list, zip(*done, strict=True)))

    # ids may repeat, so each row has a number of its own, which is stored with it
    media = stored(audio_column(docs, params, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "audio", "zstd")
    tensors = stored(audio_tensors(media.select(F.col("row").alias("doc_id"), "media"), params).withColumnRenamed("doc_id", "row"), "tensors", "zstd")
    parts = media.mapInArrow(checks, _SPANS_SQL).unionAll(tensors.select("row", "span", "spans", "start_s", "frames", "marks", "tensor").mapInArrow(spans, _SPANS_SQL))
    ordered = parts.repartition(partitions(docs.sparkSession), "row").sortWithinPartitions("row", "span")
    return ordered.mapInArrow(features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
