"""Samples from and to PCM bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow
from ..params import FRAME, RATE


def decoded(data: bytes, channels: int = 1) -> np.ndarray:
    """16-bit little-endian samples as floats in [-1, 1); several channels become their mean, and bytes of an incomplete last frame are left out."""
    whole = len(data) // (2 * channels) * channels
    x = np.frombuffer(data, "<i2", whole).astype(np.float32) / 32768
    return x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def pcm16_to_floats(channels: int = 1):
    @arrow("array<float>")
    def decode(data: pd.Series) -> pd.Series:
        return pd.Series([decoded(d or b"", channels) for d in data])

    return decode


@arrow("binary")
def floats_to_pcm16(samples: pd.Series) -> pd.Series:
    """The server's way: times 32767, clipped, towards zero."""
    return pd.Series([(np.clip(np.asarray(s, np.float32), -1, 1) * 32767).astype("<i2").tobytes() for s in samples])


@arrow("binary")
def floats_to_pcm16_by_client(samples: pd.Series) -> pd.Series:
    """The client's way: negative samples times 32768, others times 32767."""
    x = [np.clip(np.asarray(s, np.float64), -1, 1) for s in samples]
    return pd.Series([np.where(v < 0, v * 0x8000, v * 0x7FFF).astype("<i2").tobytes() for v in x])


class Resampler:
    """Linear-phase resampling of a stream in blocks: the filter's state and position go on from block to block, so blocks and the whole give the same samples."""

    def __init__(self, rate_in: int, rate_out: int = RATE, taps: int = 32):
        self.step, self.taps = rate_in / rate_out, taps
        self.width = min(1.0, rate_out / rate_in)
        self.tail, self.first, self.next, self.got = np.zeros(taps, np.float64), -taps, 0, 0

    def push(self, x: np.ndarray, last: bool = False) -> np.ndarray:
        self.got += len(x)
        own = np.concatenate([self.tail, x, np.zeros(self.taps if last else 0)])
        limit = self.got if last else self.first + len(own) - self.taps // 2
        count = max(0, int(np.ceil((limit - self.next * self.step) / self.step)))
        at = (self.next + np.arange(count)) * self.step
        low = np.floor(at).astype(int) - self.taps // 2 + 1
        k = low[:, None] + np.arange(self.taps)
        d = (k - at[:, None])
        w = np.sinc(d * self.width) * self.width * np.cos(np.pi * d / (self.taps + 2)) ** 2
        out = (own[np.clip(k - self.first, 0, len(own) - 1)] * w).sum(axis=1) / np.maximum(1e-9, w.sum(axis=1)) if count else np.zeros(0)
        self.next += count
        keep = max(0, int(np.floor(self.next * self.step)) - self.taps - self.first)
        self.tail, self.first = own[keep:], self.first + keep
        return out.astype(np.float32)


def resampled(blocks: DataFrame, rate_in: int, rate_out: int = RATE) -> DataFrame:
    """(session, block, samples) of blocks (session, block, samples) at another rate; each session's blocks are one stream."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        r, n = Resampler(rate_in, rate_out), len(pdf)
        return pdf.assign(samples=[r.push(np.asarray(s, float), i == n - 1) for i, s in enumerate(pdf["samples"])])

    return blocks.select("session", "block", "samples").groupBy("session").applyInPandas(run, "session string, block long, samples array<float>")


def framed(blocks: DataFrame, size: int = FRAME) -> DataFrame:
    """(session, frame_no, rms, peak, n) of blocks (session, pos, samples): a frame may lie in several blocks, so frames are summed up by position. Only features go on."""
    own = blocks.select("session", F.posexplode("samples").alias("i", "x"), "pos")
    x = F.col("x").cast("double")
    sums = own.groupBy("session", F.floor((F.col("pos") + F.col("i")) / size).alias("frame_no")).agg(F.count("*").alias("n"), F.sum(x * x).alias("sq"), F.max(F.abs(x)).alias("peak"))
    return sums.select("session", "frame_no", F.sqrt(F.col("sq") / F.col("n")).alias("rms"), "peak", "n")
