"""Recordings as tables and as WAV files."""

from __future__ import annotations

import io
import struct
import wave

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import valid_session
from ..functions.udf import arrow
from ..params import RATE


def append(blocks: DataFrame, path: str) -> None:
    """Add blocks (session, pos, data) to a table that has a folder for each session; nothing that is there changes."""
    blocks.write.mode("append").partitionBy("session").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pos long, data binary, session string").parquet(path)


def load_slice(recordings: DataFrame, session: str, start: float, end: float, rate: int = RATE) -> DataFrame:
    """(pos, sample bytes) of a session's range in seconds, clamped to what is there; nothing if it ends before it starts. The session is a partition and the position has statistics, so only what is asked for is read."""
    a, z = max(0, int(start * rate)), max(0, int(end * rate))
    n = F.octet_length("data") / 2
    own = recordings.where((F.col("session") == session) & (F.col("pos") < z) & (F.col("pos") + n > a) & F.lit(z > a))
    lo, hi = F.greatest(F.lit(a) - F.col("pos"), F.lit(0)), F.least(F.lit(z) - F.col("pos"), n)
    return own.select((F.col("pos") + lo).cast("long").alias("pos"), F.substring("data", (lo * 2 + 1).cast("int"), ((hi - lo) * 2).cast("int")).alias("data")).orderBy("pos")


def durations(recordings: DataFrame, rate: int = RATE) -> DataFrame:
    return recordings.groupBy("session").agg((F.max(F.col("pos") + F.octet_length("data") / 2) / rate).alias("seconds"))


@arrow("double")
def wav_seconds(head: pd.Series, size: pd.Series) -> pd.Series:
    """A WAV file's length by its header; by its size where the header can't be read."""

    def one(raw: bytes, n: int) -> float:
        try:
            with wave.open(io.BytesIO(raw)) as w:
                return w.getnframes() / w.getframerate()
        except (wave.Error, EOFError, ZeroDivisionError):
            return max(0, n - 44) / 32000

    return pd.Series([one(h or b"", int(n)) for h, n in zip(head, size, strict=True)])


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(session, seconds, bytes, modified) of the WAV files in a folder, the newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    session = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    return files.select(session.alias("session"), wav_seconds("content", "length").alias("seconds"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy(F.desc("session"))


def deletions(requests: DataFrame, catalog_rows: DataFrame, active: DataFrame) -> DataFrame:
    """(session, status) of requests to delete: invalid, missing, active (still being written) or delete."""
    own = requests.join(catalog_rows.select("session", F.lit(True).alias("_there")), "session", "left").join(active.select("session", F.lit(True).alias("_open")), "session", "left")
    status = F.when(~valid_session(F.col("session")), "invalid").when(F.col("_there").isNull(), "missing").when(F.col("_open"), "active").otherwise("delete")
    return own.select("session", status.alias("status"))


def to_wav(pcm: bytes, rate: int = RATE) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(pcm)) + pcm


def clips(hunks: DataFrame, recordings: DataFrame, pad: float = 2.0, after: float = 6.0, rate: int = RATE) -> DataFrame:
    """(session, at_sec, wav): the sound around each hunk (session, at_sec), from `pad` before to `pad` + `after` behind it, within the recording."""
    a, z = F.greatest(F.col("at_sec") - pad, F.lit(0.0)), F.col("at_sec") + pad + after
    want = hunks.where("at_sec >= 0").select("session", "at_sec", (a * rate).cast("long").alias("_a"), (z * rate).cast("long").alias("_z"))
    n = F.octet_length("data") / 2
    own = recordings.join(want, "session").where((F.col("pos") < F.col("_z")) & (F.col("pos") + n > F.col("_a")))
    lo, hi = F.greatest(F.col("_a") - F.col("pos"), F.lit(0)), F.least(F.col("_z") - F.col("pos"), n)
    cut = own.select("session", "at_sec", "pos", F.substring("data", (lo * 2 + 1).cast("int"), ((hi - lo) * 2).cast("int")).alias("data"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"session": [pdf["session"].iloc[0]], "at_sec": [pdf["at_sec"].iloc[0]], "wav": [to_wav(b"".join(pdf["data"]), rate)]})

    return cut.groupBy("session", "at_sec").applyInPandas(build, "session string, at_sec double, wav binary")
