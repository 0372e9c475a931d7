"""Scratch tables, partition counts and vectorised text primitives that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a longer document is a step of its own.
STEP_BYTES = 2 << 20

def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, rows: int) -> DataFrame:
    """left joined with right (one row a key) on key, where no partition gets more of one key than its fair share.

    counts: (key, n) of left's rows, rows their number. Keys of more than rows / partitions rows,
    of which there are fewer than partitions, are dealt over several partitions, to each of which
    right's row goes; the table of these keys is all that is broadcast.
    """
    spark = left.sparkSession
    share = max(1, rows // partitions(spark))
    hot = counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).alias("__parts")).collect()
    if not hot:
        return left.join(right.hint("merge"), key)
    hot = F.broadcast(spark.createDataFrame([tuple(r) for r in hot], counts.select(key, F.lit(0).cast("long").alias("__parts")).schema))
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    left = left.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), parts)).drop("__parts")
    right = right.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return left.join(right.hint("merge"), [key, "__part"]).drop("__part")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text); a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each (a single longer row is a range of its own)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    i, n = 0, len(ends)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield i, j
        i = j


def zipped(texts: DataFrame) -> DataFrame:
    """(doc_id, text) with each text compressed: for an exchange that whole texts go through."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
        for b in batches:
            for i, j in steps(b.column("text"), 8 << 20):
                yield batch(schema, b.column("doc_id")[i:j], [zip_.compress(t.as_buffer()) for t in b.column("text")[i:j]])

    return texts.select("doc_id", "text").mapInArrow(squeeze, "doc_id long, text binary")


def unzipped(texts: pa.Array) -> pa.Array:
    unzip = zstandard.ZstdDecompressor()
    return pa.array([unzip.decompress(t.as_buffer()) for t in texts], pa.large_binary()).view(pa.large_string())


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, a blank after each, and the n + 1 places where they start."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    spaced = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    _, offs, data = spaced.buffers()
    offs = np.frombuffer(offs, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(0x5EED)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)))
_SPAN, _SPAN_INVERSE = (np.uint64(x) for x in (0xD1B54A32D192ED03, pow(0xD1B54A32D192ED03, -1, 2**64)))
_BLOCK = 1 << 19
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's life."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, _BLOCK + (1 << 16)), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of h."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, offs: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` in joined() texts, and the first word of each text (n + 1)."""
    gap = SEPARATOR[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = len(data) > 0 and not gap[0]
    edge[-1] = False
    np.not_equal(gap[1:], gap[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice's bytes; slices are in the order of their starts. Works on _BLOCK bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _BLOCK)))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        size = int(e.max())
        total = np.zeros(size + 1, np.uint64)
        np.multiply(_BYTE[data[starts[i] : starts[i] + size]], powers(_BASE, size), out=total[1:])
        np.cumsum(total, out=total)
        out[i:j] = mix((total[e] - total[s]) * powers(_INVERSE, size + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def span_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n items, from the items' hashes; entry i is of items i .. i + n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_SPAN, len(h)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(_SPAN_INVERSE, len(h))[: len(h) - n + 1])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + counts[0] - 1, then the same for the next, as one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = counts > 0
    starts, counts = np.asarray(starts)[keep], np.asarray(counts)[keep]
    out = np.ones(total, np.int64)
    first = np.cumsum(counts) - counts
    out[0] = starts[0]
    out[first[1:]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def batch(schema: str | pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
