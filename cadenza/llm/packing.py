"""Packing by concatenating and cutting."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batch, documents, steps, stored
from .tokenizer import encoder, load

_ENCODED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first pass: each document's ids, then end_id, and where they begin within what its task encodes. Stored, as the second pass needs them again."""
    data, version = load(tokenizer)
    file = docs.sparkSession.sparkContext.broadcast(data)  # of a fixed size: the vocabulary file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(file.value, version), TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j in steps(b.column("text")):
                own = [np.array([*enc.ids(t.as_py()), end_id], enc.dtype) for t in b.column("text")[i:j]]
                n = np.array([len(x) for x in own], np.int64)
                yield batch(_ENCODED, b.column("doc_id")[i:j], np.full(j - i, part), at + np.cumsum(n) - n, n, [x.tobytes() for x in own])
                at += int(n.sum())

    return stored(documents(docs, id_col, text_col).mapInArrow(encode, "doc_id long, part int, start_in_part long, n long, ids binary"), "packing")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Lay all documents' ids in one row and cut it every `length` ids; a row for each piece of a document.

    Two passes: the first encodes and counts; the sum of the counts before a partition (one row
    for each partition, so this small table is all that meets in one task and is broadcast)
    gives each document its place in the whole; the second cuts it at the windows' edges. Only
    the last sequence is not full. Columns: doc_id; start and length, where the piece lies in
    its document; ids_crc32 of its ids as little-endian unsigned 32-bit; doc_tokens with end_id;
    sequence_id and offset, where it lies in the result; ids, as little-endian unsigned 32-bit,
    if with_ids.

    A null text counts as empty: a piece with end_id alone. Repeated rows are documents of their
    own. An empty table gives no rows. Other columns are ignored.
    """
    table = encoded(docs, tokenizer, end_id, id_col, text_col)
    dtype = np.uint16 if encoder(*load(tokenizer)).dtype is np.uint16 else np.uint32
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = table.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("ids"), 4 << 20):
                out: list[tuple] = []
                for doc, at, n, raw in zip(*(b.column(c)[i:j].to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                    ids = np.frombuffer(raw, dtype).astype("<u4")
                    edges = [at, *range((at // length + 1) * length, at + n, length), at + n]
                    for a, z in zip(edges, edges[1:], strict=False):
                        own = ids[a - at : z - at].tobytes()
                        out.append((doc, a - at, z - a, zlib.crc32(own), n, a // length, a % length, own if with_ids else None))
                if out:
                    yield batch(_PIECES, *map(list, zip(*out, strict=True)))

    pieces = placed.mapInArrow(cut, PIECES)
    return pieces if with_ids else pieces.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """A row for each sequence: its ids, and the boundaries of the pieces in it. A sequence's size is bounded by the window."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(own.alias("p")).select(
        "sequence_id",
        F.expr("aggregate(p, binary(''), (a, x) -> concat(a, x.ids))").alias("ids"),
        F.expr("transform(p, x -> named_struct('offset', x.offset, 'doc_id', x.doc_id, 'start', x.start, 'length', x.length))").alias("boundaries"),
    )
