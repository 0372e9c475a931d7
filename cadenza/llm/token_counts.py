"""Token counts through a cache of content digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch, documents, partitions, spread_join, steps, stored
from .tokenizer import encoder, load

_CACHE = "digest binary, n_tokens long"
_TEXTS = pa.schema([("digest", pa.binary()), ("text", pa.string())])
_COUNTS = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def _unrepeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop what this task has had already, so that a text with very many copies travels once a task."""
    seen: set[bytes] = set()
    for b in batches:
        own = b.column("digest").to_pylist()
        keep = [d not in seen and not seen.add(d) for d in own]
        yield b.filter(pa.array(keep, pa.bool_()))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes, n_tokens) of every row of docs.

    The cache is a Parquet table in a folder that all executors share, one partition for each
    tokenizer version (the digest of its file); a row has the SHA-256 of a normalised text and
    its count. Texts whose digest it lacks are brought together by digest, encoded once each and
    appended; then the documents join the table. Normalisation is the tokenizer's own, so texts
    that it takes for one share an entry; a tokenizer without any, and a text that holds one of
    its special strings, which are looked for before it, are taken as they are. Only digests
    take part in the final join, and a digest of very many documents is dealt over partitions.

    A null text counts as empty (0 tokens); repeated rows and repeated ids each give a row; an
    empty table gives no rows; other columns are ignored. A task that is run again appends
    nothing twice, since Spark commits the files of one attempt only. Of writers that append at
    the same time each may add the same digest; reads take one count for each.
    """
    spark = docs.sparkSession
    data, version = load(tokenizer)
    file = spark.sparkContext.broadcast(data)  # of a fixed size: the vocabulary file
    path = f"{cache.rstrip('/')}/tokenizer={version[:32]}"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(file.value, version), set()
        for b in batches:
            out = [(d, len(enc.ids(t))) for d, t in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True) if d not in seen and not seen.add(d)]
            yield batch(_COUNTS, [d for d, _ in out], [n for _, n in out])

    def table() -> DataFrame:
        return spark.read.schema(_CACHE).parquet(path)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file.value, version)
        for b in batches:
            for i, j in steps(b.column("text")):
                own = b.slice(i, j - i)
                yield own.append_column("normal", pa.array([enc.normal(t) for t in own.column("text").to_pylist()], pa.string()))

    texts = documents(docs, id_col, text_col)
    if encoder(data, version).normalises:
        texts = texts.mapInArrow(normal, "doc_id long, text string, normal string")
    else:
        texts = texts.withColumn("normal", F.col("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("normal", 256))).drop("normal")
    misses = texts.select("digest", "text")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        misses = misses.join(table().select("digest"), "digest", "left_anti")
    misses = misses.mapInArrow(_unrepeated, "digest binary, text string").repartition(partitions(spark), "digest")
    misses.mapInArrow(encoded, _CACHE).write.mode("append").parquet(path)
    known = table().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    own = stored(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    return spread_join(own, known, "digest", own.groupBy("digest").agg(F.count("*").alias("n")), own.count()).select("doc_id", "digest", "n_bytes", "n_tokens")
