"""Exact removal of repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import Runs, anchored_runs, collapse, covered, marks, same_bytes
from .shared import SEPARATOR, batch, documents, joined, mix, partitions, powers, span_hashes, steps, unzipped, word_hashes, words, zipped
from .shared import _SPAN, _SPAN_INVERSE

_SENT = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_MARKS = pa.schema([("doc_id", pa.int64()), ("a", pa.int32()), ("z", pa.int32())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])


def super_kmers(doc: np.ndarray, texts: pa.Array, width: int, core: int) -> tuple[Runs, np.ndarray]:
    """The super-k-mers of some texts, words joined by one space, and each one's minimiser as a hash. A stretch that repeats itself is one super-k-mer, as its windows have one minimiser."""
    data, offs = joined(texts)
    starts, ends, first = words(data, offs)
    h = word_hashes(data, starts, ends)
    cores = span_hashes(h, core)
    text, window, count, anchor, value = anchored_runs(cores, first[:-1], first[1:], width, core, by_value=True)
    keep = ~SEPARATOR[data]
    keep[ends] = True  # one blank after each word; joined() has one after each text
    dense = np.where(SEPARATOR[data], np.uint8(0x20), data)[keep]
    begin = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    last = window + count - 1 + width
    at = begin[window]
    runs = Runs(doc[text], window - first[text], count, anchor - window, at, begin[last] - at - 1, dense)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_SPAN, len(h)), out=total[1:])
    collapse(runs, mix((total[last] - total[window]) * powers(_SPAN_INVERSE, len(h) + 1)[window] + count.astype(np.uint64)), within=False)
    return runs, mix(value)


def repeated_windows(runs: Runs, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Run and place of each window whose words also start in a document with a smaller id, among the runs of one bucket."""
    starts, ends, first = words(runs.data, np.append(runs.at, len(runs.data))) if len(runs) else (np.zeros(0, np.int64),) * 3
    h = span_hashes(word_hashes(runs.data, starts, ends), width)
    run = np.repeat(np.arange(len(runs)), runs.count)
    place = np.arange(len(run)) - np.repeat(np.cumsum(runs.count) - runs.count, runs.count)
    at = first[run] + place
    key, owner = h[at], runs.doc[run]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(order)))
    several = np.repeat(size > 1, size)
    order, group = order[several], (np.cumsum(new) - 1)[several]
    order = order[np.lexsort((order, owner[order], group))]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    least = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    later = owner[order] > owner[least]
    hit, best = order[later], least[later]
    by = np.argsort(hit)
    hit, best = hit[by], best[by]
    # Equal hashes, equal words: compared once for each stretch of windows that moves along the same earlier stretch.
    if len(hit):
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (best[1:] != best[:-1] + 1) | (run[hit][1:] != run[hit][:-1]) | (run[best][1:] != run[best][:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hit)) - 1
        a, b = starts[at[hit[head]]], starts[at[best[head]]]
        size = ends[at[hit[tail]] + width - 1] - a
        same = size == ends[at[best[tail]] + width - 1] - b
        same[same] = same_bytes(runs.data, a[same], b[same], size[same])
        if not same.all():
            return _by_words(runs, starts, ends, at, run, place, width)
    return run[hit], place[hit]


def _by_words(runs: Runs, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, run: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for a bucket in which two different windows have one hash."""
    raw = runs.data.tobytes()
    own = [raw[starts[i] : ends[i + width - 1]] for i in at]
    least: dict[bytes, int] = {}
    for s, r in zip(own, run, strict=True):
        least[s] = min(least.get(s, runs.doc[r]), runs.doc[r])
    hit = np.array([runs.doc[r] > least[s] for s, r in zip(own, run, strict=True)], bool)
    return run[hit], place[hit]


def substring_marks(docs: DataFrame, width: int = 50, core: int = 8, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, z): word ranges of each document that windows with an earlier copy cover.

    Consecutive windows that share a minimiser travel as one packed string to the bucket of
    that minimiser; each bucket sorts its windows, so every copy of a window meets the others
    there. Copies within a step of a task are settled before anything is sent, so that a
    passage which very many documents share reaches its bucket about once a step.
    """
    many = buckets or 4 * partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text")):
                runs, key = super_kmers(np.asarray(b.column("doc_id")[i:j]), b.column("text")[i:j], width, core)
                sent = [(k, own.pack()) for k, own in runs.split((key % np.uint64(many)).astype(np.int64))]
                if sent:
                    yield batch(_SENT, *map(list, zip(*sent, strict=True)))

    def settle(table: pa.Table) -> pa.Table:
        runs = Runs.unpack(x.as_py() for x in table.column("packed"))
        told, open_ = runs.take(np.flatnonzero(runs.size == 0)), runs.take(np.flatnonzero(runs.size > 0))
        run, place = repeated_windows(_spaced(open_), width)
        doc, a, z = marks(open_.doc, open_.start, run, place, width)
        columns = np.append(doc, told.doc), np.append(a, told.start), np.append(z, told.start + told.count - 1 + width)
        return pa.Table.from_batches([batch(_MARKS, columns[0], columns[1].astype(np.int32), columns[2].astype(np.int32))])

    sent = documents(docs, id_col, text_col).where("doc_id is not null").mapInArrow(send, "bucket int, packed binary")
    return sent.groupBy("bucket").applyInArrow(settle, "doc_id long, a int, z int")


def _spaced(runs: Runs) -> Runs:
    """The same runs with a blank between their strings."""
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(runs), [None, pa.py_buffer(np.append(runs.at, runs.at[-1] + runs.size[-1] if len(runs) else 0).astype(np.int64)), pa.py_buffer(runs.data)]) if len(runs) else pa.array([], pa.large_binary())
    data, offs = joined(text.view(pa.large_string()) if len(runs) else pa.array([], pa.large_string()))
    return Runs(runs.doc, runs.start, runs.count, runs.anchor, offs[:-1], runs.size, data)


def remove_substrings(docs: DataFrame, width: int = 50, core: int = 8, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept) for every row: what is left of each text's words, joined by one space.

    A word goes if it lies in a window of `width` words that also starts in a document with a
    smaller id; windows are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`, unchanged.
    A null text has no words; a text with fewer than `width` words keeps them all; a window
    that is repeated only within its own document stays. Rows that share an id count as one
    document, and each of them loses what is marked for that id; a row without an id keeps its
    words. An empty table gives no rows; other columns are ignored.
    """
    own = substring_marks(docs, width, core, buckets, id_col, text_col).groupBy("doc_id").agg(F.collect_list(F.struct("a", "z")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text")):
                data, offs = joined(unzipped(b.column("text")[i:j]))
                starts, ends, first = words(data, offs)
                out = []
                for k, spans in enumerate(b.column("marks")[i:j]):
                    s, e = starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
                    spans = spans.values
                    spans = np.zeros((0, 2), np.int64) if spans is None else np.stack([spans.field("a"), spans.field("z")], axis=1)
                    gone, n = covered(spans, len(s))
                    raw = data[offs[k] : offs[k + 1]].tobytes()
                    base = offs[k]
                    kept = b" ".join([raw[x - base : y - base] for x, y in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True)]) if len(s) else b""
                    out.append((len(s), int(gone.sum()), n, kept.decode("utf-8")))
                yield batch(_RESULT, b.column("doc_id")[i:j], *map(list, zip(*out, strict=True)))

    joined_docs = zipped(documents(docs, id_col, text_col)).join(own, "doc_id", "left").select("doc_id", "text", "marks")
    return joined_docs.mapInArrow(cut, "doc_id long, n_words long, n_removed long, n_spans long, kept string")


def removal_digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
