"""Exact removal of repeated byte strings by sorted suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import Runs, anchored_runs, collapse, covered, marks
from .shared import batch, documents, joined, mix, partitions, ranges, steps, stored, unzipped, word_hashes, zipped

#: Leading bytes of a suffix: what its bucket depends on.
CORE = 16

_SENT = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_SETTLED = pa.schema([("doc_id", pa.int64()), ("a", pa.int32()), ("z", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])
_KEYS = pa.schema([("key", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def leading(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts as they do."""
    wide = data.astype(np.uint64)
    for n in (1, 2, 4):
        wide = (wide[:-n] << np.uint64(8 * n)) | wide[n:]
    return wide


def suffix_runs(doc: np.ndarray, texts: pa.Array, width: int) -> tuple[Runs, np.ndarray]:
    """The sampled suffixes of some texts and their leading CORE bytes. A suffix is sampled where a window of `width` bytes has its anchor, and carries what lies before it in these windows."""
    data, offs = joined(texts)
    if len(data) < width:
        return Runs(*(np.zeros(0, np.int64),) * 6, data), np.zeros(0, f"S{CORE}")
    eight = leading(data)
    cores = mix(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + mix(eight[8:]))
    text, window, count, anchor, _ = anchored_runs(cores, offs[:-1], offs[1:] - 1, width, CORE)
    size = count - 1 + width
    runs = Runs(doc[text], window - offs[:-1][text], count, anchor - window, window, size, data)
    collapse(runs, word_hashes(data, window, window + size), within=True)
    key = np.stack([eight[anchor], eight[anchor + 8]], axis=1).astype(">u8").view(f"S{CORE}").ravel() if len(anchor) else np.zeros(0, f"S{CORE}")
    return runs, key


def multikey_sort(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their columns (numbers of eight bytes), and the bytes each row shares with the one before it.

    Multikey quicksort: each open group is split in three around a pivot of its column, the
    median of three; rows equal to the pivot go on to the next column, the others stay at this
    one. All open groups take a step at once.
    """
    n, k = columns.shape
    order = np.arange(n)
    start, size, depth = (np.array([x], np.int64) for x in (0, n, 0))
    while len(start):
        at = ranges(start, size)
        group = np.repeat(np.arange(len(start)), size)
        rows = order[at]
        v = columns[rows, depth[group]]
        head = np.cumsum(size) - size
        pivot = _middle(v[head], v[head + size // 2], v[head + size - 1])
        side = 3 * group + (v >= pivot[group]) + (v > pivot[group])
        order[at] = rows[np.argsort(side, kind="stable")]
        parts = np.bincount(side, minlength=3 * len(start)).reshape(-1, 3)
        begin = (start[:, None] + np.cumsum(parts, axis=1) - parts).ravel()
        level = (depth[:, None] + np.array([0, 1, 0])).ravel()
        parts = parts.ravel()
        open_ = (parts > 1) & (level < k)
        start, size, depth = begin[open_], parts[open_], level[open_]
    shared = np.zeros(n, np.int64)
    if n > 1:
        differ = columns[order[1:]] ^ columns[order[:-1]]
        at = (differ != 0).argmax(axis=1)
        first = differ[np.arange(n - 1), at]
        alike = np.full(n - 1, 8)
        for b in range(8):
            alike -= first >= np.uint64(1 << (8 * b))
        shared[1:] = np.where(first == 0, 8 * k, 8 * at + alike)
    return order, shared


def _middle(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The median of three."""
    return np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))


def repeated_windows(runs: Runs, width: int) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Run and place of each window whose bytes start earlier too, among the runs of one bucket; the runs come back by document and place.

    The suffixes from the anchors are sorted forwards, and what lies before the anchors
    backwards. Windows are equal if their anchors lie r bytes in, the forward suffixes share
    width - r bytes and the backward ones r: both are stretches of the sorted order between
    which no neighbours share less.
    """
    none = np.zeros(0, np.int64)
    runs = runs.take(np.lexsort((runs.start + runs.anchor, runs.doc)))
    if len(runs) < 2:
        return runs, none, none
    front, back = 8 * -(-width // 8), 8 * -(-(width - CORE) // 8)
    buf = np.concatenate([np.zeros(back, np.uint8), runs.data, np.zeros(front, np.uint8)])
    at = runs.at + runs.anchor + back
    head = np.lib.stride_tricks.sliding_window_view(buf, CORE)[at].view(f"S{CORE}").ravel()
    _, which, size = np.unique(head, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[which] > 1)
    if not len(several):
        return runs, none, none
    at, n = at[several], len(several)
    doc, place, anchor, count = runs.doc[several], (runs.start + runs.anchor)[several], runs.anchor[several], runs.count[several]
    views = np.lib.stride_tricks.sliding_window_view
    order_f, shared_f = multikey_sort(np.ascontiguousarray(views(buf, front)[at]).view(">u8").astype(np.uint64))
    order_b, shared_b = multikey_sort(np.ascontiguousarray(views(buf, back)[at - back][:, ::-1]).view(">u8").astype(np.uint64))
    rank_f, rank_b = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_f[order_f] = rank_b[order_b] = np.arange(n)
    rows, places = [], []
    for r in range(width - CORE + 1):
        own = np.flatnonzero((anchor >= r) & (anchor - r < count))
        f = np.cumsum(shared_f < width - r)[rank_f[own]]
        own = own[np.bincount(f, minlength=n + 1)[f] > 1]
        if not len(own):
            continue
        pair = np.cumsum(shared_f < width - r)[rank_f[own]] * (n + 1) + np.cumsum(shared_b < r)[rank_b[own]]
        order = np.argsort(pair, kind="stable")
        new = np.ones(len(own), bool)
        new[1:] = pair[order][1:] != pair[order][:-1]
        own = own[order]
        least = own[np.flatnonzero(new)][np.cumsum(new) - 1]
        own = own[(doc[own] != doc[least]) | (place[own] != place[least])]
        rows.append(own)
        places.append(anchor[own] - r)
    run, where = (several[np.concatenate(rows)], np.concatenate(places)) if rows else (none, none)
    by = np.lexsort((where, run))
    return runs, run[by], where[by]


def splitters(docs: DataFrame, width: int, buckets: int) -> np.ndarray:
    """buckets - 1 keys that cut the suffixes into about equal ranges; one that stands there more than once is a hot key.

    They come from about 8 documents a bucket (those whose id's hash is divisible by a number
    that follows the table's size), so what the driver gets is bounded by the buckets. They
    decide only where a suffix goes, never what is found.
    """
    rate = max(1, docs.count() // (8 * buckets))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text")):
                runs, key = suffix_runs(np.asarray(b.column("doc_id")[i:j]), b.column("text")[i:j], width)
                key = np.random.default_rng(0).permutation(key[runs.size > 0])[: 64 * (j - i)]
                yield batch(_KEYS, [k.ljust(CORE, b"\0") for k in key.tolist()])

    found = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0).mapInArrow(keys, "key binary").toPandas()["key"]
    sample = np.sort(np.array(found.tolist(), f"S{CORE}"))
    return sample[np.arange(1, buckets) * len(sample) // buckets] if len(sample) else sample


class Ranges:
    """The bucket of each suffix: its range, or for a hot key one of as many buckets as it has splitters."""

    def __init__(self, cuts: np.ndarray):
        self.cuts, many = np.unique(cuts, return_counts=True) if len(cuts) else (cuts, np.zeros(0, int))
        self.hot, self.share = self.cuts[many > 1], many[many > 1]
        self.first_hot = len(self.cuts) + 1
        self.offset = self.first_hot + np.cumsum(self.share) - self.share

    def of(self, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        to = np.searchsorted(self.cuts, key, side="right") if len(self.cuts) else np.zeros(len(key), np.int64)
        if len(self.hot) and len(key):
            at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            hit = self.hot[at] == key
            salt = mix(doc.astype(np.uint64)) % self.share[at].astype(np.uint64)
            to = np.where(hit, self.offset[at] + salt.astype(np.int64), to)
        return to

    def hot_bucket(self, bucket: int) -> bool:
        """Whether it holds a part of a hot key's suffixes, so that what is left of it must meet that of its other buckets."""
        return bucket >= self.first_hot


#: Parts in which a hot key's windows meet across its buckets, by how many bytes lie before the key.
PARTS = 4


def deeper(runs: Runs, width: int, many: int) -> Iterator[tuple[int, Runs]]:
    """The runs of hot keys dealt out again: (bucket, runs).

    Windows of one part have the key at nearly the same place, so they share many more bytes
    than the key: by these they are dealt, and equal windows still meet.
    """
    data, step = runs.data, -(-(width - CORE + 1) // PARTS)
    for low in range(0, width - CORE + 1, step):
        high = min(low + step, width - CORE + 1)  # bytes before the key: low .. high - 1
        a = np.maximum(runs.anchor - high + 1, 0)
        z = np.minimum(runs.anchor - low + 1, runs.count)
        own = np.flatnonzero(z > a)
        if not len(own):
            continue
        a, n, anchor = a[own], (z - a)[own], runs.anchor[own]
        part = Runs(runs.doc[own], runs.start[own] + a, n, anchor - a, runs.at[own] + a, n - 1 + width, data)
        begin = runs.at[own] + anchor - low
        order = np.argsort(begin, kind="stable")
        key = np.empty(len(own), np.uint64)
        key[order] = word_hashes(data, begin[order], begin[order] + width - high + 1 + low)
        yield from part.split((mix(key + np.uint64(low)) % np.uint64(many)).astype(np.int64))


def substring_marks(docs: DataFrame, width: int = 100, buckets: int | None = None) -> DataFrame:
    """(doc_id, a, z): the byte ranges of each document (doc_id, text) that strings with an earlier start cover.

    Sampled splitters deal the suffixes out by their leading bytes; each bucket sorts its
    suffixes. A range never parts equal leading bytes, so that only a hot key, which has several
    buckets, goes over a boundary: each of its buckets settles its own part, and the suffixes
    that are still the first of something there are compared across those buckets in a second
    round, dealt out by more of their bytes.
    Copies within a step of a task are settled before anything is sent.
    """
    docs = docs.where("doc_id is not null")
    many = buckets or 4 * partitions(docs.sparkSession)
    to = Ranges(splitters(docs, width, many))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text")):
                runs, key = suffix_runs(np.asarray(b.column("doc_id")[i:j]), b.column("text")[i:j], width)
                sent = [(k, own.pack()) for k, own in runs.split(to.of(key, runs.doc))]
                if sent:
                    yield batch(_SENT, *map(list, zip(*sent, strict=True)))

    def settled_in(table: pa.Table, again: bool) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        runs = Runs.unpack(x.as_py() for x in table.column("packed"))
        told = runs.take(np.flatnonzero(runs.size == 0))
        open_, run, place = repeated_windows(runs.take(np.flatnonzero(runs.size > 0)), width)
        doc, a, z = (np.append(x, y) for x, y in zip(marks(open_.doc, open_.start, run, place, width), (told.doc, told.start, told.start + told.count - 1 + width), strict=True))
        n = len(doc)
        out = [batch(_SETTLED, doc, a.astype(np.int32), z.astype(np.int32), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))]
        if not again and to.hot_bucket(bucket):
            left = np.flatnonzero(np.bincount(run, minlength=len(open_)) < open_.count)
            out += [batch(_SETTLED, [None], [None], [None], [k], [own.pack()]) for k, own in deeper(open_.take(left), width, many)]
        return pa.Table.from_batches(out)

    def settle(table: pa.Table) -> pa.Table:
        return settled_in(table, False)

    def settle_again(table: pa.Table) -> pa.Table:
        return settled_in(table, True)

    schema = "doc_id long, a int, z int, bucket int, packed binary"
    settled = docs.mapInArrow(send, "bucket int, packed binary").groupBy("bucket").applyInArrow(settle, schema)
    if len(to.hot):
        settled = stored(settled, "suffixes")
        across = settled.where("packed is not null").select("bucket", "packed").groupBy("bucket").applyInArrow(settle_again, schema)
        settled = settled.where("packed is null").union(across)
    return settled.select("doc_id", "a", "z")


def remove_substrings(docs: DataFrame, width: int = 100, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row: what is left of each text's UTF-8 bytes.

    A byte goes if it lies in a string of `width` bytes that also starts earlier: in a document
    with a smaller id, or before it in its own document. Strings are judged on the input.
    A null text counts as empty; a text shorter than `width` stays whole. Rows that share an id
    count as one document, and each of them loses what is marked for that id; a row without an
    id stays whole. An empty table gives no rows; other columns are ignored.
    """
    texts = documents(docs, id_col, text_col)
    # the texts themselves meet their marks compressed
    own = substring_marks(texts, width, buckets).groupBy("doc_id").agg(F.collect_list(F.struct("a", "z")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text")):
                data, offs = joined(unzipped(b.column("text")[i:j]))
                out = []
                for k, spans in enumerate(b.column("marks")[i:j]):
                    raw, spans = data[offs[k] : offs[k + 1] - 1], spans.values
                    spans = np.zeros((0, 2), np.int64) if spans is None else np.stack([spans.field("a"), spans.field("z")], axis=1)
                    gone, n = covered(spans, len(raw))
                    out.append((len(raw), int(gone.sum()), n, raw[~gone].tobytes()))
                yield batch(_RESULT, b.column("doc_id")[i:j], *map(list, zip(*out, strict=True)))

    return zipped(texts).join(own, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def removal_digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
