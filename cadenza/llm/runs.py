"""Windows that share an anchor travel together: the part that both exact-substring operators need.

A window is `width` consecutive items (bytes or words) of one text. Its anchor is the item
sequence of `core` items within it that has the smallest hash, the leftmost of equal ones. So
equal windows have equal anchors at equal places, and a run of consecutive windows with one
anchor is sent as one string.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard

from .shared import ranges

#: Bits of an item's place in a step's texts (no string of Spark's has more items); the others hold the hash by which anchors are chosen.
_PLACE = np.uint64(32)


def _small(column: np.ndarray) -> np.ndarray:
    return column.astype(np.min_scalar_type(int(column.max())) if len(column) else np.uint8)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i : i + n] for every i, in log2(n) passes."""
    size, cur = 1, x
    while 2 * size <= n:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = len(x) - n + 1
    return np.minimum(cur[:rest], cur[n - size : n - size + rest]) if size < n else cur[:rest]


def anchored_runs(core_hashes: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, core: int, by_value: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (text, first window, windows, anchor, the anchor's value), places counted over all texts.

    core_hashes: of the items i .. i + core - 1; first, last: where each text's items begin and
    end. by_value: windows whose anchors have one value share a run even where the anchor moves,
    so that a stretch that repeats itself is one run; anchor is then the first window's.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    count = np.maximum(last - first - width + 1, 0)
    if not count.any():
        return none
    low = np.uint64((1 << int(_PLACE)) - 1)
    packed = sliding_min((core_hashes & ~low) | np.arange(len(core_hashes), dtype=np.uint64), width - core + 1)
    at = ranges(first, count)
    own = packed[at]
    mark = own >> _PLACE if by_value else own
    new = np.ones(len(at), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    text = np.repeat(np.arange(len(first)), count)[head]
    return text, at[head], np.diff(np.append(head, len(at))), (own[head] & low).astype(np.int64), own[head] >> _PLACE


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are equal, for each of the slices."""
    if not len(a):
        return np.zeros(0, bool)
    step = max(1, int(1e6 // max(1, size.mean())))
    out = []
    for i in range(0, len(a), step):
        s = size[i : i + step]
        differ = data[ranges(a[i : i + step], s)] != data[ranges(b[i : i + step], s)]
        edge = np.concatenate([[0], np.cumsum(s)])
        hit = np.concatenate([[0], np.cumsum(differ)])
        out.append(hit[edge[1:]] == hit[edge[:-1]])
    return np.concatenate(out)


@dataclass
class Runs:
    """Runs as columns. doc: document; start: the first window's place in it; count: windows; anchor: the anchor's place in the string (not used where it moves within a run); at, size: the string in data. A run without a string (size 0) is a verdict already: all its windows go."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    at: np.ndarray
    size: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, index: np.ndarray) -> Runs:
        return Runs(*(c[index] for c in (self.doc, self.start, self.count, self.anchor, self.at, self.size)), self.data)

    def pack(self) -> bytes:
        """Columns in the smallest types that hold them, then the strings; compressed."""
        ids, which = np.unique(self.doc, return_inverse=True)
        columns = [ids.astype("<i8"), *(_small(c) for c in (which, self.start, self.count, self.anchor, self.size))]
        head = struct.pack("<qq", len(ids), len(self)) + b"".join(c.dtype.char.encode() for c in columns[1:])
        raw = head + b"".join(c.tobytes() for c in columns) + self.data[ranges(self.at, self.size)].tobytes()
        return zstandard.ZstdCompressor(level=3).compress(raw)

    @staticmethod
    def unpack(blobs: Iterator[bytes]) -> Runs:
        parts, base = [], 0
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            many, n = struct.unpack_from("<qq", raw)
            kinds, at = raw[16:21].decode(), 21
            ids = np.frombuffer(raw, "<i8", many, at)
            at += ids.nbytes
            columns = []
            for kind in kinds:
                own = np.frombuffer(raw, kind, n, at)
                at += own.nbytes
                columns.append(own.astype(np.int64))
            which, start, count, anchor, size = columns
            data = np.frombuffer(raw, np.uint8, offset=at)
            parts.append((ids[which], start, count, anchor, base + np.cumsum(size) - size, size, data))
            base += len(data)
        return Runs(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    def split(self, to: np.ndarray) -> Iterator[tuple[int, Runs]]:
        """The runs of each destination, in their order."""
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        for own in np.split(order, cuts):
            if len(own):
                yield int(to[own[0]]), self.take(own)

    def verdict(self, index: np.ndarray) -> None:
        """Turn these runs into verdicts."""
        self.size = self.size.copy()
        self.size[index] = 0


def collapse(runs: Runs, digest: np.ndarray, within: bool) -> None:
    """Before anything is sent: of runs with equal strings keep the first one's, by document and place; the later ones' windows all go.

    within: whether a document's own earlier place counts too; if not, copies in the first
    one's document are kept as they are. Strings are compared, not only their digests.
    """
    order = np.lexsort((runs.start, runs.doc, digest))
    new = np.ones(len(order), bool)
    new[1:] = digest[order][1:] != digest[order][:-1]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = order != head
    later &= (runs.doc[order] > runs.doc[head]) | (within & (runs.doc[order] == runs.doc[head]) & (runs.start[order] > runs.start[head]))
    a, b = order[later], head[later]
    same = (runs.size[a] == runs.size[b]) & (runs.count[a] == runs.count[b])
    a, b = a[same], b[same]
    runs.verdict(a[same_bytes(runs.data, runs.at[a], runs.at[b], runs.size[a])])


def marks(doc: np.ndarray, start: np.ndarray, run: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, from, to) of what the removed windows cover; run, place: their run and their place in it, sorted."""
    if not len(run):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(run)) - 1
    own = run[head]
    return doc[own], start[own] + place[head], start[own] + place[tail] + width


def covered(spans: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Which of `size` items lie in a span (rows of from, to), and how many maximal runs they form."""
    edge = np.zeros(size + 2, np.int64)
    if len(spans):
        np.add.at(edge, np.minimum(spans[:, 0], size), 1)
        np.add.at(edge, np.minimum(spans[:, 1], size), -1)
    inside = np.cumsum(edge)[:size] > 0
    return inside, int(np.count_nonzero(inside[1:] & ~inside[:-1]) + (size > 0 and inside[0]))
