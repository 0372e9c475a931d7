"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, batch, documents, joined, ranges, span_hashes, steps, stored, word_hashes, words

#: Bits of the table that most seeds of clean documents fail at once.
_SIEVE = 22
#: (Seed, item) pairs that are looked at together.
_AT_ONCE = 1 << 21

_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("covered", pa.int32()), ("tiles", pa.int32()), ("coverage", pa.float64())])
HITS = "doc_id long, item_id long, item_words int, covered int, tiles int, coverage double"


@dataclass
class Words:
    """The words (A-Z in lower case) of some texts: bytes, places, hashes, and where each text's words begin (n + 1)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Words:
        data, offs = joined(texts)
        data = LOWER[data]
        starts, ends, first = words(data, offs)
        return Words(data, starts, ends, word_hashes(data, starts, ends), first)

    def spelled(self, i: int, n: int) -> list[bytes]:
        """n words from the i-th on."""
        base = self.starts[i]
        raw = self.data[base : self.ends[i + n - 1]].tobytes()
        return [raw[a:z] for a, z in zip((self.starts[i : i + n] - base).tolist(), (self.ends[i : i + n] - base).tolist(), strict=True)]


def _free_from(free: np.ndarray) -> np.ndarray:
    """How many unmarked words follow each other from each place on."""
    here = np.arange(len(free))
    stop = np.minimum.accumulate(np.where(free, len(free), here)[::-1])[::-1]
    return stop - here


def tile(a: np.ndarray, b: np.ndarray, hits: np.ndarray, least: int, same: Callable[[int, int, int], bool] = lambda i, j, n: True) -> tuple[np.ndarray, int]:
    """Greedy string tiling of b by a (hashes of words): which of b's words tiles cover, and the number of tiles.

    The longest match of unmarked words is marked first (of equal ones the earliest in b, then
    in a), until none of at least `least` words is left; each word of a and of b lies in one
    tile at most. Running Karp-Rabin: the length of the longest match is found by halving,
    each trial by the hashes of all unmarked stretches of that length; then all matches of that
    length are marked in one pass. So memory follows the lengths of a and b, whatever repeats.

    hits: the places in a where `least` words begin that b has too; only what they cover is
    looked at. same(i, j, n): whether n words from i in a and j in b are spelled alike; matches
    of unlike words with like hashes are passed over.
    """
    used_b, tiles = np.zeros(len(b), bool), 0
    if not len(hits):
        return used_b, tiles
    inside = np.zeros(hits[-1] - hits[0] + least + 1, np.int32)
    np.add.at(inside, hits - hits[0], 1)
    np.add.at(inside, hits - hits[0] + least, -1)
    place = np.flatnonzero(np.cumsum(inside) > 0) + hits[0]
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    place = np.insert(place, gap, -1)  # a marked word keeps the stretches apart
    free, own = place >= 0, a[place]

    def windows(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, to = np.flatnonzero(_free_from(free) >= n), np.flatnonzero(_free_from(~used_b) >= n)
        return at, span_hashes(own, n)[at], to, span_hashes(b, n)[to]

    def shared(n: int) -> bool:
        _, x, _, y = windows(n)
        return bool(np.isin(y, x).any())

    most = len(b)
    while True:
        high = min(most, int(_free_from(free).max(initial=0)), int(_free_from(~used_b).max(initial=0)))
        low = least - 1  # no longer match than high, and one of low words (or none wanted)
        if high > low and shared(high):
            low = high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if shared(mid) else (low, mid)
        n = low
        if n < least:
            return used_b, tiles
        at, x, to, y = windows(n)
        order = np.argsort(x, kind="stable")
        at, x = at[order], x[order]
        begin, end = np.searchsorted(x, y, "left"), np.searchsorted(x, y, "right")
        done = 0
        for j, k, stop in zip(to.tolist(), begin.tolist(), end.tolist(), strict=True):
            while j >= done and k < stop:
                i = int(at[k])
                marked = np.flatnonzero(~free[i : i + n])
                if len(marked):
                    k += int(np.searchsorted(at[k:stop], i + marked[-1] + 1))
                elif same(int(place[i]), j, n):
                    free[i : i + n] = False
                    used_b[j : j + n] = True
                    tiles, done = tiles + 1, j + n
                else:
                    k += 1
        most = n - 1


@dataclass
class Items:
    """A block of benchmark items: their words, and for each seed the items that hold it and how often."""

    ids: list[int]
    text: Words
    seeds: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    times: np.ndarray
    sieve: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: list[str | None], least: int) -> Items:
        w = Words.of(pa.array(texts, pa.string()))
        seeds = [span_hashes(w.hashes[a:z], least) for a, z in zip(w.first, w.first[1:], strict=False)]
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        seed = np.concatenate([*seeds, np.zeros(0, np.uint64)]).astype(np.uint64)
        order = np.lexsort((item, seed))
        seed, item = seed[order], item[order]
        new = np.ones(len(seed), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])
        head = np.flatnonzero(new)
        sieve = np.zeros(1 << _SIEVE, bool)
        sieve[(seed & np.uint64((1 << _SIEVE) - 1)).astype(np.int64)] = True
        return Items(ids, w, seeds, seed[head], item[head], np.diff(np.append(head, len(seed))), sieve)

    def matches(self, w: Words, least: int, threshold: float) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(text, item id, item words, covered words, tiles, coverage) of the pairs at or above the threshold."""
        s = span_hashes(w.hashes, least)
        at = np.flatnonzero(self.sieve[(s & np.uint64((1 << _SIEVE) - 1)).astype(np.int64)])
        text = np.searchsorted(w.first, at, side="right") - 1
        near = np.minimum(np.searchsorted(self.seed, s[at]), max(len(self.seed) - 1, 0))
        keep = (at + least <= w.first[text + 1]) & (self.seed[near] == s[at] if len(self.seed) else False)
        at, text = at[keep], text[keep]
        begin = np.searchsorted(text, np.arange(len(w.first)))
        order = np.lexsort((s[at], text))  # each seed of a text once
        new = np.ones(len(at), bool)
        new[1:] = (text[order][1:] != text[order][:-1]) | (s[at[order]][1:] != s[at[order]][:-1])
        own, value = text[order][new], s[at[order]][new]
        low, high = np.searchsorted(self.seed, value, "left"), np.searchsorted(self.seed, value, "right")
        size = np.diff(self.text.first)
        cuts = np.flatnonzero(np.diff(own)) + 1  # whole texts at once
        total = np.concatenate([[0], np.cumsum(high - low)])
        a = 0
        for z in [*cuts.tolist(), len(own)]:
            if z < len(own) and total[z] - total[a] < _AT_ONCE:
                continue
            post = ranges(low[a:z], (high - low)[a:z])
            pair = np.repeat(own[a:z], (high - low)[a:z]) * len(size) + self.item[post]
            pair, which = np.unique(pair, return_inverse=True)
            most = least * np.bincount(which, self.times[post], len(pair))
            for p in pair[most >= threshold * size[pair % len(size)]].tolist():
                yield from self._tiled(w, *divmod(p, len(size)), at, s, begin, least, threshold)
            a = z

    def _tiled(self, w: Words, t: int, k: int, at: np.ndarray, s: np.ndarray, begin: np.ndarray, least: int, threshold: float) -> Iterator[tuple[int, int, int, int, int, float]]:
        mine = at[begin[t] : begin[t + 1]]
        hits = mine[np.isin(s[mine], self.seeds[k])]
        reach = np.zeros(len(self.seeds[k]) + least, np.int32)
        known = np.flatnonzero(np.isin(self.seeds[k], s[hits]))
        np.add.at(reach, known, 1)
        np.add.at(reach, known + least, -1)
        a, b = w.first[t], self.text.first[k]
        n = int(self.text.first[k + 1] - b)
        if np.count_nonzero(np.cumsum(reach) > 0) < threshold * n:
            return
        same = lambda i, j, m: w.spelled(a + i, m) == self.text.spelled(b + j, m)
        used, tiles = tile(w.hashes[a : w.first[t + 1]], self.text.hashes[b : b + n], hits - a, least, same)
        covered = int(used.sum())
        if covered and covered >= threshold * n:
            yield t, self.ids[k], n, covered, tiles, covered / n


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, covered, tiles, coverage): documents whose text covers at least `threshold` of a benchmark item's words by tiles of at least `least` words.

    Passages count in any order and with gaps between them, as each tile is marked on its own.
    The benchmark is the query set: it is held against all documents in blocks of at most
    `block_bytes` of its text, each of which is broadcast; its size is taken before. Where there
    are several, each block's result is stored before the next one comes to the driver. Documents
    stay where they are: shared seeds are joined with the broadcast ones. Words are compared with
    A-Z in lower case, and tiles by their spelling.

    A null or empty text has no match, nor has an item of fewer than `least` words; items
    without an id are left out. Repeated rows, ids and items each give rows of their own; empty
    tables give no rows; other columns are ignored.
    """
    texts = documents(docs, id_col, text_col)
    out = None
    for block, last in _blocks(benchmark, block_bytes, item_col, item_text):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items.of(*block.value, least)
            for b in batches:
                for i, j in steps(b.column("text")):
                    found = list(items.matches(Words.of(b.column("text")[i:j]), least, threshold))
                    if found:
                        own = b.column("doc_id")[i:j].take(pa.array([x[0] for x in found]))
                        yield batch(_HITS, own, *(list(c) for c in list(zip(*found, strict=True))[1:]))

        hits = texts.mapInArrow(search, HITS)
        if not last:
            hits = stored(hits, "tiles")
            block.destroy()
        out = hits if out is None else out.union(hits)
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def _blocks(benchmark: DataFrame, block_bytes: int, item_col: str, item_text: str) -> Iterator[tuple[Broadcast, bool]]:
    """The items in blocks of bounded size, each broadcast, and whether it is the last one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("item_id is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows])), k == blocks - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = 32 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text isn't contaminated; each row is judged where it lies.

    Null and empty texts, repeated rows and empty tables: as in contaminated().
    """
    index = docs.columns.index(text_col)
    for block, last in _blocks(benchmark, block_bytes, item_col, item_text):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items.of(*block.value, least)
            for b in batches:
                for i, j in steps(b.column(index)):
                    keep = np.ones(j - i, bool)
                    keep[[x[0] for x in items.matches(Words.of(b.column(index)[i:j]), least, threshold)]] = False
                    yield b.slice(i, j - i).filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
        if not last:
            docs = stored(docs, "unseen")
            block.destroy()
    return docs
