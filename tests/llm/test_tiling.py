"""String tiling against a search without hashes."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from cadenza.llm import tiling
from samples import corpus, frame, lower, prose, split


def tiled(a, b, least):
    used_a, used_b, tiles = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k >= least and k > best[0]:
                    best = (k, j, i)
        k, j, i = best
        if not k:
            return used_b, tiles
        used_a[i : i + k], used_b[j : j + k] = [True] * k, [True] * k
        tiles += 1


def brute(rows, items, least, threshold):
    out = []
    for d, t in rows:
        for k, b in items:
            if k is None or len(split(b)) < least:
                continue
            used, tiles = tiled(split(lower(t)), split(lower(b)), least)
            if sum(used) and sum(used) >= threshold * len(used):
                out.append((d, k, len(used), sum(used), tiles))
    return sorted(out, key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").repartition(2)


def planted(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(6)] + [(6, "a b a b a b a b a b a b"), (7, "too few"), (8, None), (None, "no id but many words in it here")]
    rows = []
    for i in range(20):
        own = split(items[i % 6][1])
        cut = rng.randint(5, len(own) - 5)
        parts = [own[:cut], own[cut:]]
        rng.shuffle(parts)
        words = [*prose(rng, 10).split(), *parts[0], *prose(rng, rng.randint(0, 4)).split(), *(parts[1] if i % 3 else parts[1][: rng.randint(0, 12)]), *prose(rng, 10).split()]
        rows.append((i, " ".join(words).upper() if i % 2 else " ".join(words)))
    rows += [(30, "a b a b a b a"), (31, None), (32, ""), (33, items[0][1]), (33, items[0][1]), (None, items[1][1]), (34, prose(rng, 60))]
    return rows, items


@pytest.mark.parametrize(("seed", "threshold", "block"), [(1, 0.5, 32 << 20), (2, 0.3, 200), (3, 0.9, 200)])
def test_matches_are_those_of_a_plain_search(spark, seed, threshold, block):
    rows, items = planted(seed)
    got = tiling.contaminated(frame(spark, rows, extra=True), benchmark(spark, items), 5, threshold, block)
    assert sorted(((r.doc_id, r.item_id, r.item_words, r.covered, r.tiles) for r in got.collect()), key=repr) == brute(rows, items, 5, threshold)


@pytest.mark.parametrize("seed", range(60))
def test_tiles_are_greedy_and_do_not_overlap(seed):
    rng = random.Random(seed)
    a, b = (np.array([rng.choice((11, 12, 13)[: 2 + seed % 2]) for _ in range(rng.randint(3, 60))], np.uint64) for _ in range(2))
    known = {tuple(b[j : j + 3]) for j in range(len(b) - 2)}
    hits = np.array([i for i in range(len(a) - 2) if tuple(a[i : i + 3]) in known], np.int64)
    used, tiles = tiling.tile(a, b, hits, 3)
    assert (used.tolist(), tiles) == tiled(a.tolist(), b.tolist(), 3)


def test_words_with_one_hash_are_told_apart_by_spelling(monkeypatch):
    """With all hashes equal only the spelling is left."""
    monkeypatch.setattr(tiling, "word_hashes", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    rows, items = planted(1)
    own = tiling.Items.of([k for k, _ in items[:4]], [t for _, t in items[:4]], 5)
    for row in rows[:6]:
        found = [(row[0], *x[1:5]) for x in own.matches(tiling.Words.of(pa.array([row[1]])), 5, 0.5)]
        assert sorted(found) == brute([row], items[:4], 5, 0.5)


def test_long_runs_of_one_word_stay_small():
    """100,000 equal words against 10,000: all pairs of places would be a thousand million."""
    item = tiling.Items.of([1, 2], ["a " * 10_000, "a b " * 5_000], 5)
    text = tiling.Words.of(pa.array(["a " * 100_000, "a b " * 6_000 + "a " * 3_000]))
    began = time.perf_counter()
    tracemalloc.start()
    got = list(item.matches(text, 5, 0.5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:5] for x in got] == [(0, 1, 10_000, 10_000, 1), (1, 2, 10_000, 10_000, 1)]
    assert most < 200 << 20 and time.perf_counter() - began < 20


def test_only_contaminated_rows_go(spark):
    rows, items = planted(4)
    docs = frame(spark, rows, extra=True)
    kept = tiling.decontaminate(docs, benchmark(spark, items))
    bad = {d for d, *_ in brute(rows, items, 5, 0.5)}
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d, _ in rows if d not in bad)


def test_empty_tables(spark):
    rows, items = planted(5)
    assert tiling.contaminated(frame(spark, []), benchmark(spark, items)).count() == 0
    assert tiling.contaminated(frame(spark, rows), benchmark(spark, [])).count() == 0
    assert tiling.decontaminate(frame(spark, rows), benchmark(spark, [])).count() == len(rows)
    clean = [(d, t) for d, t in corpus() if d != 90]
    assert tiling.contaminated(frame(spark, clean), benchmark(spark, items)).count() == 0
