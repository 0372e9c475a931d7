"""Both exact-substring operators against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from cadenza.llm import runs, suffixes, superkmers
from samples import by_id, corpus, frame, prose, split, unique_ids


def removed_bytes(rows, width):
    first, gone = {}, {}
    rows = sorted((d, (t or "").encode()) for d, t in rows)
    for doc, raw in rows:
        for i in range(len(raw) - width + 1):
            first.setdefault(raw[i : i + width], (doc, i))
    for doc, raw in rows:
        hit = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < (doc, i):
                hit[i : i + width] = True
        gone[doc] = raw, hit
    out = []
    for doc, (raw, hit) in gone.items():
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], hit.astype(int)])) == 1))
        kept = np.frombuffer(raw, np.uint8)[~hit].tobytes()
        out.append((doc, len(raw), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removed_words(rows, width):
    least, out = {}, []
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - width + 1):
            own = tuple(w[i : i + width])
            least[own] = min(least.get(own, doc), doc)
    for doc, text in rows:
        w = split(text)
        hit = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < doc:
                hit[i : i + width] = [True] * width
        kept = " ".join(x for x, h in zip(w, hit, strict=True) if not h)
        out.append((doc, len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "width", "buckets"), [(1, 100, None), (2, 100, 3), (3, 40, 64)])
def test_suffixes_remove_what_brute_force_removes(spark, seed, width, buckets):
    rows = unique_ids(corpus(seed))
    got = suffixes.removal_digest(suffixes.remove_substrings(frame(spark, rows, extra=True), width, buckets))
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(rows, width)


def test_a_hot_key_is_compared_across_its_buckets(spark):
    same = "the very same passage of words that stands in nearly all of these texts, again and again, so often that it is hot. " * 2
    rows = [(i, f"{i} {same} {i * 7919}") for i in range(200)]
    got = suffixes.removal_digest(suffixes.remove_substrings(frame(spark, rows, slices=8), 100, 40))
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(rows, 100)


def test_a_hot_key_in_many_surroundings_is_dealt_out_again(spark):
    """What stands around the key differs from text to text, and some windows over it are equal."""
    rng, same = random.Random(4), "the key that all of these texts hold "
    around = [prose(rng, 14) for _ in range(12)]
    rows = [(i, f"{prose(rng, 6)} {rng.choice(around)} {same}{rng.choice(around)} {prose(rng, 6)}") for i in range(240)]
    got = suffixes.removal_digest(suffixes.remove_substrings(frame(spark, rows, slices=8), 100, 60))
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(rows, 100)


def test_a_long_run_of_one_word_is_one_super_kmer():
    texts = pa.array(["a " * 1_000_000, "b c " * 300_000 + "d"])
    tracemalloc.start()
    own, key = superkmers.super_kmers(np.array([1, 2]), texts, 50, 8)
    assert len(own) == len(key) < 60 and own.size.sum() < 2 * 3_300_000
    run, place = superkmers.repeated_windows(superkmers._spaced(runs.Runs.unpack([own.pack()])), 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(run) and most < 600 << 20


def test_repetitive_texts_lose_what_brute_force_removes(spark):
    rows = [(1, "a " * 3000), (2, "b " + "a " * 700), (3, "a b " * 400), (4, "c " + "a b " * 60 + "d"), (5, "x y z " * 200), (6, "z x y " * 30 + "a " * 49)]
    for width, core in ((50, 8), (7, 7)):
        got = superkmers.removal_digest(superkmers.remove_substrings(frame(spark, rows), width, core))
        assert by_id(got, "n_words", "n_removed", "kept_sha256") == removed_words(rows, width)
    got = suffixes.removal_digest(suffixes.remove_substrings(frame(spark, rows), 100))
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(rows, 100)


def test_texts_beyond_a_step(spark):
    """Longer than STEP_BYTES: each is a step of its own."""
    rng = random.Random(3)
    long = prose(rng, 400_000)
    rows = [(1, long), (2, f"{prose(rng, 30)} #{long[1_000_000:1_200_000]}"), (3, long[5:])]
    assert len(long) > 2 << 20
    got = by_id(superkmers.remove_substrings(frame(spark, rows), 50), "n_removed")
    assert got[0] == (1, 0) and got[2][1] == len(split(rows[2][1])) - 1 and 0 < got[1][1] < len(split(rows[1][1])) - 29
    got = by_id(suffixes.remove_substrings(frame(spark, rows), 100), "n_removed")
    assert got == [(1, 0), (2, 200_000), (3, len(rows[2][1]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_multikey_sort_orders_rows_and_tells_what_neighbours_share(seed):
    rng = np.random.default_rng(seed)
    raw = rng.integers(0, 2, (300, 24), np.uint8)
    order, shared = suffixes.multikey_sort(raw.view(">u8").astype(np.uint64))
    got = [raw[i].tobytes() for i in order]
    assert got == sorted(got)
    for i in range(1, len(got)):
        assert shared[i] == next((k for k in range(24) if got[i][k] != got[i - 1][k]), 24)


@pytest.mark.parametrize(("seed", "width", "core", "buckets"), [(1, 50, 8, None), (2, 50, 8, 2), (3, 6, 3, 16), (4, 9, 9, 5)])
def test_super_kmers_remove_what_brute_force_removes(spark, seed, width, core, buckets):
    rows = unique_ids(corpus(seed))
    got = superkmers.removal_digest(superkmers.remove_substrings(frame(spark, rows, extra=True), width, core, buckets))
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == removed_words(rows, width)


def test_a_bucket_in_which_hashes_clash_compares_words(monkeypatch):
    texts = [("p q r s t u " * 3).strip(), ("p q r s t u " * 2 + "v w").strip()]
    whole = [superkmers.super_kmers(np.array([1, 2]), superkmers.pa.array(texts), 4, 2)[0]]
    blob = runs.Runs.unpack(r.pack() for r in whole)
    own = superkmers._spaced(blob.take(np.flatnonzero(blob.size > 0)))
    want = superkmers.repeated_windows(own, 4)
    monkeypatch.setattr(superkmers, "span_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    got = superkmers.repeated_windows(own, 4)
    assert sorted(zip(*map(list, got), strict=True)) == sorted(zip(*map(list, want), strict=True))


@pytest.mark.parametrize("op", [suffixes, superkmers])
def test_repeated_and_missing_ids_and_empty_tables(spark, op):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (1, text), (None, text), (2, text), (3, None)]
    got = op.removal_digest(op.remove_substrings(frame(spark, rows))).collect()
    assert len(got) == 5
    gone = {(r.doc_id, r.n_removed > 0) for r in got}
    assert (2, True) in gone and (None, False) in gone and (3, False) in gone
    assert op.removal_digest(op.remove_substrings(frame(spark, []))).count() == 0
