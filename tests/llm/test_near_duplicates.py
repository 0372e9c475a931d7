"""Near-duplicate groups against all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from cadenza.llm import minmax
from cadenza.llm.components import components
from samples import by_id, corpus, frame, lower, prose, split, unique_ids


def shingles(text):
    w = split(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def groups(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = groups(links, sets)
    return sorted((d, len(s), label[d], label[d] == d) for d, s in sets.items())


def chain(seed):
    """Texts each near the next, so that the first and the last are far apart."""
    rng = random.Random(seed)
    own, out = prose(rng, 100).split(" "), []
    for i in range(12):
        out.append((1000 + i, " ".join(own)))
        for _ in range(2):
            own[rng.randrange(100)] = f"new{i}"
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = unique_ids(corpus(seed)) + chain(seed)
    got = minmax.near_groups(frame(spark, rows, extra=True))
    assert by_id(got, "n_shingles", "component_id", "kept") == brute(rows)


def test_a_whole_table_loses_no_link(spark):
    """Recall against all pairs of the 1,000 documents of the table: every component is theirs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert sum(d != c for d, _, c, _ in want) > 50
    assert by_id(minmax.near_groups(docs), "n_shingles", "component_id", "kept") == want


def test_a_link_at_exactly_three_quarters_counts(spark):
    w = [f"w{i}" for i in range(40)]
    a = " ".join(w[:25])  # 21 shingles
    rows = [(1, a), (2, " ".join(w[:32])), (3, " ".join(w[:33]))]  # 28 and 29 shingles: 21/28 and 28/29, 21/29
    assert by_id(minmax.near_groups(frame(spark, rows)), "component_id") == [(1, 1), (2, 1), (3, 1)]
    assert by_id(minmax.near_groups(frame(spark, [rows[0], rows[2]])), "component_id") == [(1, 1), (3, 3)]


def test_buckets_beyond_a_block_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 8)
    monkeypatch.setattr(minmax, "FOLLOWERS", 8)
    rng = random.Random(9)
    own = prose(rng, 80).split(" ")
    rows = [(i, " ".join([*own[: i % 80], f"x{i}", *own[i % 80 + 1 :]])) for i in range(90)] + chain(4)
    assert by_id(minmax.near_groups(frame(spark, rows)), "n_shingles", "component_id", "kept") == brute(rows)


def test_rows_that_share_an_id_are_one_node(spark):
    """An id's texts are both its own: what either is linked with is one component."""
    rng = random.Random(6)
    a, z = prose(rng, 60), prose(rng, 60)
    rows = [(1, a + " q"), (2, a), (2, z), (3, z + " q"), (4, prose(rng, 30)), (3, None), (2, a)]
    got = minmax.near_groups(frame(spark, rows))
    assert by_id(got, "component_id", "kept") == [(1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True)]
    assert by_id(minmax.keep_one(frame(spark, rows))) == [(1,), (4,)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    sets = [(d, shingles(t)) for d, t in rows]
    links = [(d, e) for (d, x), (e, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    label = groups(links, {d for d, _ in rows})
    assert by_id(minmax.near_groups(frame(spark, rows)), "component_id") == sorted((d, label[d]) for d, _ in rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    both, one, two = (rng.integers(0, 2**63, n, np.uint64) for n in (700, 100, 100))
    x, y = (np.sort(np.concatenate([both, z])) for z in (one, two))
    sig = minmax.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    assert sig.shape == (2, 2 * minmax.PERMUTATIONS)
    assert abs((sig[0] == sig[1]).mean() - 700 / 900) < 0.1
    assert minmax.shingle_sets(pa.array([None, "", "A b", "a B"]))[1].tolist() == [0, 0, 0, 1, 2]


def test_one_of_each_group_stays_with_its_columns(spark):
    rows = [(5, "a b c d e f g h"), (4, "A b c d e f g h"), (None, "a b c d e f g h"), (9, None), (8, ""), (4, "A b c d e f g h")]
    docs = frame(spark, rows, extra=True)
    kept = minmax.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 4), (False, 4), (False, 8), (False, 9), (True, 0)]
    assert minmax.near_groups(frame(spark, [])).count() == 0
    assert minmax.near_groups(frame(spark, [(None, None), (7, None)])).count() == 2


def test_components_of_long_chains_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 300), (7, 7), (300, 200)]
    rng.shuffle(links)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
