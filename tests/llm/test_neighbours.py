"""Approximate neighbours against all distances."""

import numpy as np
import pytest
from cadenza.llm import neighbours as nn
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    """{query: [(distance, id)]} over all valid rows; of several vectors under one id the smallest."""
    valid = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            valid[i] = min(valid.get(i, v), v)
    dim = max((len(v) for v in valid.values()), default=0)
    ids = np.array(sorted(valid))
    x = np.array([np.r_[np.float32(valid[i]), np.zeros(dim - len(valid[i]))] for i in ids], float)
    out = {}
    for q in queries:
        if q in valid:
            at = int(np.searchsorted(ids, q))
            d = np.sqrt(((x - x[at]) ** 2).sum(1))
            order = [i for i in np.lexsort((ids, d)) if i != at][:k]
            out[q] = [(float(d[i]), int(ids[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, rows):
    plain = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame(plain, SCHEMA).repartition(3).selectExpr("*", "'x' as u", "1 as ids", "null as code", "2 as q", "'y' as score", "0 as id", "1 as vec")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 24)) * 2
    x = (centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(nn.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0)), brute(rows, range(0, 3000, 100), 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    dists = {(q, i): d for q, near in brute(rows, want, 2999).items() for d, i in near}
    for q, near in got.items():
        assert near == sorted(near)
        assert all(abs(d - dists[q, i]) < 1e-9 for d, i in near)


def test_copies_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    hot, other = [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]
    rows = [(i, hot) for i in range(0, 900, 3)] + [(i, other) for i in range(1, 40, 3)] + [(i, rng.standard_normal(3).astype(np.float32).tolist()) for i in range(2, 240, 3)]
    rows += [(5000, None), (5100, []), (5200, [0.0, 0.0, 0.0]), (5300, [1.0, None, 2.0]), (5400, [float("nan"), 1.0, 1.0]), (5500, [float("inf"), 1.0, 1.0]), (None, hot), (300, hot), (5600, [4.0]), (5601, [-1e30, 1e30, 5.0]), (5700, [1e30, 1e30, 1.0]), (600, [9.0, 9.0, 9.0])]
    queries = range(0, 6000, 100)
    got = found(nn.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0))
    want = brute(rows, queries, 10)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]])


@pytest.mark.parametrize("n", [0, 1, 7])
def test_small_tables(spark, n):
    rows = [(100 * i, [1.0, float(i)]) for i in range(n)]
    got = found(nn.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in brute(rows, range(0, 100 * n, 100), 10).items() if v}


def test_a_node_with_very_many_links_meets_in_blocks(spark):
    """One vector in the middle of all others is near to everything."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 40))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(0, (x.mean(0) + 1e-4).tolist())]
    got, want = found(nn.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0)), brute(rows, range(0, 1501, 100), 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
