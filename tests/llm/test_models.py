"""Language-model scores and the quality ranking."""

import dataclasses
import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cadenza.llm import hmm, quality
from cadenza.llm.queries import crc_of, op3_hmm_scores, op6_quality
from pyspark.sql import functions as F
from samples import by_id, corpus, frame, lower, prose, split, unique_ids

SMALL = hmm.HmmParams(head=40, tail=8, states=3, warm=1, rounds=2, gain=-1.0, slices=4)
WARM = dataclasses.replace(SMALL, warm=3, warm_rounds=2)


def held(doc):
    return zlib.crc32(str(doc).encode()) % 7 == 2


def base(rows):
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*split(lower(t)), None])
    n, v, out = sum(counts.values()), len(counts), {}
    for d, t in rows:
        own = [*split(lower(t)), None]
        out[d] = (held(d), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    return out


def test_counts_and_base_scores_are_those_of_plain_counting(spark):
    rows = unique_ids(corpus(2)) + [(300 + i, "the same line of words") for i in range(30)]
    want = base(rows)
    got = hmm.hmm_scores(frame(spark, rows, extra=True).drop("held_out"), crc_of("doc_id", 7) == 2, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], abs=1e-6)
        assert r.score < 0 and math.isfinite(r.score)


def plainly_trained(seqs, totals, p):
    """Baum-Welch one sequence at a time, without scaling: rounds over the texts of the sample, then over all."""
    m, k = hmm.Hmm.first(totals, p), p.states
    some = [s for s in seqs if zlib.crc32(np.array(s, p.dtype).tobytes()) % p.warm == 0]
    for own in [some] * (p.warm_rounds if p.warm > 1 else 0) + [seqs] * p.rounds:
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((p.symbols, k))
        for s in own:
            alpha, beta = np.zeros((len(s), k)), np.ones((len(s), k))
            alpha[0] = m.start * m.emit[s[0]]
            for t in range(1, len(s)):
                alpha[t] = (alpha[t - 1] @ m.move) * m.emit[s[t]]
            for t in range(len(s) - 2, -1, -1):
                beta[t] = m.move @ (m.emit[s[t + 1]] * beta[t + 1])
            total = alpha[-1].sum()
            start += alpha[0] * beta[0] / total
            for t in range(len(s)):
                emit[s[t]] += alpha[t] * beta[t] / total
                if t:
                    move += np.outer(alpha[t - 1], m.emit[s[t]] * beta[t]) * m.move / total
        m = hmm.Hmm.of_counts(start, move, emit, p)
    return m


@pytest.mark.parametrize("p", [SMALL, WARM])
def test_scores_are_those_of_a_plainly_trained_model(spark, p):
    """The whole score again: counts, symbols, training and the product over moves, emissions and words."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{min(int(rng.exponential(12)), 99)}" for _ in range(rng.integers(1, 45)))) for i in range(60)] + [(60, None), (61, "w1 unheard w2")]
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*split(lower(t)), None])
    as_hash = lambda w: int(hmm.END.view(np.int64)) if w is None else int(hmm.tokens(pa.array([w]))[0][:1].view(np.int64)[0])
    hashes = {w: as_hash(w) for w in {*counts, *(w for _, t in rows for w in split(lower(t)))}}
    head = sorted(sorted(counts, key=lambda w: (-counts[w], hashes[w]))[: SMALL.head], key=hashes.get)
    symbol = {w: head.index(w) if w in head else SMALL.head + h % SMALL.tail for w, h in hashes.items()}
    totals, distinct = np.zeros(SMALL.symbols), np.zeros(SMALL.symbols)
    for w, c in counts.items():
        totals[symbol[w]] += c
        distinct[symbol[w]] += w not in head
    seqs = {d: [symbol[w] for w in [*split(lower(t)), None]] for d, t in rows}
    m = plainly_trained([s for d, s in seqs.items() if not held(d)], totals, p)
    got, narrow = ({r.doc_id: r.score for r in hmm.hmm_scores(frame(spark, rows), crc_of("doc_id", 7) == 2, x).collect()} for x in (p, dataclasses.replace(p, narrow=True)))
    for d, t in rows:
        s, alpha = seqs[d], None
        for x in s:
            alpha = (m.start if alpha is None else alpha @ m.move) * m.emit[x]
        words = sum(math.log10((counts[w] + 1) / (totals[symbol[w]] + distinct[symbol[w]] + 1)) for w in [*split(lower(t)), None] if w not in head)
        assert got[d] == pytest.approx(math.log10(alpha.sum()) + words, abs=1e-6)
        assert narrow[d] == pytest.approx(got[d], rel=1e-4)


def model(seed=0, symbols=7, states=3):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def empty_counts():
    return np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))


def test_the_forward_recursion_sums_over_all_paths():
    m, rng = model(), np.random.default_rng(4)
    seqs = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 5, 3, 5, 2)]
    like = m.run(seqs)
    for s, got in zip(seqs, like, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        assert got == pytest.approx(math.log(total))


def test_expected_counts_are_those_of_all_paths_and_do_not_depend_on_the_split():
    m, rng = model(1), np.random.default_rng(5)
    seqs = [rng.integers(0, 7, n).astype(np.uint16) for n in (4, 2, 5)]
    start, move, emit = empty_counts()
    for s in seqs:
        paths = list(itertools.product(range(3), repeat=len(s)))
        p = np.array([m.start[q[0]] * m.emit[s[0], q[0]] * math.prod(m.move[q[t - 1], q[t]] * m.emit[s[t], q[t]] for t in range(1, len(s))) for q in paths])
        for q, w in zip(paths, p / p.sum(), strict=True):
            start[q[0]] += w
            for t, k in enumerate(q):
                emit[s[t], k] += w
                if t:
                    move[q[t - 1], k] += w
    one = empty_counts()
    for s in seqs:
        m.run([s], one)
    for got, want in zip(one, (start, move, emit), strict=True):
        np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_change_neither_likelihoods_nor_counts(block):
    m, rng = model(2), np.random.default_rng(6)
    seqs = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 200, 64, 65, 3, 500)]
    whole, parts = empty_counts(), empty_counts()
    np.testing.assert_allclose(m.run(seqs, parts, block), m.run(seqs, whole, 1000))
    for got, want in zip(parts, whole, strict=True):
        np.testing.assert_allclose(got, want, atol=1e-7)


def test_a_very_long_sequence_stays_small():
    m, s = model(3), np.random.default_rng(7).integers(0, 7, 3_000_000).astype(np.uint16)
    tracemalloc.start()
    like = m.run([s], empty_counts())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(like).all() and most < 250 << 20


@pytest.mark.parametrize("least", [1e-3, 1e-12, 1e-90])
def test_small_probabilities_do_not_vanish_between_two_scalings(least):
    """Moves and emissions that are hardly possible, again in logarithms."""
    start, move, emit = np.full(2, 0.5), np.array([[1 - least, least], [least, 1 - least]]), np.array([[1.0, least], [least, 1.0], [1e-80, 1e-90]])
    m, s = hmm.Hmm(start, move, emit), np.array([0, 1, 1, 2, 0, 1, 2, 2, 1, 0] * 30, np.uint16)
    alpha = np.log(start) + np.log(emit[s[0]])
    for x in s[1:]:
        alpha = np.logaddexp.reduce(alpha[:, None] + np.log(move), axis=0) + np.log(emit[x])
    counts = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for block in (7, None):
        assert m.run([s], counts, block)[0] == pytest.approx(np.logaddexp.reduce(alpha))
    np.testing.assert_allclose(counts[2].sum(axis=1), 2 * np.bincount(s), rtol=1e-9)
    assert counts[1].sum() == pytest.approx(2 * (len(s) - 1))


def test_tasks_that_send_sums_follow_the_cores_and_not_the_files(spark):
    """A task's sums are one table of symbols x states however few texts it reads."""
    rng = np.random.default_rng(3)
    rows = [(bytearray(rng.integers(0, SMALL.symbols, 20).astype(SMALL.dtype).tobytes()),) for _ in range(200)]
    encoded, ran = spark.createDataFrame(rows, "symbols binary").repartition(64), spark.sparkContext.statusTracker()
    earlier = set(ran.getJobIdsForGroup())
    hmm._trained(encoded, hmm.Hmm.first(np.ones(SMALL.symbols), SMALL), SMALL, 1, -1.0)
    jobs = [ran.getJobInfo(j) for j in set(ran.getJobIdsForGroup()) - earlier]
    tasks = [ran.getStageInfo(i).numTasks for j in jobs for i in j.stageIds if ran.getStageInfo(i)]
    assert tasks and max(tasks) <= 2 * spark.sparkContext.defaultParallelism


def likelier(spark, rows, **params):
    got = hmm.hmm_scores(frame(spark, rows), crc_of("doc_id", 7) == 2, hmm.HmmParams(slices=4, **params)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    return got.s / got.b


def test_topics_and_word_order_are_learnt(spark):
    """Held-out texts whose topic changes now and then, and texts in which two kinds of words alternate, become likelier than under the base."""
    rng = np.random.default_rng(1)
    topics = [(i, " ".join(f"topic{(i + k // 20) % 2}word{rng.integers(40)}" for k in range(60))) for i in range(100)]
    turns = [(i, " ".join(f"kind{k % 2}word{rng.integers(40)}" for k in range(rng.integers(20, 60)))) for i in range(200)]
    assert likelier(spark, topics, head=512) < 0.93
    assert likelier(spark, turns, head=512) < 0.93


def test_held_out_documents_are_likelier_than_under_the_base(spark):
    got = op3_hmm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > 0.95 * got.b


def test_odd_tables_of_texts(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "some words"), (3, "some words")]
    got = hmm.hmm_scores(frame(spark, rows), F.col("doc_id") == 3, SMALL).collect()
    assert sorted((r.n_tokens, r.held_out) for r in got) == [(1, False), (1, False), (1, False), (3, False), (3, True)]
    assert hmm.hmm_scores(frame(spark, []), F.col("doc_id") == 3, SMALL).count() == 0


def test_quality_of_held_out_documents(spark, tables):
    scores = {r.doc_id: r for r in op6_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").dropna().collect()
    own = [(r.quality, scores[r.doc_id]) for r in labels if r.doc_id in scores and scores[r.doc_id].held_out]
    good, bad = ([s.score for q, s in own if q == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([s.predicted == q for q, s in own]) > 0.85
    assert all(0 <= s.score <= 1 and s.predicted == (s.score >= 0.3) and s.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, s in scores.items())


def test_quality_scores_are_those_of_a_plain_fit(spark):
    """The whole query again: labels chosen plainly, the logistic loss minimised by gradient steps, the cut looked up among sorted scores."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None and r.doc_id in docs}
    own = [(docs[d], q) for d, q in labels.items() if zlib.crc32(str(d).encode()) % 5]
    x, y = np.stack([quality.text_features(pa.array([t]))[0] for t, _ in own]), np.array([q for _, q in own])
    order = np.lexsort((*x.T, y))  # the order in which pairs are drawn
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, rng = (x - mean) / scale, np.random.default_rng(7)
    d = z[rng.choice(np.flatnonzero(y == 1), 40_000)] - z[rng.choice(np.flatnonzero(y == 0), 40_000)]
    w, speed = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(6000):  # gradient steps with momentum
        speed = 0.95 * speed + d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) / len(d) - 1e-3 * w
        w = w + 0.05 * speed
    s = np.sort(z @ w)
    bad, good = (z @ w)[y == 0], (z @ w)[y == 1]
    at = (len(bad) / len(s)) * (len(s) - 1)
    cut = (bad.max() + good.min()) / 2 if bad.max() < good.min() else s[int(at)] + (at - int(at)) * (s[int(at) + 1] - s[int(at)])
    high = np.median(good)
    for r in op6_quality(spark, sf).collect():
        v = 4 / max(1e-6, high - cut) * (((quality.text_features(pa.array([docs[r.doc_id]]))[0] - mean) / scale) @ w - cut)
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, v))) * 7 / 3), abs=0.02)


def test_features_depend_on_a_text_alone():
    texts = [t for _, t in corpus(3)]
    whole = quality.text_features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        np.testing.assert_array_equal(whole[i], quality.text_features(pa.array([t], pa.string()))[0])
    assert not whole[[i for i, t in enumerate(texts) if not t]].any()


def test_the_ranker_learns_pairs_and_puts_the_cut_at_the_quantile():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, len(quality.NAMES)))
    label = (x[:, 3] - 0.5 * x[:, 5] > -0.8).astype(int)
    r = quality.train_ranker(x, label)
    assert ((r.score(x) >= 0.3) == label).mean() > 0.95
    for only in (0, 1):
        assert ((quality.train_ranker(x, np.full(600, only)).score(x) >= 0.3) == only).all()
    assert np.isfinite(quality.train_ranker(x[:0], label[:0]).score(x)).all()


def test_odd_tables_of_labels(spark):
    rows = corpus(4) + [(None, "no id")]
    docs = frame(spark, rows, extra=True)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 1), (999, 0)], "doc_id long, quality int")
    ranker = quality.fit_quality(docs, labels)
    scores = quality.quality_scores(docs, ranker).collect()
    assert len(scores) == len(rows)
    kept = quality.keep_quality(docs, ranker)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in scores)
    none = quality.fit_quality(docs, labels.limit(0))
    assert {r.predicted for r in quality.quality_scores(docs, none).collect()} == {1}
    empty = quality.fit_quality(frame(spark, []), labels.limit(0))
    assert quality.quality_scores(frame(spark, []), empty).count() == 0
    same = by_id(quality.quality_scores(frame(spark, [(1, prose(__import__("random").Random(1), 30))] * 2), ranker), "score")
    assert same[0] == same[1]
