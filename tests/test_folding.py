"""Folds of sessions that lie in many Arrow batches, against the same folds in one batch."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import commands, dictionary, segments
from cadenza.params import Joining, Paragraphs, Segmenting


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, before)


def test_batches_change_nothing(spark, small_batches):
    rng = random.Random(3)
    frames = [(s, i, rng.choice([0.0001, 0.02, 0.03]) if i // 40 % 3 else 0.0001, 512 if i < n - 1 else 100) for s, n in (("a", 1500), ("b", 1), (None, 300), ("c", 7)) for i in range(n)]
    rng.shuffle(frames)
    levels = spark.createDataFrame(frames, "session string, frame_no long, rms double, n int").repartition(5)
    texts = spark.createDataFrame([("t", i, rng.choice(["", "word " * 9, "終わり。", None]), rng.choice([None, 0.2, 1.5])) for i in range(400)], "session string, ord long, text string, pause double")
    ends = spark.createDataFrame([(s, i, i * 7 + rng.randrange(40)) for s in "ab" for i in range(300)], "session string, ord long, delivered_end long")
    shown = spark.createDataFrame([(s, float(i) / 7) for s in "ab" for i in range(300)], "session string, at double")
    log = spark.createDataFrame([("s", i, rng.choice(["insert", "cancel", "restore", "replace", "trim"]), rng.choice(["ab", "b ", "c"]), "x") for i in range(300)], "session string, ord int, op string, text string, into string")
    p, j = Segmenting(silence=0.16, longest=3.0, shortest=0.1, pad=0.06), Joining(2.0, 6.0, 2.0)
    adaptive = Segmenting(silence=0.16, longest=3.0, shortest=0.1, pad=0.06, adaptive=True)
    folds = {
        "segments": lambda: segments.segments(levels, p), "adaptive": lambda: segments.segments(levels, adaptive), "joined": lambda: segments.joined(segments.segments(levels, p), j), "replayed": lambda: segments.replayed(levels, p, j),
        "paragraphs": lambda: segments.paragraphs(texts, Paragraphs(60, 0.7, 150)), "refinements": lambda: segments.refinements(ends, 200, 50), "floor": lambda: segments.noise_floor(levels),
        "throttled": lambda: segments.throttled(shown, "session", "at", 1.0), "edited": lambda: commands.edited(log),
    }
    for name, fold in folds.items():
        small_batches(10_000)
        want = sorted(map(repr, fold().collect()))
        small_batches(37)
        assert sorted(map(repr, fold().collect())) == want and want, name


def test_a_prompt_takes_the_first_items_output_though_the_preferred_words_are_many(spark):
    words = spark.createDataFrame([(f"p{i}", i) for i in range(3)], "word string, place int")
    items = spark.createDataFrame([("key1", "out1", 1), ("key2", "out2", 2)], "observed string, output string, place int")
    made = lambda limit, preferred=words, own=items: dictionary.prompt(preferred, own, limit, 90).first()[0]
    assert made(3) == made(2) == "p0 p1 p2 out1" and made(5) == "p0 p1 p2 out1 key1"
    known = items.where("place = 2").union(spark.createDataFrame([("key1", "p1", 1)], "observed string, output string, place int"))
    assert made(3, own=known) == "p0 p1 p2" and made(4, own=known) == "p0 p1 p2 key1"
    assert made(3, own=items.withColumn("output", F.lit("x"))) == "p0 p1 p2"
