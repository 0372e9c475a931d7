"""Joins against plain searches."""

import bisect
import random
import time

from pyspark.sql import functions as F

from cadenza.operators import joins


def test_as_of_is_a_search_in_a_sorted_list(spark):
    rng = random.Random(1)
    right = [(k, rng.randint(0, 60) * 1.0, rng.choice(["a", "b", None])) for k in (1, 2, 3) for _ in range(30)]
    right = list({(k, at): (k, at, v) for k, at, v in right}.values())
    left = [(n, rng.randint(1, 4), rng.choice([None, rng.randint(-5, 70) * 1.0])) for n in range(200)]
    got = joins.as_of(spark.createDataFrame(left, "n int, k int, p double"), spark.createDataFrame(right, "k int, at double, v string"), "k", "p", "at", "v")
    assert got.columns == ["n", "k", "p", "v"]
    for r in got.collect():
        own = sorted((at, v) for k, at, v in right if k == r.k) if r.k < 4 else []
        want = own[max(0, bisect.bisect_right([at for at, _ in own], r.p if r.p is not None else -1e9) - 1)][1] if own else None
        assert r.v == want


def test_as_of_takes_the_last_row_even_if_it_holds_null(spark):
    right = spark.createDataFrame([("s", 1, "old"), ("s", 4, None)], "k string, at int, v string")
    left = spark.createDataFrame([("s", 5), ("s", 2), ("s", 0), ("t", 1)], "k string, p int")
    assert {(r.k, r.p): r.v for r in joins.as_of(left, right, "k", "p", "at", "v").collect()} == {("s", 5): None, ("s", 2): "old", ("s", 0): "old", ("t", 1): None}


def test_as_of_of_one_key_is_linear(spark):
    rows = spark.range(300_000).select(F.lit("s").alias("k"), F.col("id").alias("p"))
    began = time.perf_counter()
    got = joins.as_of(rows, rows.select("k", (F.col("p") + 10).alias("at"), F.col("p").alias("v")), "k", "p", "at", "v")
    assert got.where(F.col("v") == F.greatest(F.col("p") - 10, F.lit(0))).count() == 300_000
    assert time.perf_counter() - began < 60


def test_keywords_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL", 7)
    words = spark.createDataFrame([(f"K{i}z",) for i in range(40)] + [(None,)], "word string")
    rows = spark.createDataFrame([(i, f"x k{i}Z y") for i in range(60)] + [(99, None)], "id int, text string")
    assert sorted(r.id for r in joins.with_keyword(rows, words).collect()) == list(range(40))
    assert joins.with_keyword(rows, words.limit(0)).count() == 0
