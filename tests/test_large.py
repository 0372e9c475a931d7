"""Long dictionaries, rings, ranges and phrase tables against plain searches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cadenza.operators import dictionary, joins, keywords, reconvert


def plain_replace(text, table):
    pattern = re.compile("|".join(re.escape(k) for k in sorted(table, key=lambda k: -len(k))))
    return text if text is None else pattern.sub(lambda m: table[m[0]], text)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_replacing_is_leftmost_longest(spark, block):
    rng = random.Random(3)
    table = {"".join(rng.choice("abc東") for _ in range(rng.randint(1, 5))): rng.choice(["", "X", "abc", "<東>"]) for _ in range(60)} | {"a.": "dot", "$": "\\1"}
    texts = ["".join(rng.choice("abcd東 .$😀") for _ in range(rng.randint(0, 80))) for _ in range(60)] + ["", "abcabcabc"]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "id int, text string").selectExpr("*", "'x' as value", "1 as __held")
    words = spark.createDataFrame([*table.items(), (None, "n"), ("", "e")], "observed string, output string")
    out = keywords.with_replaced(rows, words, block=block)
    assert out.columns == ["id", "value", "__held", "text"]
    assert {r.id: r.text for r in out.collect()} == {i: plain_replace(t, table) for i, t in [*enumerate(texts), (99, None)]}


def test_replacing_without_keys(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    none = spark.createDataFrame([], "observed string, output string")
    assert {r.id: r.made for r in keywords.with_replaced(rows, none, into="made").collect()} == {1: "abc", 2: None}
    some = spark.createDataFrame([("b", None), ("c", "1"), ("c", "2")], "observed string, output string")
    assert {r.id: r.text for r in keywords.with_replaced(rows, some).collect()} == {1: "a2", 2: None}


def test_a_list_of_keywords_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL", 7)
    rows = spark.createDataFrame([(i, f"x k{i}Z y") for i in range(60)] + [(99, None), (98, "")], "id int, text string")
    words = spark.createDataFrame([(f"K{i}z",) for i in range(40)] + [(None,)], "word string")
    own = words.where("word is not null").selectExpr("lower(word) as word")
    low = rows.withColumn("t", F.lower("text"))
    assert sorted(r.id for r in keywords.with_any(low, own, "t", block=40).collect()) == sorted(r.id for r in joins.with_keyword(rows, words).collect()) == list(range(40))
    assert joins.with_keyword(rows, words.union(spark.createDataFrame([("",)], "word string"))).count() == 61


def plain_cycles(table):
    cyclic = set()
    for origin in table:
        seen, at = {}, origin
        while at in table and at not in seen:
            seen[at] = len(seen)
            at = table[at]
        if at in seen:
            cyclic |= {k for k, n in seen.items() if n >= seen[at]}
    return cyclic


def test_cycles_of_any_length(spark):
    rng = random.Random(2)
    ring = lambda n, at: {f"{at}{i}": f"{at}{(i + 1) % n}" for i in range(n)}
    shapes = [ring(70, "a") | ring(120, "b") | {"p": "q", "s": "s"} | {f"t{i}": f"t{i + 1}" for i in range(300)} | {"t300": "a0"}, {str(i): str(rng.randrange(400)) for i in range(0, 400, 1)}, {"x": "y"}, {}]
    for table in shapes:
        rows = [*table.items(), (None, "p"), ("nowhere", None)]
        got = [r.observed for r in dictionary.cycle_members(spark.createDataFrame(rows, "observed string, output string")).collect()]
        assert sorted(got) == sorted(plain_cycles(table))


def test_twenty_thousand_keys_into_one_ring(spark):
    rows = [(f"k{i}", f"k{i + 1}") for i in range(20_000)] + [("k20000", "k19999")]
    got = {r.observed for r in dictionary.cycle_members(spark.createDataFrame(rows, "observed string, output string")).collect()}
    assert got == {"k19999", "k20000"}


def test_ranges_of_any_length(spark):
    rng = random.Random(4)
    make = lambda: [(i, rng.choice("st"), a, a + rng.choice([0.0, 0.5, 30.0, 31.0, 1e4, 3e9, -5.0])) for i in range(120) for a in [rng.choice([-1e6, 0.0, 30.0, rng.uniform(-100, 5e4)])]]
    left, right = [*make(), (500, "s", None, 5.0), (501, None, 0.0, 5.0), (502, "s", 0.0, float("inf")), (503, "s", float("nan"), 1.0)], [*make(), (600, "s", 5.0, None)]
    a, b = spark.createDataFrame(left, "i int, k string, start double, end double"), spark.createDataFrame(right, "j int, k string, r_start double, r_end double")
    for slack in (0.0, 0.6):
        got = sorted((r.i, r.j) for r in joins.overlaps(a, b, "k", cell=30.0, slack=slack).collect())
        ok = lambda s, e: s is not None and e is not None and s <= e < float("inf")
        want = sorted((x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and ok(x[2], x[3]) and ok(y[2], y[3]) and min(x[3], y[3]) - max(x[2], y[2]) > slack)
        assert got == want
    assert joins.overlaps(a.limit(0), b, "k").count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("indexed", [3, 1])
def test_phrases_of_a_long_list(spark, monkeypatch, indexed):
    monkeypatch.setattr(joins, "SMALL", 20)
    monkeypatch.setattr(joins, "INDEXED", indexed)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abあ") for _ in range(rng.randint(0, 7)))
    phrases = [(i, word()) for i in range(90)] + [(500, None)]
    keys = [(i, word()) for i in range(80)] + [(900, None), (901, "")]
    table = spark.createDataFrame(phrases, "ord int, reading string")
    out = joins.nearest(spark.createDataFrame(keys, "id int, word string"), F.col("word"), table, lambda n: F.when(n <= 4, 1).otherwise(2))
    got = {r.id: None if r.match is None else (r.match.distance, r.match.e.ord) for r in out.collect()}
    want = {}
    for i, k in keys:
        near = [] if k is None else [(d, o) for o, p in phrases if p is not None and (d := plain_distance(k, p)) <= (1 if len(p) <= 4 else 2)]
        want[i] = min(near, default=None)
    assert got == want


ECHOES = ["を再変", "を修正", "を変換", "を言い直", "を訂正"]


def plain_last(text, options, window, before, anchor):
    def search(a, z, skip):
        win, best = text[a:z], None
        for s in options:
            if s:
                at = win.rfind(s)
                while skip and at >= 0 and any(win[at + len(s) :].startswith(e) for e in ECHOES):
                    at = -1 if at == 0 else win.rfind(s, 0, at - 1 + len(s))
                if at >= 0 and (best is None or a + at > best[0]):
                    best = (a + at, s)
        return best

    end = max(0, min(before, len(text)))
    stop = min(anchor, len(text))
    return search(max(0, stop - window), max(max(0, stop - window), min(stop, end)), True) or search(0, end, True) or search(0, end, False) or (None, None)


def test_searching_backwards_skips_what_a_command_says(spark):
    rng = random.Random(8)
    bits = ["あ", "ああ", "い", "を修正", "を再変換", "を言い直し", "。", "\\E", "😀", "を"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        rows.append((i, text, [rng.choice(["あ", "い", "ああ", "😀", "\\E", "。", "", "あい"]) for _ in range(rng.randint(1, 3))], rng.randint(0, 20), rng.randint(-2, 30), rng.randint(0, 30)))
    rows += [(900, "スミシンの件。スミシンを再変", ["スミシン"], 2000, 99, 99), (901, "スミシンを再変", ["スミシン"], 2000, 99, 99)]
    df = spark.createDataFrame([*rows, (999, None, ["a"], 1, 1, 1)], "id int, t string, o array<string>, w int, b int, a int")
    got = {r.id: (r.r["at"], r.r.surface) for r in df.select("id", reconvert.last_surface(F.col("t"), F.col("o"), F.col("w"), F.col("b"), F.col("a")).alias("r")).collect()}
    assert got.pop(999) == (None, None)
    assert got == {i: plain_last(t, o, w, b, a) for i, t, o, w, b, a in rows}
    assert got[900] == (0, "スミシン") and got[901] == (0, "スミシン")


def test_a_target_is_sought_as_said_then_by_its_surfaces(spark):
    df = spark.createDataFrame([(1, "隅新と墨信と住信", "住信"), (2, "隅新と墨信と", "住信"), (3, "何も", "住信"), (4, "住信と墨信。住信を訂正", "住信")], "id int, t string, said string")
    parts = F.array(F.array(F.lit("墨"), F.lit("隅")), F.array(F.lit("信"), F.lit("新")))
    got = {r.id: (r.r["at"], r.r.surface) for r in df.select("id", reconvert.last_target(F.col("t"), F.col("said"), parts).alias("r")).collect()}
    assert got == {1: (6, "住信"), 2: (3, "墨信"), 3: (None, None), 4: (0, "住信")}


def test_a_search_without_hits_reads_a_long_text_a_few_times_only(spark):
    """Eight surfaces that occur nowhere, over 60 million characters: before, reversed texts were searched by patterns, several times each."""
    rows = spark.range(2000).select("id", F.expr("concat(repeat('ab ', 10000), 'abを修正')").alias("t"))
    began = time.time()
    found = rows.select(reconvert.last_surface(F.col("t"), F.array(*map(F.lit, ("zq", "qz", "za", "bz", "bb", "ba", "aa", "b  ")))).alias("r")).select("r.at", "r.surface").where("at is not null").count()
    last = rows.where("id < 5").select(reconvert.last_surface(F.col("t"), F.array(F.lit("ab"))).alias("r")).first().r
    assert found == 0 and last["at"] == 29_997
    assert time.time() - began < 12


def test_a_worker_holds_one_bounded_part_of_the_keys(spark, monkeypatch):
    monkeypatch.setattr(keywords, "PART_BYTES", 300)
    rng = random.Random(9)
    table = {"".join(rng.choice("abc東") for _ in range(rng.randint(1, 6))): f"<{i}>" for i in range(150)}
    texts = ["".join(rng.choice("abcd東 ") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    sent = [b for b, _ in keywords._blocks(spark.createDataFrame([*table.items()], "key string, value string"), 1 << 20)]
    assert len(sent) == 1 and len(sent[0].value) > 3 and sum(len(keywords._rows(p)) for p in sent[0].value) == len(table)
    assert max(keywords._rows(p).num_rows for p in sent[0].value) < len(table) / 2
    rows = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    out = keywords.with_replaced(rows, spark.createDataFrame([*table.items()], "observed string, output string"))
    assert {r.id: r.text for r in out.collect()} == {i: plain_replace(t, table) for i, t in enumerate(texts)}
    words = spark.createDataFrame([(k,) for k in table if len(k) > 3], "word string")
    assert {r.id for r in keywords.with_any(rows, words, "text").collect()} == {i for i, t in enumerate(texts) if any(k in t for k in table if len(k) > 3)}
