"""Symbols and punctuation from morphemes against a plain walk over them."""

import random

from pyspark.sql import functions as F

from cadenza.functions import morphemes as m
from cadenza.plans.flows import clean_by_language, clean_text


def inline(own):
    """Left to right, the most morphemes first."""
    table, out, i = {r: (s, kana, inside) for words, s, kana, inside in m.INLINE_SYMBOLS for r in words}, "", 0
    kana = lambda s: s != "" and all(c in "ー" or "ぁ" <= c <= "ん" or "ァ" <= c <= "ヶ" for c in s)
    while i < len(own):
        for k in (4, 3, 2, 1):
            run = own[i : i + k]
            hit = table.get("".join(r for _, r, _ in run)) if len(run) == k else None
            if hit and (not hit[1] or kana("".join(s for s, _, _ in run))):
                out, i = out + hit[0], i + k
                break
        else:
            word, at = own[i][0], 0
            if word and all(c == "ー" or "ァ" <= c <= "ヶ" for c in word):
                while at < len(word):
                    hit = next(((r, s) for words, s, _, inside in m.INLINE_SYMBOLS if inside for r in words if word.startswith(r, at) and word[at + len(r) : at + len(r) + 1] not in tuple("ーウゥ")), None)
                    out, at = (out + hit[1], at + len(hit[0])) if hit else (out + word[at], at + 1)
            else:
                out += word
            i += 1
    return out


def marked(own):
    """Marks between morphemes, looked up one after another."""
    parts = []
    for i, (s, _, pos) in enumerate(own):
        parts.append(s)
        if (s and s[-1] in m.TERMINALS) or s == "、" or i + 1 == len(own) or own[i + 1][0] in set(m.TERMINALS) | {"、"}:
            continue
        after = own[i + 1][0]
        two = after + (own[i + 2][0] if i + 2 < len(own) else "")
        begins = own[i + 1][2][0] in m.STARTER_POS or two in m.CONJUNCTION_PAIRS or after in m.CONJUNCTIONS
        if begins and ((pos[0] == "助動詞" and s in m.POLITE_ENDERS) or pos[:2] == ["助詞", "終助詞"]):
            parts.append("。")
        elif begins and pos[:2] == ["助詞", "接続助詞"] and s in m.JOIN_PARTICLES:
            parts.append("、")
        elif (pos[0] == "接続詞" or s in m.LEAD_CONNECTIVES) and (len(parts) < 2 or not parts[-2] or parts[-2][-1] in m.TERMINALS):
            parts.append("、")
    text, (s, _, pos) = "".join(parts), own[-1]
    if text and text[-1] not in m.TERMINALS + "、" and (s in m.END_ENDERS or pos[:2] == ["助詞", "終助詞"] or (pos[0] in ("動詞", "形容詞", "助動詞") and "終止形" in pos[5])):
        text += "。"
    return text


def cases(pool, seed, n=150):
    rng = random.Random(seed)
    return [[rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(n)]


def run(spark, function, rows):
    df = spark.createDataFrame([(i, "".join(s for s, _, _ in own) or "x", own) for i, own in enumerate(rows)], f"id int, text string, m {m.MORPHEMES}")
    return [r.x for r in df.select("id", function(F.col("text"), F.col("m")).alias("x")).orderBy("id").collect()]


def test_symbols_within(spark):
    none = [""] * 6
    pool = [(s, r, none) for s, r in [("鍵", "カギ"), ("カギ", "カギ"), ("かっこ", "カッコ"), ("括弧", "カッコ"), ("と", "ト"), ("じ", "ジ"), ("閉じ", "トジ"), ("し", "シ"), ("バージョンカッコトジ", "バージョンカッコトジ"), ("カギカッコー", "カギカッコー"), ("カギカッコトジウ", "カギカッコトジウ"), ("カギカッコ", "カギカッコ"), ("は", "ハ"), ("カッコウ", "カッコウ"), ("カギカッコトシカッコトジ", "x")]]
    rows = cases(pool, 1, 300)
    got = run(spark, m.with_inline_symbols, rows)
    assert got == [inline(own) for own in rows]
    assert any("」" in x for x in got) and any("（" in x for x in got)


def test_punctuation(spark):
    p = lambda *x: [*x, *[""] * (6 - len(x))]
    verb = ["動詞", "", "", "", "", "終止形-一般"]
    pool = [("です", "", p("助動詞")), ("ます", "", p("助動詞")), ("ね", "", p("助詞", "終助詞")), ("から", "", p("助詞", "接続助詞")), ("が", "", p("助詞", "格助詞")), ("今日", "", p("名詞")), ("晴れる", "", verb), ("で", "", p("助動詞")), ("も", "", p("助詞", "係助詞")), ("しかし", "", p("接続詞")), ("つまり", "", p("副詞")), ("。", "", p("補助記号")), ("、", "", p("補助記号")), ("（注）", "", p("名詞")), ("た", "", p("助動詞")), ("", "", p(""))]
    rows = [own for own in cases(pool, 2, 500) if "".join(s for s, _, _ in own)]
    got = run(spark, m.punctuated, rows)
    assert got == [marked(own) for own in rows]
    assert any("。しかし、" in x for x in got) and any("から、" in x for x in got)


def test_texts_without_morphemes_stay(spark):
    df = spark.createDataFrame([("かっこ", None), ("かっこ", []), (None, None)], f"text string, m {m.MORPHEMES}")
    assert [tuple(r) for r in df.select(m.with_inline_symbols(F.col("text"), F.col("m")), m.punctuated(F.col("text"), F.col("m"))).collect()] == [("かっこ", "かっこ"), ("かっこ", "かっこ"), (None, None)]


def test_cleaning_in_its_order(spark):
    """An analyser that cuts at each character: symbols within, then the dictionary, then punctuation."""
    cut = lambda t: F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.struct(c.alias("surface"), c.alias("reading"), F.array(F.lit("動詞"), *[F.lit("")] * 4, F.lit("終止形")).alias("pos")))
    df = spark.createDataFrame([("ＡＢ カッコ　る", "ja"), ("a  b　ｃ", "en"), ("", "ja")], "t string, l string")
    got = [tuple(r) for r in df.select(clean_text(F.col("t"), {"B": "びー"}, analyse=cut, inline=True, punctuate=True), clean_by_language(F.col("t"), F.col("l"), {"a": "x"})).collect()]
    assert got == [("Aびー（る。", "ABカッコる"), ("a b c。", "a b c"), ("", "")]
