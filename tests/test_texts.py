"""Golden cases of the text, alignment and source functions."""

import difflib
import re
import time
import unicodedata
import wave
from io import BytesIO

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions import align, guards, signal, text
from cadenza.operators import commands, dictionary, reconvert
from cadenza.plans.flows import clean_text
from cadenza.queries import texts
from cadenza.sources import files, pcm, recordings


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_clean_text(spark):
    cases = {"今日は Python を書く": "今日はPythonを書く", "New York に行く": "New Yorkに行く", "Ａトックを使う": "ATOKを使う", "はい。。そうです": "はい。そうです"}
    for raw, want in cases.items():
        assert one(spark, clean_text(F.col("t"), {"Aトック": "ATOK"}), t=raw) == want
    assert one(spark, clean_text(F.col("t"), symbols=True), t="これはテストです まる") == "これはテストです。"
    assert one(spark, clean_text(F.col("t"), symbols=True), t="かっこ") == "（"
    assert one(spark, clean_text(F.col("t")), t="") == ""


def test_safety(spark):
    f = lambda a, b: one(spark, align.refinement_safety(F.col("a"), F.col("b")), a=a, b=b)
    base = "本日はお忙しい中お集まりいただきありがとうございます。これより説明会を始めます。"
    assert f(base, base).safe
    assert f(base, base[:15]).reason == "too-short"
    assert f("", "x").safe
    assert align.common_length("abcbdab", "bdcaba") == 4 and align.common_length("", "a") == 0


def test_paragraph_transplant(spark):
    f = lambda new, old: one(spark, align.with_paragraphs_of(F.col("new"), F.col("old")), new=new, old=old)
    assert f("あいう。えおか。", "あいう。\n\nえおか。") == "あいう。\n\nえおか。"
    assert f("あいうえおか", "あいう\n\nえおか") == "あいうえおか"
    assert f("abc", "abc") == "abc"
    assert f("ab、cd、ef", "xx\n\nyy") == "ab、\n\ncd、ef"
    assert f("あ。い。う。え。お", "あああ\n\nいいい\r\n\r\nううう") == "あ。\n\nい。う。\n\nえ。お"
    assert f("あい。うえ", "\n\nあい\n\n") == "\n\nあい。うえ\n\n"
    assert f("a\nb", "abc") == "a\nb" and f("", "a\n\nb") == ""


def test_differences(spark):
    kinds = lambda a, b, **p: [h.kind for h in one(spark, align.differences(F.col("a"), F.col("b"), **p), a=a, b=b)]
    assert kinds("移動した", "異動した") == ["相違"]
    assert kinds("これは余分な話です。おわり", "これは話です。おわり") == ["余分"]
    assert kinds("これは話です", "これは大切な話です") == ["脱落"]
    assert kinds("", "") == [] and kinds("同じ。", "同じ") == []
    # eight equal characters between two differences join them, nine part them
    assert kinds("Xabcdefgh1", "Yabcdefgh2") == ["相違"] and kinds("Xabcdefghi1", "Yabcdefghi2") == ["相違", "相違"]
    assert kinds("abcX", "abc") == [] and kinds("abcX", "abc", least=1) == ["余分"]
    (h,) = one(spark, align.differences(F.col("a"), F.col("b"), context=3), a="前の文、 Ａ BCの 後ろ", b="前の文。後ろ")
    assert (h.kind, h.live, h.ref, h.ref_pos, h.live_left, h.live_right) == ("余分", "Ａ BCの", "", 4, "前の文", "後ろ")
    (h,) = one(spark, align.differences(F.col("a"), F.col("b"), context=4), a="ab\ncd", b="ab\ncdxyz")
    assert (h.kind, h.ref, h.ref_pos, h.ref_left, h.ref_right) == ("脱落", "xyz", 5, "ab cd"[-5:], "")


def test_prefix_and_repeats(spark):
    r = one(spark, align.aligned_prefix(F.col("a"), F.col("b")), a="あいうえおかきくけこさしすせそ" * 1 + "たちつてとなにぬねの" * 3, b="あいうえおかきくけこさしすせそ")
    assert r.status == "cut" and r.text == "あいうえおかきくけこさしすせそ"
    status = lambda a, b: one(spark, align.aligned_prefix(F.col("a"), F.col("b")), a=a, b=b).status
    assert (status("", "abc"), status("abc", "abd"), status("あいうえおかきくけこ" * 3, "x" * 12)) == ("empty", "whole", "lost")
    found = one(spark, align.repeats_in()(F.col("t")), t="比べると比べると良い")
    assert [(x.pos, x.unit) for x in found] == [(0, "比べると")]


def test_readings(spark):
    df = spark.createDataFrame([("ては",), ("へんか",), ("かこ",)], "reading string")
    got = {}
    for r in reconvert.variants(df, 50).collect():
        got.setdefault(r.reading, set()).add(r.variant)
    assert {"では", "てば", "てぱ"} <= got["ては"] and "てっは" not in got["ては"]
    assert "へんかん" in got["へんか"] and "へっんか" not in got["へんか"] and "かっこ" in got["かこ"]
    known = spark.createDataFrame([("ては", "手は")], "reading string, candidate string")
    table = spark.createDataFrame([("では", 0, "出は"), ("てはん", 0, "てはん"), ("てんは", 0, "転派")], "reading string, ord int, candidate string")
    out = [r.candidate for r in reconvert.variant_candidates(reconvert.variants(df.where("reading = 'ては'"), 50), table, known, 8).collect()]
    assert {"では", "出は", "転派"} <= set(out) and "てはん" not in out and "手は" not in out
    assert len(reconvert.variant_candidates(reconvert.variants(df, 50), table, known, 3).where("reading = 'ては'").collect()) == 3


def test_surfaces(spark):
    df = spark.createDataFrame([("住信", [["墨", "隅"], ["信", "新"]], "隅新と墨信")], "t string, s array<array<string>>, body string")
    r = df.select(reconvert.surfaces(F.col("t"), F.col("s")).alias("o"), "body", "s").select("o", reconvert.last_surface(F.col("body"), F.col("o")).alias("l"), reconvert.preselected(F.lit("隅新だ"), F.col("s")).alias("p")).first()
    assert r.o == ["住信", "墨信", "墨新", "隅信", "隅新"] and (r.l["at"], r.l.surface) == (3, "墨信") and r.p == ["隅", "新"]


def test_edits(spark):
    f = lambda t, s, e, n: one(spark, commands.replaced_at(F.col("t"), F.col("s"), F.col("e"), F.col("n")), t=t, s=s, e=e, n=n)
    assert f("abcabc", 0, "abc", "x") == "xabc" and f("abcabc", 1, "abc", "x") == "abcx" and f("abc", 0, "zz", "x") == "abc"
    assert one(spark, commands.occurrences_backwards(F.col("t"), F.col("p")), t="a.b.a.b", p="a.") == [4, 0]
    assert one(spark, commands.classified_in_dialog(F.col("t")), t="サンバー")["index"] == 3
    assert one(spark, commands.classified_in_dialog(F.col("t")), t="カクテイ").kind == "confirm"


def test_pcm(spark):
    data = np.array([[32767, 32767], [32767, -32768], [-16384, -16384]], "<i2").tobytes() + b"\1"
    assert np.allclose(pcm.decoded(data, 2), [32767 / 32768, -0.5 / 32768, -0.5])
    x = np.sin(np.arange(48000) / 50)
    r = pcm.Resampler(48000)
    parts = [r.push(x[i : i + 777], i + 777 >= len(x)) for i in range(0, len(x), 777)]
    whole = pcm.Resampler(48000).push(x, True)
    assert abs(sum(map(len, parts)) - 16000) <= 1 and np.allclose(np.concatenate(parts), whole, atol=1e-5)
    df = spark.createDataFrame([("s", 0, [0.5] * 300), ("s", 300, [0.5] * 724)], "session string, pos long, samples array<float>")
    assert [(f.frame_no, f.n, round(f.rms, 6)) for f in pcm.framed(df).orderBy("frame_no").collect()] == [(0, 512, 0.5), (1, 512, 0.5)]


def test_evidence(spark):
    def of(values):
        df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "session string, pos long, x double")
        return signal.evidence(signal.frames(df)).first()

    assert 0.09 <= of([0.0] * 8000 * 9 + [0.004] * 8000).active_ratio <= 0.11
    click = of([0.5] * 100)
    assert click.peak == 0.5 and click.active_ratio == 1.0
    assert signal.fixed_floor(0.5) == 0.016


def test_recordings(spark, tmp_path):
    rec = spark.createDataFrame([("20260101-000000", i * 1600, np.full(1600, i, "<i2").tobytes()) for i in range(10)], "session string, pos long, data binary")
    recordings.append(rec, str(tmp_path / "rec"))
    back = recordings.load(spark, str(tmp_path / "rec"))
    got = b"".join(bytes(r.data) for r in recordings.load_slice(back, "20260101-000000", 0.05, 0.25).collect())
    assert np.frombuffer(got, "<i2").tolist() == [0] * 800 + [1] * 1600 + [2] * 800
    assert recordings.load_slice(back, "20260101-000000", 0.5, 0.5).count() == 0
    assert recordings.durations(back).first().seconds == 1.0
    clip = recordings.clips(spark.createDataFrame([("20260101-000000", 0.2)], "session string, at_sec double"), back, 0.1, 0.1).first()
    assert wave.open(BytesIO(bytes(clip.wav))).getnframes() == 4800
    (tmp_path / "wav").mkdir()
    (tmp_path / "wav" / "a.wav").write_bytes(bytes(clip.wav))
    (tmp_path / "wav" / "b.wav").write_bytes(b"x" * 32044)
    assert [(r.session, round(r.seconds, 3)) for r in recordings.catalog(spark, str(tmp_path / "wav")).collect()] == [("b", 1.0), ("a", 0.3)]


def test_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('{\n "schemaVersion": 1, // version\n "id": "common",\n "entries": [{"observed": "A", "output": "B",}],\n "symbols": {"x": "y"}\n "hotwords": ["h"]\n}')
    t = files.profile_tables(files.read_json(spark, str(tmp_path / "p.json")))
    assert t["entries"].first().output == "B" and t["symbols"].first().output == "y" and t["words"].first().word == "h"
    df = spark.createDataFrame([(1, 0.5, "a\tb\nc"), (2, None, "")], "n int, x double, t string")
    files.write_tsv(df.coalesce(1), str(tmp_path / "tsv"))
    back = files.read_tsv(spark, str(tmp_path / "tsv"), "n int, x double, t string").orderBy("n").collect()
    assert (back[0].x, back[0].t, back[1].x) == (0.5, "a b c", None)
    made = []
    for _ in range(2):
        files.reused(lambda: made.append(1) or df, spark, str(tmp_path / "cache"))
    assert made == [1]


def test_unicode_stripping(spark):
    assert one(spark, text.stripped(F.col("t")), t="　 あ　") == "あ"
    assert one(spark, guards.is_boilerplate(F.col("t")), t="ご視聴ありがとうございました\nx") is False


def test_blocks_and_edits_are_those_of_plain_search():
    rng = np.random.default_rng(3)

    def plain(a, b):
        d = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
        return d[-1, -1]

    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc𠮷"), rng.integers(30))) for _ in range(2))
        assert align._edits(list(a), list(b)) == plain(a, b)
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        for cells in (0, 1 << 20):
            own = align.Matcher(a, b, cells)
            assert own.get_opcodes() == m.get_opcodes() and own.ratio() == m.ratio()


def test_comparisons_see_what_lies_behind_character_600(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(300)) + " the king"
    spark.createDataFrame([(1, 0, long)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {n: texts.QUERIES[n](spark, str(tmp_path)).collect() for n in ("text_differences", "text_match_ratio", "word_errors", "safe_refinements")}
    assert len(got["text_differences"]) == 1 and got["text_differences"][0].ref_pos > 600
    assert 0.99 < got["text_match_ratio"][0].ratio < 1
    assert got["word_errors"][0].wer == 2 / 302
    assert got["safe_refinements"][0].safe
    lost = "".join(chr(0x4E00 + i) for i in range(1500))
    r = spark.createDataFrame([(lost, lost[:1300] + "x" * 200)], "a string, b string").select(align.refinement_safety(F.col("a"), F.col("b")).alias("s")).first().s
    assert r.reason == "trailing-content-lost"


def test_edit_distances_see_whole_names(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 30, "a" * 20 + "b" * 10)], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert texts.QUERIES["edit_distances"](spark, str(tmp_path)).first().distance == 10


def test_reloading_keeps_the_last_good_state(spark, tmp_path):
    file, loads = tmp_path / "p.json", []

    def load():
        loads.append(file.read_text())
        if loads[-1] == "broken":
            raise ValueError("broken")
        return loads[-1]

    kept = files.Reloading(spark, (str(tmp_path / "*.json"),), load, "default")
    assert kept.get() == "default" and kept.error  # nothing there yet
    file.write_text("one")
    assert kept.get() == "one" and kept.get() == "one" and loads == ["one"] and kept.error is None
    file.write_text("broken")
    assert kept.get() == "one" and "broken" in kept.error and kept.get() == "one" and len(loads) == 2
    file.write_text("other")
    assert kept.get() == "other" and kept.error is None


def test_symbols_are_appended_by_revision(spark):
    symbols = spark.createDataFrame([("a", 0, "まる", "。"), ("a", 1, "てん", "、")], "profile string, ord int, symbol string, output string")
    rows = [("a", "悪", "。", "r1"), ("a", " まる ", "。", "r1"), ("a", "まる", ".", None), ("a", "x", "y", "r0"), ("a", " ", "y", "r1"), ("b", "x", "y", None)]
    requests = spark.createDataFrame(rows, "profile string, observed string, output string, revision string")
    revisions = spark.createDataFrame([("a", "r1")], "profile string, revision string")
    got = sorted((r.observed, r.status) for r in dictionary.appended_symbols(symbols, requests, revisions).collect())
    assert got == sorted([("悪", "created"), ("まる", "exists"), ("まる", "conflict"), ("x", "conflict"), ("", "invalid"), ("x", "conflict")])
    after = dictionary.with_symbols(symbols, requests, revisions).orderBy("ord").collect()
    assert [(r.ord, r.symbol, r.output) for r in after] == [(0, "まる", "。"), (1, "てん", "、"), (2, "悪", "。")]


def test_repeats_are_those_of_a_pattern():
    rng = np.random.default_rng(5)
    for least, most in ((4, 40), (2, 7), (1, 300)):
        for letters in ("ab", "abc𠮷", "a"):
            for size in (0, 1, 5, 40, 900):
                t = "".join(rng.choice(list(letters), size))
                want = [(m.start(), len(m[1])) for m in re.compile(rf"(?s)(.{{{least},{most}}})\1").finditer(t)]
                assert align.doubled(np.array([ord(c) for c in t], np.uint32), least, most) == want


def test_comparable_texts_are_those_of_single_characters():
    t = "".join(map(chr, [*range(0x3000), *range(0xD7FF, 0xE001), *range(0xF900, 0x10400)])) + "㍿½İ…ﷺ。 Ａ"
    pairs = [(c.lower(), i) for i, ch in enumerate(t) for c in unicodedata.normalize("NFKC", ch) if not c.isspace() and c not in text.UNCOMPARED]
    assert text.comparable_text(t) == ("".join(c for c, _ in pairs), [i for c, i in pairs for _ in c])
    assert text.comparable_text("") == ("", [])


def test_repeats_take_a_small_time_for_each_character(spark):
    words = np.random.default_rng(2).choice(["the", "an", "tion", "er", "Ing", "é", " ", ". "], (150, 10_000))
    rows = spark.createDataFrame([(i, "".join(w)) for i, w in enumerate(words)], "id int, t string").repartition(4).cache()
    assert rows.count() == 150
    began = time.time()
    assert rows.select(F.explode(align.repeats_in()(F.col("t")))).count() > 0
    assert time.time() - began < 3


def test_a_refinement_is_judged_in_one_python_function(spark):
    df = spark.createDataFrame([("Ａb c。　ｶﾞd\u2003\x1c\x85 x" * 9, "x"), (None, ""), ("short one", None)], "a string, b string")
    judged = df.select(align.refinement_safety(F.col("a"), F.col("b")).alias("s"))
    assert judged._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r.s) for r in judged.collect()] == [(False, "too-short"), (True, None), (False, "too-short")]
    assert [text.client_text(r.a or "") for r in df.collect()] == [r.x or "" for r in df.select(text.comparable_by_client(F.col("a")).alias("x")).collect()]
