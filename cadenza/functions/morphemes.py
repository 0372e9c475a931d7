"""Symbols and punctuation from a text's morphemes, which an analyser gives as an array of (surface, reading, pos)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup, stripped

#: The type of a morpheme: reading in katakana; pos from the broad class to the conjugation form.
MORPHEMES = "array<struct<surface:string,reading:string,pos:array<string>>>"

#: Readings that stand for a symbol within a text; whether only if written in kana; whether also within a longer katakana word.
INLINE_SYMBOLS = [
    (("カギカッコトジ", "カギカッコトシ"), "」", False, True),
    (("カギカッコ",), "「", False, True),
    (("カッコトジ", "カッコトシ"), "）", False, True),
    (("カッコ",), "（", True, False),
]
LONGEST_RUN = 4
CONTINUATION = "ーウゥ"

#: Words and classes that rules of punctuation ask for.
POLITE_ENDERS = ("です", "でした", "でしょう", "ます", "ません", "ました", "ませんでした")
END_ENDERS = (*POLITE_ENDERS, "だ", "だった", "である", "た", "ない", "なかった", "いる", "ある", "する", "ください", "下さい")
JOIN_PARTICLES = ("が", "けど", "けれど", "けれども", "ので", "のに", "から")
STARTER_POS = ("名詞", "代名詞", "副詞", "接続詞", "感動詞", "連体詞", "動詞", "形容詞", "形状詞")
LEAD_CONNECTIVES = ("つまり", "たとえば", "例えば", "ちなみに", "要するに", "一方")
CONJUNCTION_PAIRS = ("でも", "だが", "しかし", "ただし", "けれど")
CONJUNCTIONS = ("しかし", "ただし", "また", "そして", "それで", "つまり", "一方", "ちなみに")
TERMINALS = "。！？!?…」）)"


def _joined(morphemes: Column, field: str) -> Column:
    return F.array_join(F.transform(morphemes, lambda m: F.coalesce(m[field], m["surface"], F.lit(""))), "")


def within_katakana(surface: Column) -> Column:
    """Symbols in place of their words within a katakana word, unless the word goes on with a long sound. No word can begin within another one of a rule before it, so the rules go one after another."""
    out = surface
    for readings, symbol, _, inside in INLINE_SYMBOLS:
        if inside:
            out = F.regexp_replace(out, f"(?:{'|'.join(readings)})(?![{CONTINUATION}])", symbol)
    return F.when(surface.rlike(r"^[ァ-ヶー]+\z"), out).otherwise(surface)


def with_inline_symbols(text: Column, morphemes: Column) -> Column:
    """A text with symbols in place of up to LONGEST_RUN morphemes that read as one of their words, the most morphemes first.

    Without morphemes (null or none) the text stays as it is.
    """
    symbols = {r: s for readings, s, _, _ in INLINE_SYMBOLS for r in readings}
    kana_only = [r for readings, _, kana, _ in INLINE_SYMBOLS if kana for r in readings]
    n = F.size(morphemes)

    def hit(at: Column, length: int) -> Column:
        """The symbol of `length` morphemes from a place on, or null."""
        own = F.slice(morphemes, at + 1, length)
        reading = _joined(own, "reading")
        written = ~reading.isin(*kana_only) | _joined(own, "surface").rlike(r"^[ぁ-んァ-ヶー]+\z")
        return F.when((at + length <= n) & written, lookup(symbols, reading))

    def step(acc: Column, at: Column) -> Column:
        found = F.coalesce(*[F.when(hit(at, k).isNotNull(), F.struct(hit(at, k).alias("part"), F.lit(k).alias("size"))) for k in range(LONGEST_RUN, 0, -1)])
        own = F.coalesce(found, F.struct(within_katakana(F.coalesce(F.get(morphemes, at)["surface"], F.lit(""))).alias("part"), F.lit(1).alias("size")))
        taken = F.struct((at + own["size"]).alias("next"), F.concat(acc["text"], own["part"]).alias("text"))
        return F.when(at < acc["next"], acc).otherwise(taken)

    start = F.struct(F.lit(0).alias("next"), F.lit("").alias("text"))
    whole = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["text"])
    return F.when(F.coalesce(n, F.lit(0)) > 0, whole).otherwise(text)


def punctuated(text: Column, morphemes: Column) -> Column:
    """A text with 。 after a polite or final ending and 、 after a joining particle where a new sentence begins, 、 after a leading connective, and 。 at its end if that is a predicate.

    Without morphemes (null or none), or if it is blank, the text stays as it is.
    """
    last_char = lambda s: s.substr(F.length(s), F.lit(1))
    terminal = lambda s: (s != "") & F.lit(TERMINALS).contains(last_char(s))
    surface_at = lambda i: F.get(morphemes, i)["surface"]
    pos_at = lambda i, k: F.coalesce(F.get(F.get(morphemes, i)["pos"], F.lit(k)), F.lit(""))

    def starts(i: Column) -> Column:
        """Whether a sentence may begin with the i-th morpheme."""
        two = F.concat(surface_at(i), F.coalesce(surface_at(i + 1), F.lit("")))
        return pos_at(i, 0).isin(*STARTER_POS) | two.isin(*CONJUNCTION_PAIRS) | surface_at(i).isin(*CONJUNCTIONS)

    def open_(i: Column) -> Column:
        """Whether a mark may follow: neither side is one."""
        following = surface_at(i + 1)
        marks = [*TERMINALS, "、"]
        return ~terminal(surface_at(i)) & (surface_at(i) != "、") & following.isNotNull() & ~following.isin(*marks)

    def stops(i: Column) -> Column:
        ends = ((pos_at(i, 0) == "助動詞") & surface_at(i).isin(*POLITE_ENDERS)) | ((pos_at(i, 0) == "助詞") & (pos_at(i, 1) == "終助詞"))
        return open_(i) & ends & starts(i + 1)

    def mark(i: Column) -> Column:
        joins = (pos_at(i, 0) == "助詞") & (pos_at(i, 1) == "接続助詞") & surface_at(i).isin(*JOIN_PARTICLES) & starts(i + 1)
        leads = (pos_at(i, 0) == "接続詞") | surface_at(i).isin(*LEAD_CONNECTIVES)
        before = F.when(i > 0, surface_at(i - 1))
        first = F.coalesce(before, F.lit("")) == ""  # nothing before, or nothing to see of it
        after_stop = first | terminal(before) | ((i > 0) & stops(i - 1))
        return F.when(stops(i), "。").when(open_(i) & (joins | (leads & after_stop)), "、").otherwise("")

    n = F.size(morphemes)
    whole = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(surface_at(i), mark(i))), "")
    at = n - 1
    predicate = surface_at(at).isin(*END_ENDERS) | ((pos_at(at, 0) == "助詞") & (pos_at(at, 1) == "終助詞")) | (pos_at(at, 0).isin("動詞", "形容詞", "助動詞") & F.contains(pos_at(at, 5), F.lit("終止形")))
    closed = F.when((whole != "") & ~terminal(whole) & (last_char(whole) != "、") & predicate, F.concat(whole, F.lit("。"))).otherwise(whole)
    return F.when((F.coalesce(n, F.lit(0)) > 0) & (stripped(text) != ""), closed).otherwise(text)
