"""String functions."""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow

#: The ranges that count as Japanese text.
JAPANESE = "　-〿぀-ゟ゠-ヿ㐀-䶿一-鿿＀-￯"

#: Words that alone stand for a symbol, and those of them that also do so at a text's end.
SYMBOL_WORDS = [
    (("かいぎょう", "あたらしいぎょう", "改行", "開業", "会場", "回教"), "\n"),
    (("まる", "マル", "丸", "終わる"), "。"),
    (("てん", "テン", "点", "天"), "、"),
    (("かぎかっことじ", "カギカッコトジ", "かぎ括弧閉じ", "カギカッコ閉じ", "鍵かっことじ", "鍵かっこ閉じ", "鍵括弧閉じ", "鉤括弧閉じ"), "」"),
    (("かぎかっこ", "カギカッコ", "かぎ括弧", "カギ括弧", "鍵かっこ", "鍵括弧", "鉤括弧"), "「"),
    (("かっことじ",), "）"),
    (("かっこ",), "（"),
    (("びっくりまーく", "エクスクラメーション"), "！"),
    (("はてなまーく", "クエスチョン"), "？"),
    (("なかぐろ",), "・"),
    (("さんてん", "てんてん", "三点リーダー"), "…"),
    (("ころん",), "："),
    (("すらっしゅ",), "／"),
]
ENDERS = ("まる", "マル", "丸", "てん", "テン")
_TAIL = "。、 　\t"


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def half_width(text: Column) -> Column:
    """Full-width ASCII and the ideographic space in half width."""
    return F.translate(text, "".join(map(chr, range(0xFF01, 0xFF5F))) + "　", "".join(map(chr, range(0x21, 0x7F))) + " ")


def without_japanese_spaces(text: Column) -> Column:
    """Without the blanks that have Japanese on one side and Japanese or alphanumerics on the other."""
    ja, an = f"[{JAPANESE}]", "[A-Za-z0-9]"
    return F.regexp_replace(text, f"(?<={ja}) +(?={an})|(?<={an}) +(?={ja})|(?<={ja}) +(?={ja})", "")


def collapsed(text: Column) -> Column:
    """One in place of repeated marks and blanks."""
    for pattern, one in (("、{2,}", "、"), ("。{2,}", "。"), (r"[ \t]{2,}", " ")):
        text = F.regexp_replace(text, pattern, one)
    return text


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """The key's value in a literal map, or null."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def dictated_symbols(text: Column, own: dict[str, str] | None = None) -> Column:
    """A text that is a symbol's word alone becomes the symbol, the caller's words first; one that ends in an ending word ends in its mark."""
    t = stripped(text)
    bare = F.regexp_replace(t, f"[{_TAIL}]+$", "")
    symbol = {w: mark for words, mark in SYMBOL_WORDS for w in words}
    alone = F.coalesce(lookup(own or {}, bare), lookup(symbol, bare))
    word = F.regexp_extract(t, f"({'|'.join(ENDERS)})$", 1)  # no ender ends in another one
    rest = F.regexp_replace(t.substr(F.lit(1), F.length(t) - F.length(word)), f"[{_TAIL}]+$", "")
    ended = F.when(word != "", F.concat(rest, lookup({w: symbol[w] for w in ENDERS}, word)))
    return F.when(t == "", t).otherwise(F.coalesce(alone, ended, t))


def katakana_to_hiragana(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097))))


def hiragana_to_katakana(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30F7))))


def latin_ratio(text: Column) -> Column:
    """Share of ASCII letters among what isn't white space; 0 of nothing."""
    solid = F.regexp_replace(text, r"(?U)\s", "")
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, "[^A-Za-z]", "")) / F.length(solid)).otherwise(0.0)


@arrow("double")
def repetition(text: pd.Series) -> pd.Series:
    """Compressed size over size of the UTF-8 bytes; 1 of fewer than 24 bytes. Small where a text repeats itself."""
    raw = [t.encode() if t is not None else b"" for t in text]
    return pd.Series([len(zlib.compress(r, 6)) / len(r) if len(r) >= 24 else 1.0 for r in raw])


@arrow("string")
def nfkc(text: pd.Series) -> pd.Series:
    return pd.Series([unicodedata.normalize("NFKC", t) if t is not None else None for t in text])


#: What a comparison of texts leaves out, besides white space.
UNCOMPARED = "。、，．,.!?！？「」『』〈〉《》【】〔〕（）()[]{}…‥・:：;；\"'“”‘’|/\\*#>=+_~〜～`^&$@%"
UNCOMPARED_BY_CLIENT = r"[\s、。！？!?・：:；;,.「」『』（）()\[\]…]"


class _Forms:
    """What each code point becomes in a comparable text; worked out when it is first met."""

    def __init__(self):
        self.known, self.size, self.first, self.more = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint32), {}

    def meet(self, codes: np.ndarray) -> None:
        for code in np.unique(codes[~self.known[codes]]).tolist():
            own = [ord(x) for c in unicodedata.normalize("NFKC", chr(code)) if not c.isspace() and c not in UNCOMPARED for x in c.lower()]
            self.known[code], self.size[code], self.first[code] = True, len(own), own[0] if own else 0
            if len(own) > 1:
                self.more[code] = own


@cache
def _forms() -> _Forms:
    return _Forms()


def comparable_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """NFKC, lower case, without white space and UNCOMPARED, character by character: the code points, and each one's place in text."""
    codes, forms = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _forms()
    forms.meet(codes)
    size = forms.size[codes]
    at = np.repeat(np.arange(len(codes)), size)
    out = forms.first[codes[at]]
    for i in np.flatnonzero(size > 1).tolist():
        begin = int(np.searchsorted(at, i))
        out[begin : begin + int(size[i])] = forms.more[int(codes[i])]
    return out, at


def comparable_text(text: str) -> tuple[str, list[int]]:
    """The comparable characters as a text, and each one's place."""
    codes, at = comparable_codes(text)
    return codes.tobytes().decode("utf-32-le", "surrogatepass"), at.tolist()


@arrow("norm string, idx array<int>")
def comparable(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([comparable_text(t or "") for t in text], columns=["norm", "idx"])


def client_text(text: str) -> str:
    """What comparable_by_client gives, of one text; white space is that of ASCII, as in Spark's patterns."""
    return re.sub(UNCOMPARED_BY_CLIENT, "", unicodedata.normalize("NFKC", text), flags=re.ASCII)


def comparable_by_client(text: Column) -> Column:
    return F.regexp_replace(nfkc(text), UNCOMPARED_BY_CLIENT, "")


def word_list(text: Column) -> Column:
    """Lower-case words for word error rates."""
    flat = F.regexp_replace(F.lower(text), r"(?U)[^\w\s']", " ")
    return F.filter(F.split(flat, r"(?U)\s+"), lambda w: w != "")


def reading_key(text: Column) -> Column:
    """Only the hiragana of the NFKC form, katakana taken as hiragana."""
    return F.regexp_replace(katakana_to_hiragana(nfkc(text)), "[^ぁ-ゖ]", "")


def clock(seconds: Column) -> Column:
    """HH:MM:SS; dashes for negative seconds."""
    s = F.floor(seconds)
    return F.when(seconds < 0, "--:--:--").otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def minute_clock(seconds: Column) -> Column:
    """m:ss.s, rounded by the exact value of the double, halves to even, as C and Python do; Java rounds its shortest decimal form, halves up."""
    seconds = seconds.cast("double")
    minutes = F.floor(seconds / 60)
    rest = seconds - minutes * 60
    tenths, high = rest * 10, F.floor(rest * (1 << 20)) / (1 << 20)
    whole = F.floor(tenths)
    # what the product lost by rounding: both parts of rest times 10 are exact
    lost = (high * 10 - tenths) + (rest - high) * 10
    half = tenths - whole == 0.5
    up = (tenths - whole > 0.5) | half & ((lost > 0) | (lost == 0) & (whole % 2 == 1))
    n = whole + up.cast("int")
    return F.format_string("%d:%02d.%d", minutes, F.floor(n / 10), n % 10)


def size_label(n: Column) -> Column:
    """Bytes in KB or MB."""
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", n / (1 << 20))).otherwise(F.format_string("%.0f KB", n / 1024))


#: Numbers in kanji and in kana.
KANJI_NUMBERS = {c: i for i, c in enumerate("一二三四五六七八九十", 1)}
KANA_NUMBERS = {"いち": 1, "に": 2, "さん": 3, "よん": 4, "し": 4, "ご": 5, "ろく": 6, "なな": 7, "しち": 7, "はち": 8, "きゅう": 9, "きゅ": 9, "く": 9, "じゅう": 10, "じゅ": 10}


def number(token: Column, kana: bool = False) -> Column:
    """Digits of either width, or a kanji (or kana) number; null otherwise."""
    digits = F.translate(token, "０１２３４５６７８９", "0123456789")
    names = {k: str(v) for k, v in (KANJI_NUMBERS | (KANA_NUMBERS if kana else {})).items()}
    return F.coalesce(F.when(digits.rlike("^[0-9]{1,9}$"), digits), lookup(names, token)).cast("int")


def split_keys(text: Column) -> Column:
    """The parts between 、 , ， ／ / and line breaks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[、,，／/\n]"), stripped), lambda x: x != "")


def needs_conversion(original: Column, spoken: Column) -> Column:
    """A short spoken word in kana only for an original that isn't."""
    kana = "^[ぁ-ゖァ-ヶー]+$"
    return (F.length(spoken).between(1, 8)) & ~original.rlike(kana) & spoken.rlike(kana)


def english_final(text: Column) -> Column:
    """One blank in place of each run of white space, none at the ends."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def without_line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "[\r\n]+", "")


def pause_comma(text: Column, pause: Column, previous: Column, suppressed: Column | None = None, longest: float = 2.0) -> Column:
    """A leading 、 after a short pause, unless a mark, a bracket or a line break stands at the edge on either side."""
    opens = text.rlike("^[、。！？!?…・：\n）」』]")
    closes = previous.rlike("[、。！？!?…・：\\s　\n「『（(]$")
    go = (pause > 0) & (pause <= longest) & (text != "") & ~opens & (F.length(previous) > 0) & ~closes
    go = go & ~F.coalesce(suppressed, F.lit(False)) if suppressed is not None else go
    return F.when(F.coalesce(go, F.lit(False)), F.concat(F.lit("、"), text)).otherwise(text)


#: What a note's plain text leaves out, in this order.
NOTE_RULES = (
    (r"(?s)\A---\r?\n.*?\r?\n---\r?\n", ""),
    (r"(?s)```.*?```", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[\[[^\]|]*\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]|]*)\|?\]\]", "$1"),
    (r"(?m)^\s{0,3}(?:[#>]+|[-*+]|\d+\.)\s+", ""),
    (r"\*\*|~~|==|`", ""),
)


def note_text(text: Column) -> Column:
    """A Markdown note's own words: of a wiki link its alias, else its target."""
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), NOTE_RULES, text)


def tsv_cell(value: Column, kind: str) -> Column:
    """Three decimals of a float, nothing for null, blanks for tabs and line breaks."""
    if kind in ("float", "double"):
        return F.coalesce(F.format_string("%.3f", value), F.lit(""))
    return F.coalesce(F.translate(value.cast("string"), "\t\n", "  "), F.lit(""))


def reading(morphemes: Column) -> Column:
    """A text's reading from its morphemes: each one's reading, or its surface."""
    return F.array_join(F.transform(morphemes, lambda m: F.coalesce(F.nullif(m["reading"], F.lit("")), m["surface"])), "")
