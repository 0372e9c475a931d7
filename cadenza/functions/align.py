"""Differences, similarity and repetition of texts: Arrow functions with small per-row helpers."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import bound
from .text import client_text, comparable_codes, comparable_text, stripped, without_line_breaks
from .udf import arrow

class Matcher(difflib.SequenceMatcher):
    """difflib's matcher without junk and with the same blocks; of up to `cells` pairs of characters, one table of common runs stands in for its searches."""

    def __init__(self, a: str, b: str, cells: int = 1 << 23):
        super().__init__(None, a, b, autojunk=False)
        self.runs = self._runs(a, b) if 0 < len(a) * len(b) <= cells and min(len(a), len(b)) < 1 << 14 else None

    @staticmethod
    def _runs(a: str, b: str) -> np.ndarray:
        """For each end in a and in b, how long the run is that ends there in both."""
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
        out = np.zeros((len(x) + 1, len(y) + 1), np.int16)
        same = {c: (y == c).astype(np.int16) for c in set(x.tolist())}
        for i, c in enumerate(x.tolist()):
            np.multiply(out[i, :-1] + 1, same[c], out=out[i + 1, 1:])
        return out[1:, 1:]

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if self.runs is None:
            return super().find_longest_match(alo, ahi, blo, bhi)
        if alo >= ahi or blo >= bhi:
            return difflib.Match(alo, blo, 0)
        # a run that began before the ranges counts from where they begin; argmax takes the first in a, then in b
        own = self.runs[alo:ahi, blo:bhi]
        if alo:
            own = np.minimum(own, np.minimum(np.arange(1, ahi - alo + 1), 1 << 14).astype(np.int16)[:, None])
        if blo:
            own = np.minimum(own, np.minimum(np.arange(1, bhi - blo + 1), 1 << 14).astype(np.int16))
        i, j = divmod(int(own.argmax()), bhi - blo)
        size = int(own[i, j])
        return difflib.Match(alo + i + 1 - size, blo + j + 1 - size, size) if size else difflib.Match(alo, blo, 0)


#: Raw ranges of a difference: in live, in ref, and before and after it in both; pos: where it lies in ref.
_CUTS = ("live", "ref", "live_left", "live_right", "ref_left", "ref_right")


def _raw_ranges(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Start and length in the raw text of the comparable characters lo .. hi - 1; at: their raw places."""
    lo, hi = np.clip(lo, 0, len(at)), np.clip(hi, 0, len(at))
    start, last = np.append(at, 0)[lo], np.append(at, 0)[hi - 1]
    return np.stack([start, np.where(lo < hi, last + 1 - start, 0)], axis=1)


def difference_ranges(live: str, ref: str, merge: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """Where two comparable texts differ: raw (start, length) of each of _CUTS for every difference, and its place in ref.

    Differences lie between the blocks that match; blocks of at most `merge` characters don't
    part two of them.
    """
    (a, at_a), (b, at_b) = comparable_text(live), comparable_text(ref)
    at_a, at_b = np.array(at_a, np.int64), np.array(at_b, np.int64)
    x, y, n = np.array([(0, 0, 0), *Matcher(a, b).get_matching_blocks()], np.int64).T
    gaps = np.stack([x[:-1] + n[:-1], x[1:], y[:-1] + n[:-1], y[1:]])
    some = (gaps[1] > gaps[0]) | (gaps[3] > gaps[2])
    gaps = gaps[:, some]
    first = np.ones(gaps.shape[1], bool)
    first[1:] = gaps[0, 1:] - gaps[1, :-1] > merge
    last = np.append(first[1:], True)[: len(first)]
    i, k, j, m = gaps[0, first], gaps[2, first], gaps[1, last], gaps[3, last]
    cuts = [_raw_ranges(at, lo, hi) for at, lo, hi in ((at_a, i, j), (at_b, k, m), (at_a, i - context, i), (at_a, j, j + context), (at_b, k - context, k), (at_b, m, m + context))]
    end = at_b[-1] if len(at_b) else 0
    return np.stack(cuts, axis=1).reshape(-1, 2 * len(_CUTS)), np.append(at_b, end)[k]


def differences(live: Column, ref: Column, merge: int = 8, context: int = 24, least: int = 2) -> Column:
    """array<struct<kind, live, ref, ref_pos, live_left, live_right, ref_left, ref_right>>: where two texts differ as comparable texts: 脱落 (only in ref), 余分 (only in live), 相違 (both).

    Differences at most `merge` characters apart are one; one-sided ones of fewer than `least`
    characters don't count. A null text counts as empty. The search for blocks takes time in
    proportion to the product of the two lengths at worst; only the ranges come from it, texts
    are cut by Spark.
    """

    @arrow("array<struct<at:array<int>,pos:int>>")
    def ranges(live: pd.Series, ref: pd.Series) -> pd.Series:
        found = [difference_ranges(x or "", y or "", merge, context) for x, y in zip(live, ref, strict=True)]
        return pd.Series([[{"at": at, "pos": pos} for at, pos in zip(*(v.tolist() for v in own), strict=True)] for own in found])

    texts = {"live": F.coalesce(live, F.lit("")), "ref": F.coalesce(ref, F.lit(""))}

    def cut(d: Column) -> Column:
        own = {c: texts[c.split("_")[0]].substr(d["at"][2 * k] + 1, d["at"][2 * k + 1]) for k, c in enumerate(_CUTS)}
        own = {c: F.replace(t, F.lit("\n"), F.lit(" ")) if "_" in c else stripped(t) for c, t in own.items()}
        kind = F.when((own["live"] != "") & (own["ref"] != ""), "相違").when(own["live"] != "", "余分").otherwise("脱落")
        return F.struct(kind.alias("kind"), own["live"].alias("live"), own["ref"].alias("ref"), d["pos"].alias("ref_pos"), *(own[c].alias(c) for c in _CUTS[2:]))

    counts = lambda h: (h["kind"] == "相違") | (F.greatest(F.length(h["live"]), F.length(h["ref"])) >= max(least, 1))
    return F.filter(F.transform(ranges(live, ref), cut), counts)


@arrow("double")
def match_ratio(live: pd.Series, ref: pd.Series) -> pd.Series:
    """Share of both comparable texts that matching blocks hold."""
    return pd.Series([Matcher(comparable_text(x or "")[0], comparable_text(y or "")[0]).ratio() for x, y in zip(live, ref, strict=True)])


@arrow("size int, stop int, live_size int, ref_size int")
def _end_in(live: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """The longest run that live and ref's last 160 comparable characters share: its size, where it stops in the raw live, and both comparable sizes."""
    rows = []
    for (a, at), (b, _) in zip((comparable_text(x or "") for x in live), (comparable_text(y or "") for y in ref), strict=True):
        run = Matcher(a, b[-160:]).find_longest_match(0, len(a), 0, len(b[-160:]))
        rows.append((run.size, at[run.a + run.size - 1] + 1 if run.size else 0, len(a), len(b)))
    return pd.DataFrame(rows, columns=["size", "stop", "live_size", "ref_size"])


def aligned_prefix(live: Column, ref: Column) -> Column:
    """struct(text, matched, status): live up to where ref's end lies in it, if live is over 1.3 times as long.

    status: empty (nothing to compare), whole (of like length), lost (fewer than 12 characters of ref's end are found), cut.
    """

    def judged(found: Column) -> Column:
        empty, whole = F.least(found["live_size"], found["ref_size"]) == 0, found["live_size"] <= 1.3 * found["ref_size"]
        status = F.when(empty, "empty").when(whole, "whole").when(found["size"] < 12, "lost").otherwise("cut")
        text = F.when(status == "cut", live.substr(F.lit(1), found["stop"])).otherwise(live)
        return F.struct(text.alias("text"), F.when(empty | whole, 0).otherwise(found["size"]).alias("matched"), status.alias("status"))

    return bound(_end_in(live, ref), judged)


#: Comparable characters that are searched for repeats at once.
_STRETCH = 1 << 18


def doubled(codes: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """(start, size) of the stretches of least .. most codes that come twice in a row, from left to right, the longest at each place, none within another or its repeat.

    Hashes of short runs are compared at each distance; what they propose is compared itself.
    """
    width = min(least, 4)
    grams = np.zeros(max(len(codes) - width + 1, 0), np.uint32)
    for k in range(width):
        grams = grams * np.uint32(0x9E3779B1) + codes[k : k + len(grams)]
    best = np.zeros(len(grams), np.min_scalar_type(most))
    for n in range(least, min(most, len(codes) // 2) + 1):
        same, more = np.flatnonzero(grams[:-n] == grams[n:]), n - width
        starts = same[: max(len(same) - more, 0)]
        best[starts[same[more:] - starts == more]] = n
    out, done = [], 0
    for i in np.flatnonzero(best).tolist():
        if i >= done and (n := next((n for n in range(int(best[i]), least - 1, -1) if np.array_equal(codes[i : i + n], codes[i + n : i + 2 * n])), 0)):
            out.append((i, n))
            done = i + 2 * n
    return out


def repeats_in(least: int = 4, most: int = 40):
    """array<struct<pos, unit>>: stretches of a comparable text that come twice in a row, the longest at each place; pos is in the raw text."""

    def found(texts: list[tuple[np.ndarray, np.ndarray]]) -> list[list[dict]]:
        # one code after each text that no other is equal to
        codes = np.concatenate([x for k, (own, _) in enumerate(texts) for x in (own, np.array([0x110000 + k], np.uint32))])
        begin = np.cumsum([0, *(len(own) + 1 for own, _ in texts)])
        out: list[list[dict]] = [[] for _ in texts]
        hits = doubled(codes, least, most)
        for (i, n), k in zip(hits, (np.searchsorted(begin, [i for i, _ in hits], side="right") - 1).tolist(), strict=True):
            out[k].append({"pos": int(texts[k][1][i - begin[k]]), "unit": codes[i : i + n].tobytes().decode("utf-32-le", "surrogatepass")})
        return out

    @arrow("array<struct<pos:int,unit:string>>")
    def find(text: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for t in text:
            held.append(comparable_codes(t or ""))
            size += len(held[-1][0])
            if size >= _STRETCH:
                out, held, size = out + found(held), [], 0
        return pd.Series(out + found(held) if held else out)

    return find


def _edits(a: list, b: list) -> int:
    """Edit distance by bit-parallel counting: a bit for each item of a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last, n = (1 << len(a)) - 1, 1 << len(a) >> 1, len(a)
    if not a:
        return len(b)
    up, down = full, 0
    for y in b:
        hit = places.get(y, 0)
        v, h = hit | down, (((hit & up) + up) ^ up) | hit
        more, less = down | ~(h | up), up & h
        n += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(v | more)) & full, more & v & full
    return n


@arrow("double")
def word_error_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edits between two arrays of words over the reference's number; 0 of an empty reference."""
    return pd.Series([_edits(list(r), list(h)) / len(r) if len(r) else 0.0 for r, h in zip(ref, hyp, strict=True)])


def common_length(a: str, b: str) -> int:
    """Of the longest common subsequence, by bit-parallel counting: a bit for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        hit = v & places.get(c, 0)
        v = ((v + hit) | (v - hit)) & full
    return len(a) - v.bit_count()


#: A refined text may have this share of the length; this share of an edge, and of the whole, must be left.
LEAST_LENGTH, LEAST_EDGE, LEAST_WHOLE = 0.78, 0.4, 0.45


@arrow("x int, y int, leading double, trailing double, whole double")
def _kept(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Sizes of both comparable texts; which shares of the first and last characters of a text, and of all of it, its later version still has in their order; an edge is looked for in twice its length."""
    share = lambda a, b: common_length(a, b) / max(1, len(a))

    def one(x: str, y: str) -> tuple:
        n = min(48, max(16, len(x) // 4))
        return len(x), len(y), share(x[:n], y[: 2 * n]), share(x[-n:], y[-2 * n :]), share(x, y)

    rows = [one(client_text(x or ""), client_text(y or "")) for x, y in zip(before, after, strict=True)]
    return pd.DataFrame(rows, columns=["x", "y", "leading", "trailing", "whole"]).astype({"x": "int32", "y": "int32"})


def refinement_safety(before: Column, after: Column) -> Column:
    """struct(safe, reason): whether a refined text keeps its provisional one, by comparable characters: enough length, enough of both edges, enough of the whole; of a short or empty one only the length counts. The whole texts count, where the client looks at 1200 characters."""

    def judged(v: Column) -> Column:
        long = v["x"] >= 24
        rules = {"too-short": v["y"] / v["x"] < LEAST_LENGTH}
        rules |= {f"{side}-content-lost": long & (v[side] < LEAST_EDGE) for side in ("leading", "trailing")}
        rules["content-diverged"] = long & (v["whole"] < LEAST_WHOLE)
        reason = F.when(v["x"] > 0, F.coalesce(*[F.when(broken, name) for name, broken in rules.items()]))
        return F.struct(reason.isNull().alias("safe"), reason.alias("reason"))

    return bound(_kept(before, after), judged)


#: Where a paragraph may end, and where it may if there is no such place.
SENTENCE_ENDS, CLAUSE_ENDS = "[。！？!?」』）]", r"[、，,：:；;\s]"


@arrow("array<int>")
def _places(text: pd.Series, shares: pd.Series) -> pd.Series:
    """For each share (of the length, rising) a place in the text: the edge's own at 0 and 1, else the nearest end of a sentence behind the place before, else of a clause; none if there is neither."""

    def one(t: str, shares: np.ndarray) -> list[int]:
        ends = [np.array([m.end() for m in re.finditer(p, t) if m.end() < len(t)], int) for p in (SENTENCE_ENDS, CLAUSE_ENDS)]
        out: list[int] = []
        for share in shares:
            if share in (0.0, 1.0):
                out.append(int(share) * len(t))
                continue
            first = min(len(t), out[-1] + 1 if out else 0)
            goal = max(first, int(share * len(t) + 0.5))  # half up, as the client rounds
            free = next((own for e in ends if len(own := e[e >= first])), None)
            if free is not None:
                out.append(int(free[np.abs(free - goal).argmin()]))
        return out

    return pd.Series([one(t, s) for t, s in zip(text, shares, strict=True)])


def with_paragraphs_of(refined: Column, provisional: Column) -> Column:
    """The refined text with the provisional one's paragraph breaks, each at the nearest sentence end to its relative place, else at the nearest comma or blank, else left out."""
    new, old = F.coalesce(refined, F.lit("")), F.coalesce(provisional, F.lit(""))
    flat, parts = without_line_breaks(new), F.split(old, r"(?:\r?\n){2,}", -1)
    size = F.length(without_line_breaks(old))
    before = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.length(without_line_breaks(F.array_join(F.slice(parts, 1, i + 1), ""))) / size)

    def broken(places: Column) -> Column:
        edges = F.concat(F.array(F.lit(0)), places, F.array(F.length(flat)))
        pieces = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: flat.substr(F.get(edges, i - 1) + 1, F.get(edges, i) - F.get(edges, i - 1)))
        return F.array_join(pieces, "\n\n")

    some = (F.size(parts) > 1) & (F.length(flat) > 0) & (size > 0)
    return F.when(some, bound(_places(flat, F.when(some, before).otherwise(F.array().cast("array<double>"))), broken)).otherwise(new)


def edit_distance(a: Column, b: Column) -> Column:
    """Character edits, by code points."""
    return F.levenshtein(a, b)
