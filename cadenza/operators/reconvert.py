"""Candidates for a wrongly heard word: variants of its reading, surfaces, symbols."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import bound, plausible_reading
from ..functions.text import hiragana_to_katakana, stripped
from .commands import COMMAND_RESTS, is_echo

#: Kana that differ by their marks only.
VOICING = "かが きぎ くぐ けげ こご さざ しじ すず せぜ そぞ ただ ちぢ つづ てで とど はばぱ ひびぴ ふぶぷ へべぺ ほぼぽ".split()
#: Symbols that may be meant by a short word, in their order.
SYMBOLS = ("。", "、", "\n", "「", "」", "（", "）", "？", "！", "・", "…", "：", "／")

#: What stands before a place in the reversed text where a command's rest follows it in reading order.
ECHO_BEFORE = "|".join(r[::-1] for r in COMMAND_RESTS)


def variants(readings: DataFrame, limit: int = 6) -> DataFrame:
    """(reading, variant, kind, place): readings one edit away, in turn from voicing, hatsuon (ん) and sokuon (っ, ー), each reading once, implausible ones left out.

    A reading's edits are an array, bounded by its length; no rows are multiplied before.
    """
    others = F.create_map(*[F.lit(x) for g in VOICING for c in g for x in (c, "".join(o for o in g if o != c))])
    r = F.col("reading")
    n = F.length(r)
    spot = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    char = lambda i: r.substr(i, F.lit(1))
    left, right = (lambda i: r.substr(F.lit(1), i - 1)), (lambda i: r.substr(i + 1, n))

    def voiced(i: Column) -> Column:
        given = F.coalesce(F.element_at(others, char(i)), F.lit(""))
        return F.transform(F.filter(F.split(given, ""), lambda c: c != ""), lambda c: F.concat(left(i), c, right(i)))

    def put(mark: str) -> Column:
        return F.transform(spot(F.lit(2), n), lambda i: F.concat(left(i), F.lit(mark), r.substr(i, n)))

    def drop(marks: str) -> Column:
        return F.transform(F.filter(spot(F.lit(1), n), lambda i: F.contains(F.lit(marks), char(i))), lambda i: F.concat(left(i), right(i)))

    made = {
        "voicing": F.flatten(F.transform(spot(F.lit(1), n), voiced)),
        "hatsuon": F.concat(drop("ん"), F.array(F.concat(r, F.lit("ん"))), put("ん")),
        "sokuon": F.concat(drop("っー"), put("っ")),
    }
    rows = None
    for k, (kind, edits) in enumerate(made.items()):
        own = readings.where(n > 0).select("reading", F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.posexplode(edits).alias("i", "variant"))
        rows = own if rows is None else rows.union(own)
    rows = rows.where((F.col("variant") != F.col("reading")) & plausible_reading(F.col("variant")))
    once = rows.withColumn("again", F.row_number().over(Window.partitionBy("reading", "variant").orderBy("k", "i"))).where("again = 1")
    turn = once.withColumn("turn", F.row_number().over(Window.partitionBy("reading", "k").orderBy("i")))
    placed = turn.withColumn("place", F.row_number().over(Window.partitionBy("reading").orderBy("turn", "k")))
    return placed.where(F.col("place") <= limit).select("reading", "variant", "kind", "place")


def variant_candidates(found: DataFrame, table: DataFrame, known: DataFrame, most: int = 8, each: int = 2) -> DataFrame:
    """(reading, candidate, place): surfaces for the variants, at most `each` of one and `most` in all, none that is known.

    found: variants(); table: (reading, ord, candidate), what the variants convert to; known:
    (reading, candidate). A voicing variant is a candidate itself; of the others the kana that
    came back unchanged are noise. A candidate that two variants give belongs to the first.
    """
    own = found.select("reading", "variant", "kind", "place")
    as_is = own.where("kind = 'voicing'").select("*", F.lit(-1).alias("ord"), F.col("variant").alias("candidate"))
    looked = own.join(table.select(F.col("reading").alias("variant"), "ord", "candidate"), "variant").select(*own.columns, "ord", "candidate")
    noise = (F.col("kind") != "voicing") & ((F.col("candidate") == F.col("variant")) | (F.col("candidate") == hiragana_to_katakana(F.col("variant"))))
    rows = as_is.union(looked).where(~noise & (F.col("candidate") != "")).join(known, ["reading", "candidate"], "left_anti")
    once = rows.withColumn("again", F.row_number().over(Window.partitionBy("reading", "candidate").orderBy("place", "ord"))).where("again = 1")
    few = once.withColumn("own", F.row_number().over(Window.partitionBy("reading", "place").orderBy("ord"))).where(F.col("own") <= each)
    return few.withColumn("n", F.row_number().over(Window.partitionBy("reading").orderBy("place", "ord"))).where(F.col("n") <= most).select("reading", "candidate", F.col("n").alias("place"))


def surfaces(target: Column, segments: Column, top: int = 5, most: int = 50) -> Column:
    """A target, then the joined candidates of its segments (array of arrays): the first `top` of each, `most` in all at every step, each surface once."""

    def add(heads: Column, cands: Column) -> Column:
        own = F.slice(cands, 1, top)
        all_ = F.flatten(F.transform(heads, lambda h: F.transform(own, lambda c: F.concat(h, c))))
        return F.when(F.size(own) > 0, F.slice(all_, 1, most)).otherwise(heads)

    made = F.aggregate(segments, F.array(F.lit("")), add)
    return F.filter(F.array_distinct(F.concat(F.array(target), made)), lambda s: s != "")


def _last_in(options: Column, skip_echo: bool, text: Column) -> Column:
    """struct(at, i, surface): the option that begins last in text, with place -1 if none does; of two at one place the first given. An occurrence after which the rest of a command stands is passed over if skip_echo.

    A search from the end stops at the first hit. Only where that is an echo is the text reversed
    and searched by a pattern.
    """

    def one(s: Column, i: Column) -> Column:
        n, size = F.length(s), F.length(text)

        def place(after: Column) -> Column:
            at = F.when(F.length(after) < size, size - F.length(after) - n)
            if not skip_echo:
                return at
            back = F.reverse(text)
            # in the reversed text, where s begins and no command's rest stands before it
            spelt = F.replace(F.reverse(s), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
            free = F.concat(F.lit(f"(?s)^(.*?)(?<!{ECHO_BEFORE})\\Q"), spelt, F.lit("\\E"))
            earlier = bound(F.struct(back.alias("back"), free.alias("free")), lambda v: F.when(F.regexp_like(v["back"], v["free"]), size - F.length(F.call_function("regexp_extract", v["back"], v["free"], F.lit(1))) - n))
            return F.when(is_echo(after, F.lit(0)), earlier).otherwise(at)

        # what follows the last occurrence; the whole text if there is none
        found = bound(F.call_function("substring_index", text, s, F.lit(-1)), place)
        return F.struct(F.when(n > 0, F.coalesce(found, F.lit(-1))).otherwise(-1).alias("at"), (-i).alias("i"), s.alias("surface"))

    return F.array_max(F.transform(F.filter(options, lambda s: s.isNotNull()), one))


def _or_else(rest: Column, near: bool, x: Column) -> Column:
    """struct(at, surface, near) of a hit x, else rest."""
    return F.when(x["at"] >= 0, F.struct(x["at"].alias("at"), x["surface"].alias("surface"), F.lit(near).alias("near"))).otherwise(rest)


def last_surface(text: Column, options: Column, window: int | Column = 2000, before: Column | None = None, anchor: Column | None = None) -> Column:
    """struct(at, surface): the surface that occurs last; at from 0, null if none does. Of two at one place the first given.

    Looked for in the `window` characters up to `anchor` (the text's end if none is given), then
    in all of the text, and both times without occurrences that are a command's own words (is_echo);
    only then in all of the text with these. Nothing from `before` on is looked at, so that a walk
    goes on from its last hit. A null text gives null. A search runs only where those before it
    found nothing.
    """
    size = F.length(text)
    end = size if before is None else F.greatest(F.lit(0), F.least(before, size))
    stop = size if anchor is None else F.least(anchor, size)
    begin = F.greatest(F.lit(0), stop - window)
    until = F.least(stop, end)

    def searched(v: Column) -> Column:
        whole, part = v["text"].substr(F.lit(1), v["end"]), v["text"].substr(v["begin"] + 1, F.greatest(v["until"] - v["begin"], F.lit(0)))
        out = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("surface"), F.lit(False).alias("near"))
        for own, skip_echo, near in ((whole, False, False), (whole, True, False), (part, True, True)):
            out = bound(bound(own, partial(_last_in, v["options"], skip_echo)), partial(_or_else, out, near))
        return bound(out, lambda x: F.struct((x["at"] + F.when(x["near"], v["begin"]).otherwise(0)).alias("at"), x["surface"].alias("surface")))

    return bound(F.struct(text.alias("text"), options.alias("options"), end.alias("end"), begin.alias("begin"), until.alias("until")), searched)


def last_target(text: Column, target: Column, segments: Column, window: int | Column = 2000, top: int = 5, most: int = 50) -> Column:
    """struct(at, surface): where what was said stands last as it was said, else where one of the surfaces of its segments does."""

    def sought(t: Column) -> Column:
        meant = last_surface(t, surfaces(target, segments, top, most), window)
        return bound(last_surface(t, F.array(target), window), lambda said: F.when(said["at"].isNotNull(), said).otherwise(meant))

    return bound(text, sought)


def preselected(text: Column, segments: Column) -> Column:
    """The candidates, one a segment, that spell a text from its beginning: at each segment the first that fits what is left; it ends where none does."""
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("chosen"), F.lit(True).alias("go"))

    def step(acc: Column, cands: Column) -> Column:
        hit = F.get(F.filter(cands, lambda c: (c != "") & acc["rest"].startswith(c)), F.lit(0))
        more = F.struct(acc["rest"].substr(F.length(hit) + 1, F.length(acc["rest"])).alias("rest"), F.concat(acc["chosen"], F.array(hit)).alias("chosen"), F.lit(True).alias("go"))
        stop = F.struct(acc["rest"].alias("rest"), acc["chosen"].alias("chosen"), F.lit(False).alias("go"))
        return F.when(acc["go"] & hit.isNotNull(), more).otherwise(stop)

    return F.aggregate(segments, start, step, lambda acc: acc["chosen"])


def symbol_choices(text: Column, n_segments: Column, existing: Column, longest: int = 6) -> Column:
    """Symbols that a short single word may stand for, without those that are there."""
    own = stripped(text)
    all_ = F.array(*map(F.lit, SYMBOLS))
    go = (n_segments == 1) & F.length(own).between(1, longest) & ~own.isin(*SYMBOLS)
    return F.when(go, F.array_except(all_, existing)).otherwise(F.array().cast("array<string>"))


def reconverted(words: DataFrame, table: DataFrame) -> DataFrame:
    """words (id, reading) with candidates: what the table (reading, ord, candidate) has, in order, else the reading itself."""
    own = table.groupBy("reading").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "candidate"))), lambda x: x["candidate"]).alias("candidates"))
    return words.join(own, "reading", "left").withColumn("candidates", F.coalesce("candidates", F.array("reading")))
