"""Joins by position, interval, containment and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keywords import with_any

#: Rows of a list of words or phrases that may become one array of the plan; they are counted before.
SMALL = 1_000
#: Tolerance up to which phrases are looked up by what deletions leave of them.
INDEXED = 3


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """left with value: of the last right row at or before it (its value, even if null), or of the key's first row if there is none before.

    Both sides are put in one order by key and position and the last right row is carried
    forward in one pass; each key's first row comes from an aggregate. No pairs are made,
    whatever the number of rows of a key. Of right rows at one place the largest value is the
    last one and the smallest the first one. A key without right rows gives null; a null
    position on the left lies before all others, right rows without a position are left out.
    """
    held = right.select(F.col(key), F.col(right_at).cast("double").alias("_at"), F.col(value).alias("_value")).where("_at is not null").withColumn("_row", F.struct(F.col("_value").alias("v")))
    a = left.withColumns({"_at": F.col(left_at).cast("double"), "_side": F.lit(1)})
    both = a.unionByName(held.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy(F.asc_nulls_first("_at"), "_side", F.asc_nulls_first("_value")).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_past", F.last("_row", ignorenulls=True).over(by)).where("_side = 1")
    first = held.groupBy(key).agg(F.min(F.struct("_at", "_value", "_row"))["_row"].alias("_first"))
    return placed.join(first, key, "left").withColumn("_found", F.coalesce("_past", "_first")["v"]).select(*(F.col(c) for c in left.columns if c != value), F.col("_found").alias(value))


def overlaps(left: DataFrame, right: DataFrame, key: str, start: str = "start", end: str = "end", r_start: str = "r_start", r_end: str = "r_end", cell: float = 30.0, slack: float = 0.0) -> DataFrame:
    """Pairs of one key whose ranges overlap by more than `slack` (0 or more): an equi-join on cells of time.

    A range's level is that of the smallest cell, of `cell` times a power of two, that is as long
    as it, so it lies in two cells of its level at most. Two ranges meet in cells of the higher
    one of their levels, in the cell where their overlap begins. A range of any length thus gives
    two rows for each level from its own on that the tables have, and these are as many as there
    are powers of two between the shortest and the longest. Null, reversed and endless ranges
    overlap nothing.
    """

    def levelled(t: DataFrame, a: str, z: str) -> DataFrame:
        a, z = F.col(a).cast("double"), F.col(z).cast("double")
        size = z - a
        good = (size >= 0) & (size < float("inf")) & (F.abs(a) < float("inf"))
        return t.where(good).withColumns({"_own": F.ceil(F.log2(F.greatest(size / cell, F.lit(1.0)))).cast("int"), "_a": a, "_z": z})

    a, b = levelled(left, start, end), levelled(right, r_start, r_end)
    # at most as many as a double has exponents
    levels = sorted({r[0] for t in (a, b) for r in t.select("_own").distinct().collect()})
    width = lambda level: F.lit(cell) * F.pow(F.lit(2.0), level)

    def placed(t: DataFrame, side: str) -> DataFrame:
        own = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v >= F.col("_own"))
        t = t.withColumn("_level", F.explode(own))
        first, last = (F.floor(F.col(c) / width(F.col("_level"))) for c in ("_a", "_z"))
        t = t.withColumn("_cell", F.explode(F.array_distinct(F.array(first, last))))
        return t.withColumnsRenamed({"_own": f"_own{side}", "_a": f"_a{side}", "_z": f"_z{side}"})

    pairs = placed(a, "1").join(placed(b, "2"), [key, "_level", "_cell"]).where(F.col("_level") == F.greatest("_own1", "_own2"))
    begin = F.greatest("_a1", "_a2")
    found = pairs.where((F.col("_cell") == F.floor(begin / width(F.col("_level")))) & (F.least("_z1", "_z2") - begin > slack))
    return found.drop("_level", "_cell", "_own1", "_own2", "_a1", "_a2", "_z1", "_z2")


def spans_of(spans: DataFrame, needles: DataFrame, key: str = "session") -> DataFrame:
    """(key, needle, start, end): the range of all spans of a session whose text holds the needle or is held by it. Pairs are made within a session only; empty texts and needles match nothing."""
    text, needle = F.trim("text"), F.trim("needle")
    own = spans.withColumn("_t", text).where("_t <> ''").join(needles.withColumn("_n", needle).where("_n <> ''"), key)
    hit = F.contains("_t", F.col("_n")) | F.contains("_n", F.col("_t"))
    return own.where(hit).groupBy(key, "needle").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def on_rounded(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, order: str, per_second: int = 100) -> DataFrame:
    """left with the last of the right rows (by order) at the same time, in whole hundredths of a second."""
    unit = lambda c: F.bround(F.col(c) * per_second).cast("long")
    by = Window.partitionBy(key, "_unit").orderBy(F.desc(order))
    b = right.withColumn("_unit", unit(right_at)).withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")
    return left.withColumn("_unit", unit(left_at)).join(b, [key, "_unit"]).drop("_unit")


def unconsumed(rows: DataFrame, consumed: DataFrame, key: str = "session", seq: str = "seq", most: int = 20) -> DataFrame:
    """Rows whose number isn't among each session's last `most` consumed ones."""
    by = Window.partitionBy(key).orderBy(F.desc("consumed_at"), F.desc(seq))
    last = consumed.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= most).select(key, seq)
    return rows.join(last, [key, seq], "left_anti")


def zipped(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of one place in their order joined."""
    place = lambda t: t.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop(order)
    return place(left).join(place(right), [key, "_place"]).withColumnRenamed("_place", "place")


def with_keyword(rows: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """Rows that hold one of the keywords (lower case).

    Up to SMALL words are one array of the plan; a longer list, of any length, is one automaton,
    broadcast in blocks of bounded size. Null words and texts match nothing, an empty word
    matches every text.
    """
    words = keywords.select(F.lower("word").alias("word")).dropna().distinct()
    few = words.limit(SMALL + 1).collect()
    if any(r[0] == "" for r in few) or len(few) > SMALL and not words.where("word = ''").isEmpty():
        return rows.where(F.col(text).isNotNull())
    if len(few) <= SMALL:
        own = F.array(*[F.lit(r[0]) for r in few]).cast("array<string>")
        return rows.where(F.exists(own, lambda w: F.contains(F.lower(F.col(text)), w)))
    return with_any(rows.withColumn("_lower", F.lower(F.col(text))), words, "_lower").drop("_lower")


def _deletions(text: Column, most: int) -> list[Column]:
    """[d0 .. d_most]: the strings that are left when up to so many characters go."""
    rounds = [F.array(text)]
    for _ in range(most):
        drop = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))).otherwise(F.array(s))
        rounds.append(F.array_distinct(F.concat(rounds[-1], F.flatten(F.transform(rounds[-1], drop)))))
    return rounds


def nearest(rows: DataFrame, key: Column, table: DataFrame, tolerance: Column, order: str = "ord") -> DataFrame:
    """rows with match: the row of table (ord, reading, ...) at the least edit distance within its tolerance, the first of equal ones; null if none.

    Up to SMALL phrases are one array of the plan. A longer list is looked up through an index:
    strings within distance t have a string in common that is left when up to t characters of
    each go. So distinct keys and phrases meet by equality, and only those pairs are measured.
    Where a tolerance is over INDEXED, that index would be too wide: the phrases go over the
    rows in blocks of SMALL. Null keys and readings match nothing.
    """
    names = table.columns
    n = table.limit(SMALL + 1).count()
    if n <= SMALL:
        return rows.withColumn("match", _of_few(key, table.orderBy(order).collect(), table, tolerance, order))
    own = table.where(F.col("reading").isNotNull()).withColumn("_t", F.coalesce(tolerance_of(F.col("reading"), tolerance).cast("int"), F.lit(-1))).where("_t >= 0")
    most = own.agg(F.max("_t")).first()[0] or 0
    if most > INDEXED:
        out = rows.withColumn("match", F.lit(None).cast(_match_type(table, order)))
        parts = -(-table.count() // SMALL)
        for k in range(parts):  # a stated list of phrases against all rows, in blocks
            block = table.where(F.pmod(F.xxhash64(order, "reading"), F.lit(parts)) == k).collect()
            out = out.withColumn("match", F.array_min(F.array_compact(F.array("match", _of_few(key, block, table, tolerance, order).cast(_match_type(table, order))))))
        return out
    left = _deletions(F.col("reading"), most)
    index = own.select("_t", F.struct(F.col(order).alias("_o"), F.struct(*names).alias("e")).alias("_e"), F.explode(F.get(F.array(*left), F.col("_t"))).alias("_left"))
    keyed = rows.withColumn("_key", key)
    asked = keyed.select("_key").where(F.col("_key").isNotNull()).distinct()
    met = asked.select("_key", F.explode(_deletions(F.col("_key"), most)[-1]).alias("_left")).join(index, "_left")
    distance = F.levenshtein(F.col("_key"), F.col("_e.e.reading")).alias("distance")
    best = met.select("_key", "_t", distance, "_e").where(F.col("distance") <= F.col("_t"))
    best = best.groupBy("_key").agg(F.min(F.struct("distance", F.col("_e._o").alias("_o"), F.col("_e.e").alias("e"))).alias("match"))
    return keyed.join(best, "_key", "left").drop("_key").select(*rows.columns, "match")


def _match_type(table: DataFrame, order: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    return f"struct<distance:int,_o:{kinds[order]},e:struct<{','.join(f'{n}:{t}' for n, t in kinds.items())}>>"


def _of_few(key: Column, entries: list, table: DataFrame, tolerance, order: str) -> Column:
    """The nearest of a few phrases, as one array of the plan."""
    kinds = {f.name: f.dataType for f in table.schema}
    literal = F.array(*[F.struct(*[F.lit(e[n]).cast(kinds[n]).alias(n) for n in table.columns]) for e in entries])
    scored = F.transform(literal, lambda e: F.struct(F.levenshtein(key, e["reading"]).alias("distance"), e[order].alias("_o"), e.alias("e")))
    return F.array_min(F.filter(scored, lambda s: s["distance"] <= tolerance_of(s["e"]["reading"], tolerance)))


def tolerance_of(reading: Column, tolerance) -> Column:
    return tolerance(F.length(reading)) if callable(tolerance) else F.lit(tolerance)
