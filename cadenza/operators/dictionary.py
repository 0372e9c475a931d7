"""Dictionaries: profiles of entries, merged into snapshots, with diagnostics.

Tables: profiles (profile, schema_version, name, description), entries (profile, ord, observed,
output, enabled, hotword, priority, note), symbols (profile, ord, symbol, output), words
(profile, kind, ord, word) for hot words and hallucinations, sets (set_id, ord, profile).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..sources.scratch import stored

#: Limits of a profile.
MOST_ENTRIES, MOST_SYMBOLS, MOST_WORDS, MOST_OBSERVED, MOST_OUTPUT, MOST_NOTE, EXPLICIT = 20_000, 2_000, 2_000, 128, 256, 1_000, 10_000


def active(entries: DataFrame) -> DataFrame:
    return entries.where(F.coalesce("enabled", F.lit(True))).withColumn("observed", stripped(F.col("observed")))


def in_set(table: DataFrame, sets: DataFrame, set_id: str) -> DataFrame:
    """The rows of a set's profiles, with profile_ord: its place in the set. A set is small."""
    own = sets.where(F.col("set_id") == set_id).select("profile", F.col("ord").alias("profile_ord"))
    return table.join(own, "profile")


def replacements(entries: DataFrame, sets: DataFrame, set_id: str) -> DataFrame:
    """(observed, output, profile, first): each key once, of the last profile and entry that has it; first is the place of its first sight."""
    own = active(in_set(entries, sets, set_id))
    by = Window.partitionBy("observed").orderBy(F.desc("profile_ord"), F.desc("ord"))
    first = F.min(F.struct("profile_ord", "ord")).over(Window.partitionBy("observed"))
    return own.withColumn("rank", F.row_number().over(by)).withColumn("first", first).where("rank = 1").select("observed", "output", "profile", "first")


def longest_first(table: DataFrame, key: str = "observed") -> DataFrame:
    """With place: 1 for the longest key; of equal lengths the one that was seen first."""
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.length(key)), "first")))


def reverse(entries: DataFrame, sets: DataFrame, set_id: str) -> DataFrame:
    """(output, observed, place): the longest output first, of equal lengths in the order of the keys."""
    own = longest_first(replacements(entries, sets, set_id)).where("output <> '' and observed <> ''")
    return own.select("output", "observed", F.row_number().over(Window.orderBy(F.desc(F.length("output")), "place")).alias("place"))


def overrides(entries: DataFrame, sets: DataFrame, set_id: str) -> DataFrame:
    """A warning for each entry that changes what an earlier one gave."""
    by = Window.partitionBy("observed").orderBy("profile_ord", "ord")
    own = active(in_set(entries, sets, set_id)).withColumns({"was": F.lag("output").over(by), "was_profile": F.lag("profile").over(by)}).where("was <> output")
    return own.select(F.lit("warning").alias("severity"), F.lit("set.replacement-override").alias("code"), "observed", "was_profile", "was", "profile", "output")


def hotwords(entries: DataFrame, words: DataFrame, sets: DataFrame, set_id: str) -> DataFrame:
    """(word, place): by priority, later profiles first, then order; each word once. Explicit words rank as 10000."""
    own = active(in_set(entries, sets, set_id)).where(F.coalesce("hotword", F.lit(False)))
    pair = F.posexplode(F.array("output", "observed")).alias("k", "word")
    of_entries = own.select(F.coalesce("priority", F.lit(0)).alias("priority"), "profile_ord", "ord", pair).select("priority", "profile_ord", (F.col("ord") * 2 + F.col("k")).alias("ord"), "word")
    explicit = in_set(words.where("kind = 'hotword'"), sets, set_id).select(F.lit(EXPLICIT).alias("priority"), "profile_ord", "ord", "word")
    order = (F.desc("priority"), F.desc("profile_ord"), F.col("ord"))
    ranked = of_entries.union(explicit).where("word <> ''").withColumn("again", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where("again = 1")
    return ranked.select("word", F.row_number().over(Window.orderBy(*order)).alias("place"))


def prompt(preferred: DataFrame, items: DataFrame, limit: int = 50, chars: int = 90) -> DataFrame:
    """One row (prompt): preferred words, then the items' output and key of two or more characters up to `limit` words in all; each once, joined by blanks up to the first word that would pass `chars`.

    preferred: (word, place); items: (observed, output, place).
    """
    first = preferred.where("word <> ''").select(F.lit(0).alias("part"), F.col("place").alias("p"), F.lit(0).alias("k"), "word", F.lit(True).alias("always"))
    second = items.select(F.lit(1).alias("part"), F.col("place").alias("p"), F.posexplode(F.array("output", "observed")).alias("k", "word"))
    second = second.withColumn("always", (F.col("k") == 0) & (F.col("p") == F.min("p").over(Window.partitionBy()))).where(F.length("word") >= 2)
    order = ("part", "p", "k")
    once = first.union(second).withColumn("again", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where("again = 1")
    all_ = Window.orderBy(*order)
    # the limit is looked at after each word: preferred words are never cut, nor is the first item's output
    numbered = once.withColumn("n", F.row_number().over(all_)).where(F.col("always") | (F.col("n") <= limit))
    sized = numbered.withColumn("total", F.sum(F.length("word") + 1).over(all_) - 1)
    kept = sized.withColumn("over", F.max(F.col("total") > chars).over(all_)).where(~F.col("over"))
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]), " ").alias("prompt"))


def hallucinations(words: DataFrame, sets: DataFrame, set_id: str) -> DataFrame:
    return in_set(words.where("kind = 'hallucination'"), sets, set_id).select("word").distinct()


def symbol_map(symbols: DataFrame, sets: DataFrame, set_id: str, newline_words: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, output) of the last profile that has it; newline_words, if given, name a line break."""
    by = Window.partitionBy("symbol").orderBy(F.desc("profile_ord"), F.desc("ord"))
    own = in_set(symbols, sets, set_id).withColumn("rank", F.row_number().over(by)).where("rank = 1")
    output = F.when(F.col("output").isin(*newline_words), "\n").otherwise(F.col("output")) if newline_words else F.col("output")
    return own.select("symbol", output.alias("output"))


def cycle_members(table: DataFrame) -> DataFrame:
    """(observed) of the keys that lie on a cycle of replacements, of any length.

    By pointer doubling: after k rounds each key knows the one 2**k steps on, or that its chain
    ended. What is still reached once that set stays the same are the cycles; a ring of n keys
    and chains of n keys into it take log2(n) joins. Null keys and outputs end a chain; of
    equal keys the largest output counts.
    """
    links = table.where("observed is not null").groupBy("observed").agg(F.max("output").alias("to"))
    links = stored(links.join(links.select(F.col("observed").alias("to")), "to", "left_semi").select("observed", "to"), "links")
    before = -1
    while True:
        reached = links.select(F.col("to").alias("observed")).distinct()
        n = reached.count()
        if n == before:
            return reached
        before = n
        on = links.select(F.col("observed").alias("to"), F.col("to").alias("next"))
        links = stored(links.join(on, "to").select("observed", F.col("next").alias("to")), "links")


def diagnostics(profiles: DataFrame, entries: DataFrame, symbols: DataFrame, words: DataFrame) -> DataFrame:
    """(profile, severity, code, entry, detail): every broken rule of every profile."""

    def rule(table: DataFrame, bad: Column, code: str, severity: str = "error", entry: Column | None = None, detail: Column | None = None) -> DataFrame:
        none = F.lit(None)
        return table.where(bad).select("profile", F.lit(severity).alias("severity"), F.lit(code).alias("code"), (entry if entry is not None else none).cast("int").alias("entry"), (detail if detail is not None else none).cast("string").alias("detail"))

    c, at = F.col, F.col("ord")
    empty = lambda col: F.coalesce(stripped(c(col)) == "", F.lit(True))
    ok = entries.where(~empty("observed") & (F.length("observed") <= MOST_OBSERVED) & (F.length("output") <= MOST_OUTPUT))
    own = active(ok)
    first = F.first("output").over(Window.partitionBy("profile", "observed").orderBy("ord"))
    place = F.row_number().over(Window.partitionBy("profile", "observed").orderBy("ord"))
    seen = own.withColumns({"first_output": first, "again": place})
    links = seen.where("again = 1").select("profile", "ord", F.concat_ws("\u0001", "profile", "observed").alias("observed"), F.concat_ws("\u0001", "profile", "output").alias("output"), c("observed").alias("name"))
    cyclic = links.join(cycle_members(links), "observed").withColumn("observed", c("name"))
    count = lambda t: t.groupBy("profile").count()
    parts = [
        rule(profiles, F.coalesce(c("schema_version") != 1, F.lit(True)), "profile.schema-version"),
        rule(profiles, ~F.coalesce(c("profile").rlike(r"^[a-z0-9][a-z0-9._-]{0,63}\z"), F.lit(False)), "profile.id"),
        rule(profiles, empty("name") | (F.length("name") > 80), "profile.name"),
        rule(profiles, F.length("description") > 500, "profile.description"),
        rule(count(entries), c("count") > MOST_ENTRIES, "entries.limit"),
        rule(entries, empty("observed") | (F.length("observed") > MOST_OBSERVED), "entry.observed", entry=at),
        rule(entries.where(~empty("observed") & (F.length("observed") <= MOST_OBSERVED)), F.coalesce(F.length("output") > MOST_OUTPUT, F.lit(True)), "entry.output", entry=at),
        rule(ok, F.length("note") > MOST_NOTE, "entry.note", entry=at),
        rule(seen, (c("again") > 1) & (c("first_output") == c("output")), "entry.duplicate", "warning", at, c("observed")),
        rule(seen, (c("again") > 1) & (c("first_output") != c("output")), "entry.conflict", "error", at, c("observed")),
        rule(own, c("observed") == c("output"), "entry.identity", "warning", at, c("observed")),
        rule(own, F.length("observed") == 1, "entry.too-short", "warning", at, c("observed")),
        rule(cyclic, F.lit(True), "entry.cycle", "warning", at, c("observed")),
        rule(count(symbols), c("count") > MOST_SYMBOLS, "symbols.limit"),
        rule(symbols, empty("symbol") | (F.length("symbol") > MOST_OBSERVED), "symbols.key"),
        rule(symbols, F.coalesce(F.length("output") > MOST_OUTPUT, F.lit(True)), "symbols.value"),
        *(rule(count(words.where(c("kind") == k)), c("count") > MOST_WORDS, f"{k}s.limit") for k in ("hotword", "hallucination")),
        *(rule(words.where(c("kind") == k), empty("word") | (F.length("word") > MOST_OUTPUT), f"{k}s.value", entry=at) for k in ("hotword", "hallucination")),
    ]
    return reduce(DataFrame.union, parts)


def warning_count(found: DataFrame, shown: int = 100) -> DataFrame:
    """(n, shown): warnings, and the first of them."""
    own = found.where("severity = 'warning'")
    first = own.orderBy("profile", "code", "entry").limit(shown).agg(F.array_sort(F.collect_list(F.struct("profile", "code", "entry", "detail"))).alias("shown"))
    return own.agg(F.count("*").alias("n")).crossJoin(first)


def revision(canonical: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a canonical JSON text."""
    return F.substring(F.sha2(canonical, 256), 1, 16)


def catalog(profiles: DataFrame, entries: DataFrame, symbols: DataFrame, words: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each profile, broken ones too: counts of entries, symbols, words and errors."""

    def counted(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("profile").agg(F.count("*").alias(name))

    parts = [counted(entries, "entries"), counted(symbols, "symbols"), counted(words.where("kind = 'hotword'"), "hotwords"), counted(words.where("kind = 'hallucination'"), "hallucinations"), counted(found.where("severity = 'error'"), "errors")]
    out = reduce(lambda a, b: a.join(b, "profile", "left"), parts, profiles.select("profile", "name"))
    return out.na.fill(0, ["entries", "symbols", "hotwords", "hallucinations", "errors"])


def merged(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after an update by (profile, observed, output): given keys change or are appended, enabled keys that aren't given go, disabled ones stay with all their fields."""
    key = ["profile", "observed"]
    old = entries.join(new.select("profile").distinct(), "profile", "left_semi")
    rest = entries.join(new.select("profile").distinct(), "profile", "left_anti")
    kept = old.where(~F.coalesce("enabled", F.lit(True)))
    changed = old.where(F.coalesce("enabled", F.lit(True))).drop("output").join(new, key).select(*entries.columns)
    last = old.groupBy("profile").agg(F.max("ord").alias("last"))
    fresh = new.join(old.where(F.coalesce("enabled", F.lit(True))), key, "left_anti").join(last, "profile", "left")
    place = F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("profile").orderBy("observed"))
    values = {"ord": place, "enabled": F.lit(True), "hotword": F.lit(False), "priority": F.lit(0), "note": F.lit(None)}
    fresh = fresh.select(*[(values[c] if c in values else F.col(c)).cast(entries.schema[c].dataType).alias(c) for c in entries.columns])
    return rest.unionByName(kept.unionByName(changed)).unionByName(fresh)


def _status(requests: DataFrame, have: DataFrame, revisions: DataFrame, wrong: Column) -> DataFrame:
    """(profile, observed, status). have: (profile, observed, have)."""
    own = requests.withColumn("observed", stripped(F.col("observed"))).join(revisions.withColumnRenamed("revision", "current"), "profile", "left").join(have, ["profile", "observed"], "left")
    stale = F.col("current").isNull() | F.coalesce(F.col("revision") != F.col("current"), F.lit(False))
    status = F.when(stale, "conflict").when(F.col("have") == F.col("output"), "exists").when(F.col("have").isNotNull(), "conflict").when(wrong, "invalid").otherwise("created")
    return own.select("profile", "observed", status.alias("status"))


def _wrong() -> Column:
    return F.coalesce((F.col("observed") == "") | (F.length("observed") > MOST_OBSERVED) | (F.length("output") > MOST_OUTPUT), F.lit(True))


def appended(entries: DataFrame, requests: DataFrame, revisions: DataFrame) -> DataFrame:
    """(profile, observed, status) for each request (profile, observed, output, revision) to append an entry.

    conflict if its revision is given and stale, its profile is missing or another output is
    there; exists if the same one is; invalid if a length is out of bounds; else created. Only
    enabled entries count. revisions: (profile, revision).
    """
    have = active(entries).groupBy("profile", "observed").agg(F.min_by("output", "ord").alias("have"))
    return _status(requests, have, revisions, _wrong())


def appended_symbols(symbols: DataFrame, requests: DataFrame, revisions: DataFrame) -> DataFrame:
    """The same for symbols, which stand in a map of their own: a word of one letter is as good as any, as it counts only alone."""
    have = symbols.groupBy("profile", F.col("symbol").alias("observed")).agg(F.max_by("output", "ord").alias("have"))
    return _status(requests, have, revisions, _wrong())


def with_symbols(symbols: DataFrame, requests: DataFrame, revisions: DataFrame) -> DataFrame:
    """The table of symbols with those that were created behind each profile's others."""
    made = appended_symbols(symbols, requests, revisions).where("status = 'created'").select("profile", "observed").distinct()
    last = symbols.groupBy("profile").agg(F.max("ord").alias("last"))
    new = requests.withColumn("observed", stripped(F.col("observed"))).join(made, ["profile", "observed"]).groupBy("profile", "observed").agg(F.min("output").alias("output")).join(last, "profile", "left")
    place = F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("profile").orderBy("observed"))
    return symbols.unionByName(new.select("profile", place.cast(symbols.schema["ord"].dataType).alias("ord"), F.col("observed").alias("symbol"), "output"))


def valid_map(pairs: DataFrame, most: int = 500, key_length: int = 64, value_length: int = 128) -> DataFrame:
    """(key, value, ok): trimmed pairs without blank keys; too long or too many ones aren't ok."""
    own = pairs.select(stripped(F.col("key")).alias("key"), "value").where("key <> ''")
    n = F.count("*").over(Window.partitionBy())
    return own.withColumn("ok", (F.length("key") <= key_length) & (F.length("value") <= value_length) & (n <= most))


def grouped_by_value(pairs: DataFrame) -> DataFrame:
    """(value, keys): keys in their order, groups by first sight. pairs: (ord, key, value)."""
    own = pairs.groupBy("value").agg(F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"]).alias("keys"))
    return own.select("ord", "value", F.array_join("keys", "、").alias("keys"))


def flattened(groups: DataFrame, keys: Column) -> DataFrame:
    """(key, value, n): each key of each group; the last group wins a key that several have, and n says how many do."""
    own = groups.select("ord", "value", F.posexplode(keys).alias("k", "key"))
    by = Window.partitionBy("key")
    return own.withColumn("n", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("ord"), F.desc("k")))).where("rank = 1").select("key", "value", "n")


def target(sets: DataFrame, catalog_rows: DataFrame, set_id: str, writable: str | None = None) -> DataFrame:
    """(profile, revision): the set's writable profile, or its last one; no row if the set or the profile is missing."""
    own = sets.where(F.col("set_id") == set_id).agg(F.max_by("profile", "ord").alias("last")).where("last is not null")
    return own.select(F.coalesce(F.lit(writable), F.col("last")).alias("profile")).join(catalog_rows, "profile")


def from_legacy(raw: DataFrame) -> DataFrame:
    """(profile, ord, observed, output, enabled, hotword, priority, note) of legacy rows (profile, replacements map)."""
    own = raw.select("profile", F.posexplode(F.map_entries("replacements")).alias("ord", "e"))
    return own.select("profile", "ord", F.col("e.key").alias("observed"), F.col("e.value").alias("output"), F.lit(True).alias("enabled"), F.lit(False).alias("hotword"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("note"))
