"""Operators at the sizes they are meant for: long dictionaries, rings and ranges, phrase tables, and searches backwards through whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands, dictionary, joins, keywords, reconvert
from .base import TIMED, table, timed


def _words(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """(conv_id, turn, word): the lower-case words of the conversations' whole texts."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least},}}"), F.lit(0))).alias("word"))
    return own


def replace_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with every word that the conversations have replaced: thousands of keys, many of them within others."""
    keys = _words(spark, sf_dir, 4).select(F.col("word").alias("observed")).distinct().withColumn("output", F.concat(F.lit("<"), F.upper("observed"), F.lit(">")))
    own = keywords.with_replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), keys)
    return own.select("doc_id", F.md5("text").alias("md5"))


def keyword_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a long word of the conversations."""
    return joins.with_keyword(table(spark, sf_dir, "documents"), _words(spark, sf_dir, 12).select("word").distinct()).select("doc_id")


def cycle_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of parts: in even blocks of 97 a ring, in odd ones a chain into the next block."""
    k = F.col("p_partkey")
    ring = (F.floor(k / 97) % 2 == 0) & (k % 97 == 96)
    links = table(spark, sf_dir, "part").select(k.cast("string").alias("observed"), F.when(ring, k - 96).otherwise(k + 1).cast("string").alias("output"))
    return dictionary.cycle_members(links)


def overlap_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from a second to months, each with those of its user that it overlaps."""
    own = timed(spark, sf_dir).select("user_id", "event_id", (F.col("us") / 1e6).alias("start"), (F.col("us") / 1e6 + F.pow(F.lit(6.0), F.col("event_id") % 10)).alias("end"))
    left, right = own.where("event_id % 2 = 0").withColumnRenamed("event_id", "a"), own.where("event_id % 2 = 1").select("user_id", F.col("event_id").alias("b"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = joins.overlaps(left, right, "user_id", cell=1.0)
    return pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("first"), F.max("b").alias("last"))


def nearest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each word of the answers the nearest word of the questions."""
    own = _words(spark, sf_dir, 5)
    phrases = own.where("turn % 2 = 0").select(F.col("word").alias("reading")).distinct().withColumn("ord", F.col("reading"))
    asked = own.where("turn % 2 = 1").select("word").distinct()
    found = joins.nearest(asked, F.col("word"), phrases, lambda n: F.when(n <= 6, 1).otherwise(2))
    return found.select("word", F.col("match.e.reading").alias("phrase"), F.col("match.distance").alias("distance"))


#: Texts that end in a command's rest after a word of their own, so that the last occurrence is an echo.
_ECHOED = "concat_ws(' ', text, case when doc_id % 3 = 0 then 'theを修正 ofを再変換' when doc_id % 3 = 1 then 'andを言い直し' end)"
_SOUGHT = ("the", "and", " of", "zq")


def safe_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ECHOED).alias("t"))
    own = own.select("doc_id", reconvert.last_surface(F.col("t"), F.array(*map(F.lit, _SOUGHT)), 60, F.length("t") - F.col("doc_id") % 50).alias("r"))
    return own.select("doc_id", "r.at", "r.surface")


def last_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was said stands there, or else one of its surfaces."""
    said = F.element_at(F.array(*map(F.lit, ("ther", "zqx", "anin", "qqq"))), (F.col("doc_id") % 4 + 1).cast("int"))
    parts = F.array(F.array(F.lit("t"), F.lit("a")), F.array(F.lit("h"), F.lit("n"), F.lit("zz")))
    own = table(spark, sf_dir, "documents").select("doc_id", reconvert.last_target(F.expr(_ECHOED), said, parts, 300).alias("r"))
    return own.select("doc_id", "r.at", "r.surface")


QUERIES = {f.__name__: f for f in (replace_dictionary, keyword_documents, cycle_rings, overlap_lengths, nearest_words, safe_surfaces, last_targets)}

_REST = f"^({'|'.join(commands.COMMAND_RESTS)})"
_WORDS = "select conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{%d,}')) as word from conversations"


def _last_sql(source: str) -> str:
    """CTEs after source (doc_id, part, skipped, whole, options): r (doc_id, at, surface). Occurrences come from splitting at each option."""
    return f"""{source},
tries as (select doc_id, 1 as turn, part as t, skipped, options from b union all select doc_id, 2, whole, 0, options from b union all select doc_id, 3, whole, 0, options from b),
o as (select * exclude (options), unnest(options) as o, unnest(range(len(options))) as i from tries),
p as (select *, string_split(t, o) as p from o where o <> ''),
k as (select *, list_max(list_filter(range(1, len(p)), lambda k: turn = 3 or not regexp_matches(p[k + 1], '{_REST}'))) as k from p),
a as (select doc_id, turn, o, i, list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(o) + skipped as place from k where k is not null),
w as (select *, row_number() over (partition by doc_id order by turn, place desc, i) as rank from a)
select b.doc_id, w.place::int as "at", w.o as surface from b left join w on w.doc_id = b.doc_id and w.rank = 1"""


_BASE = f"with m as (select doc_id, {_ECHOED} as t from documents)"
ORACLE_SQL = {
    "keyword_documents": f"with w as ({_WORDS % 12}), d as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as x from documents), s as (select distinct doc_id, x from d where length(x) >= 12) select distinct doc_id from s join (select distinct word from w) on contains(x, word)",
    "cycle_rings": "with recursive l as (select p_partkey as a, case when p_partkey // 97 % 2 = 0 and p_partkey % 97 = 96 then p_partkey - 96 else p_partkey + 1 end as b from part), w(origin, here) as (select a, b from l union select origin, l.b from w join l on l.a = w.here and l.b // 97 = w.origin // 97) select origin::varchar as observed from w where here = origin",
    "overlap_lengths": f"with {TIMED}, s as (select event_id, user_id, us / 1e6 as a, us / 1e6 + pow(6, event_id % 10) as z from e) select l.event_id as a, count(*) as n, min(r.event_id) as first, max(r.event_id) as last from s l join s r on l.user_id = r.user_id and l.event_id % 2 = 0 and r.event_id % 2 = 1 and least(l.z, r.z) - greatest(l.a, r.a) > 0 group by 1",
    "nearest_words": f"with w as ({_WORDS % 5}), q as (select distinct word as phrase, case when length(word) <= 6 then 1 else 2 end as t from w where turn % 2 = 0), x as (select distinct word from w where turn % 2 = 1), d as (select word, phrase, levenshtein(word, phrase) as d, t from x join q on length(phrase) between length(word) - 2 and length(word) + 2), f as (select word, min({{'d': d, 'phrase': phrase}}) as m from d where d <= t group by 1) select x.word, m.phrase as phrase, m.d::int as distance from x left join f using (word)",
    "safe_surfaces": _last_sql(f"{_BASE}, n as (select *, greatest(0, length(t) - doc_id % 50) as stop, greatest(0, length(t) - 60) as skipped from m), b as (select doc_id, skipped, substr(t, skipped + 1, greatest(0, least(length(t), stop) - skipped)) as part, left(t, stop) as whole, ['the', 'and', ' of', 'zq'] as options from n)"),
    "last_targets": _last_sql(f"{_BASE}, n as (select *, ['ther', 'zqx', 'anin', 'qqq'][doc_id % 4 + 1] as said, greatest(0, length(t) - 300) as skipped from m), b as (select doc_id, skipped, substr(t, skipped + 1) as part, t as whole, case when contains(t, said) then [said] else [said, 'th', 'tn', 'tzz', 'ah', 'an', 'azz'] end as options from n)"),
}
