"""Dictionaries: profiles of entries that are made from the tables of parts, customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionary import relaxed_json
from ..operators import dictionary as d

#: The tables of the operators, in SQL that both engines read; a name in braces is a given table.
_TABLES = {
    "entries": """select 'p' || (p_partkey % 5) as profile, cast(p_partkey as int) as ord,
      case when p_partkey % 11 = 0 then '' when p_partkey % 11 = 1 then ' ' || p_name || ' ' when p_partkey % 11 = 2 then left(p_name, 1) else p_name || ' ' || (p_partkey % 8) end as observed,
      case when p_partkey % 17 = 0 then repeat(p_name, 40) when p_partkey % 13 = 0 then p_name || ' ' || (p_partkey % 8) when p_partkey % 3 = 0 then p_type else p_name || ' ' || ((p_partkey + 3) % 8) end as output,
      p_partkey % 9 <> 4 as enabled, p_partkey % 6 = 0 as hotword, cast(p_partkey % 4 as int) as priority, case when p_partkey % 19 = 0 then repeat(p_name, 300) else '' end as note from {part}""",
    "profiles": "select case when r_regionkey = 4 then 'Bad Id' else 'p' || r_regionkey end as profile, case when r_regionkey = 3 then 2 else 1 end as schema_version, case when r_regionkey = 2 then ' ' else r_name end as name, repeat(r_name, r_regionkey * 40) as description from {region}",
    "symbols": "select 'p' || n_regionkey as profile, n_nationkey as ord, case when n_nationkey % 7 = 0 then '' else 's' || (n_nationkey % 4) end as symbol, case when n_nationkey % 5 = 0 then '改行' else n_name end as output from {nation}",
    "words": "select 'p' || (c_custkey % 5) as profile, case when c_custkey % 3 = 0 then 'hotword' else 'hallucination' end as kind, cast(c_custkey as int) as ord, case when c_custkey % 8 = 0 then ' ' else c_mktsegment || (c_custkey % 20) end as word from {customer}",
    "sets": "select 'payments' as set_id, r_regionkey as ord, 'p' || r_regionkey as profile from {region} where r_regionkey in (0, 1, 3) union all select 'default', 0, 'p0' from {region} where r_regionkey = 0",
    "requests": """select 'p' || (p_partkey % 6) as profile, case p_partkey % 4 when 0 then p_name || ' ' || (p_partkey % 8) when 1 then ' ' || p_name when 2 then '' else 'new ' || p_partkey end as observed,
      case when p_partkey % 7 = 0 then repeat(p_type, 60) else p_type end as output, case when p_partkey % 5 = 0 then cast(null as {string}) when p_partkey % 5 = 1 then 'old' else 'r' || (p_partkey % 6) end as revision from {part}""",
    "revisions": "select 'p' || r_regionkey as profile, 'r' || r_regionkey as revision from {region}",
    "changes": "select profile, observed, max(output) as output from (select 'p' || (p_partkey % 5) as profile, p_name || ' ' || (p_partkey % 8) as observed, 'new ' || p_partkey as output from {part} where p_partkey % 5 in (1, 2)) t group by profile, observed",
    "pairs": "select case when s_suppkey % 5 = 0 then '  ' else ' ' || s_name || ' ' end as key, repeat(s_name, cast(s_suppkey % 9 as int)) as value from {supplier}",
    "groups": "select p_partkey as ord, p_type || ' ' || (p_partkey % 9) as value, p_name as keys from {part}",
    "many_sets": "select 's' || (s_suppkey % 3) as set_id, s_suppkey as ord, 'p' || (s_suppkey % 5) as profile from {supplier}",
    "legacy": "select p_brand as profile, p_name as k, max(p_type) as v from {part} group by p_brand, p_name",
    "jsons": """select p_partkey, p_name, p_size, case p_partkey % 3 when 0 then concat('{{"a": ', p_size, ', "b": "http://', p_name, '"}}') when 1 then concat('{{', chr(10), '  "a": ', p_size, ', // one', chr(10), '  "b": "', p_name, '"', chr(10), '  "c": "y",', chr(10), '}}') else p_name end as raw from {part}""",
}
_GIVEN = ("part", "region", "nation", "customer", "supplier")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_TABLES[name].format(string="string", **{g: f"parquet.`{sf_dir}/{g}.parquet`" for g in _GIVEN}))


def compile_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(spark, sf_dir).select("place", "observed", "output", "profile")


def _compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.longest_first(d.replacements(_t(spark, sf_dir, "entries"), _t(spark, sf_dir, "sets"), "payments"))


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.hotwords(*(_t(spark, sf_dir, n) for n in ("entries", "words", "sets")), "payments")


def reverse_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.reverse(_t(spark, sf_dir, "entries"), _t(spark, sf_dir, "sets"), "payments")


def override_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.overrides(_t(spark, sf_dir, "entries"), _t(spark, sf_dir, "sets"), "payments").select("code", "observed", "was_profile", "was", "profile", "output")


def hotword_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir)


def prompt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.prompt(_hot(spark, sf_dir), _compiled(spark, sf_dir), 50, 4000)


def hallucination_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.hallucinations(_t(spark, sf_dir, "words"), _t(spark, sf_dir, "sets"), "payments")


def symbol_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.symbol_map(_t(spark, sf_dir, "symbols"), _t(spark, sf_dir, "sets"), "payments", ("改行",))


def replacement_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.cycle_members(_t(spark, sf_dir, "entries"))


def profile_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.diagnostics(*(_t(spark, sf_dir, n) for n in ("profiles", "entries", "symbols", "words")))


def diagnostic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.warning_count(profile_diagnostics(spark, sf_dir)).select("n", F.size("shown").alias("shown"))


def profile_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.catalog(*(_t(spark, sf_dir, n) for n in ("profiles", "entries", "symbols", "words")), profile_diagnostics(spark, sf_dir)).drop("name")


def content_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", d.revision(F.col("text")).alias("revision"))


def append_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.appended(*(_t(spark, sf_dir, n) for n in ("entries", "requests", "revisions")))


def merge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.merged(_t(spark, sf_dir, "entries"), _t(spark, sf_dir, "changes")).select("profile", "ord", "observed", "output", "enabled")


def map_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.valid_map(_t(spark, sf_dir, "pairs"))


def grouped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.grouped_by_value(_t(spark, sf_dir, "groups").withColumnRenamed("keys", "key"))


def flattened_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.flattened(_t(spark, sf_dir, "groups"), F.split("keys", " "))


def write_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.target(_t(spark, sf_dir, "many_sets"), _t(spark, sf_dir, "revisions"), "s1")


def legacy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("k", "v")))
    return d.from_legacy(_t(spark, sf_dir, "legacy").groupBy("profile").agg(F.map_from_entries(pairs).alias("replacements"))).select("profile", "ord", "observed", "output")


def json_with_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _t(spark, sf_dir, "jsons").select("p_partkey", relaxed_json(F.col("raw"), "a int, b string, c string").alias("j"))
    return own.select("p_partkey", "j.a", "j.b", "j.c")


QUERIES = {f.__name__: f for f in (compile_set, reverse_dict, override_warnings, hotword_ranks, prompt_prefix, hallucination_set, symbol_map, replacement_cycles, profile_diagnostics, diagnostic_counts, profile_catalog, content_revisions, append_entries, merge_entries, map_validation, grouped_values, flattened_groups, write_target, legacy_entries, json_with_comments)}

_SQL = ", ".join(f"{n} as ({t.format(string='varchar', **{g: g for g in _GIVEN})})" for n, t in _TABLES.items())
_OWN = f"""{_SQL},
own as (select e.*, trim(observed) as key, s.ord as p from entries e join sets s on s.profile = e.profile and s.set_id = 'payments' where enabled),
rep as (select key as observed, arg_max(output, (p, ord)) as output, arg_max(profile, (p, ord)) as profile, min((p, ord)) as first from own group by key),
ranked as (select *, row_number() over (order by length(observed) desc, first) as place from rep),
hot as (select priority, p, ord * 2 + k as o, case k when 0 then output else key end as word from own, (values (0), (1)) x(k) where hotword
  union all select 10000, s.ord, w.ord, word from words w join sets s on s.profile = w.profile and s.set_id = 'payments' where kind = 'hotword'),
once as (select word, min((-priority, -p, o)) as rank from hot where word <> '' group by word),
hotwords as (select word, row_number() over (order by rank) as place from once)"""
_DIAGNOSED = f"""{_SQL},
nonblank as (select * from entries where trim(observed) <> '' and length(observed) <= 128),
ok as (select * from nonblank where length(output) <= 256),
live as (select profile, ord, trim(observed) as observed, output from ok where enabled),
seen as (select *, first(output) over w as first_output, row_number() over w as again from live window w as (partition by profile, observed order by ord)),
links as (select profile, ord, observed, output from seen where again = 1),
reach(profile, origin, here) as (select profile, observed, output from links union select r.profile, r.origin, l.output from reach r join links l on l.profile = r.profile and l.observed = r.here),
found as (
  select profile, 'error' as severity, 'profile.schema-version' as code, null::int as entry, null::varchar as detail from profiles where schema_version <> 1
  union all select profile, 'error', 'profile.id', null, null from profiles where not regexp_full_match(profile, '[a-z0-9][a-z0-9._-]{{0,63}}')
  union all select profile, 'error', 'profile.name', null, null from profiles where trim(name) = '' or length(name) > 80
  union all select profile, 'error', 'profile.description', null, null from profiles where length(description) > 500
  union all select profile, 'error', 'entries.limit', null, null from entries group by profile having count(*) > 20000
  union all select profile, 'error', 'entry.observed', ord, null from entries where trim(observed) = '' or length(observed) > 128
  union all select profile, 'error', 'entry.output', ord, null from nonblank where length(output) > 256
  union all select profile, 'error', 'entry.note', ord, null from ok where length(note) > 1000
  union all select profile, 'warning', 'entry.duplicate', ord, observed from seen where again > 1 and first_output = output
  union all select profile, 'error', 'entry.conflict', ord, observed from seen where again > 1 and first_output <> output
  union all select profile, 'warning', 'entry.identity', ord, observed from live where observed = output
  union all select profile, 'warning', 'entry.too-short', ord, observed from live where length(observed) = 1
  union all select profile, 'warning', 'entry.cycle', ord, observed from links where (profile, observed) in (select (profile, origin) from reach where origin = here)
  union all select profile, 'error', 'symbols.limit', null, null from symbols group by profile having count(*) > 2000
  union all select profile, 'error', 'symbols.key', null, null from symbols where trim(symbol) = '' or length(symbol) > 128
  union all select profile, 'error', 'symbols.value', null, null from symbols where length(output) > 256
  union all select profile, 'error', kind || 's.limit', null, null from words group by profile, kind having count(*) > 2000
  union all select profile, 'error', kind || 's.value', ord, null from words where trim(word) = '' or length(word) > 256)"""
_count = lambda t, where="true": f"coalesce((select count(*) from {t} x where x.profile = p.profile and {where}), 0)"
ORACLE_SQL = {
    "compile_set": f"with {_OWN} select place, observed, output, profile from ranked",
    "reverse_dict": f"with {_OWN} select output, observed, row_number() over (order by length(output) desc, place) as place from ranked where output <> '' and observed <> ''",
    "override_warnings": f"with {_OWN}, l as (select *, lag(output) over w as was, lag(profile) over w as was_profile from own window w as (partition by key order by p, ord)) select 'set.replacement-override' as code, key as observed, was_profile, was, profile, output from l where was <> output",
    "hotword_ranks": f"with {_OWN} select word, place from hotwords",
    "prompt_prefix": f"""with {_OWN}, all_words as (select 0 as part, place as p, 0 as k, word from hotwords union all select 1, place, k, case k when 0 then output else observed end from ranked, (values (0), (1)) x(k)),
      good as (select word, min((part, p, k)) as rank, min(part) as part from all_words where part = 0 or length(word) >= 2 group by word),
      n as (select word, rank, part, row_number() over (order by rank) as n from good),
      held as (select *, sum(length(word) + 1) over (order by rank) - 1 as total from n where part = 0 or n <= 50 or rank = (1, 1, 0)),
      k as (select * from held where n < coalesce((select min(n) from held where total > 4000), 1000000))
      select string_agg(word, ' ' order by n) as prompt from k""",
    "hallucination_set": f"with {_SQL} select distinct word from words w join sets s on s.profile = w.profile and s.set_id = 'payments' where kind = 'hallucination'",
    "symbol_map": f"with {_SQL}, b as (select symbol, arg_max(output, (s.ord, y.ord)) as output from symbols y join sets s on s.profile = y.profile and s.set_id = 'payments' group by symbol) select symbol, case when output = '改行' then chr(10) else output end as output from b",
    "replacement_cycles": f"with recursive {_SQL}, l as (select observed as a, max(output) as b from entries group by observed), w(origin, here) as (select a, b from l union select origin, l.b from w join l on l.a = w.here) select origin as observed from w where origin = here",
    "profile_diagnostics": f"with recursive {_DIAGNOSED} select * from found",
    "diagnostic_counts": f"with recursive {_DIAGNOSED} select count(*) as n, least(count(*), 100) as shown from found where severity = 'warning'",
    "profile_catalog": f"with recursive {_DIAGNOSED} select profile, {_count('entries')} as entries, {_count('symbols')} as symbols, {_count('words', chr(34) + 'kind' + chr(34) + ' = ' + chr(39) + 'hotword' + chr(39))} as hotwords, {_count('words', 'kind <> ' + chr(39) + 'hotword' + chr(39))} as hallucinations, {_count('found', 'severity = ' + chr(39) + 'error' + chr(39))} as errors from profiles p",
    "content_revisions": "select doc_id, left(sha256(text), 16) as revision from documents",
    "append_entries": f"""with {_SQL}, h as (select profile, trim(observed) as observed, arg_min(output, ord) as have from entries where enabled group by all),
      q as (select r.profile, trim(r.observed) as observed, r.output, r.revision, v.revision as current from requests r left join revisions v using (profile))
      select q.profile, q.observed, case when current is null or coalesce(q.revision <> current, false) then 'conflict' when have = output then 'exists' when have is not null then 'conflict' when q.observed = '' or length(q.observed) > 128 or length(output) > 256 then 'invalid' else 'created' end as status from q left join h on h.profile = q.profile and h.observed = q.observed""",
    "merge_entries": f"""with {_SQL}, mine as (select * from entries where profile in (select profile from changes)), last as (select profile, max(ord) as last from mine group by profile),
      fresh as (select c.*, row_number() over (partition by c.profile order by c.observed) as k from changes c where not exists (select 1 from mine m where m.enabled and m.profile = c.profile and m.observed = c.observed))
      select profile, ord, observed, output, enabled from entries where profile not in (select profile from changes)
      union all select profile, ord, observed, output, enabled from mine where not enabled
      union all select m.profile, m.ord, m.observed, c.output, m.enabled from mine m join changes c on m.enabled and m.profile = c.profile and m.observed = c.observed
      union all select f.profile, l.last + k, f.observed, f.output, true from fresh f join last l on l.profile = f.profile""",
    "map_validation": f"with {_SQL}, t as (select trim(key) as key, value from pairs where trim(key) <> '') select key, value, length(key) <= 64 and length(value) <= 128 and (select count(*) from t) <= 500 as ok from t",
    "grouped_values": f"with {_SQL} select min(ord) as ord, value, string_agg(keys, '、' order by ord, keys) as keys from groups group by value",
    "flattened_groups": f"with {_SQL}, u as (select ord, value, unnest(string_split(keys, ' ')) as key, generate_subscripts(string_split(keys, ' '), 1) as k from groups) select key, arg_max(value, (ord, k)) as value, count(*) as n from u group by key",
    "write_target": f"with {_SQL}, l as (select arg_max(profile, ord) as profile from many_sets where set_id = 's1') select profile, revision from l join revisions using (profile)",
    "legacy_entries": f"with {_SQL} select profile, row_number() over (partition by profile order by k) - 1 as ord, k as observed, v as output from legacy",
    "json_with_comments": f"with {_SQL} select p_partkey, case when p_partkey % 3 < 2 then p_size end as a, case p_partkey % 3 when 0 then 'http://' || p_name when 1 then p_name end as b, case when p_partkey % 3 = 1 then 'y' end as c from jsons",
}
