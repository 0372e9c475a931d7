"""Recordings, tables and reports that are written and read back; the samples are the embeddings' components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..sources import files, pcm, recordings
from ..sources.scratch import folder
from .base import table, timed

#: Samples a second of these recordings.
_RATE = 64


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 vectors are the blocks of a session."""
    own = table(spark, sf_dir, "embeddings")
    return own.select(F.concat(F.lit("s"), F.floor(F.col("vec_id") / 16)).alias("session"), (F.col("vec_id") % 16 * 64).alias("pos"), pcm.floats_to_pcm16("embedding").alias("data"))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two parts, the second of which is appended."""
    path, own = folder(spark, "recordings"), _blocks(spark, sf_dir)
    recordings.append(own.where("pos < 512"), path)
    recordings.append(own.where("pos >= 512"), path)
    return recordings.load(spark, path)


def pcm_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as bytes, the server's and the client's way."""
    own = table(spark, sf_dir, "embeddings")
    return own.select("vec_id", F.lower(F.hex(pcm.floats_to_pcm16("embedding"))).alias("server"), F.lower(F.hex(pcm.floats_to_pcm16_by_client("embedding"))).alias("client"))


def pcm_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bytes read as one channel and as the mean of two."""
    data = pcm.floats_to_pcm16("embedding")
    own = table(spark, sf_dir, "embeddings").select("vec_id", pcm.pcm16_to_floats()(data).alias("one"), pcm.pcm16_to_floats(2)(data).alias("two"))
    return own.select("vec_id", F.posexplode(F.arrays_zip("one", "two")).alias("k", "x")).select("vec_id", "k", F.col("x.one").cast("double").alias("one"), F.col("x.two").cast("double").alias("two"))


def recording_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of one session that begin and end within blocks, before it and behind it."""
    own, out = _recorded(spark, sf_dir), None
    for start, end in ((1.5, 9.26), (-3.0, 0.5), (15.25, 99.0), (4.0, 4.0)):
        part = recordings.load_slice(own, "s3", start, end, _RATE).select(F.lit(start).alias("start"), "pos", F.lower(F.hex("data")).alias("data"))
        out = part if out is None else out.union(part)
    return out


def recording_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.durations(_recorded(spark, sf_dir), _RATE)


def sound_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound around one place of each session, without the file's header."""
    hunks = _blocks(spark, sf_dir).where("pos % 320 = 0").select("session", (F.col("pos") / 64 + 0.5).alias("at_sec"))
    own = recordings.clips(hunks, _recorded(spark, sf_dir), 1.0, 2.0, _RATE)
    return own.select("session", "at_sec", F.octet_length("wav").alias("bytes"), F.md5(F.lower(F.hex(F.expr("substring(wav, 45)")))).alias("md5"))


def recording_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to delete sessions, named by parts, of which some are there and some are open."""
    own = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.format_string("20240101-%06d", (F.col("p_partkey") % 50).cast("int")))
    there = own.select(F.format_string("20240101-%06d", (F.col("p_partkey") % 30).cast("int")).alias("session")).distinct()
    return recordings.deletions(own.select(name.alias("session")).distinct(), there, there.where("substring(session, -1) = '7'"))


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tsv")
    own = timed(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"), F.concat("event_type", F.lit("\t"), "user_id", F.lit("\n")).alias("note"))
    files.write_tsv(own, path)
    return files.read_tsv(spark, path, "event_id long, value double, note string")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice: the second set of rows replaces the first."""
    path, own = folder(spark, "json"), table(spark, sf_dir, "conversations")
    files.write_json(own.where("turn = 0"), path)
    files.write_json(own.where("turn > 0").select("conv_id", "turn", "text"), path)
    return spark.read.schema("conv_id long, turn long, text string").json(path).select("conv_id", "turn", F.md5("text").alias("md5"))


def reused_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second call reads what the first one wrote, and does not make it again."""
    path = folder(spark, "kinds")
    files.reused(lambda: timed(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")), spark, path)
    return files.reused(lambda: spark.createDataFrame([], "event_type string, n long"), spark, path)


def report_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir)
    kinds = own.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    hunks = own.where("value > 40").select(F.col("event_id").alias("at"), F.col("event_type").alias("kind"), F.lit("a").alias("live_left"), F.col("user_id").cast("string").alias("live"), F.lit("z").alias("live_right"))
    terms = own.groupBy(F.concat(F.lit("user "), "user_id").alias("term")).agg(F.count("*").alias("n"))
    return files.report_lines(kinds, hunks, terms).select("part", "line")


QUERIES = {f.__name__: f for f in (pcm_bytes, pcm_channels, recording_slices, recording_seconds, sound_clips, recording_deletions, tsv_round_trip, json_round_trip, reused_table, report_of_events)}

_hex = lambda x: f"printf('%02x%02x', ({x} + 65536) % 256, ({x} + 65536) // 256 % 256)"
_INTS = "i as (select vec_id, 's' || (vec_id // 16) as session, vec_id % 16 * 64 as pos, unnest(range(len(embedding))) as k, trunc(greatest(-1, least(1, unnest(embedding)))::float * 32767::float)::int as x, unnest(embedding)::double as v from embeddings)"
_slice = lambda a, z, start: f"select {start}::double as start, greatest(pos, {a}) as pos, string_agg({_hex('x')}, '' order by k) as data from i where session = 's3' and pos + k >= {a} and pos + k < {z} group by pos"
ORACLE_SQL = {
    "pcm_bytes": f"with {_INTS}, c as (select *, trunc(greatest(-1, least(1, v)) * case when v < 0 then 32768 else 32767 end)::int as y from i) select vec_id, string_agg({_hex('x')}, '' order by k) as server, string_agg({_hex('y')}, '' order by k) as client from c group by vec_id",
    "pcm_channels": f"with {_INTS}, t as (select vec_id, k // 2 as k, avg(x / 32768) as two from i group by all having count(*) = 2) select vec_id, k::int as k, i.x / 32768 as one, t.two from i left join t using (vec_id, k)",
    "recording_slices": f"with {_INTS} " + " union all ".join(_slice(a, z, s) for a, z, s in ((96, 592, 1.5), (0, 32, -3.0), (976, 6336, 15.25))),
    "recording_seconds": f"with {_INTS} select session, max(pos + k + 1) / {_RATE} as seconds from i group by session",
    "sound_clips": f"with {_INTS}, h as (select distinct session, pos / 64 + 0.5 as at_sec from i where pos % 320 = 0), w as (select h.session, at_sec, i.pos + k as p, {_hex('x')} as b from h join i on i.session = h.session and i.pos + k >= trunc(greatest(at_sec - 1, 0) * 64) and i.pos + k < trunc((at_sec + 3) * 64)) select session, at_sec, 44 + 2 * count(*) as bytes, md5(string_agg(b, '' order by p)) as md5 from w group by all",
    "recording_deletions": f"with t as (select distinct printf('20240101-%06d', p_partkey % 30) as session from part), r as (select distinct case when p_partkey % 4 = 0 then p_name else printf('20240101-%06d', p_partkey % 50) end as session from part) select r.session, case when not regexp_full_match(r.session, '[0-9]{{8}}-[0-9]{{6}}(-[0-9]+)?') then 'invalid' when t.session is null then 'missing' when right(t.session, 1) = '7' then 'active' else 'delete' end as status from r left join t using (session)",
    "tsv_round_trip": "select event_id, case when event_id % 7 > 0 then round(value, 3) end as value, event_type || ' ' || user_id || ' ' as note from events",
    "json_round_trip": "select conv_id, turn, md5(text) as md5 from conversations where turn > 0",
    "reused_table": "select event_type, count(*) as n from events group by 1",
    "report_of_events": "select 0 as part, '- ' || event_type || ': ' || count(*) as line from events group by event_type union all select 1, '- `' || event_id || '` ' || event_type || ' …a【' || user_id || '】z…' from events where value > 40 union all select 2, '- user ' || user_id || ' × ' || count(*) from events group by user_id",
}
