"""A trie of conversations' common beginnings, by partition refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running
from .shared import batch, mix, spread_join, stored

#: Turns that a conversation may take over from another one at most.
MOST_SHARED = 5
#: Ids that are hashed as one row: those of one range of so many.
CHUNK = 4096
_ENDS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): each turn with its place from 1; the text itself goes through no exchange.

    By turn, null first; turns with the same number are in the order of the digests of (role,
    text), so repeated rows stay side by side. A null role or text counts as empty; rows
    without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("pos"))
    return stored(running(turns, "conv_id", [F.col("turn").asc_nulls_first(), "digest"], ["pos"], "turns").drop("turn"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, with `last`, and (conv_id, length) of all of them.

    Conversation c gets the first h = crc32(c) % 6 turns of conversation c - c % 100 (as many as
    there are), then its own turns after its first h.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = turns.where((F.col("pos") <= MOST_SHARED) & (F.col("conv_id") % 100 == 0)).withColumnRenamed("conv_id", "base")
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("have"))
    plan = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).alias("h"))
    taken = F.least("h", F.coalesce("have", F.lit(0).cast("long")))
    plan = stored(plan.join(sizes, "base", "left").select("conv_id", "base", "n", "h", taken.alias("m"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("length")), "plan")
    first = plan.where("m > 0").join(heads, "base").where("pos <= m").select("conv_id", "pos", "digest", "chars", (F.col("pos") == F.col("length")).alias("last"))
    rest = spread_join(turns, plan.select("conv_id", "h", "m", "length"), "conv_id", plan.select("conv_id", "n"), turns.count()).where("pos > h")
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("m")).select("conv_id", "pos", "digest", "chars", (F.col("pos") == F.col("length")).alias("last"))
    return first.unionByName(rest), plan.select("conv_id", "length")


def labelled(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, chars, last, node, up): node names the sequence of turns up to this one, up that before it.

    A name is 128 bits: the sum of a hash of each (digest, place). So it can be summed over
    ranges, and no conversation has to fit in one task.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halves = np.frombuffer(b"".join(b.column("digest").to_pylist()), np.uint64).reshape(-1, 2)
            at = mix(np.asarray(b.column("pos")).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            own = [mix(halves[:, i] ^ mix(at + np.uint64(i + 1)) ^ (halves[:, 1 - i] >> np.uint64(7))).view(np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("conv_id", "pos", "chars", "last")} | {"xa": own[0], "xb": own[1], "a": own[0], "b": own[1]})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, own = (np.stack([np.asarray(b.column(c)).view(np.uint64) for c in pair], 1) for pair in ("ab", ("xa", "xb")))
            names = [pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, 16 * len(x) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in (sums, sums - own)]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("conv_id", "pos", "chars", "last")} | {"node": names[0], "up": names[1]})

    plain = "conv_id long, pos long, chars long, last boolean"
    sums = running(turns.mapInArrow(hashed, f"{plain}, xa long, xb long, a long, b long"), "conv_id", ["pos"], ["a", "b"], "names")
    return stored(sums.mapInArrow(named, f"{plain}, node binary, up binary"), "labelled")


def refined(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of two conversations and more (node, up, pos, n, conv_id, chars), and (conv_id, first) of those that come to be alone, with the place from which they are.

    All conversations are one class at first. Each round splits the classes by their next turns,
    retires those with one member, and goes on with the rest; it takes as many turns as all
    rounds before, so that a long common beginning takes few rounds, and at most as many rows
    more than turn by turn.
    """
    classes, alone, active, done, width = [], [], None, 0, 1
    while True:
        block = turns.where((F.col("pos") > done) & (F.col("pos") <= done + width))
        block = block if active is None else block.join(active, "conv_id", "left_semi")
        split = stored(block.groupBy("node", "up", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars")), "split")
        single = split.where("n = 1").groupBy("conv_id").agg(F.min("pos").alias("first"))
        classes.append(split.where("n > 1"))
        alone.append(single)
        active = stored(block.where(F.col("pos") == done + width).select("conv_id").join(single, "conv_id", "left_anti"), "active")
        if active.isEmpty():
            union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
            return union(classes), union(alone)
        done, width = done + width, done + width


def _ends(ended: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id). Ids are joined by ranges of CHUNK ids, whose texts go through the hash in order, one after the other."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            out = []
            for own, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if own != node:
                    if sha:
                        out.append((node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            if out:
                yield batch(_ENDS, *map(list, zip(*out, strict=True)))
        if sha:
            yield batch(_ENDS, [node], [sha.hexdigest()])

    chunk = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    ids = ended.groupBy("node", chunk).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return ids.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Folding back needs no walk over depths: a leaf and what a node saves are put down to the
    node's smallest member, so a class's sums over its subtree are sums over its members, but for
    the part of its smallest member's own path that lies above it.

    See numbered() for nulls, ties and repeated rows. An empty table gives no rows.
    """
    base, lengths = rebuilt(numbered(conversations))
    turns = labelled(base)
    n_turns = turns.count()
    inner, alone = refined(turns)
    alone = stored(alone, "alone")
    counts = lengths.select("conv_id", F.col("length").alias("n"))

    # beginnings of one conversation alone: unary chains
    chains = stored(spread_join(turns.select("conv_id", "pos", "last", "up"), alone, "conv_id", counts, n_turns).where("pos >= first"), "chains")
    heads = chains.where("pos = first").select("conv_id", "pos", "up")
    kids = stored(inner.select("up", "pos").unionByName(heads.select("up", "pos")).groupBy("up", "pos").agg(F.count(F.lit(1)).alias("n_children")), "kids")

    saves = (F.col("n") - 1) * F.col("chars")
    inner = stored(inner.join(kids.select(F.col("up").alias("node"), "n_children"), "node", "left").select("node", "up", "pos", "n", "conv_id", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), saves.alias("saves")), "inner")
    owners = inner.groupBy("conv_id").agg(F.sum("saves").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    per = lengths.join(alone, "conv_id", "left").join(owners, "conv_id", "left")
    leaf = F.when(F.col("first").isNotNull(), 1).otherwise(F.coalesce("leaf", F.lit(0))).cast("long")
    per = stored(per.select("conv_id", "length", F.col("first").isNotNull().alias("alone"), F.coalesce(F.col("first") - 1, "length").alias("stop"), F.coalesce("owned", F.lit(0).cast("long")).alias("owned"), leaf.alias("leaf")), "members")

    members = spread_join(turns.select("conv_id", "pos", "node"), per.select("conv_id", "stop", "owned", "leaf"), "conv_id", counts, n_turns).where("pos <= stop")
    sums = members.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("owned").alias("below"))
    above = running(inner.select("conv_id", "pos", "node", "saves", F.col("saves").alias("upto")), "conv_id", ["pos"], ["upto"], "paths").select("node", (F.col("upto") - F.col("saves")).alias("above"))

    root = F.lit(bytes(16))
    ended = turns.where("last").select("conv_id", "node").join(alone, "conv_id", "left_anti").unionByName(lengths.where("length = 0").select("conv_id", root.alias("node")))
    ends = stored(_ends(ended), "ends")

    least = per.agg(F.min("conv_id")).first()[0]
    nodes = inner.select("node", "up", "pos", "conv_id", F.col("n").alias("n_convs"), "n_children").join(sums, "node").join(above, "node").join(ends, "node", "left")
    nodes = nodes.select("up", "pos", "conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    one, none = (F.lit(i).cast("long") for i in (1, 0))
    single = lambda df: df.select("up", "pos", "conv_id", one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_EMPTY).alias("ends_sha256"))
    starts = nodes.unionByName(single(chains.where("pos = first")))
    parents = inner.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    many = kids.where("pos > 1").select("up", F.col("n_children").alias("n"))
    deep = spread_join(starts.where("pos > 1"), parents, "up", many, n_turns)
    top = starts.where("pos = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    tails = single(chains.where("pos > first")).withColumn("parent_conv_id", F.col("conv_id"))
    whole = per.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("some"), F.sum("owned").alias("saved_tokens")).where("n_convs > 0")
    whole = whole.select("*", root.alias("up"), F.lit(1).cast("long").alias("one")).join(kids.where("pos = 1").select("up", "n_children"), "up", "left").join(ends.withColumnRenamed("node", "up"), "up", "left")
    whole = whole.select("conv_id", none.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", none).alias("n_children"), F.greatest("some", F.when(F.col("n_children").isNull(), 1).otherwise(0)).cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    names = whole.columns
    below = [x.withColumn("depth", F.col("pos")).select(*names) for x in (deep, top, tails)]
    return whole.unionByName(below[0]).unionByName(below[1]).unionByName(below[2])


def trie_sql() -> str:
    """The same by listing every beginning, as DuckDB SQL."""
    return """
with recursive t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, unhex(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))) as pos from conversations where conv_id is not null),
c as (select conv_id, list({'role': role, 'text': text} order by pos) as turns, conv_id - conv_id % 100 as base from t group by conv_id),
bits as (select conv_id, conv_id::varchar as s, 0 as i, 4294967295::bigint as crc from c union all
    select conv_id, s, i + 1, case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end from (select conv_id, s, i, case when i % 8 = 0 then xor(crc, ascii(s[i // 8 + 1])::bigint) else crc end as x from bits where i < 8 * length(s))),
h as (select c.conv_id, base, turns, xor(crc, 4294967295) % 6 as h from c join bits on c.conv_id = bits.conv_id and i = 8 * length(s)),
r as (select h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) as turns from h left join c b on h.base = b.conv_id),
p as (select conv_id, unnest(range(0, len(turns) + 1)) as depth, turns from r),
n as (select turns[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(turns) = depth), '') as ends from p group by all),
k as (select a.path, count(*) as n from n a join n b on b.depth = a.depth + 1 and b.path[1:a.depth] = a.path group by all),
s as (select path[1:d] as path, sum(leaf) as n_leaves, sum(saves) as saved_tokens from (select n.path, (k.n is null)::int as leaf, case when n.depth = 0 then 0 else (n_convs - 1) * length(n.path[n.depth].text) end as saves, unnest(range(0, n.depth + 1)) as d from n left join k using (path)) group by all)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n_convs, coalesce(k.n, 0)::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(ends) as ends_sha256
from n join s using (path) left join k using (path) left join (select path as upper_path, depth as upper, conv_id from n) u on u.upper = n.depth - 1 and u.upper_path = n.path[1:n.depth - 1]
"""
