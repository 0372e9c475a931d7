"""The conversation trie against a plain walk and against its SQL, and running sums over ranges."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from cadenza.llm import prefix_trie as pt
from cadenza.llm.running import running

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {}
    for path in members:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(own) - 1) * len(path[-1][1]) if path else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def talks(seed):
    """Conversations with shared beginnings, copies, long ones, missing bases, null fields, repeated rows and equal turn numbers."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, 25), *range(100, 140), *range(250, 262), 5000, 9000, 9100]:
        stem = rng.choice("abc")
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "user", None]), f"{stem}{t}" if rng.random() < 0.7 else rng.choice(["", None, "é東", "x" * 9])))
    long = [f"turn {i}" for i in range(60)]
    rows += [(c, i, "user", x) for c in (300, 8800, 8801, 8802) for i, x in enumerate(long)]
    rows += [(8803, i, "user", x) for i, x in enumerate(long[:40])]
    rows += [(7000, None, "user", "first"), (7000, 1, "user", "b"), (7000, 1, "user", "a"), (7000, 1, "user", "a"), (7001, 3, None, None), (None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_the_trie_is_the_plain_walks(spark, seed):
    rows = talks(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "cast(null as string) as node", "'z' as pos", "1 as up", "2.5 as length", "null as __range")
    assert got(pt.prefix_trie(df)) == plain_trie(rows)


def test_small_tables(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(2, 0, "a", "b"), (3, 0, "a", "b"), (None, 0, "a", "b")], [(7, 0, "u", "x"), (7, 1, None, None)]):
        assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_one_conversation_holds_most_turns(spark):
    rng = random.Random(5)
    rows = [(100, i, "user", f"t{rng.random()}") for i in range(3000)]
    rows += [(101, t, r, x) for _, t, r, x in rows[:2500]] + [(c, i, "user", "hello") for c in range(1000, 1100) for i in range(3)]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == plain_trie(rows)


def test_the_trie_is_the_sqls(spark, tmp_path):
    spark.createDataFrame(talks(3), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    want = con.execute(pt.trie_sql())
    names = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, pt.prefix_trie(spark.read.parquet(f"{tmp_path}/c")).select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_running_sums_cross_ranges(spark):
    rng = np.random.default_rng(3)
    keys = np.sort(rng.choice([1, 2, 2, 2, 2, 3, 9], 4000))
    values = rng.integers(-(2**63), 2**63 - 1, 4000)
    rows = [(int(k), i, int(v), "kept") for i, (k, v) in enumerate(zip(keys, values, strict=True))]
    out = {r.at: r for r in running(spark.createDataFrame(rows, "key long, at int, v long, note string").repartition(5), "key", ["at"], ["v"], "sums").collect()}
    for k in np.unique(keys):
        want = np.cumsum(values[keys == k].astype(np.uint64)).view(np.int64)
        assert [out[i].v for i in np.flatnonzero(keys == k)] == want.tolist()
    assert len(out) == 4000 and out[0].note == "kept"
