"""Near-duplicate groups by min-max hashing, with every link confirmed on the full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import LOWER, batch, documents, joined, mix, ranges, span_hashes, spread_join, steps, stored, unused, word_hashes, words

#: Permutations; each gives its minimum and its maximum, so a signature has twice as many values.
PERMUTATIONS = 80
#: Values in a band. At a similarity of 0.75 a pair misses all 40 bands with a probability of 3e-7.
ROWS = 4
#: The sketch has one byte of each value; candidates in a band are sieved by it ...
SKETCH = 2 * PERMUTATIONS
#: ... and must agree in so many bytes: at a similarity of 0.75 fewer have a probability of 2e-9.
AGREE = 86
#: Members of a bucket, and shingles of theirs, that are compared in one task.
BLOCK, WEIGHT = 2048, 1 << 21
#: Pairs of one leader that are confirmed in one place.
FOLLOWERS = 512

_rng = np.random.default_rng(0xB0A7)
_XOR, _TIMES = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64), _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
SIGNED = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch binary"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PLACES = pa.schema([("bucket", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("core", pa.bool_()), ("x", pa.bool_()), ("y", pa.bool_())])
PLACES = "bucket long, i long, j long, node long, label long, core boolean, x boolean, y boolean"


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, and where each text's set begins (n + 1).

    Words are compared with A-Z in lower case. A text with fewer words than `size` has its
    whole sequence as one shingle; one without words has none.
    """
    data, offs = joined(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offs)
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    s = span_hashes(h, size)
    long = np.maximum(count - size + 1, 0)
    text, value = [np.repeat(np.arange(len(count)), long)], [s[ranges(first[:-1], long)]]
    for n in range(1, size):
        few = np.flatnonzero(count == n)
        text.append(few)
        value.append(mix(span_hashes(h, n)[first[few]] + np.uint64(n)) if len(few) else np.zeros(0, np.uint64))
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(count) + 1))


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima, then maxima, under each permutation, for each set that isn't empty: one hash evaluation gives two values."""
    full = first[:-1][np.diff(first) > 0]
    out = np.empty((2 * PERMUTATIONS, len(full)), np.uint64)
    if len(full):
        for p in range(PERMUTATIONS):
            v = (sets ^ _XOR[p]) * _TIMES[p]
            out[p] = np.minimum.reduceat(v, full)
            out[PERMUTATIONS + p] = np.maximum.reduceat(v, full)
    return out.T


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest of the set, band hashes, sketch) of each (doc_id, text); no bands for an empty set."""
    bands = 2 * PERMUTATIONS // ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text")):
                sets, first = shingle_sets(b.column("text")[i:j])
                size = np.diff(first)
                sig = np.zeros((j - i, 2 * PERMUTATIONS), np.uint64)
                sig[size > 0] = signatures(sets, first)
                key = np.zeros((j - i, bands), np.uint64)
                for r in range(ROWS):  # a band: two permutations, the minimum and the maximum of each
                    key = mix(key + sig[:, r * bands : (r + 1) * bands])
                key = mix(key + np.arange(bands, dtype=np.uint64))
                sketch = (mix(sig) & np.uint64(255)).astype(np.uint8)
                digest = [hashlib.blake2b(sets[a:z].tobytes(), digest_size=16).digest() for a, z in zip(first, first[1:], strict=False)]
                n = np.where(size > 0, bands, 0)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(key[size > 0].view(np.int64).ravel()))
                yield batch(_SIGNED, b.column("doc_id")[i:j], b.column("text_hash")[i:j], size, digest, lists, [s.tobytes() for s in sketch])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sign, SIGNED)


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def look_alikes(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets can be near: sizes within the bound, and sketches that agree."""

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_sketches(b.column("sa")) == _sketches(b.column("sb"))).sum(axis=1) >= AGREE
            yield batch(_PAIRS, *(b.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")))

    one, two = (reps.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(sieve, "a long, b long")


def _candidates(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one bucket's members (or of two blocks of them): each member outside the main label, and its possible partners of other labels, the most alike first.

    Partners are as large as the bound allows and agree by sketch. A pair that several buckets
    hold belongs to the one with the smallest key.
    """
    doc, root, core, x, y, size = (np.asarray(table.column(c)) for c in ("node", "label", "core", "x", "y", "n_shingles"))
    bucket, top = table.column("bucket")[0].as_py(), np.iinfo(np.int64).max
    sketch, bands = _sketches(table.column("sketch")), np.asarray(pc.list_flatten(table.column("bands"))).reshape(len(doc), -1)
    for m in np.flatnonzero(y):
        left = np.flatnonzero(x & (root != root[m]) & (core | (doc < doc[m])) & (100 * np.minimum(size, size[m]) >= percent * np.maximum(size, size[m])))
        near = (sketch[left] == sketch[m]).sum(axis=1)
        left = left[np.argsort(-near, kind="stable")][: np.count_nonzero(near >= AGREE)]
        left = left[np.where(bands[left] == bands[m], bands[left], top).min(axis=1, initial=top) == bucket]
        if len(left):
            yield int(m), left


def open_members(percent: int):
    """The members of one bucket (or of two blocks of it) that have a possible partner of another label there: only these send their sets."""

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hit_x, hit_y = np.zeros(len(table), bool), np.zeros(len(table), bool)
        for m, left in _candidates(table, percent):
            hit_y[m] = True
            hit_x[left] = True
        own = table.select(_PLACES.names[:-2]).append_column("x", pa.array(hit_x)).append_column("y", pa.array(hit_y))
        return own.filter(pa.array(hit_x | hit_y)).cast(_PLACES)

    return find


def joining_links(percent: int):
    """Of one bucket's members (or of two blocks of them): links between different labels, no more than it takes to join these.

    Two labels that a link has joined are one from then on. So every pair that could join two
    labels is compared on the full sets, but no pair is listed.
    """

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, root = (np.asarray(table.column(c)) for c in ("node", "label"))
        root = root.copy()
        raw = table.column("shingles").to_pylist()
        size = np.array([len(s) // 8 for s in raw], np.int64)
        start = np.cumsum(size) - size
        _, code = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        mine = np.zeros(int(code.max(initial=-1)) + 1, bool)
        out = []
        for m, left in _candidates(table, percent):
            left = left[root[left] != root[m]]
            own = code[start[m] : start[m] + size[m]]
            mine[own] = True
            many = 1
            while len(left):
                now, left = left[:many], left[many:]
                both = np.add.reduceat(mine[code[ranges(start[now], size[now])]].astype(np.int64), np.cumsum(size[now]) - size[now])
                for k in now[100 * both >= percent * (size[now] + size[m] - both)]:
                    if root[k] != root[m]:
                        out.append((doc[k], doc[m]))
                        root[root == root[k]] = root[m]
                left = left[root[left] != root[m]]
                many *= 4
            mine[own] = False
        return pa.Table.from_batches([batch(_PAIRS, *(list(map(list, zip(*out, strict=True))) or [[], []]))])

    return find


def shingled(bodies: DataFrame) -> DataFrame:
    """(node, shingles): each text's set, as sorted 64-bit hashes."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text")):
                sets, first = shingle_sets(b.column("text")[i:j])
                yield batch(schema, b.column("node")[i:j], [sets[a:z].tobytes() for a, z in zip(first, first[1:], strict=False)])

    return bodies.select("node", "text").mapInArrow(shingle, "node long, shingles binary")


def confirmed(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets have 100 * |intersection| >= percent * |union|.

    A text travels once to each of its leaders a, and a leader once for about FOLLOWERS pairs,
    in front of them: what a task holds is one leader's set and a step of texts.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1, np.uint64)
        for b in batches:
            for i, j in steps(b.column("text")):
                sets, first = shingle_sets(b.column("text")[i:j])
                linked = np.zeros(j - i, bool)
                for k, leads in enumerate(b.column("leads")[i:j].to_pylist()):
                    own = sets[first[k] : first[k + 1]]
                    if leads:
                        mine = own
                        continue
                    both = np.count_nonzero(mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own)
                    linked[k] = 100 * both >= percent * (len(mine) + len(own) - both)
                yield batch(_PAIRS, *(b.column(c)[i:j].filter(pa.array(linked)) for c in ("a", "node")))

    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).alias("parts")).where("parts > 1")
    asked = pairs.join(hot, "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).alias("part"), "b")
    asked = asked.select("a", "part", F.col("b").alias("node"), F.lit(False).alias("leads")).union(asked.select("a", "part", F.col("a"), F.lit(True)).distinct())
    rows = asked.join(bodies.hint("merge"), "node").repartition("a", "part").sortWithinPartitions("a", "part", F.desc("leads"))
    return rows.select("a", "node", "leads", "text").mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked if the sets of their 5-word shingles have
    100 * |intersection| >= percent * |union|; component_id is the smallest doc_id that links
    reach, and kept says whether it is the document's own.

    1. Equal sets form a class, which is a node; one of its texts goes on.
    2. Nodes that agree in a band share a bucket. Each is paired with its buckets' first nodes:
       no more pairs than memberships. Pairs that the sketches leave are confirmed on full sets.
    3. Where a bucket's members are in several components, their sketches meet in its task;
       only members with a possible partner in another component send their sets there, and
       every such pair is compared unless other links have joined the two: at most one link
       less than there are components comes out. Of buckets with the same members one is read.
    Very large buckets are dealt to several tasks, each block of members against each block of
    those outside the largest component. Joins of tables that grow with the corpus are merge
    joins at every size.

    A null or empty text has no shingles and is linked with nothing. Rows that share an id are
    one node even if their texts differ: what any of them is linked with is linked, and they
    have one component_id, while each row has its own n_shingles; a row without an id is its own
    component, null. An empty table gives no rows; other columns are ignored.
    """
    texts = documents(docs, id_col, text_col)
    all_signed = stored(signed(texts), "signed")
    some = all_signed.where("doc_id is not null and n_shingles > 0")
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "bands", "sketch")).alias("m"))
    reps = stored(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "m.*"), "classes")
    repeated = not all_signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()

    member = reps.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    first = stored(member.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    members = stored(spread_join(member, first.drop("n"), "bucket", first, reps.count() * 2 * PERMUTATIONS // ROWS), "buckets")
    own = members.select("node").distinct()
    bodies = texts.withColumn("text_hash", F.xxhash64("text")).join(reps.join(own.hint("merge"), "node").select("node", "doc_id", "text_hash").hint("merge"), ["doc_id", "text_hash"]).select("node", "text")
    bodies = stored(bodies.dropDuplicates(["node"]) if repeated else bodies, "bodies", "zstd")

    stars = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(stored(look_alikes(stars, reps, percent), "pairs"), bodies, percent)
    if repeated:
        holds = some.select("doc_id", "digest").distinct().join(reps.select("digest", "node").hint("merge"), "digest")
        least = holds.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.union(holds.join(least.hint("merge"), "doc_id").where("node <> a").select("a", F.col("node").alias("b")))
    label = components(stored(links, "links"))

    labelled = stored(members.drop("first").join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    shape = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t")).where("low < high")
    chosen = stored(shape.groupBy("n", "s", "t").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "chosen")
    mixed = stored(spread_join(labelled, chosen.drop("n"), "bucket", chosen, labelled.count()), "mixed")
    sizes = mixed.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / WEIGHT))
    sizes = sizes.select("bucket", "n", F.col("top.label").alias("main"), blocks(F.col("n"), F.col("w")).alias("bi"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("bj"))
    sizes = stored(sizes, "sizes")
    rows = spread_join(mixed, sizes.drop("n"), "bucket", sizes, mixed.count()).withColumn("core", F.col("label") == F.col("main"))
    rows = rows.withColumn("hi", F.pmod(F.xxhash64("node"), "bi")).withColumn("hj", F.pmod(F.xxhash64("node"), "bj"))
    as_x = F.transform(F.sequence(F.lit(0).cast("long"), F.col("bj") - 1), lambda j: F.struct(F.col("hi").alias("i"), j.alias("j")))
    as_y = F.transform(F.sequence(F.lit(0).cast("long"), F.col("bi") - 1), lambda i: F.struct(i.alias("i"), F.col("hj").alias("j")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("core"), as_x).otherwise(F.array_union(as_x, as_y))))
    rows = rows.select("bucket", "at.i", "at.j", "node", "label", "core", (F.col("at.i") == F.col("hi")).alias("x"), (~F.col("core") & (F.col("at.j") == F.col("hj"))).alias("y"))
    marks = reps.select("node", "n_shingles", "bands", "sketch")
    places = stored(rows.join(marks.hint("merge"), "node").groupBy("bucket", "i", "j").applyInArrow(open_members(percent), PLACES), "places")
    sets = places.join(marks.hint("merge"), "node").join(shingled(bodies.join(places.select("node").distinct().hint("merge"), "node")).hint("merge"), "node")
    more = stored(sets.groupBy("bucket", "i", "j").applyInArrow(joining_links(percent), "a long, b long"), "links")
    if not more.isEmpty():
        label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    found = reps.select("node", "digest", "doc_id").join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = found.groupBy("label").agg(F.min("doc_id").alias("component"))
    component = found.join(least.hint("merge"), "label").select("digest", "component")
    out = all_signed.select("doc_id", "n_shingles", "digest").join(component.hint("merge"), "digest", "left")
    out = out.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))))
    if repeated:  # rows without words follow the id's others
        of_id = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("of_id"))
        out = out.join(of_id.hint("merge"), "doc_id", "left").withColumn("component", F.col("of_id"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of the smallest id of each near-duplicate group. Rows without an id stay."""
    name = unused(docs, "__gone")
    gone = near_groups(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
