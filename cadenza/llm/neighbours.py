"""Approximate nearest neighbours: NN-descent builds a neighbour graph by joins, a greedy search walks it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, scratch, spread_join, stored

#: A list of neighbours: node u, their ids (int64), squared distances (float32), whether each is new (bytes); u's code where the row has it.
ROW = "u long, ids binary, ds binary, new binary, code binary"
_ROW = pa.schema([("u", pa.int64()), *((c, pa.binary()) for c in ("ids", "ds", "new", "code"))])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("new", pa.bool_())])
#: Nodes that are compared with one another at most in one block.
BLOCK = 128


@dataclass(frozen=True)
class Search:
    """degree: neighbours kept for each node; trees: dealings that the graph starts from; settled: share of neighbours that a last round changes; rounds: bound of them;
    beam: nodes that a query keeps; width: of these, how many it expands at once; again: how many are compared by their original vectors."""

    degree: int = 28
    trees: int = 4
    settled: float = 0.1
    rounds: int = 16
    beam: int = 400
    width: int = 400
    again: int = 60


# codes: 8 bytes of scale, then a signed byte a component


def _codes(vectors: list) -> list[bytes]:
    out = []
    for v in vectors:
        v = np.asarray(v, float)
        top = np.abs(v).max()
        q = np.rint(v / top * 127)
        out.append(np.float64(top / 127).tobytes() + q.astype(np.int8).tobytes())
    return out


def _vectors(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    scale = np.ascontiguousarray(raw[:, :8]).view(np.float64).ravel()
    return (raw[:, 8:].view(np.int8) * scale[:, None]).astype(np.float32)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        d = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.where(np.isfinite(d), np.maximum(d, 0), np.float32(np.finfo(np.float32).max)).astype(np.float32)


def _lists(u: np.ndarray, ids: np.ndarray, ds: np.ndarray, new: np.ndarray, codes: list | None = None) -> pa.RecordBatch:
    """Rows of ROW from entries sorted by u."""
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, int)
    edge = np.r_[first, len(u)]
    slices = lambda x, size: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edge * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays([pa.array(u[first]), slices(ids, 8), slices(ds, 4), slices(new.view(np.uint8), 1), pa.array(codes if codes is not None else [None] * len(first), pa.binary())], schema=_ROW)


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """All entries of ROW rows: row number, id, distance, new."""
    ids, ds, new = (np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (("ids", np.int64), ("ds", np.float32), ("new", np.bool_)))
    return np.repeat(np.arange(b.num_rows), np.array([len(x) // 8 for x in b.column("ids").to_pylist()], int)), ids, ds, new


def _best(u: np.ndarray, ids: np.ndarray, ds: np.ndarray, new: np.ndarray, most: int) -> np.ndarray:
    """Indices of the `most` nearest different ids of each u, by u, then distance; of an id's entries an old one wins."""
    order = np.lexsort((new, ids, u))
    keep = np.r_[True, (u[order][1:] != u[order][:-1]) | (ids[order][1:] != ids[order][:-1])] if len(u) else np.zeros(0, bool)
    order = order[keep]
    order = order[np.lexsort((ids[order], ds[order], u[order]))]
    own = u[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    return order[np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)])) < most]


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut so that no key lies in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = np.asarray(b.column(key))
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(cut))
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def merged(rows: DataFrame, most: int, name: str) -> DataFrame:
    """One row for each u that has a code, with its `most` nearest neighbours of all its rows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches, "u"):
            codes = b.column("code").to_pylist()
            row, ids, ds, new = _entries(b)
            u = np.asarray(b.column("u"))[row]
            k = _best(u, ids, ds, new, most)
            own = {x: c for x, c in zip(b.column("u").to_pylist(), codes, strict=True) if c is not None}
            yield _lists(u[k], ids[k], ds[k], new[k], [own.get(x) for x in np.unique(u[k]).tolist()])

    # a row of u's neighbours has bounded size, and the proposals of one task for u come as one row
    return stored(rows.repartition("u").sortWithinPartitions("u").mapInArrow(merge, ROW), name, "uncompressed")


def _spread(node: pa.Array) -> np.ndarray:
    x = np.asarray(node).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def started(nodes: DataFrame, dim: int, s: Search) -> DataFrame:
    """Lists from a few dealings of (u, code): each sorts the nodes by the signs of random projections and compares blocks of neighbours in that order."""

    def signs(tree: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = np.random.default_rng([17, tree]).standard_normal((dim, 24)).astype(np.float32)
            for b in batches:
                bits = (_vectors(b.column("code").to_pylist()) @ planes > 0) @ (1 << np.arange(23, -1, -1))
                yield pa.RecordBatch.from_pydict({"at": pa.array(bits), "tie": pa.array((_spread(b.column("u")) >> np.uint64(1)).astype(np.int64)), "u": b.column("u"), "code": b.column("code")})

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(max(0, min(i, b.num_rows - BLOCK)), BLOCK)  # the last block takes some of the one before
                ids, codes = np.asarray(part.column("u")), part.column("code").to_pylist()
                d = _squares(x := _vectors(codes), x)
                np.fill_diagonal(d, np.inf)
                most = min(s.degree, len(ids) - 1)
                near = np.argpartition(d, most - 1, axis=1)[:, :most] if most else np.zeros((len(ids), 0), int)
                u, w = np.repeat(np.arange(len(ids)), most), near.ravel()
                order = np.argsort(ids[u], kind="stable")
                u, w = u[order], w[order]
                yield _lists(ids[u], ids[w], d[u, w], np.ones(len(u), bool))

    rows = nodes.select("u", *[F.lit(b"").alias(c) for c in ("ids", "ds", "new")], "code")
    # as the last batch of a range may hold few rows, ranges are few and large
    for tree in range(s.trees):
        dealt = nodes.mapInArrow(signs(tree), "at long, tie long, u long, code binary").repartitionByRange("at", "tie").sortWithinPartitions("at", "tie")
        rows = rows.unionByName(dealt.select("u", "code").mapInArrow(compare, ROW))
    return merged(rows, s.degree, "started")


def linked(graph: DataFrame, degree: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of the graph in both directions (at, m, new); (at, n, any): their number and whether one is new; and (m, code, worst), worst: the distance that a neighbour of m must beat."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ids, _, new = _entries(b)
            u = np.asarray(b.column("u"))[row]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, ids)), pa.array(np.maximum(u, ids)), pa.array(new)], schema=_EDGE)

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worst = [np.frombuffer(x, np.float32)[-1] if len(x) >= 4 * degree else np.inf for x in b.column("ds").to_pylist()]
            yield pa.RecordBatch.from_pydict({"m": b.column("u"), "code": b.column("code"), "worst": pa.array(worst, pa.float32())})

    edges = graph.mapInArrow(pairs, "a long, b long, new boolean").groupBy("a", "b").agg(F.max("new").alias("new"))
    ways = F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("m"), "new"), F.struct(F.col("b").alias("at"), F.col("a").alias("m"), "new"))
    both = stored(edges.select(F.explode(ways).alias("x")).select("x.*"), "links", "uncompressed")
    return both, both.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("any")), graph.mapInArrow(limits, "m long, code binary, worst float")


def _with_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows (.., m) joined with m's code. A merge join of two plain exchanges: Spark splits the partition of a node with very many links."""
    return rows.join(codes.hint("merge"), "m")


def descended(graph: DataFrame, turn: int, s: Search) -> DataFrame:
    """One round: the neighbours of each node, in either direction, meet there, and each pair with a new link may enter both lists.

    Where a node has very many links, they meet in blocks of BLOCK that are dealt by hash anew
    in each round: all links take part, and no group grows with the data.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def proposals() -> pa.RecordBatch:
            u, ids, ds = (np.concatenate(x) for x in zip(*held, strict=True))
            k = _best(u, ids, ds, np.ones(len(u), bool), s.degree)
            return _lists(u[k], ids[k], ds[k], np.ones(len(k), bool))

        for b in _whole(batches, "meet"):
            meet, m, new, worst = (np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in ("meet", "m", "new", "worst"))
            x = _vectors(b.column("code").to_pylist())
            edge = np.r_[np.flatnonzero(np.r_[True, meet[1:] != meet[:-1]]), len(meet)]
            for i, j in zip(edge, edge[1:], strict=False):
                if new[i:j].any():
                    d = _squares(x[i:j], x[i:j])
                    near = (d < worst[i:j, None]) & (new[i:j, None] | new[None, i:j]) & (m[i:j, None] != m[None, i:j])
                    p, q = np.nonzero(near)
                    held.append((m[i:j][p], m[i:j][q], d[p, q]))
            if sum(len(h[0]) for h in held) > 1 << 19:
                yield proposals()
                held = []
        if held:
            yield proposals()

    both, degrees, codes = linked(graph, s.degree)
    sizes = degrees.where("any").select("at", F.ceil(F.col("n") / BLOCK).alias("parts"))
    dealt = both.join(sizes, "at").select(F.xxhash64("at", F.pmod(F.xxhash64("m", F.lit(turn)), "parts")).alias("meet"), "m", "new")
    met = _with_codes(dealt, codes).repartition("meet").sortWithinPartitions("meet", "m")
    return merged(_told(graph).unionByName(met.select("meet", "m", "new", "code", "worst").mapInArrow(local, ROW)), s.degree, "descended")


def _told(lists: DataFrame) -> DataFrame:
    return lists.withColumn("new", F.unhex(F.repeat(F.lit("00"), F.length("new"))))


def _news(lists: DataFrame) -> int:
    """Entries that are new."""
    return lists.agg(F.sum(F.length(F.replace(F.hex("new"), F.lit("00"), F.lit(""))) / 2)).first()[0] or 0


def graph_of(nodes: DataFrame, dim: int, s: Search) -> DataFrame:
    """The neighbour graph of nodes (u, code), as ROW: rounds of NN-descent until one changes few neighbours."""
    n = nodes.count()
    graph = started(nodes, dim, s)
    for turn in range(s.rounds):
        graph = descended(graph, turn, s)
        if _news(graph) <= s.settled * n * s.degree:
            break
    return graph


def adjacency(graph: DataFrame, s: Search) -> DataFrame:
    """(at, ids, codes): what a search reads where it comes to a node, in rows of at most BLOCK links. A table with buckets, so that no step of the search exchanges it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m, codes = np.asarray(b.column("at")), np.asarray(b.column("m")), b.column("code").to_pylist()
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
            cuts = [k for i, j in zip(starts, np.r_[starts[1:], len(at)], strict=True) for k in range(i, j, BLOCK)] + [len(at)]
            own = list(zip(cuts, cuts[1:], strict=False))
            yield pa.RecordBatch.from_pydict({"at": pa.array(at[cuts[:-1]]), "ids": pa.array([m[i:j].tobytes() for i, j in own], pa.binary()), "codes": pa.array([b"".join(codes[i:j]) for i, j in own], pa.binary())})

    spark = graph.sparkSession
    both, _, codes = linked(graph, s.degree)
    rows = _with_codes(both.select("at", "m"), codes.drop("worst"))
    path, n = scratch(spark, "adjacency"), partitions(spark)
    name = path.rpartition("/")[2].replace("-", "_")
    packed = rows.repartition(n, "at").sortWithinPartitions("at").select("at", "m", "code").mapInArrow(pack, "at long, ids binary, codes binary")
    packed.write.bucketBy(n, "at").sortBy("at").option("path", path).saveAsTable(name)
    return spark.table(name)


def searched(links: DataFrame, starts: DataFrame, s: Search) -> DataFrame:
    """Greedy search from starts (ROW: query u with its code, entries to begin from): each step expands the nearest nodes of a query's beam that aren't expanded yet, till all are."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, u, code, worst = [], [], [], []
            for q, c, ids, ds, new in zip(*(b.column(x).to_pylist() for x in ("u", "code", "ids", "ds", "new")), strict=True):
                k = np.flatnonzero(np.frombuffer(new, np.bool_))[: s.width]
                at += np.frombuffer(ids, np.int64)[k].tolist()
                u += [q] * len(k)
                code += [c] * len(k)
                worst += [float(np.frombuffer(ds, np.float32)[-1]) if len(ids) >= 8 * s.beam else np.inf] * len(k)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "u": pa.array(u, pa.int64()), "code": pa.array(code, pa.binary()), "worst": pa.array(worst, pa.float32())})

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = []
            for new in b.column("new").to_pylist():
                own = np.frombuffer(new, np.bool_).copy()
                own[np.flatnonzero(own)[: s.width]] = False
                rest.append(own.tobytes())
            yield b.set_column(b.schema.get_field_index("new"), "new", pa.array(rest, pa.binary()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for q, code, worst, ids, codes in zip(*(b.column(x).to_pylist() for x in ("u", "code", "worst", "ids", "codes")), strict=True):
                d = _squares(_vectors([code]), _vectors([codes[i : i + len(code)] for i in range(0, len(codes), len(code))]))[0]
                k = np.flatnonzero(d < worst)
                found.append((np.full(len(k), q), np.frombuffer(ids, np.int64)[k], d[k]))
            if found:
                u, ids, ds = (np.concatenate(x) for x in zip(*found, strict=True))
                k = _best(u, ids, ds, np.ones(len(u), bool), s.beam)
                yield _lists(u[k], ids[k], ds[k], np.ones(len(k), bool))

    beams = stored(starts, "beams")
    while _news(beams):
        asked = beams.mapInArrow(opened, "at long, u long, code binary, worst float")
        found = asked.join(links, "at").select("u", "code", "worst", "ids", "codes").mapInArrow(measured, ROW)
        beams = merged(beams.mapInArrow(closed, ROW).unionByName(found), s.beam, "beams")
    return beams


def nearest(vectors: DataFrame, queries: Column, k: int = 10, search: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where `queries` holds, by Euclidean distance, ties to the smaller id.

    All distinct vectors are nodes of the graph; copies share a node, so a vector that a third
    of all rows have is one node, of which the k + 1 smallest ids can be neighbours. Nodes are
    compared by components of 8 bits with a scale; the `search.again` nearest found are then
    measured on the original vectors in double precision. A query begins at its own node.

    Rows whose id or vector is null, or whose vector is empty, zero, or holds a null or a
    component that isn't finite, take no part. Shorter vectors count as filled up with zeros. Of
    several vectors under one id the smallest counts, so repeated rows count once. Other
    columns are ignored; an empty table gives no rows.
    """
    spark, s = vectors.sparkSession, search
    vec = F.col(vector_col).cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(queries, F.lit(False)).alias("asked"))
    dim = rows.agg(F.max(F.size("vec"))).first()[0]
    result = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return spark.createDataFrame([], result)
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"), F.max("asked").alias("asked"))
    rows = stored(rows.select("id", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))).alias("vec"), "asked"), "vectors")

    by = Window.partitionBy("vec").orderBy("id")
    first = rows.select("id", "vec", F.row_number().over(by).alias("nth")).where(F.col("nth") <= k + 1)
    nodes = stored(first.groupBy("vec").agg(F.min("id").alias("u"), F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    asked = rows.where("asked").select("id", "vec")
    sizes = asked.groupBy("vec").agg(F.count(F.lit(1)).alias("n"))
    asked = stored(spread_join(asked, nodes.select("vec", "u"), "vec", sizes, asked.count()).select("id", "u"), "asked")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"u": b.column("u"), "code": pa.array(_codes(b.column("vec").to_pylist()), pa.binary())})

    codes = stored(nodes.select("u", "vec").mapInArrow(coded, "u long, code binary"), "codes")
    links = adjacency(graph_of(codes, dim, s), s)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = np.asarray(b.column("u"))
            yield _lists(u, u, np.zeros(len(u), np.float32), np.ones(len(u), bool), b.column("code").to_pylist())

    wanted = asked.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    beams = searched(links, codes.join(wanted, "u", "left_semi").repartition("u").mapInArrow(begun, ROW), s)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, np.int64)[: max(s.again, k + 1)] for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(np.asarray(b.column("u")), [len(x) for x in ids])), "u": pa.array(np.concatenate([np.zeros(0, np.int64), *ids]))})

    pairs = beams.select("u", "ids").mapInArrow(listed, "q long, u long")
    square = F.aggregate(F.zip_with("vec", "own", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    near = pairs.join(nodes, "u").join(nodes.select(F.col("u").alias("q"), F.col("vec").alias("own")), "q").select("q", F.sqrt(square).alias("score"), F.explode("ids").alias("vec_id"))
    own = Window.partitionBy("q").orderBy("score", "vec_id")  # k + 1 ids of each of the nodes that a query keeps, so of bounded size
    best = near.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1)
    best = best.groupBy(F.col("q").alias("u")).agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    out = spread_join(asked, best, "u", wanted, asked.count())
    other = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(other).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
