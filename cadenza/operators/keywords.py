"""Many keys in texts at once: an automaton of all keys is broadcast and runs over Arrow batches."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Bytes of keys and values that are broadcast at once. A longer table goes over the rows block by block, which are stored in between.
BLOCK_BYTES = 64 << 20
#: Bytes of keys and values that a worker holds as one automaton, which takes about six times as much (53 MB of 9 MB). A block's parts follow one another over the same texts.
PART_BYTES = 24 << 20
#: Characters whose hits a worker holds at once.
_STEP = 4 << 20

Hit = tuple[int, int, str]  # start, length, value
_HITS = "array<struct<at:int,n:int,value:string>>"
_kept: dict[tuple[int, int], tuple] = {}


def _rows(part: bytes) -> pa.Table:
    return pa.ipc.open_stream(part).read_all()


def _automaton(table, k: int) -> tuple[ahocorasick.Automaton, list[int]] | None:
    """Of part k of a broadcast list of Arrow tables (key, value): the automaton of the keys' places, and the keys' sizes; the worker keeps the last one."""
    if (id(table.value), k) not in _kept:
        _kept.clear()
        own, size = ahocorasick.Automaton(ahocorasick.STORE_INTS), array("i")
        for chunk in _rows(table.value[k]).column("key").iterchunks():
            for key in chunk:
                word = key.as_py()
                own.add_word(word, len(size))
                size.append(len(word))
        own.make_automaton()
        _kept[id(table.value), k] = table.value, (own, size) if size else None
    return _kept[id(table.value), k][1]


def _steps(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of about _STEP characters."""
    size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + _STEP, side="right")))
        yield texts[i:j].to_pylist()
        i = j


def _found(texts: list[str | None], table) -> list[np.ndarray]:
    """For each text the rows (start, -length, part, place in it) of the longest key of each part at each place where one begins, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for k in range(len(table.value)):
        if (own := _automaton(table, k)) is None:
            continue
        keys, size = own
        for held, t in zip(out, texts, strict=True):
            if t:
                # a longer key at the same place ends later, and so stays
                last = {end - size[i]: i for end, i in keys.iter(t)}
                if last:
                    place = np.fromiter(last.values(), np.int32, len(last))
                    held.append(np.stack([np.fromiter(last, np.int32, len(last)) + 1, -np.asarray(size)[place], np.full(len(last), k, np.int32), place], axis=1))
    rows = [np.concatenate(x) if x else np.zeros((0, 4), np.int32) for x in out]
    return [x[np.lexsort((x[:, 1], x[:, 0]))] for x in rows]


def _free(rows: np.ndarray) -> np.ndarray:
    """Of ordered rows (start, -length, ...) from left to right those that overlap none that was taken."""
    done, taken = 0, []
    for r, (at, n) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1].tolist(), strict=True)):
        if at >= done:
            taken.append(r)
            done = at - n
    return rows[taken]


def _put(text: str, hits: Iterable[Hit]) -> str:
    """Hits in order; what overlaps a replaced key stays."""
    out, done = [], 0
    for at, n, value in hits:
        if at >= done:
            out += (text[done:at], value)
            done = at + n
    return "".join([*out, text[done:]])


def _blocks(table: DataFrame, size: int) -> Iterator:
    """The rows (key, value) of table as broadcast lists of Arrow tables, of about `size` bytes at most in all."""
    spark = table.sparkSession
    total = table.agg(F.sum(F.octet_length("key") + F.octet_length("value"))).first()[0] or 0
    each = min(size, PART_BYTES)
    n, many = max(1, -(-total // each)), size // each
    table = table.select("key", "value")
    if n > 1:
        table = stored(table.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n))), "keys")
    for k in range(0, n, many):
        parts = [(table if n == 1 else table.where(F.col("part") == i).drop("part")).toArrow() for i in range(k, min(k + many, n))]
        yield spark.sparkContext.broadcast([_sent(t) for t in parts]), k + many >= n


def _sent(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _values(table) -> pa.ChunkedArray:
    """The values of all parts, one after another."""
    return pa.chunked_array([c for part in table.value for c in _rows(part).column("value").iterchunks()], pa.string())


def _places(table) -> np.ndarray:
    """Where each part's values begin."""
    return np.cumsum([0, *(len(_rows(part)) for part in table.value)])


def _mapped(rows: DataFrame, column: str, kind: str, work: Callable, *also: str) -> DataFrame:
    """rows with column set to what work gives for the arrays of `also`; no other column is sent to it."""
    return rows.select(*(F.col(c) for c in rows.columns if c != column), F.arrow_udf(work, kind)(*also).alias(column))


def with_replaced(rows: DataFrame, table: DataFrame, text: str = "text", into: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """rows with `into`: the text with every key of table (observed, output) replaced in one pass, the longest at each place; what was put in is not looked at again.

    The plan does not grow with the table, and the time for a text hardly. Null and empty keys
    are left out, a null output counts as empty, of equal keys the largest output counts. A null
    text stays null.
    """
    own = table.where("observed <> ''").groupBy(F.col("observed").alias("key")).agg(F.max(F.coalesce("output", F.lit(""))).alias("value"))
    hits = "__hits"
    many = False
    for words, last in _blocks(own, block):
        if last and not many:

            def one(texts: pa.Array, w=words) -> pa.Array:
                value, out = _values(w), []
                for ts in _steps(texts):
                    taken = [_free(x) for x in _found(ts, w)]
                    rows = np.concatenate(taken)
                    values, upto = value.take(pa.array(_places(w)[rows[:, 2]] + rows[:, 3])).to_numpy(), np.cumsum([0, *map(len, taken)]).tolist()
                    put = lambda t, x, i, j, values=values: _put(t, zip(x[:, 0].tolist(), (-x[:, 1]).tolist(), values[i:j], strict=True))
                    out.append(pa.array([t if t is None else put(t, *own) for t, *own in zip(ts, taken, upto, upto[1:], strict=False)], pa.string()))
                return pa.concat_arrays(out) if out else pa.array([], pa.string())

            return _mapped(rows, into, "string", _of_arrays(one, 1), text)
        rows, many = rows if many else rows.withColumn(hits, F.lit(None).cast(_HITS)), True

        def more(texts: pa.Array, earlier: pa.Array, w=words) -> pa.Array:
            value, place, out, upto = _values(w), _places(w), [], 0
            for ts in _steps(texts):
                for x, h in zip(_found(ts, w), earlier[upto : upto + len(ts)].to_pylist(), strict=True):
                    best = {y["at"]: y for y in h or ()}
                    for at, n, k, i in x.tolist():
                        if at not in best or best[at]["n"] < -n:
                            best[at] = {"at": at, "n": -n, "value": value[int(place[k]) + i].as_py()}
                    out.append(list(best.values()))
                upto += len(ts)
            return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("value", pa.string())])))

        rows = stored(_mapped(rows, hits, _HITS, _of_arrays(more, 2), text, hits), "hits")

    def final(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _put(t, ((x["at"], x["n"], x["value"]) for x in sorted(h.as_py(), key=lambda x: x["at"]))) for t, h in zip(texts.to_pylist(), found, strict=True)], pa.string())

    return _mapped(rows, into, "string", _of_arrays(final, 2), text, hits).drop(hits)


def _of_arrays(work: Callable, n: int) -> Callable:
    """work as a function of exactly n arrays, which Spark takes the kind of function from."""
    if n == 1:

        def own(a: pa.Array) -> pa.Array:
            return work(a)
    else:

        def own(a: pa.Array, b: pa.Array) -> pa.Array:
            return work(a, b)

    return own


def with_any(rows: DataFrame, words: DataFrame, text: str, block: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text holds one of words (word); block by block, a row that has one is not looked at again."""
    own, held = words.where("word <> ''").select(F.col("word").alias("key"), F.lit("").alias("value")), "__held"
    rows, names = rows.withColumn(held, F.lit(False)), rows.columns
    for table, last in _blocks(own, block):

        def look(texts: pa.Array, earlier: pa.Array, w=table) -> pa.Array:
            out = earlier.to_pylist()
            upto = 0
            for ts in _steps(texts):
                for k in range(len(w.value)):
                    if (own := _automaton(w, k)) is not None:
                        for i, t in enumerate(ts, upto):
                            out[i] = out[i] or bool(t and next(own[0].iter(t), None))
                upto += len(ts)
            return pa.array(out, pa.bool_())

        rows = _mapped(rows, held, "boolean", _of_arrays(look, 2), text, held)
        rows = rows if last else stored(rows, "held")
    return rows.where(held).select(*names)
