"""Language-model scores by a hidden Markov model over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, batch, joined, partitions, ranges, steps, stored, word_hashes, words

#: The end token's hash.
END = np.uint64(0xE0D0F0D0C0DE5EED)

_SUMS = pa.schema([("to", pa.int64()), ("sums", pa.binary())])
_COUNTS = pa.schema([("word", pa.int64()), ("times", pa.int64())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("head_log", pa.float64()), ("head_known", pa.int64()), ("loss", pa.float64()), ("symbols", pa.binary()), ("tail", pa.list_(pa.int64()))])
ENCODED = "doc_id long, held_out boolean, train boolean, n_tokens long, head_log double, head_known long, loss double, symbols binary, tail array<long>"
#: Tokens whose forward vectors are kept at once.
_PORTION = 1 << 20
#: Tokens whose counts are added up at once.
_TURNED = 1 << 17
#: Fixed point of sums of logarithms, so that they don't depend on the order of addition.
_POINT = 2.0**36


@dataclass(frozen=True)
class HmmParams:
    """head: the most frequent words, each an emission symbol of its own; tail: symbols that all other words are dealt to by hash (both bound the model's size, not what is counted); states: latent states; warm, warm_rounds: the first rounds run over one text in `warm`, until a round gains less than ten times `gain`, and warm_rounds at most, so that those over all texts start near their end; gain: training ends when a round over all training texts raises their log-likelihood by a smaller share; rounds: a bound of them that only guards against one that never settles; floor: pseudo-count of an emission; slices: parts in which expected counts are summed; narrow: vectors of 32 bits in training."""

    head: int = 16_000
    tail: int = 256
    states: int = 8
    warm: int = 8
    warm_rounds: int = 12
    rounds: int = 60
    gain: float = 2e-4
    floor: float = 0.01
    slices: int = 32
    narrow: bool = False
    seed: int = 11

    @property
    def symbols(self) -> int:
        return self.head + self.tail

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(np.uint16 if self.symbols <= 1 << 16 else np.uint32)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (words with A-Z in lower case, then one end each), and where each text's begin (n + 1)."""
    data, offs = joined(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offs)
    count = np.diff(first)
    out = np.full(len(starts) + len(count), END, np.uint64)
    begin = np.concatenate([[0], np.cumsum(count + 1)])
    out[ranges(begin[:-1], count)] = word_hashes(data, starts, ends)
    return out, begin


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, times) of all tokens of (train, text) rows in training, by 64-bit hash; a task adds up each step's own before anything is sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text"), 8 << 20):
                word, times = np.unique(tokens(b.column("text")[i:j])[0], return_counts=True)
                yield batch(_COUNTS, word.view(np.int64), times)

    return docs.where("train").select("text").mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))


@dataclass
class Vocabulary:
    """The frequent words, sorted, with their counts, and of each tail symbol the tokens and the distinct words in training."""

    word: np.ndarray
    times: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray

    @staticmethod
    def of(counts: DataFrame, p: HmmParams) -> Vocabulary:
        """From the whole table of counts; the driver gets p.head rows of words and p.tail of sums."""
        head = counts.orderBy(F.desc("times"), "word").limit(p.head)
        top = head.toPandas().sort_values("word")
        rest = counts.join(F.broadcast(head.select("word")), "word", "left_anti")
        tail_tokens, tail_words = np.zeros(p.tail, np.int64), np.zeros(p.tail, np.int64)
        for r in rest.groupBy(F.pmod("word", F.lit(p.tail)).alias("k")).agg(F.sum("times").alias("n"), F.count("*").alias("v")).collect():
            tail_tokens[r.k], tail_words[r.k] = r.n, r.v
        return Vocabulary(top["word"].to_numpy(np.int64), top["times"].to_numpy(np.int64), tail_tokens, tail_words)

    def totals(self, p: HmmParams) -> np.ndarray:
        """Training tokens of each symbol."""
        out = np.zeros(p.symbols)
        out[: len(self.times)] = self.times
        out[p.head :] = self.tail_tokens
        return out

    def encoded(self, h: np.ndarray, p: HmmParams) -> tuple[np.ndarray, np.ndarray]:
        """Each token's symbol, and its place among the frequent words (-1: none)."""
        h = h.view(np.int64)
        at = np.minimum(np.searchsorted(self.word, h), max(len(self.word) - 1, 0))
        hit = self.word[at] == h if len(self.word) else np.zeros(len(h), bool)
        at = np.where(hit, at, -1)
        return np.where(hit, at, p.head + h % p.tail).astype(p.dtype), at


def _portions(order: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """The blocks in portions of about _PORTION symbols."""
    ends = np.cumsum(n[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PORTION, side="right")))
        yield order[i:j]
        i = j


class _Steps:
    """Blocks that are run together, by falling length. symbol: the first symbols of all blocks, then the second ones, ...; active: blocks longer than each step; edge: where each step begins."""

    def __init__(self, pieces: list[np.ndarray]):
        n = np.array([len(x) for x in pieces])
        self.flat, self.begin = np.concatenate(pieces).astype(np.intp), np.cumsum(n) - n
        active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")
        edge = np.concatenate([[0], np.cumsum(active)])
        self.active, self.edge = active.tolist(), edge.tolist()
        place = np.arange(len(self.flat)) - np.repeat(self.begin, n)
        self.symbol = np.empty_like(self.flat)
        self.symbol[edge[place] + np.repeat(np.arange(len(n)), n)] = self.flat

    def summed(self, of_symbol: np.ndarray) -> np.ndarray:
        """Each block's sum of a number that each symbol has."""
        return np.add.reduceat(of_symbol[self.flat], self.begin)


def _block(size: np.ndarray) -> int:
    """The length of blocks that costs least: a step takes as long as 100 tokens, and the matrices of longer sequences as long as their tokens run once or twice more."""
    ordered = np.sort(size)
    behind = np.concatenate([np.cumsum(ordered[::-1])[::-1], [0]])

    def cost(block: int) -> int:
        longer = int(behind[np.searchsorted(ordered, block, side="right")])
        return 100 * block * (2 if longer else 1) + 3 * longer // 2

    most = int(ordered[-1]) if len(ordered) else 1
    return min([1 << i for i in range(8, 15)] + [most] * (most < 1 << 15), key=cost)


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


class Hmm:
    """Start, move and emission probabilities (symbols x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)
        # A symbol's emissions by their largest one: a step then leaves a vector at least the smallest move's share, so that vectors are scaled only every few steps.
        most = self.emit.max(axis=1)
        self.shape, self.log = self.emit / most[:, None], np.log(most.astype(float))
        with np.errstate(divide="ignore"):
            lost = max(1.0, -np.log10(move.min()))
        self.every = int(np.clip((100 if move.dtype == np.float64 else 20) // lost, 1, 8))

    @staticmethod
    def first(totals: np.ndarray, p: HmmParams) -> Hmm:
        """Emissions are the symbols' counts, shaken by a seeded generator. All states but the last two have a bent to stay, and those to alternate: topics and word order both have a start."""
        k, rng = p.states, np.random.default_rng(p.seed)
        emit = (totals[:, None] + p.floor) * (rng.gamma(0.3, size=(len(totals), k)) + 0.01)
        move = rng.gamma(2.0, size=(k, k))
        to = np.arange(k)
        if k > 2:
            to[-2:] = k - 1, k - 2
        move = 0.2 * move / move.sum(axis=1, keepdims=True) + 0.8 * np.eye(k)[to]
        return Hmm(np.full(k, 1 / k), move, emit / emit.sum(axis=0))

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, p: HmmParams) -> Hmm:
        start, move, emit = start + 1e-3, move + 1e-3, emit + p.floor
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def run(self, seqs: list[np.ndarray], counts: Counts | None = None, block: int | None = None) -> np.ndarray:
        """Natural log-likelihoods of whole sequences by the scaled forward recursion; with counts, the expected starts, moves and emissions are added to them.

        A longer sequence than `block` is worked on in blocks, many at once, which changes no
        result: a block's matrix takes the forward vector before it to the one after it, and the
        backward vector after it to the one before it; once these are known, each block is run
        from them. Memory follows what is run together, not a sequence's length.
        """
        size = np.array([len(s) for s in seqs], np.int64)
        block = block or _block(size)
        many = np.maximum(-(-size // block), 1)
        seq = np.repeat(np.arange(len(seqs)), many)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(many) - many, many)
        n = np.minimum(size[seq] - place * block, block)
        pieces = [seqs[q][i * block : i * block + m] for q, i, m in zip(seq.tolist(), place.tolist(), n.tolist(), strict=True)]
        before, after = np.repeat(self.start[None], len(seq), axis=0), np.ones((len(seq), len(self.start)), self.start.dtype)
        long = np.flatnonzero(many[seq] > 1)
        if len(long):
            whole = np.empty((len(seq), *self.move.shape), self.move.dtype)
            for own in _portions(long[np.argsort(-n[long], kind="stable")], n):
                whole[own] = self._matrices(_Steps([pieces[i] for i in own]), place[own] == 0)
            for i in long[place[long] > 0].tolist():
                before[i] = before[i - 1] @ whole[i - 1]
                before[i] /= before[i].sum()
            for i in long[place[long] < many[seq[long]] - 1][::-1].tolist():
                after[i] = whole[i + 1] @ after[i + 1]
                after[i] /= after[i].sum()
        like = np.zeros(len(seqs))
        for own in _portions(np.argsort(-n, kind="stable"), n):
            np.add.at(like, seq[own], self._blocks(_Steps([pieces[i] for i in own]), place[own] == 0, before[own], after[own], counts))
        return like

    def _matrices(self, x: _Steps, first: np.ndarray) -> np.ndarray:
        """Each block's matrix, up to a factor: forward runs from each state. A sequence's first symbol has no move before it."""
        k, dtype = len(self.start), self.move.dtype
        out = np.repeat(np.eye(k, dtype=dtype)[:, None], x.active[0], axis=1)
        moved, e = np.empty_like(out), np.empty((x.active[0], k), dtype)
        for t, b in enumerate(x.active):
            self.shape.take(x.symbol[x.edge[t] : x.edge[t + 1]], axis=0, out=e[:b], mode="clip")
            for i in range(k):
                np.dot(out[i, :b], self.move, out=moved[i, :b])
            if t == 0:
                moved[:, first] = out[:, first]
            np.multiply(moved[:, :b], e[:b], out=out[:, :b])
            if t % self.every == 0:
                out[:, :b] /= out[:, :b].max(axis=(0, 2))[:, None]
        return (out / out.max(axis=(0, 2))[:, None]).transpose(1, 0, 2)

    def _blocks(self, x: _Steps, first: np.ndarray, before: np.ndarray, after: np.ndarray, counts: Counts | None) -> np.ndarray:
        """Log-likelihood of each block after what is before it. A step's vectors stay in the processor's cache; only the forward vectors are kept for the way back."""
        k, dtype, edge, active = len(self.start), self.move.dtype, x.edge, x.active
        alpha, e = np.empty((edge[-1] if counts else 2 * active[0], k), dtype), np.empty((active[0], k), dtype)
        ones, like, scale = np.ones(k, dtype), x.summed(self.log), {}
        own = before
        for t, b in enumerate(active):
            lo = edge[t] if counts else t % 2 * active[0]
            last, own = own, alpha[lo : lo + b]
            np.dot(last[:b], self.move, out=own)
            if t == 0:
                own[first] = before[first]
            self.shape.take(x.symbol[edge[t] : edge[t + 1]], axis=0, out=e[:b], mode="clip")
            own *= e[:b]
            if t % self.every == 0:
                scale[t] = own @ ones
                own /= scale[t][:, None]
                like[:b] += np.log(scale[t].astype(float))
            on = active[t + 1] if t + 1 < len(active) else 0
            if on < b:  # blocks that end here
                like[on:b] += np.log((own[on:] @ ones).astype(float))
        if counts is None:
            return like
        start, move, emit = counts
        beta, back, moves, step = np.empty_like(e), np.ascontiguousarray(self.move.T), np.zeros((k, k)), np.empty((k, k), dtype)
        on = 0
        for t in range(len(active) - 1, -1, -1):
            lo, b = edge[t], active[t]
            own = alpha[lo : lo + b]
            if on:  # e: emissions of the next step, times their backward vectors
                np.dot(own[:on].T, e[:on], out=step)
                moves += step
                np.dot(e[:on], back, out=beta[:on])
            if on < b:
                beta[on:b] = after[on:b] / (own[on:] * after[on:b]).sum(axis=1, keepdims=True)
            own *= beta[:b]
            self.shape.take(x.symbol[lo : lo + b], axis=0, out=e[:b], mode="clip")
            e[:b] *= beta[:b]
            if t in scale:
                e[:b] /= scale[t][:, None]
            on = b
        if not first.all():
            moves += before[~first].T @ e[~first]
        move += moves * self.move
        start += alpha[: active[0]][first].sum(axis=0)
        # a state's own run of numbers, of which a part is turned at a time
        turned = np.empty((k, min(len(alpha), _TURNED)), dtype)
        for i in range(0, len(alpha), _TURNED):
            n = min(_TURNED, len(alpha) - i)
            for j in range(i, i + n, 4096):
                turned[:, j - i : min(j + 4096 - i, n)] = alpha[j : min(j + 4096, i + n)].T
            for j in range(k):
                emit[:, j] += np.bincount(x.symbol[i : i + n], turned[j, :n], len(emit))
        return like


def _sequences(column: pa.Array, dtype: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def train(encoded: DataFrame, totals: np.ndarray, p: HmmParams) -> Hmm:
    """Baum-Welch over whole training texts until their likelihood settles: first over a part of them, which brings the start near its end, then over all."""
    model, own = Hmm.first(totals, p), encoded.where("train")
    if p.warm > 1:
        # stored, so that these rounds don't read the other texts
        part = own.where(F.crc32("symbols") % p.warm == 0).select("symbols").coalesce(max(1, partitions(encoded.sparkSession) // p.warm))
        model = _trained(stored(part, "symbols-part"), model, p, p.warm_rounds, 10 * p.gain)
    return _trained(own, model, p, p.rounds, p.gain)


def _trained(encoded: DataFrame, model: Hmm, p: HmmParams, rounds: int, gain: float) -> Hmm:
    """Rounds over all texts of `encoded`: each task adds up its expected counts, which are summed slice by slice; the driver gets one table of symbols x states a round. A task sends one such table however much it reads, so their number follows the cores and not the texts."""
    before, dtype = None, p.dtype
    spark = encoded.sparkSession
    width = -(-p.symbols // p.slices)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model.start, model.move, model.emit))  # symbols x states numbers

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, like, n = Hmm(*(x.astype(np.float32 if p.narrow else np.float64) for x in sent.value)), 0.0, 0
            counts = np.zeros(p.states), np.zeros((p.states, p.states)), np.zeros((p.symbols, p.states))
            for b in batches:
                for i, j in steps(b.column("symbols"), 1 << 23):
                    like += own.run(_sequences(b.column("symbols")[i:j], dtype), counts).sum()
                    n += j - i
            if n:
                rows = [(k, counts[2][k * width : (k + 1) * width].ravel()) for k in range(p.slices)]
                rows.append((p.slices, np.concatenate([[like], counts[0], counts[1].ravel()])))
                yield batch(_SUMS, [k for k, _ in rows], [x.tobytes() for _, x in rows])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for to, x in zip(b.column("to").to_pylist(), b.column("sums"), strict=True):
                    own = np.frombuffer(x.as_buffer(), float)
                    total[to] = total[to] + own if to in total else own.copy()
            yield batch(_SUMS, list(total), [x.tobytes() for x in total.values()])

        schema = "to long, sums binary"
        tasks = 2 * spark.sparkContext.defaultParallelism
        sums = encoded.select("symbols").coalesce(tasks).mapInArrow(expect, schema)
        # a slice is whole in one partition, and stays so where a task takes several partitions
        sums = sums.repartition(min(p.slices, partitions(spark)), "to").coalesce(tasks).mapInArrow(add, schema)
        parts = {row.to: np.frombuffer(bytes(row.sums)) for row in sums.toLocalIterator()}
        sent.unpersist()
        if not parts:
            break
        head, k = parts[p.slices], p.states
        model = Hmm.of_counts(head[1 : k + 1], head[k + 1 :].reshape(k, k), np.concatenate([parts[i] for i in range(p.slices)]).reshape(-1, k), p)
        if before is not None and head[0] - before < gain * abs(before):
            break
        before = head[0]
    return model


def hmm_scores(docs: DataFrame, held_out: Column, params: HmmParams = HmmParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end. base_score: the sum
    of log10((c + 1) / (N + V + 1)). score: log10 of the probability of the text under

        P(text) = P(symbol sequence | hidden Markov model) * product of P(word | its symbol).

    The params.head most frequent training words are symbols of their own. Every other word is
    dealt to a tail symbol, where P(word | symbol) = (c + 1) / (N_symbol + V_symbol + 1); an
    unknown word has c = 0. The symbol sequence's probability is the exact sum over all state
    paths, by the scaled forward recursion over the whole text. Counts are of all training rows
    (held_out false or null), and so are the expected counts of every Baum-Welch round, in which
    texts are never cut. Words are known by 64-bit hashes; their counts stay distributed, and
    only tail words, none of which is frequent, are sent to meet them.

    A null text counts as empty: the end alone. Repeated rows count as texts of their own, and
    equal rows have equal scores. An empty table gives no rows; other columns are ignored.
    """
    p = params
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.select("doc_id", "held_out", (~F.col("held_out")).alias("train"), "text")
    counts = stored(word_counts(own), "word-counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("times"), F.count("*")).first())
    vocab = Vocabulary.of(counts, p)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocab)  # p.head words
    dtype = p.dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = known.value
        log = np.append(np.log10(vocab.times + 1.0), 0.0)
        loss = np.concatenate([np.zeros(p.head), np.log10(vocab.tail_tokens + vocab.tail_words + 1.0)])
        for b in batches:
            for i, j in steps(b.column("text")):
                h, begin = tokens(b.column("text")[i:j])
                symbol, at = vocab.encoded(h, p)
                rare = at < 0
                edge = np.concatenate([[0], np.cumsum(rare)])[begin]
                tail = pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(h[rare].view(np.int64)))
                add = lambda x, begin=begin: np.add.reduceat(x, begin[:-1])
                yield batch(_ENCODED, *(b.column(c)[i:j] for c in ("doc_id", "held_out", "train")), np.diff(begin), add(log[at]), np.diff(begin) - np.diff(edge), add(loss[symbol]), [symbol[a:z].tobytes() for a, z in zip(begin, begin[1:], strict=False)], tail)

    # rows may be alike, so each has a number of its own, which is stored with it
    encoded = stored(own.mapInArrow(encode, ENCODED).withColumn("row", F.monotonically_increasing_id()), "symbols")
    tail = encoded.select("row", F.explode("tail").alias("word")).join(counts.hint("merge"), "word")
    fixed = F.round(F.log10(F.col("times") + 1.0) * _POINT).cast("long")
    tail = tail.groupBy("row").agg(F.sum(fixed).alias("tail_log"), F.count("*").alias("tail_known"))
    model = train(encoded, vocab.totals(p), p)
    sent = spark.sparkContext.broadcast((model.start, model.move, model.emit))  # symbols x states numbers
    scored = pa.schema([f for f in _ENCODED if f.name not in ("train", "loss", "symbols", "tail")] + [pa.field("row", pa.int64()), pa.field("model", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = Hmm(*sent.value)
        for b in batches:
            for i, j in steps(b.column("symbols"), 1 << 23):
                like = hmm.run(_sequences(b.column("symbols")[i:j], dtype))
                yield batch(scored, *(b.column(c)[i:j] for c in scored.names[:-1]), like / np.log(10) - np.asarray(b.column("loss")[i:j]))

    rows = encoded.drop("train", "tail").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, head_log double, head_known long, row long, model double")
    rows = rows.join(tail.hint("merge"), "row", "left")
    tail_log, tail_known = F.coalesce(F.col("tail_log") / _POINT, F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    base = F.col("head_log") + tail_log - F.col("n_tokens") * float(np.log10(n + v + 1))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + tail_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + tail_log).alias("score"))
