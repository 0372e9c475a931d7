"""Quality scores learnt from preferences between pairs of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batch, documents, joined, steps, word_hashes, words

#: Classes of bytes; their shares of a text are features.
CLASSES = {"upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "space": [9, 11, 12, 13, 32], "line": [10], "stop": [44, 46], "mark": [33, 63], "bar": [124], "sign": [*b"#$%&*@^~=+<>"], "other": [*b"\"'()-/:;[\\]_`{}"]}
NAMES = [*CLASSES, "high", "bytes", "word_length", "distinct", "repeated", "near_repeated", "line_length", "odd_ends"]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _members in enumerate(CLASSES.values()):
    _CLASS[_members] = _i


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text, from its bytes and words only; zeros for an empty one."""
    data, offs = joined(texts)
    sizes = (offs[1:] - offs[:-1] - 1).astype(float)
    doc = np.repeat(np.arange(len(sizes)), np.diff(offs))
    k = len(CLASSES) + 1
    shares = np.bincount(doc * k + _CLASS[data], minlength=len(sizes) * k).reshape(-1, k).astype(float)
    shares[:, list(CLASSES).index("space")] -= 1  # the blank that joined() adds
    lines = shares[:, list(CLASSES).index("line")] + 1
    starts, ends, first = words(data, offs)
    h = word_hashes(data, starts, ends)
    own = np.repeat(np.arange(len(sizes)), np.diff(first))
    count = np.diff(first).astype(float)
    tally = lambda hit, of: np.bincount(of[hit], minlength=len(sizes)).astype(float)
    order = np.lexsort((h, own))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    near = np.zeros(len(h), bool)
    for back in (2, 3, 4):
        near[back:] |= (h[back:] == h[:-back]) & (own[back:] == own[:-back])
    last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, int)
    odd = np.isin(last, [list(CLASSES).index(x) for x in ("mark", "bar", "sign")])
    n, w = np.maximum(sizes, 1), np.maximum(count, 1)
    columns = [*(shares / n[:, None]).T, np.log1p(sizes), np.minimum((sizes - count) / w, 50) / 10, tally(new, own[order]) / w, tally(again, own) / w, tally(near, own) / w, np.log1p(sizes / lines), tally(odd, own) / w]
    return np.where(sizes[:, None] > 0, np.stack(columns, axis=1), 0.0)


@dataclass(frozen=True)
class Ranker:
    """score(x) = 1 / (1 + exp(-(slope * (w . (x - mean) / scale - cut) + logit(threshold)))): exactly `threshold` at the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (((x - self.mean) / self.scale * self.weights).sum(axis=1) - self.cut)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)) * (1 - self.threshold) / self.threshold)


def train_ranker(x: np.ndarray, label: np.ndarray, threshold: float = 0.3, pairs: int = 40_000, ridge: float = 1e-3, rounds: int = 25, seed: int = 7) -> Ranker:
    """Bradley-Terry: the logistic loss of w . (x_good - x_bad) over random preference pairs, by Newton's method.

    The cut is the quantile of the training scores at which the share of the labels 0 lies
    below; score() is 0.5-shifted there so that the cut maps to `threshold`. With one label
    only, all weights are 0 and every score lies on that label's side.
    """
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    z, good, bad = (x - mean) / scale, np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(z.shape[1]), 1.0 if len(bad) else -1.0, 1.0, threshold)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    low, high = np.quantile(s, len(bad) / len(s)), np.median(s[good])
    # between the quantile's neighbours when the two labels part cleanly
    under, over = s[bad].max(), s[good].min()
    cut = (under + over) / 2 if under < over else low
    return Ranker(mean, scale, w, float(cut), float(4 / max(1e-6, high - cut)), threshold)


_FEATURES = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.float64()))])


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column | None = None, label_col: str = "quality", sample: int = 20_000, threshold: float = 0.3, pairs: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """Train on at most `sample` labelled documents (those with the smallest hashes of their ids: the same ones at every run).

    keep: a condition on the labels' id. Ids labelled twice count once, with the larger label,
    and of documents that share an id the largest text; null labels and ids, and ids without a
    document, are left out. The sample's bound holds for the broadcast of its ids and for what
    comes to the driver: one row of features each. pairs: preference pairs that are drawn from
    the sample, a good and a bad document each, with a fixed seed; a bound of the driver's work.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    chosen = chosen.where(keep) if keep is not None else chosen
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text")):
                x = text_features(b.column("text")[i:j])
                yield batch(_FEATURES, b.column("label")[i:j], list(x))

    rows = documents(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
    rows = rows.select("label", "text").mapInArrow(compute, "label int, features array<double>").toPandas()  # at most `sample` rows
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(NAMES))
    label = rows["label"].to_numpy(int)
    order = np.lexsort((*x.T, label))  # independent of the order in which tasks end
    return train_ranker(x[order], label[order], threshold, pairs)


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def quality_scores(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; predicted is 1 where score >= the ranker's threshold.

    Only texts are read. A null text counts as empty; equal texts have equal scores; repeated
    rows each give a row; an empty table gives no rows; other columns are ignored.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column("text")):
                yield batch(_SCORED, b.column("doc_id")[i:j], ranker.score(text_features(b.column("text")[i:j])))

    scored = documents(docs, id_col, text_col).mapInArrow(compute, "doc_id long, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= ranker.threshold, 1).otherwise(0))


def keep_quality(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text the ranker doesn't reject."""
    names, index = docs.columns, docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in steps(b.column(index)):
                yield b.slice(i, j - i).filter(pa.array(ranker.score(text_features(b.column(index)[i:j])) >= ranker.threshold))

    return docs.select(*names).mapInArrow(kept, docs.schema)
