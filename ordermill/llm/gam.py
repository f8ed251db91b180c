"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins and has one lookup table; so have a few pairs of features on a coarser grid.
The tables are learned by cyclic boosting: round by round each feature in turn gets a shallow tree (three cuts at most)
fitted to the logistic loss of what all tables together predict, shrunk by a small rate. Then pairs are chosen by the
loss that the best four quadrants would remove, and boosted in the same way. A score is the sum of one table entry for
each feature and pair, so scoring is bin lookups and additions.

Features come from the text alone. Nulls and empty texts have zero statistics and get a score like any other row.
The fit uses at most ``fit_rows`` labelled rows; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.llm import text_stats
from ordermill.llm.common import give_back, in_batches, lower_part, prepare, texts_of

BINS = 48
GRID = 12
FIT_ROWS = 20_000


class AdditiveModel:
    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, pairs: int = 5, pair_rounds: int = 40, rate: float = 0.15):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, GRID + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        prior = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(prior / (1 - prior)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if not len(y) or y.min() == y.max():
            return
        codes = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]
        total = np.full(len(y), self.base)
        for _ in range(rounds):
            for f, code in enumerate(codes):
                slope, weight = _gradients(total, y)
                step = rate * _tree(np.bincount(code, slope, len(self.tables[f])), np.bincount(code, weight, len(self.tables[f])), 2)
                self.tables[f] += step
                total += step[code]
        grid = [np.searchsorted(e, c, side="right") for e, c in zip(self.coarse, x.T)]
        cells = {p: grid[p[0]] * GRID + grid[p[1]] for p in combinations(range(x.shape[1]), 2)}
        slope, weight = _gradients(total, y)
        gains = {p: _quadrants(*_grids(c, slope, weight))[1] for p, c in cells.items()}
        self.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
        self.grids = [np.zeros((GRID, GRID)) for _ in self.pairs]
        for _ in range(pair_rounds):
            for p, table in zip(self.pairs, self.grids):
                slope, weight = _gradients(total, y)
                step = rate * _quadrants(*_grids(cells[p], slope, weight))[0]
                table += step
                total += step.ravel()[cells[p]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for edges, table, column in zip(self.edges, self.tables, x.T):
            total += table[np.searchsorted(edges, column, side="right")]
        for (a, b), table in zip(self.pairs, self.grids):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _gradients(total: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-total))
    return y - p, p * (1 - p)


def _value(slope, weight):
    return slope / (weight + 1.0)


def _tree(slope: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """The step of each bin by a tree of so many levels of cuts over the bins."""
    out = np.full(len(slope), _value(slope.sum(), weight.sum()))
    if depth == 0 or len(slope) < 2:
        return out
    left_s, left_w = slope.cumsum()[:-1], weight.cumsum()[:-1]
    right_s, right_w = slope.sum() - left_s, weight.sum() - left_w
    k = int(np.argmax(left_s * _value(left_s, left_w) + right_s * _value(right_s, right_w))) + 1
    out[:k], out[k:] = _tree(slope[:k], weight[:k], depth - 1), _tree(slope[k:], weight[k:], depth - 1)
    return out


def _grids(cells, slope, weight):
    size = GRID * GRID
    return np.bincount(cells, slope, size).reshape(GRID, GRID), np.bincount(cells, weight, size).reshape(GRID, GRID)


def _quadrants(slope: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The step of each cell by the best pair of cuts, and how much it explains."""
    s, w = slope.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)

    def corners(c):
        a = c[:-1, :-1]
        return a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a
    gain = sum(q * _value(q, r) for q, r in zip(corners(s), corners(w)))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(slope)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, columns] = _value(slope[rows, columns].sum(), weight[rows, columns].sum())
    return out, float(gain[i, j])


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, mark: str, folds: int, held: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (text, mark) outside the held-out fold, drawn by a hash of their id.

    The drawn ids, at most ``rows`` of them, are broadcast; only their texts are read on.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(mark).cast("int").alias("__mark")) \
                  .filter(F.col("__id").isNotNull() & F.col("__mark").isNotNull() & (fold_of(F.col("__id"), folds) != held))
    drawn = marks.filter(F.xxhash64("__id") <= lower_part(marks.count(), rows)) \
                 .groupBy("__id").agg(F.max("__mark").alias("__mark")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").alias("__text"))
    return texts.join(F.broadcast(drawn), texts["__doc"] == drawn["__id"]) \
                .select(F.col("__text").alias("text"), F.col("__mark").alias("mark"))


def _features(texts: list[str]) -> np.ndarray:
    return text_stats.shares(text_stats.matrix(texts))


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """A model of labels.quality; only a fixed number of feature rows reaches the driver."""
    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _features(texts_of(batch.column("text")))
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], batch.column("mark")], [*text_stats.SHARES, "mark"])
    schema = ", ".join(f"{n} double" for n in text_stats.SHARES) + ", mark int"
    rows = in_batches(labelled_sample(docs, labels, "quality", 5, 0, fit_rows), features, schema).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable").to_numpy(np.float64).reshape(-1, len(text_stats.SHARES) + 1)
    return AdditiveModel(rows[:, :-1], rows[:, -1])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    model = fitted(docs, labels)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(_features(texts_of(batch.column("text")))))],
            ["doc_id", "held_out", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    return in_batches(rows, score, "doc_id long, held_out boolean, score double") \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``threshold``."""
    model = fitted(docs, labels)

    @F.pandas_udf("double")  # only the text goes to Python; the rows stay where they are
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(_features([t if t is not None else "" for t in texts])))
        give_back()
    prepare(docs.sparkSession)
    return docs.filter(score("text") >= threshold)
