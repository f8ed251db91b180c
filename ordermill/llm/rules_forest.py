"""Quality rules: base rules on text statistics, then isolation forests on their shares.

Trees of random splits over a bounded random sample of rows; a row that few splits set apart is anomalous. Scores are
2 ** (-mean path / expected path). There are two forests: one over the shares of signs, capitals and repetition, and one
over all shares, word length, repeated lines, digits and length among them, so a text that is odd in any rule statistic
can be found. The threshold of the first is the score at which most bad labelled rows that pass the base rules fall for at
most ``CLEAN_LOSS`` of the good ones; of the second, among the rows that are left, the least score above all good ones.

Nulls and empty texts have all-zero statistics and fail the base rules (fewer than 50 words). Equal texts get equal
verdicts, so repeated rows and ties do; null ids are rows like others; an empty table gives no rows. Extra columns are
ignored. Very long texts are counted one at a time. Without any labelled row of both kinds the thresholds are
``DEFAULT_THRESHOLD``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm import text_stats
from ordermill.llm.common import in_batches, lower_part, texts_of, written

TREES = 400
TREE_ROWS = 128
#: Fewer rows make trees of all shares, where most say nothing of a row, less blind to kinds of bad rows that are many.
ALL_TREE_ROWS = 32
#: At most so many rows are brought to the driver to draw the trees' samples from.
SAMPLE_ROWS = 20_000
CLEAN_LOSS = 0.005
DEFAULT_THRESHOLD = 0.7
BINS = 10_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares of the first forest; the second has all.
SPLIT_ON = ("symbols", "repeats", "upper", "exclaims", "bars", "same_next")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and all rule statistics of every row's whole text."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = text_stats.matrix(texts_of(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in found.T]],
                                          ["doc_id", *text_stats.NAMES])
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in text_stats.NAMES)
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, schema)


def expected_path(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class Forest:
    """Random trees as flat arrays: column, cut, first child (0: a leaf) and the path length of each node."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        self.norm = max(expected_path(size), 1e-9)
        self.trees = []
        for _ in range(trees if len(rows) else 0):
            self.trees.append(self._grow(rows[rng.choice(len(rows), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))))

    @staticmethod
    def _grow(rows, rng, limit):
        column, cut, child, path = [0], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_columns = np.flatnonzero(high > low)
            if depth >= limit or not len(open_columns):
                path[node] = depth + expected_path(len(part))
                continue
            column[node] = int(rng.choice(open_columns))
            cut[node] = float(rng.uniform(low[column[node]], high[column[node]]))
            child[node] = len(column)
            left = part[:, column[node]] < cut[node]
            if left.all() or not left.any():  # the cut met the least value
                left = part[:, column[node]] <= low[column[node]]
                cut[node] = float(np.nextafter(low[column[node]], np.inf))
            for k, side in enumerate((part[left], part[~left])):
                column.append(0), cut.append(0.0), child.append(0), path.append(0.0)
                todo.append((child[node] + k, side, depth + 1))
        return np.array(column), np.array(cut), np.array(child), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher is odder."""
        if not self.trees:
            return np.zeros(len(rows))
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for column, cut, child, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                first = child[node]
                if not first.any():
                    break
                right = rows[each, column[node]] >= cut[node]
                node = np.where(first > 0, first + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def split_shares(stats: np.ndarray) -> np.ndarray:
    keep = [text_stats.SHARES.index(n) for n in SPLIT_ON]
    return text_stats.shares(stats)[:, keep]


def threshold_of(counts: list[tuple[int, int, int]], loss: float = CLEAN_LOSS) -> float:
    """The score from which rows are rejected: (bin, quality, rows) of all labelled rows in, a bin's lower edge out.

    Of all edges that reject at most ``loss`` of the good rows, the one with the best balance of rejected bad rows and
    kept good ones.
    """
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, quality, n in counts:
        (good if quality else bad)[b] += n
    if not good.sum() or not bad.sum():
        return DEFAULT_THRESHOLD
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    balance = np.where(lost <= loss, caught - lost, -1)
    best = int(np.flatnonzero(balance == balance.max()).max())
    return best / BINS if balance[best] > 0 else 1.1


def above_good(counts: list[tuple[int, int, int]]) -> float:
    """The least score (a bin's lower edge) above all good rows."""
    good = [b for b, quality, n in counts if quality and n]
    return (max(good) + 1) / BINS if good else DEFAULT_THRESHOLD


def judged(docs: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, base statistics, base_failed, the anomaly score and kept, for every row."""
    stats = written(statistics(docs), "rule-stats")
    order = F.xxhash64(F.lit(seed), *[F.col(n) for n in ("doc_id", *text_stats.NAMES)])
    lower = stats.filter(order <= lower_part(stats.count(), SAMPLE_ROWS))
    drawn = lower.orderBy(order).limit(SAMPLE_ROWS).select(*text_stats.NAMES).toPandas()
    sample = drawn.to_numpy(np.int64).reshape(-1, len(text_stats.NAMES))
    some, every = Forest(split_shares(sample), seed=seed), Forest(text_stats.shares(sample), tree_rows=ALL_TREE_ROWS, seed=seed + 1)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.stack([batch.column(n).to_numpy() for n in text_stats.NAMES], axis=1)
        both = some.scores(split_shares(values)), every.scores(text_stats.shares(values))
        return pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", *BASE)] + [pa.array(x) for x in both],
                                          ["doc_id", *BASE, "anomaly", "anomaly_all"])
    kinds = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", anomaly double, anomaly_all double"
    scored = written(in_batches(stats, score, kinds), "rule-scores")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
                  .filter("doc_id is not null and quality is not null").distinct()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    first, second = (F.floor(F.col(c) * BINS).cast("int") for c in ("anomaly", "anomaly_all"))
    # at most BINS * BINS counts; in fact some thousands
    counts = [tuple(r) for r in scored.filter(~failed).join(marks, "doc_id").groupBy(first, second, "quality").count().collect()]
    low = round(threshold_of([(a, q, n) for a, _, q, n in counts]) * BINS)
    high = round(above_good([(b, q, n) for a, b, q, n in counts if a < low]) * BINS)
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (first < low) & (second < high)).alias("kept"),
                         "anomaly", "anomaly_all")
