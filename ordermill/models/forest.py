"""Deep forests for many rows: each tree is grown by one task, on the packed bins of all rows.

Features have few bins, so a row is a few bytes (``boosting.grouped``) and the whole table goes to every task; no tree waits for
another, and its nodes go straight into a table instead of the driver. A tree is what ``RandomForestClassifier`` grows: Poisson
counts of all rows, the same bins from the same drawn rows, features drawn anew for every node, splits by weighted Gini gain with
so many drawn rows on each side, and sibling leaves that predict the same label taken together. Only the random numbers are others.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.models import boosting, node_table
from ordermill.session import written

#: Rows that are drawn, counted or parted at once, unless a single node has more (then they are only counted by as many).
CHUNK = 65_536
#: Nodes in a batch of results.
BATCH = 200_000
EPSILON = boosting.EPSILON
# tasks get the functions themselves, so that, like the other models, they need no package where they run
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class ForestTrees:
    """A forest as a table of its nodes."""

    nodes: DataFrame
    depth: int
    size: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, of label 0 and of label 1."""
        rows = df.withColumn("__x", vector_to_array("features"))
        risk = F.col("__total")
        return node_table.total_of(self.nodes, rows, self.depth, self.size).select(
            *df.columns, array_to_vector(F.array(1 - risk, risk)).alias("probability"))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as the library's models name it
        return boosting.importances(self.nodes, self.size, by_tree=True)


@dataclass(frozen=True)
class Table:
    """All rows as cells, and how to read a feature's bin from them."""

    cells: np.ndarray   # by row, then group
    labels: np.ndarray  # 0 or 1
    group: np.ndarray   # per feature: its group
    bins: np.ndarray    # per feature: its bins; 1 where there is nothing to split
    look: np.ndarray    # per feature and value of its cell: the bin; end to end
    wide: int           # values of the widest cell

    def bin_of(self, feature: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The bin of one feature per row of ``cells``."""
        count, width = cells.shape
        return self.look.take(feature * self.wide + cells.ravel().take(np.arange(0, count * width, width) + self.group.take(feature)))


def table_of(cells: np.ndarray, labels: np.ndarray, cuts: Sequence[np.ndarray], groups: Sequence) -> Table:
    wide = max((boosting.width(g) for g in groups), default=1)
    place, bins, look = np.zeros(len(cuts), np.int64), np.ones(len(cuts), np.int64), np.zeros((len(cuts), wide), np.int64)
    for at, group in enumerate(groups):
        for feature, stride, some in group:
            place[feature], bins[feature] = at, some
            look[feature] = np.arange(wide) // stride % some
    return Table(np.ascontiguousarray(cells.T), labels, place, bins, look.ravel(), wide)


# ---- one tree --------------------------------------------------------------------------------

def drawn_features(rng: np.random.Generator, nodes: int, features: int, wanted: int) -> np.ndarray:
    """``wanted`` different features for each node, in the places that a reservoir gives them."""
    out = np.tile(np.arange(wanted), (nodes, 1))
    each = np.arange(nodes)
    for feature in range(wanted, features):
        place = rng.integers(0, feature + 1, nodes)
        inside = place < wanted
        out[each[inside], place[inside]] = feature
    return out


def drawn_rows(rng: np.random.Generator, rows: int) -> np.ndarray:
    """How often each row is drawn."""
    out = np.empty(rows, np.uint8)
    for begin in range(0, rows, CHUNK):
        out[begin:begin + CHUNK] = rng.poisson(1.0, min(CHUNK, rows - begin))
    return out


def impurity(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    whole = zeros + ones
    zeros, ones = zeros / whole, ones / whole
    return 1.0 - zeros * zeros - ones * ones


@dataclass
class Found:
    """The best split of each node: no gain where there is none. ``low`` holds the drawn rows of both labels on that side."""

    gain: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray


def best_splits(table: Table, cells: np.ndarray, labels: np.ndarray, counts: np.ndarray, own: np.ndarray, whole: np.ndarray,
                chosen: np.ndarray, weights: np.ndarray, least: int) -> Found:
    """The best split per node among its chosen features; equal gains go to the first of these and the smallest cut.

    ``own`` is the node of each row, ``whole`` the drawn rows of both labels per node.
    """
    nodes = len(whole)
    best = Found(np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros((nodes, 2)))
    zeros, ones = (np.ascontiguousarray(w, float) for w in whole.T)
    parent, total = impurity(zeros * weights[0], ones * weights[1]), zeros * weights[0] + ones * weights[1]
    for feature in chosen.T:
        sizes = table.bins.take(feature)
        first, count = sizes.cumsum() - sizes, sizes.sum()
        sums = np.zeros(2 * count)  # of label 0, then of label 1
        for begin in range(0, len(cells), CHUNK):
            some = slice(begin, begin + CHUNK)
            at = first.take(own[some]) + table.bin_of(feature.take(own[some]), cells[some])
            at += labels[some] * count
            sums += np.bincount(at, counts[some], 2 * count)
        node, low = np.repeat(np.arange(nodes), sizes), []
        for part in (sums[:count], sums[count:]):
            upto = part.cumsum()
            low.append(upto - (upto.take(first) - part.take(first)).take(node))
        raw, every = low[0] + low[1], (zeros + ones).take(node)
        here = np.flatnonzero((raw >= least) & (every - raw >= least))
        if not len(here):
            continue
        node, low = node.take(here), [part.take(here) for part in low]
        left = [part * weight for part, weight in zip(low, weights)]
        right = [(part.take(node) - one) * weight for part, one, weight in zip((zeros, ones), low, weights)]
        whole_node = total.take(node)
        gain = parent.take(node) - (left[0] + left[1]) / whole_node * impurity(*left) - (right[0] + right[1]) / whole_node * impurity(*right)
        begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])  # the nodes with any split
        most = np.maximum.reduceat(gain, begin)
        hits = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[begin, len(node)])))
        hits = hits[np.r_[True, node[hits[1:]] != node[hits[:-1]]]]  # the first of each node
        hits = hits[gain[hits] > best.gain[node[hits]]]
        to = node[hits]
        best.gain[to], best.feature[to], best.cut[to] = gain[hits], feature[to], here[hits] - first[to]
        best.low[to, 0], best.low[to, 1] = low[0][hits], low[1][hits]
    best.gain[best.gain <= EPSILON] = 0.0
    return best


def parted(high: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each node with its low side first, and the rows of each side."""
    begin = lens.cumsum() - lens
    low = ~high
    upto = low.cumsum()
    before = upto[begin] - low[begin]
    lows = np.r_[before[1:], upto[-1]] - before
    rank = upto - np.repeat(before, lens)  # low rows of the node up to here
    at = np.where(low, np.repeat(begin, lens) + rank - 1, np.repeat(lows, lens) + np.arange(len(rows)) - rank)
    out = np.empty_like(rows)
    out[at] = rows
    return out, np.stack([lows, lens - lows], axis=1).ravel()


def chunks(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of nodes with at most ``CHUNK`` rows together, or one node."""
    upto, begin = np.r_[0, lens.cumsum()], 0
    while begin < len(lens):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + CHUNK, "right")) - 1)
        yield begin, end
        begin = end


def grown(table: Table, rng: np.random.Generator, counts: np.ndarray, weights: np.ndarray, depth: int, least: int,
          wanted: int) -> dict[str, np.ndarray]:
    """A tree on ``counts`` of the rows: its nodes by level, children side by side."""
    rows = np.flatnonzero(counts).astype(np.int32)
    whole = np.bincount(table.labels.take(rows), counts.take(rows), 2)[None, :]
    out = {"feature": [np.full(1, -1)], "cut": [np.zeros(1, np.int64)], "low": [np.full(1, -1)], "gain": [np.zeros(1)], "whole": [whole]}
    lens, number, level = np.array([len(rows)]), 1, 0  # rows of each open node, end to end; nodes so far

    def is_open(sides: np.ndarray) -> np.ndarray:
        return (sides > 0).all(axis=1) & (sides.sum(axis=1) >= 2 * least)
    ids = np.flatnonzero(is_open(whole))  # of the open nodes, in their level
    rows, lens = (rows, lens) if len(ids) else (rows[:0], lens[:0])
    while len(ids) and level < depth:
        next_rows, next_lens, next_whole, open_sides, begin_row = [], [], [], [], 0
        here = {k: out[k][-1] for k in out}
        for begin, end in chunks(lens):
            some = lens[begin:end]
            mine = rows[begin_row:begin_row + some.sum()]
            begin_row += len(mine)
            own = np.repeat(np.arange(end - begin), some)
            node = ids[begin:end]
            cells = table.cells.take(mine, axis=0)
            found = best_splits(table, cells, table.labels.take(mine).astype(np.int64), counts.take(mine).astype(float), own, here["whole"][node],
                                drawn_features(rng, len(node), len(table.bins), wanted), weights, least)
            split = found.gain > 0
            if not split.any():
                continue
            to = node[split]
            here["feature"][to], here["cut"][to], here["gain"][to] = found.feature[split], found.cut[split], found.gain[split]
            here["low"][to] = number + 2 * np.arange(len(to))
            number += 2 * len(to)
            if not split.all():
                stays = split[own]
                mine, own, cells = mine[stays], own[stays], cells[stays]
            high = np.concatenate([table.bin_of(found.feature.take(n), c) > found.cut.take(n) for n, c in (
                (own[i:i + CHUNK], cells[i:i + CHUNK]) for i in range(0, len(mine), CHUNK))])
            mine, sides = parted(high, some[split], mine)
            both = np.stack([found.low[split], here["whole"][to] - found.low[split]], axis=1).reshape(-1, 2)
            more = is_open(both)
            next_whole.append(both)
            open_sides.append(more)
            next_rows.append(mine[np.repeat(more, sides)])
            next_lens.append(sides[more])
        if not next_whole:
            break
        whole = np.concatenate(next_whole)
        rows, lens, ids = np.concatenate(next_rows), np.concatenate(next_lens), np.flatnonzero(np.concatenate(open_sides))
        level += 1
        for k, v in {"feature": np.full(len(whole), -1), "cut": np.zeros(len(whole), np.int64), "low": np.full(len(whole), -1),
                     "gain": np.zeros(len(whole)), "whole": whole}.items():
            out[k].append(v)
    starts = np.r_[0, np.cumsum([len(w) for w in out["whole"]])]
    return pruned({k: np.concatenate(v) for k, v in out.items()}, starts, weights)


def pruned(tree: dict[str, np.ndarray], starts: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The tree without sibling leaves that predict the same label, numbered anew; ``starts`` are those of its levels."""
    low, heavy = tree["low"], tree["whole"] * weights
    says = heavy[:, 1] > heavy[:, 0]
    for begin, end in zip(starts[-2::-1], starts[:0:-1]):  # from the last level up
        inner = begin + np.flatnonzero(low[begin:end] >= 0)
        left, right = low[inner], low[inner] + 1
        low[inner[(low[left] < 0) & (low[right] < 0) & (says[left] == says[right])]] = -1
    kept = np.zeros(len(low), bool)
    kept[0] = True
    for begin, end in zip(starts[:-1], starts[1:]):
        inner = begin + np.flatnonzero(kept[begin:end] & (low[begin:end] >= 0))
        kept[low[inner]] = kept[low[inner] + 1] = True
    new = kept.cumsum() - 1
    tree["low"] = np.where(low < 0, -1, new[low])
    return {k: v[kept] for k, v in tree.items()}


# ---- the forest ------------------------------------------------------------------------------

def packed(train: DataFrame, cuts: Sequence[np.ndarray], groups: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """All rows as cells by group, and their labels; rows in the order of the table's partitions."""
    kind = boosting.cell_type(groups)
    chunks = boosting.packed_chunks(train, cuts, groups).toArrow()
    cells = [np.frombuffer(c.as_buffer(), kind).reshape(len(groups), -1) for c in chunks.column("cells")]
    labels = [np.arange(c.shape[1]) >= c.shape[1] - n for c, n in zip(cells, chunks.column("positives").to_pylist())]
    return np.concatenate(cells, axis=1), np.concatenate(labels).astype(np.uint8)


def forest(train: DataFrame, labels: Mapping[int, tuple[int, float]], trees: int, depth: int, least: int, seed: int,
           max_bins: int = 32, drawn: bool = True) -> ForestTrees:
    """``trees`` trees on ``label`` and ``features``; ``labels`` holds the rows and the weight of each label.

    Unless rows and features are ``drawn``, every tree has all of them.
    """
    spark = train.sparkSession
    cuts = boosting.binned(train, labels, seed, max_bins)
    groups = boosting.grouped(cuts) or [[]]
    weights, size = np.array([labels[0][1], labels[1][1]]), len(cuts)
    wanted = int(np.ceil(np.sqrt(size))) if drawn else size
    shared = spark.sparkContext.broadcast(tuple(vars(table_of(*packed(train, cuts, groups), cuts, groups)).values()))
    edges = np.array([c[i] if i < len(c) else np.nan for c in cuts for i in range(max_bins)]).reshape(size, max_bins)
    batch = BATCH

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for b in batches for n in b.column("id").to_pylist()):
            table, rng = Table(*shared.value), np.random.default_rng([seed, number])
            counts = drawn_rows(rng, len(table.labels)) if drawn else np.ones(len(table.labels), np.uint8)
            tree = grown(table, rng, counts, weights, depth, least, wanted)
            count, leaf = len(tree["low"]), tree["low"] < 0
            heavy = tree["whole"] * weights
            everyone = heavy.sum(axis=1)
            columns = [pa.array(np.full(count, number, np.int32)), pa.array(np.arange(count, dtype=np.int32)),
                       pa.array(tree["feature"].astype(np.int32), mask=leaf), pa.array(edges[tree["feature"], tree["cut"]], mask=leaf),
                       pa.array(tree["low"].astype(np.int32), mask=leaf), pa.array((tree["low"] + 1).astype(np.int32), mask=leaf),
                       pa.array(heavy[:, 1] / everyone / trees), pa.array(tree["gain"] * everyone, mask=leaf)]
            whole = pa.RecordBatch.from_arrays(columns, ["tree", "node", "feature", "cut", "low", "high", "value", "gain"])
            for begin in range(0, count, batch):
                yield whole.slice(begin, batch)
    nodes = written(spark.range(0, trees, 1, trees).mapInArrow(grow, node_table.NODES), "forest")
    shared.destroy()
    return ForestTrees(nodes, depth, size)
