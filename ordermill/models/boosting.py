"""Boosted trees for many rows: the library's rounds on counts per bin, one Spark job per level of a tree.

Features have few bins, so several of them share a cell of at most ``CELLS`` values and a row is a few bytes, packed once.
A level's job counts rows and adds residuals per node and cell in every partition; only these sums reach the driver, which
picks the splits as ``GBTClassifier`` does: the same bins from the same drawn rows, the same gains, ties to the first feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.models import node_table
from ordermill.operators.shaping import inline_rows
from ordermill.session import shared_dir

#: Values of a cell; a single feature with more bins has a cell of its own.
CELLS = 256
#: Rows that are counted side by side.
CHUNK = 32_768
#: Rows of a partition: at least so many while there are fewer partitions than cores, as a task of a few bytes takes as long
#: as one of ``FEW`` rows, and at most ``MANY``.
FEW, MANY = 100_000, 4_000_000
#: Rounds after which the scores so far are checkpointed.
KEPT = 25
EPSILON = float(np.finfo(float).eps)


@dataclass(frozen=True)
class BoostedTrees:
    """Boosted trees as a table of their nodes."""

    nodes: DataFrame
    depth: int
    size: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, of label 0 and of label 1."""
        rows = df.withColumn("__x", vector_to_array("features"))
        risk = 1 / (1 + F.exp(-F.col("__total")))
        return node_table.total_of(self.nodes, rows, self.depth, self.size).select(
            *df.columns, array_to_vector(F.array(1 - risk, risk)).alias("probability"))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as the library's models name it
        return importances(self.nodes, self.size, by_tree=False)


def importances(nodes: DataFrame, size: int, by_tree: bool) -> DenseVector:
    """Each feature's share of all gain."""
    out = np.zeros(size)
    for r in node_table.gain_shares(nodes, by_tree).collect():  # one row per feature
        out[r.feature] = r.importance
    return DenseVector(out)


# ---- bins ------------------------------------------------------------------------------------

def drawn(rows: DataFrame, count: int, seed: int, max_bins: int) -> tuple[DataFrame, float]:
    """The rows by which the library places its cuts, about 10,000 of them, and their share of all."""
    wanted = max(max_bins * max_bins, 10_000)
    if wanted >= count:
        return rows, 1.0
    spark = rows.sparkSession
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    some = rows._jdf.javaRDD().sample(False, wanted / count, draw)
    return DataFrame(spark._jsparkSession.createDataFrame(some, rows._jdf.schema()), spark), wanted / count


def cuts_of(values: np.ndarray, weights: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most ``most`` cuts between the values, about equally heavy parts between them.

    Zeros are not counted: they weigh what the others lack of the ``expected`` weight.
    """
    some = values != 0
    known, place = np.unique(values[some], return_inverse=True)
    if not len(known):
        return known
    heavy = np.bincount(place, weights[some])
    zeros = expected - heavy.sum()
    if zeros > EPSILON * some.sum() * 100:
        at = np.searchsorted(known, 0.0)
        known, heavy = np.insert(known, at, 0.0), np.insert(heavy, at, zeros)
    between = (known[:-1] + known[1:]) / 2
    if len(between) <= most:
        return between
    out, stride = [], expected / (most + 1)
    target, upto = stride, heavy[0]
    for cut, more in zip(between, heavy[1:]):
        before, upto = upto, upto + more
        if abs(before - target) < abs(upto - target):
            out.append(cut)
            target += stride
    return np.array(out)


def binned(train: DataFrame, labels: Mapping[int, tuple[int, float]], seed: int, max_bins: int) -> list[np.ndarray]:
    """Each feature's cuts; a column of zeros and ones has one."""
    attributes = train.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    if attributes.get("nominal"):
        raise ValueError("features with several categories are not supported; use columns of zeros and ones")
    binary = {a["idx"] for a in attributes.get("binary", [])}
    count = sum(n for n, _ in labels.values())
    rows, share = drawn(train.select("label", "features"), count, seed, max_bins)
    table = rows.select("label", vector_to_array("features").alias("x")).toArrow()
    x = np.array(table.column("x").combine_chunks().flatten()).reshape(len(table), -1)
    weights = np.where(table.column("label").to_numpy() == 1, labels[1][1], labels[0][1])
    expected = share * sum(n * w for n, w in labels.values())
    return [np.array([0.5]) if j in binary else cuts_of(x[:, j], weights, expected, min(max_bins, count) - 1)
            for j in range(x.shape[1])]


def grouped(cuts: Sequence[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Features that share a cell: (feature, stride, bins) each; features without cuts are left out."""
    out: list[list[tuple[int, int, int]]] = []
    for bins, feature in sorted(((len(c) + 1, -j) for j, c in enumerate(cuts) if len(c)), reverse=True):
        room = next((g for g in out if width(g) * bins <= CELLS), None)
        if room is None:
            out.append(room := [])
        room.append((-feature, width(room), bins))
    return out


def width(group: Sequence[tuple[int, int, int]]) -> int:
    return group[-1][1] * group[-1][2] if group else 1


def cell_type(groups: Sequence) -> type:
    """The smallest numbers that cells fit in."""
    return np.uint8 if all(width(g) <= 256 for g in groups) else np.uint16 if all(width(g) <= 65536 for g in groups) else np.int32


def packed_chunks(rows: DataFrame, cuts: Sequence[np.ndarray], groups: Sequence) -> DataFrame:
    """(cells, positives) per chunk of rows: the cell of each group, rows of label 0 first."""
    chunk, kind, count = CHUNK, cell_type(groups), len(groups)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            cells, label = (np.concatenate(p, axis=-1) for p in zip(*held))
            cells = np.ascontiguousarray(cells[:, np.argsort(label, kind="stable")])
            return pa.RecordBatch.from_arrays(
                [pa.array([cells.tobytes()], pa.binary()), pa.array([int(label.sum())], pa.int64())], ["cells", "positives"])
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cells = np.zeros((count, batch.num_rows), kind)
            for at, group in enumerate(groups):
                for feature, stride, _ in group:
                    cells[at] += (np.searchsorted(cuts[feature], x[:, feature]) * stride).astype(kind)
            held.append((cells, batch.column("label").to_numpy()))
            rows += batch.num_rows
            if rows >= chunk:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()
    return rows.select("label", vector_to_array("features").alias("x")).mapInArrow(cells_of, "cells binary, positives long")


def packed(train: DataFrame, cuts: Sequence[np.ndarray], groups: Sequence, parts: int) -> RDD:
    """(cells, positives, scores) per chunk of rows; no scores yet."""
    kind, count = cell_type(groups), len(groups)
    keys = [c for c in train.columns if c not in ("label", "features")]
    ordered = train.repartition(parts, *keys).sortWithinPartitions(*keys) if keys else train.repartition(parts)
    return packed_chunks(ordered, cuts, groups).rdd.map(lambda r: (np.frombuffer(r.cells, kind).reshape(count, -1), r.positives, None))


# ---- rounds ----------------------------------------------------------------------------------

def counting(sizes: Sequence[int], weights: tuple[float, float]) -> tuple[Callable, Callable]:
    """What tasks do with the chunks of a partition: add up a level, and add a tree to the scores."""
    def places(cells: np.ndarray, tree: Sequence) -> np.ndarray:
        n = cells.shape[1]
        at, flat, row = np.zeros(n, np.intp), cells.ravel(), np.arange(n)
        for group, after in tree:
            same = (group == group[0]).all()
            cell = cells[group[0]] if same else flat.take((group * n).take(at) + row)
            at *= after.shape[1]
            at += cell
            at = after.ravel().take(at)
        return at

    def level(chunks: Iterator[tuple], tree: Sequence) -> Iterator[np.ndarray]:
        total = None
        for cells, positives, score in chunks:
            n = cells.shape[1]
            zeros = n - positives
            residual = np.empty(n)
            if score is None:
                residual[:zeros], residual[zeros:] = -weights[0], weights[1]
            else:
                with np.errstate(over="ignore"):
                    residual[:zeros] = -4.0 * weights[0] / (1.0 + np.exp(-2.0 * score[:zeros]))
                    residual[zeros:] = 4.0 * weights[1] / (1.0 + np.exp(2.0 * score[zeros:]))
            at, sums = places(cells, tree), []
            for size, cell in zip(sizes, cells):
                where, most = at * size + cell, size << len(tree)
                sums.append((np.bincount(where[:zeros], minlength=most), np.bincount(where[zeros:], minlength=most),
                             np.bincount(where, residual, most)))
            sums = np.concatenate(sums, axis=1)
            total = sums if total is None else total + sums
        if total is not None:
            yield total

    def scored(chunk: tuple, tree: Sequence, values: np.ndarray) -> tuple:
        cells, positives, score = chunk
        more = values.take(places(cells, tree))
        return cells, positives, more if score is None else score + more
    return level, scored


@dataclass
class Level:
    """The best split of each node of a level: none where ``gain`` is 0. Sides are (weight, sum of residuals)."""

    gain: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    sides: np.ndarray
    whole: np.ndarray


def best_splits(sums: np.ndarray, groups: Sequence, weights: tuple[float, float], nodes: int) -> Level:
    """The best split per node. Equal gains go to the first feature; in the library the order of addition decides there."""
    features, begin = {}, 0
    for group in groups:
        size = width(group) * nodes
        block = sums[:, begin:begin + size].reshape(3, nodes, *(bins for _, _, bins in reversed(group)))
        begin += size
        for i, (feature, _, _) in enumerate(group):
            axis = 1 + len(group) - i
            features[feature] = block.sum(axis=tuple(a for a in range(2, block.ndim) if a != axis))
    every = block.sum(axis=tuple(range(2, block.ndim)))
    whole = np.stack([every[0] * weights[0] + every[1] * weights[1], every[2]], axis=1)
    best = Level(np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, int), np.zeros((nodes, 4)), whole)
    each = np.arange(nodes)
    for feature, counts in sorted(features.items()):
        upto = counts.cumsum(axis=2)
        low, high = upto[:, :, :-1], upto[:, :, -1:] - upto[:, :, :-1]
        weight = [s[0] * weights[0] + s[1] * weights[1] for s in (low, high)]
        inside = (weight[0] > 0) & (weight[1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = low[2] / weight[0] - high[2] / weight[1]
            share = weight[0] * weight[1] / (weight[0] + weight[1])
            gains = np.where(inside, share * apart * apart, 0.0)
        cut = gains.argmax(axis=1)
        gain = gains[each, cut]
        better = gain > best.gain * (1 + 1e-12)  # equal splits add up in other orders
        best.gain[better], best.feature[better], best.cut[better] = gain[better], feature, cut[better]
        sides = np.stack([weight[0][each, cut], low[2][each, cut], weight[1][each, cut], high[2][each, cut]], axis=1)
        best.sides[better] = sides[better]
    best.gain[best.gain <= EPSILON * best.whole[:, 0]] = 0.0
    return best


def grown(chunks: RDD, level: Callable, cuts: Sequence[np.ndarray], groups: Sequence, weights: tuple[float, float], depth: int,
          number: int, rate: float) -> tuple[list, np.ndarray, list[tuple]]:
    """The next tree: its steps for the tasks, what it adds to a score at each place, and its nodes."""
    home = {feature: (g, stride, bins) for g, group in enumerate(groups) for feature, stride, bins in group}
    most = max((width(g) for g in groups), default=1)
    tree, rows, ids, values = [], [], [0], [0.0]  # ids: the open node at each place
    while len(tree) < depth and any(i is not None for i in ids):
        steps = tuple(tree)
        sums = chunks.mapPartitions(lambda some: level(some, steps)).collect()  # one array per partition
        found = best_splits(sum(sums[1:], sums[0]), groups, weights, len(ids))
        if not tree:
            weight, total = found.whole[0]
            values = [total / weight]
            rows = [[number, 0, None, None, None, None, values[0], None]]
        split = [p for p, i in enumerate(ids) if i is not None and found.gain[p] > 0]
        if not split:
            break
        group = np.full(len(ids), home[int(found.feature[split[0]])][0])
        after = np.repeat(np.arange(len(ids)) * 2, most).reshape(len(ids), most)
        deeper, next_values = [None] * (2 * len(ids)), np.repeat(values, 2)
        for p in split:
            feature, cut = int(found.feature[p]), int(found.cut[p])
            group[p], stride, bins = home[feature]
            after[p] += np.arange(most) // stride % bins > cut
            low = len(rows)
            rows[ids[p]][2:6] = feature, float(cuts[feature][cut]), low, low + 1
            rows[ids[p]][7] = float(found.gain[p])
            for side in (0, 1):
                weight, total = found.sides[p, 2 * side:2 * side + 2]
                next_values[2 * p + side] = total / weight
                rows.append([number, low + side, None, None, None, None, total / weight, None])
                deeper[2 * p + side] = low + side
        tree.append((group, after))
        ids, values = deeper, next_values
    for r in rows:
        r[6] = float(r[6] * 2 * rate)
    return tree, np.asarray(values) * rate, [tuple(r) for r in rows]


def boosted(train: DataFrame, labels: Mapping[int, tuple[int, float]], rounds: int, depth: int, rate: float, seed: int,
            max_bins: int = 32) -> BoostedTrees:
    """``rounds`` trees on ``label`` and ``features``; ``labels`` holds the rows and the weight of each label."""
    spark = train.sparkSession
    shared_dir(spark)
    count, weights = sum(n for n, _ in labels.values()), (labels[0][1], labels[1][1])
    cuts = binned(train, labels, seed, max_bins)
    groups = grouped(cuts) or [[]]
    level, scored = counting([width(g) for g in groups], weights)
    parts = max(min(-(-count // FEW), spark.sparkContext.defaultParallelism), -(-count // MANY))
    state = packed(train, cuts, groups, parts).persist(StorageLevel.MEMORY_AND_DISK)
    nodes, before = [], None
    for number in range(rounds):
        tree, values, rows = grown(state, level, cuts, groups, weights, depth, number, rate if number else 1.0)
        nodes += rows
        if before is not None:  # its scores went into those just counted
            before.unpersist()
        if number + 1 < rounds:
            before, steps = state, (tuple(tree), values)
            state = before.map(lambda chunk, steps=steps: scored(chunk, *steps), preservesPartitioning=True)
            state.persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % KEPT == 0:
                state.checkpoint()
    state.unpersist()
    return BoostedTrees(inline_rows(spark, nodes, node_table.NODES), depth, len(cuts))
