"""Fitted models as tables: one row per node of every tree, or per coefficient, saved once and scored as a plan.

A saved model is a folder with three small tables: the nodes, the preparation, and what the sum of the trees means. It
needs no ML library to be scored: the nodes become a few arrays, which are broadcast after a check of their size, and
the rows of an Arrow batch walk all trees side by side, in one narrow projection without a shuffle.

The value of a node is what the score is expected to be among the training rows that reach it, so the difference between
a node and its child belongs to the feature that parted them. Summed along a row's path and over all trees, these
differences and the sum of the roots give the score exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.functions import columns as C
from ordermill.operators.shaping import inline_rows, top_n
from ordermill.plans.features import CATEGORICAL, INFREQUENT, NUMERIC, fold_level, scaled
from ordermill.session import written

#: ``low`` is the child of values up to ``cut``, ``high`` of larger ones; leaves have neither. ``gain`` is the gain of the
#: split over all rows that it parts.
NODES = "tree int, node int, feature int, cut double, low int, high int, value double, gain double"
#: Nodes that may be broadcast at once (20 bytes each, and 50 while they are collected).
MAX_NODES = 4_000_000
#: Rows that walk side by side, so that their features and places stay in the cache.
WALKED = 4096
LOG_ODDS, SHARE = "log_odds", "share"


def vector_names(levels: Mapping[str, Sequence[str]], numeric: Sequence[str] = NUMERIC) -> list[str]:
    """Feature names in vector order, as ``kind__column`` or ``kind__column_level``."""
    return [f"num__{c}" for c in numeric] + [
        f"cat__{c}_{level}" for c in levels for level in with_folded(levels[c])]


def with_folded(levels: Sequence[str]) -> list[str]:
    return sorted({*levels, INFREQUENT})


def vector(stats: Mapping[str, float], levels: Mapping[str, Sequence[str]]) -> Column:
    """The features of a row as an array: scaled numbers, then one place per level."""
    folded = {c: fold_level(F.col(c), levels[c]) for c in levels}
    return F.array(*[scaled(c, stats) for c in NUMERIC],
                   *[(folded[c] == level).cast("double") for c in levels for level in with_folded(levels[c])])


# ---- node tables -----------------------------------------------------------------------------

def nodes_of(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The node table of a tree ensemble that Spark saved at ``path``, and what its sum is.

    Boosted regression trees add up to half the log-odds, by their weights; classification trees average shares.
    """
    weights = spark.read.parquet(f"{path}/treesMetadata")
    tree, meta, weight = weights.columns
    weights = weights.select(F.col(tree).alias("treeID"), F.col(meta).contains("Regression").alias("boosted"),
                             F.col(weight).alias("weight"))
    boosted = weights.agg(F.max("boosted")).first()[0]
    trees = weights.count()
    stats = F.col("n.impurityStats")
    everyone = stats[0] if boosted else stats[0] + stats[1]
    value = F.col("n.prediction") * 2 * F.col("weight") if boosted else C.ratio(stats[1], everyone) / F.lit(float(trees))
    part = F.col("n.split")
    named = F.col("n.split.numCategories") != -1  # a column of zeros and ones: the categories that go left
    swapped = named & F.array_contains(part["leftCategoriesOrThreshold"], 1.0)
    leaf = F.col("n.leftChild") < 0
    left, right = F.col("n.leftChild"), F.col("n.rightChild")
    data = spark.read.parquet(f"{path}/data").withColumnRenamed("nodeData", "n").join(F.broadcast(weights), "treeID")  # one row per tree
    inner = lambda c: F.when(~leaf, c)
    return data.select(
        F.col("treeID").alias("tree"), F.col("n.id").alias("node"), inner(part["featureIndex"]).alias("feature"),
        inner(F.when(named, 0.5).otherwise(part["leftCategoriesOrThreshold"][0])).alias("cut"),
        inner(F.when(swapped, right).otherwise(left)).alias("low"), inner(F.when(swapped, left).otherwise(right)).alias("high"),
        value.alias("value"), inner(F.col("n.gain") * everyone).alias("gain")), LOG_ODDS if boosted else SHARE


def shared_nodes(nodes: DataFrame) -> Broadcast:
    """All trees end to end, as arrays: each tree's root, and each node's feature, cut, two children and value.

    Nodes of a tree are numbered from 0, its root. A leaf is its own child on both sides.
    """
    count = nodes.count()
    if count > MAX_NODES:
        raise ValueError(f"{count} nodes are too many to broadcast")
    rows = nodes.select("tree", "node", "feature", "cut", "low", "high", "value").toArrow()
    tree, node = (rows.column(c).to_numpy() for c in ("tree", "node"))
    order = np.lexsort((node, tree))
    tree, leaf = tree[order], rows.column("low").is_null().to_numpy()[order]
    roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if count else np.zeros(0, np.int64)
    start = np.repeat(roots, np.diff(np.r_[roots, count]))

    def column(name: str, other: float) -> np.ndarray:
        return rows.column(name).fill_null(other).to_numpy()[order]
    sides = [np.where(leaf, np.arange(count), start + column(c, 0)) for c in ("low", "high")]
    return nodes.sparkSession.sparkContext.broadcast((
        roots, column("feature", 0).astype(np.int32), column("cut", 0.0), np.stack(sides, axis=1).ravel().astype(np.int32), column("value", 0.0)))


def tree_sums(shared: Broadcast, x: Column, depth: int, size: int, begun: Column | None = None) -> Column:
    """The sum of the values of the leaves that a row's ``size`` features lead to; missing ones count as large.

    It is added to what other trees have ``begun``.
    """
    steps, walked = max(1, depth), WALKED

    def sums(features: pa.Array, before: pa.Array) -> pa.Array:
        roots, feature, cut, child, value = shared.value
        every = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), size)
        out = before.to_numpy(zero_copy_only=False).copy()
        for begin in range(0, len(every), walked):
            flat = np.ascontiguousarray(every[begin:begin + walked].T).ravel()
            n = len(flat) // size
            row = np.arange(n)
            for root in roots.tolist():
                at = np.full(n, root)
                for _ in range(steps):
                    after = child[2 * at + ~(flat[feature[at] * n + row] <= cut[at])]
                    if (after == at).all():
                        break
                    at = after
                out[begin:begin + n] += value[at]
        return pa.array(out)
    return F.arrow_udf(sums, "double")(x, F.lit(0.0) if begun is None else begun)


def total_of(nodes: DataFrame, df: DataFrame, depth: int, size: int) -> DataFrame:
    """The rows with ``__total``, the sum over all trees for the features in ``__x``.

    Trees with more than ``MAX_NODES`` nodes are taken some at a time, and what they add up to is written in between, so
    that only some of them are on the driver and with the tasks at once.
    """
    counts = nodes.groupBy("tree").count().orderBy("tree").collect()  # one row per tree
    groups, held = [], 0
    for r in counts:
        if r["count"] > MAX_NODES:
            raise ValueError(f"{r['count']} nodes are too many to broadcast")
        if not groups or held + r["count"] > MAX_NODES:
            groups.append((r.tree, r.tree))
            held = 0
        groups[-1] = (groups[-1][0], r.tree)
        held += r["count"]
    if len(groups) <= 1:
        return df.withColumn("__total", tree_sums(shared_nodes(nodes), F.col("__x"), depth, size))
    out = df.withColumn("__total", F.lit(0.0))
    for first, last in groups:
        shared = shared_nodes(nodes.filter(F.col("tree").between(first, last)))
        out = written(out.withColumn("__total", tree_sums(shared, F.col("__x"), depth, size, F.col("__total"))), "scores")
        shared.destroy()
    return out


def tree_parts(shared: Broadcast, x: Column, depth: int, size: int) -> Column:
    """What each feature adds to the sum along a row's paths, as an array of ``size``."""
    steps, walked = max(1, depth), WALKED

    def parts(features: pa.Array) -> pa.Array:
        roots, feature, cut, child, value = shared.value
        every = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), size)
        out = np.zeros((len(every), size))
        for begin in range(0, len(every), walked):
            flat = np.ascontiguousarray(every[begin:begin + walked].T).ravel()
            n = len(flat) // size
            row, total = np.arange(n), np.zeros(len(flat))
            for root in roots.tolist():
                at, own = np.full(n, root), np.zeros(len(flat))
                for _ in range(steps):
                    cell = feature[at] * n + row
                    after = child[2 * at + ~(flat[cell] <= cut[at])]
                    if (after == at).all():
                        break
                    own[cell] += value[after] - value[at]
                    at = after
                total += own
            out[begin:begin + n] = total.reshape(size, n).T
        return pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1, dtype=np.int32) * np.int32(size)), pa.array(out.ravel()))
    return F.arrow_udf(parts, "array<double>")(x)


def base_of(nodes: DataFrame) -> DataFrame:
    """One row: the score before anything is known of a row."""
    return nodes.filter("node = 0").agg(F.sum("value").alias("base"))


def gain_shares(nodes: DataFrame, by_tree: bool) -> DataFrame:
    """(feature, importance): each feature's share of all gain; ``by_tree`` gives every tree the same weight first."""
    gains = nodes.filter("feature is not null").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    if by_tree:
        totals = gains.groupBy("tree").agg(F.sum("gain").alias("all")).filter(F.col("all") > 0)
        gains = gains.join(totals, "tree").select("feature", C.ratio(F.col("gain"), F.col("all")).alias("gain"))
    sums = gains.groupBy("feature").agg(F.sum("gain").alias("gain"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("gain").alias("all")))).select(  # one row
        "feature", C.ratio(F.col("gain"), F.col("all")).alias("importance"))


# ---- saved models ----------------------------------------------------------------------------

@dataclass(frozen=True)
class SavedModel:
    """A fitted model as it was saved: nodes of trees, or one node row per coefficient (``cut`` null, ``value`` the weight)."""

    nodes: DataFrame
    stats: Mapping[str, float]
    levels: Mapping[str, Sequence[str]]
    link: str
    depth: int

    @property
    def names(self) -> list[str]:
        return vector_names(self.levels)

    @property
    def linear(self) -> bool:
        return self.depth == 0

    def features(self) -> Column:
        return vector(self.stats, self.levels)

    def _coefficients(self) -> DataFrame:
        """One row: ``weights`` in vector order and the ``intercept``."""
        return self.nodes.agg(
            F.array_sort(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "value")))).alias("w"),
            F.sum(F.when(F.col("feature").isNull(), F.col("value"))).alias("intercept")).select("w.value", "intercept").toDF("weights", "intercept")

    def scored(self, df: DataFrame) -> DataFrame:
        """The rows with ``score``, the sum of all trees (or of the weighted features)."""
        rows = df.withColumn("__x", self.features())
        if self.linear:
            total = F.aggregate(F.zip_with("__x", "weights", lambda a, b: a * b), F.col("intercept"), lambda a, b: a + b)
            return rows.crossJoin(F.broadcast(self._coefficients())).select(*df.columns, total.alias("score"))  # one row
        return total_of(self.nodes, rows, self.depth, len(self.names)).select(*df.columns, F.col("__total").alias("score"))

    def score(self, df: DataFrame) -> DataFrame:
        """The rows with ``risk``, the probability of a low review."""
        risk = F.col("score") if self.link == SHARE else 1 / (1 + F.exp(-F.col("score")))
        return self.scored(df).select(*df.columns, risk.alias("risk"))

    def contributions(self, df: DataFrame) -> DataFrame:
        """The rows with ``base`` and ``parts``, one per feature in vector order, which add up to the score."""
        if self.linear:
            raise ValueError("a linear model has no trees; see linear_attribution")
        both = df.withColumn("__x", self.features()).crossJoin(F.broadcast(base_of(self.nodes)))  # one row
        return both.select(*df.columns, "base", tree_parts(shared_nodes(self.nodes), F.col("__x"), self.depth, len(self.names)).alias("parts"))

    def importance(self, k: int = 12) -> DataFrame:
        """Share of the total gain per feature, largest first."""
        shares = gain_shares(self.nodes, by_tree=self.link == SHARE)
        named = named_features(self.nodes.sparkSession, self.names).join(shares, "feature", "left").select(
            "name", F.coalesce("importance", F.lit(0.0)).alias("importance"))
        return ranked_features(named, "importance", k)

    def save(self, path: str) -> None:
        """Nodes first; the row about the model last, so that a folder with it is whole."""
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        stats = F.create_map(*[F.lit(v) for pair in self.stats.items() for v in pair])
        levels = F.create_map(*[v for c, some in self.levels.items() for v in (
            F.lit(c), F.array(*[F.lit(x) for x in some]).cast("array<string>"))])
        about = spark.range(1).select(F.lit(self.link).alias("link"), F.lit(self.depth).alias("depth"), stats.alias("stats"), levels.alias("levels"))
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


ABOUT = "link string, depth int, stats map<string,double>, levels map<string,array<string>>"


def load(spark: SparkSession, path: str) -> SavedModel | None:
    """The model saved at ``path``; None where there is none."""
    try:
        about = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if about is None:  # begun by a run that was lost
        return None
    levels = {c: about.levels[c] for c in CATEGORICAL}
    return SavedModel(spark.read.schema(NODES).parquet(f"{path}/nodes"), about.stats, levels, about.link, about.depth)


def named_features(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return inline_rows(spark, list(enumerate(names)), "feature int, name string")


def ranked_features(named: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` features with the largest value, by the name without its kind."""
    plain = named.select(F.split_part("name", F.lit("__"), F.lit(2)).alias("feature"), value)
    return top_n(plain, k, [F.col(value).desc(), "feature"])


def mean_parts(parts: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """Mean absolute part per feature over all rows (an array column ``parts``), the ``k`` largest."""
    cells = parts.select(F.posexplode("parts").alias("feature", "part"))
    means = cells.groupBy("feature").agg(F.avg(F.abs("part")).alias("mean_abs"))
    return ranked_features(named_features(parts.sparkSession, names).join(means, "feature"), "mean_abs", k)
