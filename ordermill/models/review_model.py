"""Class-weighted classifiers for low reviews: preparation, fitting, scoring and comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ordermill.models import boosting, evaluation, forest, node_table
from ordermill.operators.quality import stacked
from ordermill.operators.shaping import inline_rows, top_n
from ordermill.plans.features import (CATEGORICAL, LABEL, NUMERIC, SEED, balanced_weights, fold_level,
                                      frequent_levels, moments, scaled)
from ordermill.session import scratch_path, shared_dir

#: Training rows of one partition; small data are fitted without a shuffle between tasks.
PART_ROWS = 100_000
#: Drawn rows on each side of a split in a forest.
LEAST_ROWS = 5
#: Rows on which trees of any depth may be fitted: none has more nodes than can be scored at once.
MAX_ROWS = node_table.MAX_NODES // 2 * LEAST_ROWS
#: Rows beyond which the trees of a forest are grown side by side, each in one task; the library grows all trees level by level,
#: which takes minutes for a few deep trees on 200,000 rows.
SIDE_BY_SIDE_ROWS = 20_000
#: Rows beyond which boosted trees are grown on counts per bin: a level takes at least one job with Python tasks there, which
#: fewer rows do not pay back.
COUNTED_ROWS = 250_000
#: Changes whenever the same rows would give another model.
VERSION = 2

@dataclass(frozen=True)
class Preparation:
    """Scaling, level folding and one-hot columns learned from training rows.

    What was learned is a handful of numbers and level names, held as literals, so
    applying it is one narrow projection without joins.
    """

    stats: Mapping[str, float]
    levels: Mapping[str, Sequence[str]]
    encoder: PipelineModel

    @property
    def names(self) -> list[str]:
        """Feature names in vector order, as ``kind__column`` or ``kind__column_level``."""
        return node_table.vector_names(self.levels)

    def apply(self, df: DataFrame) -> DataFrame:
        """Add a ``features`` vector; the input columns keep their values."""
        ready = df.withColumns({
            **{f"__{c}": scaled(c, self.stats) for c in NUMERIC},
            **{f"__{c}": fold_level(F.col(c), self.levels[c]) for c in CATEGORICAL}})
        return self.encoder.transform(ready).select(*df.columns, "features")


def prepare(train: DataFrame, min_count: int = 500) -> Preparation:
    """Learn the preparation from training rows only."""
    stats = moments(train, NUMERIC).first().asDict()
    levels = {c: frequent_levels(train, c, min_count) for c in CATEGORICAL}
    stages = []
    for c in CATEGORICAL:
        stages += [
            StringIndexerModel.from_labels(node_table.with_folded(levels[c]), inputCol=f"__{c}",
                                           outputCol=f"__{c}_index"),
            OneHotEncoder(inputCol=f"__{c}_index", outputCol=f"__{c}_hot", dropLast=False)]
    stages.append(VectorAssembler(
        inputCols=[*[f"__{c}" for c in NUMERIC], *[f"__{c}_hot" for c in CATEGORICAL]],
        outputCol="features"))
    widest = max(len(node_table.with_folded(v)) for v in levels.values())
    # one row per level is enough to tell the encoder how many levels there are
    shown = train.sparkSession.range(widest).select(
        *[F.lit(0.0).alias(f"__{c}") for c in NUMERIC],
        *[F.element_at(F.array(*[F.lit(v) for v in node_table.with_folded(levels[c])]),
                       (F.col("id") % len(node_table.with_folded(levels[c]))).cast("int") + 1).alias(f"__{c}")
          for c in CATEGORICAL])
    return Preparation(stats, levels, Pipeline(stages=stages).fit(shown))


@dataclass(frozen=True)
class ReviewModel:
    preparation: Preparation
    fitted: object

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``risk``, the probability of a low review."""
        scored = self.fitted.transform(self.preparation.apply(df))
        return scored.select(*df.columns, "features",
                             vector_to_array("probability")[1].alias("risk"))


def weighted(train: DataFrame, positive_only: bool = False) -> DataFrame:
    """Add ``weight``: balanced class weights, or the imbalance ratio on positives only."""
    weights = {r[LABEL]: r for r in balanced_weights(train).collect()}  # one row per label
    if positive_only:
        weight = F.when(F.col(LABEL) == 1, weights[1]["imbalance_ratio"]).otherwise(1.0)
    else:
        weight = F.when(F.col(LABEL) == 1, weights[1]["weight"]).otherwise(weights[0]["weight"])
    return train.withColumn("weight", weight)


def logistic(train: DataFrame, max_iter: int = 1000) -> object:
    """L2-regularised with strength 1 on the summed loss.

    Spark averages the loss over the weights, so the strength is divided by their sum.
    """
    rows = weighted(train)
    total = rows.agg(F.sum("weight")).first()[0]
    return LogisticRegression(
        labelCol=LABEL, weightCol="weight", maxIter=max_iter, regParam=1.0 / total,
        elasticNetParam=0.0, standardization=False).fit(rows)


def random_forest(train: DataFrame, trees: int = 300, max_depth: int = 30) -> object:
    """Trees as deep as their rows go, by the library, or for more than ``SIDE_BY_SIDE_ROWS`` rows each in one task.

    A tree has at most two nodes for every ``minInstancesPerNode`` rows and is scored as a whole, and its task holds a few bytes of
    every row, so rows are bounded: beyond ``MAX_ROWS`` deep trees raise an error. A lower depth goes to the library there.
    """
    by_label = {r[LABEL]: r for r in balanced_weights(train).collect()}  # one row per label
    count = sum(r["n"] for r in by_label.values())
    if max_depth > 16 and count > MAX_ROWS:
        raise ValueError(f"trees of depth {max_depth} on more than {MAX_ROWS} rows need too many nodes; lower max_depth")
    shared_dir(train.sparkSession)
    if SIDE_BY_SIDE_ROWS < count <= MAX_ROWS:
        labels = {label: (by_label[label]["n"], by_label[label]["weight"]) for label in (0, 1)}
        return forest.forest(train.withColumnRenamed(LABEL, "label"), labels, trees, max_depth, LEAST_ROWS, SEED)
    return RandomForestClassifier(
        labelCol=LABEL, weightCol="weight", numTrees=trees, maxDepth=max_depth, minInstancesPerNode=LEAST_ROWS,
        featureSubsetStrategy="sqrt", seed=SEED, maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10).fit(weighted(train))


def boosted_trees(train: DataFrame, rounds: int = 300, max_depth: int = 5,
                  rate: float = 0.1) -> object:
    """The same trees either way: by the library, or for more than ``COUNTED_ROWS`` rows on counts per bin."""
    shared_dir(train.sparkSession)  # long lineages are cut at the checkpoint folder
    by_label = {r[LABEL]: r for r in balanced_weights(train).collect()}  # one row per label
    if sum(r["n"] for r in by_label.values()) > COUNTED_ROWS:
        labels = {0: (by_label[0]["n"], 1.0), 1: (by_label[1]["n"], by_label[1]["imbalance_ratio"])}
        return boosting.boosted(train.withColumnRenamed(LABEL, "label"), labels, rounds, max_depth, rate, SEED)
    return GBTClassifier(
        labelCol=LABEL, weightCol="weight", maxIter=rounds, maxDepth=max_depth, stepSize=rate,
        checkpointInterval=10, seed=SEED).fit(weighted(train, positive_only=True))


ESTIMATORS: dict[str, Callable[..., object]] = {
    "logistic_regression": logistic, "random_forest": random_forest,
    "boosted_trees": boosted_trees,
}


def prepared(train: DataFrame, preparation: Preparation, key: str = "order_id") -> DataFrame:
    """The training vectors, written once, in a partitioning and order that only depend on the rows."""
    path = scratch_path(train.sparkSession, "training")
    parts = max(1, -(-train.count() // PART_ROWS))
    preparation.apply(train).select(key, LABEL, "features").repartition(parts, key).sortWithinPartitions(key).write.parquet(path)
    spark = train.sparkSession
    return spark.read.parquet(path).repartition(parts, key).sortWithinPartitions(key)


def fit(train: DataFrame, estimator: str, preparation: Preparation | None = None,
        key: str = "order_id", rows: DataFrame | None = None, **options) -> ReviewModel:
    """Fit on rows in a fixed partitioning and order, so that a seed repeats its result.

    ``rows`` are the training vectors, if they are prepared already.
    """
    preparation = preparation or prepare(train)
    rows = prepared(train, preparation, key) if rows is None else rows
    return ReviewModel(preparation, _without_summary(ESTIMATORS[estimator](rows, **options)))


def _without_summary(fitted: object) -> object:
    """The fitted model without its training summary.

    The summary holds the training rows and with them the session, which goes to the tasks along with the model; once
    rows were observed in the session (``files.write_clean``), it cannot be serialized any more.
    """
    if getattr(fitted, "hasSummary", False):
        fitted._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.apply(None))
    return fitted


def as_saved(spark: SparkSession, model: ReviewModel, path: str) -> node_table.SavedModel:
    """The model saved below ``path`` as a table of its nodes or coefficients, and read again."""
    fitted, preparation = model.fitted, model.preparation
    if hasattr(fitted, "coefficients"):
        weights = [(i, 0, i, None, None, None, float(w), None) for i, w in enumerate(fitted.coefficients.toArray())]
        nodes = inline_rows(spark, [*weights, (-1, 0, None, None, None, None, float(fitted.intercept), None)], node_table.NODES)
        link, depth = node_table.LOG_ODDS, 0
    elif isinstance(fitted, (boosting.BoostedTrees, forest.ForestTrees)):
        nodes, depth = fitted.nodes, fitted.depth
        link = node_table.LOG_ODDS if isinstance(fitted, boosting.BoostedTrees) else node_table.SHARE
    else:
        raw = f"{path}/spark"
        fitted.write().overwrite().save(raw)
        nodes, link = node_table.nodes_of(spark, raw)
        depth = fitted.getMaxDepth()
    node_table.SavedModel(nodes, preparation.stats, preparation.levels, link, depth).save(path)
    return node_table.load(spark, path)


def digest(df: DataFrame) -> str:
    """A name for the rows of a table, whatever their order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("a"),
                 F.sum(F.xxhash64(*df.columns, F.lit(1)).cast("decimal(38,0)")).alias("b")).first()
    return f"{row.n}-{row.a}-{row.b}"


def saved_models(train: DataFrame, options: Mapping[str, dict], min_count: int = 500,
                 key: str = "order_id") -> dict[str, node_table.SavedModel]:
    """The named estimators fitted on ``train``, each once: models live in the shared folder, by the rows and options
    they come from, and are read again wherever these are the same."""
    spark = train.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/models/{VERSION}-{min_count}-{digest(train)}"
    out, todo = {}, {}
    for name, settings in options.items():
        path = "-".join([f"{home}/{name}", *(f"{k}_{v}" for k, v in sorted(settings.items()))])
        out[name] = node_table.load(spark, path)
        if out[name] is None:
            todo[name] = path
    if todo:
        preparation = prepare(train, min_count)
        rows = prepared(train, preparation, key)

        def fitted(name: str) -> node_table.SavedModel:
            return as_saved(spark, fit(train, name, preparation, key, rows, **options[name]), todo[name])
        # fits wait for one another's many small jobs, so they run side by side
        with ThreadPoolExecutor(len(todo)) as pool:
            out |= dict(zip(todo, pool.map(inheritable_thread_target(spark)(fitted), todo)))
    return out


def compare(train: DataFrame, test: DataFrame, options: Mapping[str, dict],
            min_count: int = 500) -> DataFrame:
    """Fit every estimator named in ``options``, or take it as saved, and list its test metrics.

    The scores of all models are stacked, so the metrics take one pass.
    """
    return compared(saved_models(train, options, min_count), test)


def compared(models: Mapping[str, node_table.SavedModel], test: DataFrame) -> DataFrame:
    """Test metrics of fitted models, by name."""
    scores = [model.score(test).select(F.lit(name).alias("model"), "risk", LABEL) for name, model in models.items()]
    return evaluation.all_metrics(stacked(scores), "risk", LABEL, ["model"])


def risk_rank(model: ReviewModel | node_table.SavedModel, df: DataFrame, n: int, key: str = "order_id") -> DataFrame:
    """The ``n`` orders with the highest risk."""
    return top_n(model.score(df).select(key, "risk"), n, [F.col("risk").desc(), key])
