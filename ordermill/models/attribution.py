"""What drives a model's scores: exact contributions of linear models and of trees, and permutation importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.models.evaluation import average_precision
from ordermill.models.node_table import SavedModel, mean_parts, named_features, ranked_features
from ordermill.operators.quality import stacked
from ordermill.operators.ranking import globally_sorted, with_position
from ordermill.plans.features import CATEGORICAL, LABEL, NUMERIC, SEED, hash_order


def mean_abs(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Mean absolute value of each named column, largest first."""
    cells = [F.struct(F.lit(name).alias("feature"), F.avg(F.abs(value)).alias("mean_abs"))
             for name, value in values.items()]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c")).orderBy(
        F.col("mean_abs").desc(), "feature")


def linear_attribution(model: SavedModel, df: DataFrame) -> DataFrame:
    """Mean absolute contribution to the log-odds per feature of a linear model.

    A contribution is coefficient times distance from the feature's mean, which is
    the exact Shapley value when features are independent.
    """
    rows = df.select(model.features().alias("x"))
    # vectors are summed as vectors, however many columns the levels make
    mean = rows.agg(Summarizer.mean(array_to_vector(F.col("x"))).alias("mean"))
    far = rows.crossJoin(F.broadcast(mean)).select(F.zip_with(
        "x", vector_to_array("mean"), lambda x, m: F.abs(x - m)).alias("far"))
    apart = far.agg(Summarizer.mean(array_to_vector(F.col("far"))).alias("v")).select(F.posexplode(vector_to_array("v")).alias("feature", "far"))
    weights = model.nodes.filter("feature is not null").select("feature", F.abs("value").alias("weight"))
    named = named_features(df.sparkSession, model.names).join(weights, "feature").join(apart, "feature")
    return ranked_features(named.select("name", (F.col("weight") * F.col("far")).alias("mean_abs")), "mean_abs", len(model.names))


def tree_attribution(model: SavedModel, df: DataFrame, k: int = 12) -> DataFrame:
    """Mean absolute contribution to the score per feature of a tree ensemble, over all rows, largest first."""
    return mean_parts(model.contributions(df), model.names, k)


def permutation_importance(model: SavedModel, df: DataFrame, key: str = "order_id",
                           features: Sequence[str] = (*NUMERIC, *CATEGORICAL),
                           seed: int = SEED) -> DataFrame:
    """Loss of average precision when one feature's values move to other rows.

    Rows get a position in a repeatable random order; feature number i takes its
    value from the row i + 1 places further on. All moved copies are scored and
    ranked in one job, next to the unmoved rows.
    """
    order = df.withColumn("__hash", hash_order(key, seed))
    placed = with_position(globally_sorted(order, ["__hash", key]), "__position", "__rows")
    # every row hands each feature's value to the row so many places before it, in one shuffle
    kinds = {f: df.schema[f].dataType for f in features}
    target = [F.struct(F.lit(f).alias("feature"), (F.pmod(F.col("__position") - 1 - i, F.col("__rows")) + 1).alias("__position"),
                       F.col(f).cast("string").alias("value")) for i, f in enumerate(features, start=1)]
    moved = placed.select(F.inline(F.array(*target))).groupBy("__position").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("__moved"))  # one value per feature
    both = placed.join(moved, "__position")
    copies = [placed.select(*df.columns, F.lit("").alias("feature"))]
    for feature, kind in kinds.items():
        copies.append(both.withColumn(feature, F.col("__moved")[feature].cast(kind)).select(
            *df.columns, F.lit(feature).alias("feature")))
    scored = model.score(stacked(copies)).select("feature", "risk", LABEL)
    precision = average_precision(scored, "risk", LABEL, ["feature"])
    base = precision.filter(F.col("feature") == "").select(F.col("pr_auc").alias("base"))
    return precision.filter(F.col("feature") != "").crossJoin(F.broadcast(base)).select(
        "feature", (F.col("base") - F.col("pr_auc")).alias("pr_auc_drop")).orderBy(
        F.col("pr_auc_drop").desc(), "feature")
