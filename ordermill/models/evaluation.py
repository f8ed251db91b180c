"""Exact binary-classification metrics as Spark aggregates.

Threshold-free metrics first reduce rows to one per distinct score; the ranking
then runs as distributed prefix sums over that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.functions import columns as C
from ordermill.operators.ranking import running_sums
from ordermill.operators.shaping import attach_row


def _safe(num: Column, den: Column) -> Column:
    """A ratio that is 0 when nothing is in the denominator."""
    return F.coalesce(C.ratio(num, den), F.lit(0.0))


def threshold_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5,
                      by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of the positive class at a threshold, per group."""
    flagged, low = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(flagged & low).alias("tp"), F.count_if(flagged & ~low).alias("fp"),
        F.count_if(~flagged & low).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"),
                         _safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _ranked(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Per group and distinct score: positives, negatives and their sums down to that score."""
    per_score = df.groupBy(*by, F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    upto = running_sums(per_score, [*by, F.col("s").desc()], {"tp": "pos", "fp": "neg"})
    groups = upto.groupBy(*by).agg(
        F.min(F.col("tp") - F.col("pos")).alias("tp0"), F.min(F.col("fp") - F.col("neg")).alias("fp0"),
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    # one row per compared model or feature
    placed = upto.join(F.broadcast(groups), list(by)) if by else attach_row(upto, groups)
    return placed.select(*by, "pos", "neg", "all_pos", "all_neg",
                         (F.col("tp") - F.col("tp0")).alias("tp"),
                         (F.col("fp") - F.col("fp0")).alias("fp"))


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision as the step sum, per group."""
    ranked = _ranked(df, score, label, by)
    whole = "decimal(38,0)"
    # twice the number of (positive, negative) pairs ranked right, in whole numbers
    pairs = F.col("neg").cast("decimal(19,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(19,0)")
    step = F.col("pos").cast("double") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    sums = ranked.groupBy(*by).agg(
        F.sum(pairs).cast(whole).alias("pairs"), F.sum(step).alias("steps"),
        F.max("all_pos").alias("p"), F.max("all_neg").alias("n"))
    return sums.select(
        *by, C.ratio(F.col("pairs"), 2 * F.col("p").cast("double") * F.col("n").cast("double")).alias("roc_auc"),
        C.ratio(F.col("steps"), F.col("p")).alias("pr_auc"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return ranking_metrics(df, score, label).select("roc_auc")


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, label, by).select(*by, "pr_auc")


def all_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                threshold: float = 0.5) -> DataFrame:
    """All metrics per group, for instance per model over stacked scores."""
    fixed = threshold_metrics(df, score, label, threshold, by)
    ranked = ranking_metrics(df, score, label, by)
    # one row per compared model
    return fixed.join(F.broadcast(ranked), list(by)) if by else attach_row(fixed, ranked)


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """The 2x2 matrix; both labels and both predictions are always present."""
    flagged = F.col(score) >= threshold
    cells = df.agg(*[F.count_if((F.col(label) == y) & (flagged if p else ~flagged)).alias(f"c{y}{p}")
                     for y in (0, 1) for p in (0, 1)])
    rows = F.array(
        F.struct(F.lit("true_ok").alias("truth"), F.col("c00").alias("pred_ok"),
                 F.col("c01").alias("pred_low")),
        F.struct(F.lit("true_low").alias("truth"), F.col("c10").alias("pred_ok"),
                 F.col("c11").alias("pred_low")))
    return cells.select(F.inline(rows))


def confusion_report(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Flagged rows and share, and the share of low reviews among them and caught by them."""
    flagged, low = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(F.count("*").alias("orders"), F.count_if(flagged).alias("flagged"),
                    F.count_if(low).alias("low_reviews"), F.count_if(flagged & low).alias("caught"))
    return counts.select(
        "orders", "flagged", "low_reviews", "caught",
        _safe(F.col("flagged"), F.col("orders")).alias("flagged_share"),
        _safe(F.col("caught"), F.col("low_reviews")).alias("caught_share"),
        _safe(F.col("caught"), F.col("flagged")).alias("hit_share"))
