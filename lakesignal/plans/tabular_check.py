"""Tabular model check: KS per common feature with a family-wise threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakesignal.functions.stats import ks_p_value
from lakesignal.operators.numeric_drift import distance_summary


def tabular_signals(
    long: DataFrame,
    keys: Sequence[str] = (),
    feature: str = "feature",
    alpha: float = 0.05,
    bonferroni: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """One signal per feature present on both sides; no minimum sample size is applied.

    ``long`` has columns keys, feature, sample, value.
    """
    return signals_of(distance_summary(long, [*keys, feature], buckets), keys, feature, alpha, bonferroni)


def signals_of(summary: DataFrame, keys: Sequence[str] = (), feature: str = "feature", alpha: float = 0.05, bonferroni: bool = True) -> DataFrame:
    """The signals from a ``distance_summary``."""
    by = [*keys, feature]
    summary = summary.where((F.col("n_baseline") > 0) & (F.col("n_current") > 0))
    # one row per feature is left here, so counting them per check is a tiny window
    joined = summary.withColumn("n_features", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    threshold = F.lit(alpha) / F.col("n_features") if bonferroni else F.lit(alpha)
    return joined.select(
        *by,
        F.col("ks").alias("statistic"),
        ks_p_value(F.col("ks"), F.col("n_baseline"), F.col("n_current")).alias("p_value"),
        threshold.alias("threshold"),
        "n_baseline",
        "n_current",
    ).withColumn("is_drifted", F.col("p_value") < F.col("threshold"))


def tabular_verdict(signals: DataFrame, keys: Sequence[str] = (), drift_fraction: float = 0.3) -> DataFrame:
    """Share of flagged features per check; drifted when it reaches ``drift_fraction``."""
    score = F.avg(F.col("is_drifted").cast("double"))
    out = signals.groupBy(*keys).agg(
        F.coalesce(score, F.lit(0.0)).alias("drift_score"),
        F.count(F.lit(1)).alias("n_features"),
        F.count_if("is_drifted").alias("n_flagged"),
        F.max("threshold").alias("effective_threshold"),
    )
    return out.withColumn("is_drifted", F.col("drift_score") >= drift_fraction)


def missing_features(long: DataFrame, keys: Sequence[str] = (), feature: str = "feature") -> DataFrame:
    """Features seen in the baseline but absent from the current batch."""
    by = [*keys, feature]
    seen = long.select(*by, "sample").distinct()
    base = seen.where(F.col("sample") == "baseline").drop("sample")
    return base.join(seen.where(F.col("sample") == "current").drop("sample"), by, "left_anti")


def accuracy(df: DataFrame, keys: Sequence[str], prediction: str, label: str, weight: str | None = None) -> DataFrame:
    """Share of labelled rows predicted right; null when there is no labelled row.  A row counts ``weight`` times."""
    right = F.coalesce((F.col(prediction) == F.col(label)).cast("double"), F.lit(0.0))
    share = F.avg(right) if weight is None else F.sum(right * F.col(weight)) / F.sum(weight)
    return df.where(F.col(label).isNotNull()).groupBy(*keys).agg(share.alias("quality_score"))
