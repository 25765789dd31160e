"""Two-sample tests on category counts, and on proportions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.stats import chi_square_tail, clamp01, normal_two_sided
from lakesignal.operators.detector import BASELINE, CURRENT, detector_rows


def category_counts(df: DataFrame, keys: Sequence[str], category: str, sample: Column) -> DataFrame:
    """``(keys, category, nb, nc)``: one map-side combined pass; absent categories count 0."""
    side = df.select(*keys, F.col(category).alias("category"), sample.alias("sample"))
    return side.groupBy(*keys, "category").agg(
        F.count_if(F.col("sample") == BASELINE).alias("nb"), F.count_if(F.col("sample") == CURRENT).alias("nc")
    )


def _totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts with the totals of their key attached.  One row per key; size decides how it is joined."""
    kept = counts.where(F.col("nb") + F.col("nc") > 0)
    totals = kept.groupBy(*keys).agg(
        F.sum("nb").alias("n_baseline"), F.sum("nc").alias("n_current"), F.count(F.lit(1)).alias("_k")
    )
    return kept.join(totals, list(keys))


def chi_square_test(counts: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Pearson chi-square of a 2 x k table per key; Cramer's V as effect size.

    With exactly two categories the continuity correction is applied: each
    deviation shrinks by min(0.5, |deviation|).
    """
    nb, nc = F.col("n_baseline"), F.col("n_current")
    column = F.col("nb") + F.col("nc")
    eb, ec = column * nb / (nb + nc), column * nc / (nb + nc)

    def part(observed: Column, expected: Column) -> Column:
        gap = F.abs(observed - expected)
        gap = F.when(F.col("_k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.when(expected > 0, gap * gap / expected).otherwise(F.lit(0.0))

    per_key = (
        _totals(counts, keys)
        .groupBy(*keys)
        .agg(
            F.sum(part(F.col("nb"), eb) + part(F.col("nc"), ec)).alias("chi2"),
            F.max("n_baseline").alias("n_baseline"),
            F.max("n_current").alias("n_current"),
            F.max("_k").alias("_k"),
        )
        .withColumn("dof", F.col("_k") - 1)
        .withColumn("_p", F.when(F.col("dof") > 0, chi_square_tail(F.col("chi2"), F.col("dof"))))
    )
    return detector_rows(
        per_key,
        keys,
        "chi_square",
        statistic=F.col("chi2"),
        effect_size=F.sqrt(F.col("chi2") / (nb + nc)),
        p_value=F.col("_p"),
        drifted=F.col("_p") < alpha,
        confidence=clamp01(1 - F.col("_p")),
        insufficient=F.col("_k") < 2,
        detail={"alpha": F.lit(alpha), "degrees_of_freedom": F.col("dof")},
    )


def jensen_shannon_test(counts: DataFrame, keys: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """Base-2 Jensen-Shannon divergence per key, in [0, 1]."""
    p, q = F.try_divide("nb", "n_baseline"), F.try_divide("nc", "n_current")
    mid = (p + q) / 2

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mid)).otherwise(F.lit(0.0))

    per_key = (
        _totals(counts, keys)
        .groupBy(*keys)
        .agg(
            F.sum(0.5 * part(p) + 0.5 * part(q)).alias("jsd"),
            F.max("n_baseline").alias("n_baseline"),
            F.max("n_current").alias("n_current"),
            F.max("_k").alias("_k"),
        )
    )
    confidence = clamp01(F.col("jsd") / threshold) if threshold > 0 else F.lit(0.0)
    return detector_rows(
        per_key,
        keys,
        "jensen_shannon",
        statistic=F.col("jsd"),
        effect_size=F.col("jsd"),
        drifted=F.col("jsd") >= threshold,
        confidence=confidence,
        insufficient=F.col("_k") < 2,
        detail={"threshold": F.lit(threshold)},
    )


def two_proportion_test(pairs: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """z-test on rows ``(keys, baseline_successes, baseline_n, current_successes, current_n)``.

    No variance in the pooled sample: statistic 0, p = 1, not drifted.
    """
    nb, nc = F.col("baseline_n"), F.col("current_n")
    rate_b, rate_c = F.try_divide("baseline_successes", "baseline_n"), F.try_divide("current_successes", "current_n")
    pooled = F.try_divide(F.col("baseline_successes") + F.col("current_successes"), nb + nc)
    scored = (
        pairs.withColumn("_se", F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), nb) + F.try_divide(F.lit(1), nc))))
        .withColumn("_z", F.when(F.col("_se") > 0, (rate_c - rate_b) / F.col("_se")).otherwise(F.lit(0.0)))
        .withColumn("_p", F.when(F.col("_se") > 0, normal_two_sided(F.col("_z"))).otherwise(F.lit(1.0)))
        .withColumn("n_baseline", nb)
        .withColumn("n_current", nc)
    )
    return detector_rows(
        scored,
        keys,
        "two_proportion_ztest",
        statistic=F.col("_z"),
        effect_size=F.abs(rate_c - rate_b),
        p_value=F.col("_p"),
        drifted=(F.col("_se") > 0) & (F.col("_p") < alpha),
        confidence=clamp01(1 - F.col("_p")),
        detail={"baseline_rate": rate_b, "current_rate": rate_c, "alpha": F.lit(alpha)},
    )
