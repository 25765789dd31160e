"""Two-sample tests on numeric samples: KS, Wasserstein-1, PSI.

Input everywhere: long rows ``(keys..., sample, value)`` with sample
'baseline' or 'current'.  All keys are tested in one job.  Rows are first
reduced to counts per distinct value; the ordered pass over them is split in
buckets, so one hot key with most of the rows still uses many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakesignal.functions.stats import clamp01, ks_p_value
from lakesignal.operators.detector import BASELINE, CURRENT, MIN_SAMPLE_SIZE, detector_rows
from lakesignal.scale import pinned, value_cuts, with_bucket


def unpivot_features(df: DataFrame, features: Sequence[str], sample: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Wide rows to ``(keep..., sample, feature, value)``; null values are dropped."""
    parts = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    long = df.select(*keep, sample.alias("sample"), F.expr(f"stack({len(features)}, {parts}) as (feature, value)"))
    return long.where(F.col("value").isNotNull())


def value_counts(long: DataFrame, keys: Sequence[str], buckets: int | None = None, side: str = "sample") -> DataFrame:
    """Rows per distinct value and sample: ``(keys, value, nb, nc, _bucket)``."""
    rows = long.where(F.col("value").isNotNull())
    counts = rows.groupBy(*keys, "value").agg(F.count_if(F.col(side) == BASELINE).alias("nb"), F.count_if(F.col(side) == CURRENT).alias("nc"))
    return with_bucket(counts, value_cuts(rows, keys, "value", buckets), keys, "value", buckets)


def weighted_counts(counts: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``value_counts`` from rows that are counts already: ``(keys, sample, value, n)``, as a stored baseline has them."""
    side = lambda s: F.sum(F.when(F.col("sample") == s, F.col("n")).otherwise(0))
    merged = pinned(counts.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(side(BASELINE).alias("nb"), side(CURRENT).alias("nc")))  # read for the cuts and the ranks
    return with_bucket(merged, value_cuts(merged, keys, "value", buckets), keys, "value", buckets)


def ranked_values(long: DataFrame, keys: Sequence[str], buckets: int | None = None, side: str = "sample") -> DataFrame:
    """Distinct values per key with counts and cumulative counts of both samples.

    Columns: keys, value, nb, nc, cum_b, cum_c, n_baseline, n_current, next_value.
    """
    return ranked_counts(value_counts(long, keys, buckets, side), keys)


def ranked_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cumulative form of ``value_counts``."""
    keys = list(keys)
    per_key = W.partitionBy(*keys)
    ordered = per_key.orderBy("_bucket")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counts.groupBy(*keys, "_bucket")
        .agg(F.sum("nb").alias("_b"), F.sum("nc").alias("_c"), F.min("value").alias("_first"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_before_b"),
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before_c"),
            F.sum("_b").over(per_key).alias("n_baseline"),
            F.sum("_c").over(per_key).alias("n_current"),
            F.lead("_first").over(ordered).alias("_next_bucket"),
        )
    )
    inner = W.partitionBy(*keys, "_bucket").orderBy("value")
    upto = inner.rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.join(offsets, [*keys, "_bucket"]).select(
        *keys,
        "value",
        "nb",
        "nc",
        (F.col("_before_b") + F.sum("nb").over(upto)).alias("cum_b"),
        (F.col("_before_c") + F.sum("nc").over(upto)).alias("cum_c"),
        "n_baseline",
        "n_current",
        F.coalesce(F.lead("value").over(inner), F.col("_next_bucket")).alias("next_value"),
    )


def quantile_of(cumulative: str, n: str, p: float) -> Column:
    """Linear-interpolated quantile as an aggregate over ``ranked_values`` rows."""
    pos = F.lit(p) * (F.col(n) - 1)
    low, high = F.floor(pos), F.ceil(pos)
    at_low = F.min(F.when(F.col(cumulative) > low, F.col("value")))
    at_high = F.min(F.when(F.col(cumulative) > high, F.col("value")))
    share = F.max(pos - low)
    return at_low + (at_high - at_low) * share


def _gap() -> Column:
    """Distance of the two distribution functions at a value; null when a sample is empty."""
    return F.abs(F.try_divide("cum_b", "n_baseline") - F.try_divide("cum_c", "n_current"))


def distance_summary(long: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """One row per key: KS D, Wasserstein-1, quartiles of the baseline, both sizes."""
    return summary_of(ranked_values(long, keys, buckets), keys)


def summary_of(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary from ``ranked_values`` or ``ranked_counts`` rows."""
    return ranked.groupBy(*keys).agg(
        F.max(_gap()).alias("ks"),
        F.coalesce(F.sum(_gap() * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("wasserstein"),
        quantile_of("cum_b", "n_baseline", 0.25).alias("q1"),
        quantile_of("cum_b", "n_baseline", 0.75).alias("q3"),
        F.max("n_baseline").alias("n_baseline"),
        F.max("n_current").alias("n_current"),
    )


def ks_rows(summary: DataFrame, keys: Sequence[str], alpha: float | Column = 0.05) -> DataFrame:
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    scored = summary.withColumn("_p", ks_p_value(F.col("ks"), F.col("n_baseline"), F.col("n_current")))
    return detector_rows(
        scored,
        keys,
        "ks",
        statistic=F.col("ks"),
        effect_size=F.col("ks"),
        p_value=F.col("_p"),
        drifted=F.col("_p") < alpha,
        confidence=clamp01(1 - F.col("_p")),
        detail={"alpha": alpha},
    )


def wasserstein_rows(summary: DataFrame, keys: Sequence[str], relative_threshold: float = 0.2) -> DataFrame:
    iqr = F.greatest(F.col("q3") - F.col("q1"), F.lit(1e-9))
    ratio = F.col("wasserstein") / iqr
    return detector_rows(
        summary,
        keys,
        "wasserstein",
        statistic=F.col("wasserstein"),
        effect_size=F.col("wasserstein"),
        drifted=ratio > relative_threshold,
        confidence=clamp01(ratio / (relative_threshold * 2)),
        detail={"baseline_iqr": iqr, "ratio_to_iqr": ratio, "relative_threshold": F.lit(relative_threshold)},
    )


def ks_test(long: DataFrame, keys: Sequence[str], alpha: float = 0.05, buckets: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test per key."""
    return ks_rows(distance_summary(long, keys, buckets), keys, alpha)


def wasserstein_test(long: DataFrame, keys: Sequence[str], relative_threshold: float = 0.2, buckets: int | None = None) -> DataFrame:
    """Wasserstein-1 distance per key, judged against the baseline's interquartile range."""
    return wasserstein_rows(distance_summary(long, keys, buckets), keys, relative_threshold)


def psi_buckets(long: DataFrame, keys: Sequence[str], bins: int = 10, buckets: int | None = None) -> DataFrame:
    """Counts of both samples per baseline-quantile bucket ``(lo, hi]``."""
    keys = list(keys)
    counts = value_counts(long, keys, buckets)
    edges = ranked_counts(counts, keys).groupBy(*keys).agg(
        F.array(*[quantile_of("cum_b", "n_baseline", i / bins) for i in range(bins + 1)]).alias("_q"),
        F.max("n_baseline").alias("n_baseline"),
        F.max("n_current").alias("n_current"),
    )
    edges = edges.withColumn("_edges", F.array_distinct("_q")).select(
        *keys,
        "n_baseline",
        "n_current",
        (F.size("_edges") - 1).alias("n_bins"),
        F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0))).alias("_inner"),
    )
    placed = counts.select(*keys, "value", "nb", "nc").join(edges, keys)
    return (
        placed.withColumn("psi_bucket", F.size(F.filter("_inner", lambda e: e < F.col("value"))))
        .groupBy(*keys, "psi_bucket")
        .agg(
            F.sum("nb").alias("nb"),
            F.sum("nc").alias("nc"),
            F.max("n_bins").alias("n_bins"),
            F.max("n_baseline").alias("n_baseline"),
            F.max("n_current").alias("n_current"),
        )
    )


def psi_test(long: DataFrame, keys: Sequence[str], bins: int = 10, buckets: int | None = None) -> DataFrame:
    """Population stability index per key; fewer than two distinct bins is undefined and never drifts."""
    placed = psi_buckets(long, keys, bins, buckets)

    def share(count: Column, n: Column) -> Column:
        return (count + 0.5) / (n + 0.5 * F.col("n_bins"))

    fb, fc = share(F.col("nb"), F.col("n_baseline")), share(F.col("nc"), F.col("n_current"))
    eb, ec = share(F.lit(0), F.col("n_baseline")), share(F.lit(0), F.col("n_current"))
    summed = placed.groupBy(*keys).agg(
        (F.sum((fc - fb) * F.ln(fc / fb)) + (F.max("n_bins") - F.count(F.lit(1))) * F.max((ec - eb) * F.ln(ec / eb))).alias("_psi"),
        F.max("n_bins").alias("bins"),
        F.max("n_baseline").alias("n_baseline"),
        F.max("n_current").alias("n_current"),
    )
    summed = summed.withColumn("_psi", F.when(F.col("bins") >= 2, F.col("_psi")).otherwise(F.lit(0.0)))
    return detector_rows(
        summed,
        keys,
        "psi",
        statistic=F.col("_psi"),
        effect_size=F.col("_psi"),
        drifted=F.col("_psi") >= 0.1,
        confidence=clamp01(F.col("_psi") / 0.25),
        detail={"bins": F.col("bins")},
    )


def psi_band(psi: Column) -> Column:
    return F.when(psi < 0.1, "no significant shift").when(psi < 0.25, "moderate shift").otherwise("significant shift")


def enough(n_baseline: Column, n_current: Column) -> Column:
    return (n_baseline >= MIN_SAMPLE_SIZE) & (n_current >= MIN_SAMPLE_SIZE)


def nearest_rank_percentile(df: DataFrame, keys: Sequence[str], value: str, pct: float = 95, name: str = "p95", buckets: int | None = None) -> DataFrame:
    """Nearest-rank percentile per key (half-even rank), plus ``n``; exact, no per-key sort task."""
    from lakesignal.functions.stats import nearest_rank

    long = df.select(*keys, F.lit(BASELINE).alias("_side"), F.col(value).cast("double").alias("value"))
    ranked = ranked_values(long, keys, buckets, side="_side")
    return ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("cum_b") > nearest_rank(F.col("n_baseline"), pct), F.col("value"))).alias(name),
        F.max("n_baseline").alias("n"),
    )
