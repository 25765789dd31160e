"""Operational check on request telemetry: refusal rate, citation rate, p95 latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.operators.numeric_drift import nearest_rank_percentile
from lakesignal.scale import stacked


def telemetry_metrics(events: DataFrame, keys: Sequence[str], approximate: bool = False, buckets: int | None = None) -> DataFrame:
    """Per key: refusal_rate, citation_rate, latency_p95_ms, n_events.

    The percentile is the exact nearest-rank one; ``approximate`` swaps in the
    quantile sketch, which needs no shuffle of the values.
    """
    keys = list(keys)
    latency = F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0))
    rates = [
        F.avg((~F.coalesce("grounded", F.lit(False))).cast("double")).alias("refusal_rate"),
        F.avg((F.coalesce("citations", F.lit(0)) > 0).cast("double")).alias("citation_rate"),
        F.count(F.lit(1)).alias("n_events"),
    ]
    if approximate:
        return events.groupBy(*keys).agg(*rates, F.percentile_approx(latency, 0.95).alias("latency_p95_ms"))
    p95 = nearest_rank_percentile(events.withColumn("_lat", latency), keys, "_lat", 95, "latency_p95_ms", buckets).drop("n")
    return events.groupBy(*keys).agg(*rates).join(p95, keys)


def telemetry_signals(
    baseline: DataFrame,
    current: DataFrame,
    keys: Sequence[str],
    refusal_tolerance: float = 0.20,
    citation_tolerance: float = 0.25,
    latency_multiplier: float = 2.5,
    min_events: int = 5,
) -> DataFrame:
    """Three signal rows per key from two ``telemetry_metrics`` tables."""
    keys = list(keys)
    names = ["refusal_rate", "citation_rate", "latency_p95_ms", "n_events"]
    base = baseline.select(*keys, *[F.col(c).alias(f"b_{c}") for c in names])
    both = current.join(base, keys, "left").fillna(0.0, [f"b_{c}" for c in names])
    enough = F.col("n_events") >= min_events
    ratio = F.when(F.col("b_latency_p95_ms") > 0, F.col("latency_p95_ms") / F.col("b_latency_p95_ms")).otherwise(1.0)
    rows = stacked(
        ["name", "value", "is_drifted", "baseline", "current"],
        [
            (
                F.lit("refusal rate"),
                F.col("refusal_rate"),
                enough & (F.col("refusal_rate") - F.col("b_refusal_rate") > refusal_tolerance),
                F.col("b_refusal_rate"),
                F.col("refusal_rate"),
            ),
            (
                F.lit("citation rate"),
                F.col("citation_rate"),
                enough & (F.col("b_citation_rate") - F.col("citation_rate") > citation_tolerance),
                F.col("b_citation_rate"),
                F.col("citation_rate"),
            ),
            (
                F.lit("latency p95"),
                F.least(F.lit(1.0), ratio / (latency_multiplier * 2)),
                enough & (ratio > latency_multiplier),
                F.col("b_latency_p95_ms"),
                F.col("latency_p95_ms"),
            ),
        ],
    )
    return both.select(*keys, "n_events", rows)


def telemetry_verdict(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return signals.groupBy(*keys).agg(
        F.avg(F.col("is_drifted").cast("double")).alias("drift_score"),
        (1 - F.max(F.when(F.col("name") == "refusal rate", F.col("value")))).alias("quality_score"),
        F.bool_or("is_drifted").alias("is_drifted"),
    )
