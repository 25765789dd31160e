"""How many drifted checks in a row should open an incident."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_check_fpr(clean_runs: DataFrame, keys: Sequence[str] = (), drifted: str = "is_drifted") -> DataFrame:
    """Share of checks on known-clean traffic that reported drift (null on no rows)."""
    return clean_runs.groupBy(*keys).agg(F.avg(F.col(drifted).cast("double")).alias("single_check_fpr"))


def calibrate(fpr: DataFrame, target: float = 0.01, max_consecutive: int = 10) -> DataFrame:
    """Smallest k with fpr^k <= target (up to ``max_consecutive``), per row of ``fpr``."""
    if not 0.0 < target < 1.0:
        raise ValueError(f"target must be in (0, 1), got {target}")
    if max_consecutive < 1:
        raise ValueError(f"max_consecutive must be at least 1, got {max_consecutive}")
    p = F.col("single_check_fpr")
    fits = F.filter(F.sequence(F.lit(1), F.lit(max_consecutive)), lambda k: F.pow(p, k) <= target + 1e-12)
    k = F.when(p <= 0, F.lit(1)).otherwise(F.coalesce(F.array_min(fits), F.lit(max_consecutive)))
    return (
        fpr.withColumn("target_incident_fpr", F.lit(target))
        .withColumn("recommended_consecutive", k.cast("bigint"))
        .withColumn("achieved_incident_fpr", F.when(p <= 0, F.lit(0.0)).otherwise(F.pow(p, F.col("recommended_consecutive"))))
        .withColumn("capped", F.col("achieved_incident_fpr") > target)
    )
