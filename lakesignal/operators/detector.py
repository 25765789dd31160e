"""The result columns shared by every drift detector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewer observations than this on either side: the test is not run.
MIN_SAMPLE_SIZE = 8

BASELINE, CURRENT = "baseline", "current"


def detector_rows(
    df: DataFrame,
    keys: Sequence[str],
    detector: str,
    *,
    statistic: Column,
    effect_size: Column,
    drifted: Column,
    confidence: Column,
    p_value: Column | None = None,
    insufficient: Column | None = None,
    detail: dict[str, Column] | None = None,
) -> DataFrame:
    """Project ``df`` (one row per test, with n_baseline / n_current) onto the detector schema."""
    short = (F.col("n_baseline") < MIN_SAMPLE_SIZE) | (F.col("n_current") < MIN_SAMPLE_SIZE)
    short = F.coalesce(short if insufficient is None else (short | insufficient), F.lit(True))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    pairs = [c for name, col in (detail or {}).items() for c in (F.lit(name), col.cast("double"))]
    details = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return df.select(
        *keys,
        F.lit(detector).alias("detector"),
        F.when(short, zero).otherwise(statistic).alias("statistic"),
        F.when(short, none).otherwise(none if p_value is None else p_value).alias("p_value"),
        F.when(short, zero).otherwise(effect_size).alias("effect_size"),
        F.coalesce(~short & drifted, F.lit(False)).alias("drift_detected"),
        F.when(short, zero).otherwise(confidence).alias("confidence"),
        short.alias("insufficient_sample"),
        F.coalesce("n_baseline", F.lit(0)).cast("bigint").alias("n_baseline"),
        F.coalesce("n_current", F.lit(0)).cast("bigint").alias("n_current"),
        details.alias("detail"),
    )
