"""Golden-set check: expected against actual answers by TF-IDF cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.operators.tfidf import pair_similarity
from lakesignal.scale import latest


def match_golden(golden: DataFrame, answers: DataFrame, position: Sequence[str] = ("position",)) -> DataFrame:
    """Answers joined to the golden set on the exact prompt; a repeated golden prompt keeps its last row."""
    expected = latest(golden.select("prompt", "expected_answer", *position), ["prompt"], list(position)).drop(*position)
    return answers.join(expected, "prompt")


def golden_signals(matched: DataFrame, ids: Sequence[str], threshold: float = 0.35) -> DataFrame:
    scored = pair_similarity(matched, ids, "expected_answer", "actual_answer")
    return scored.select(
        *ids, F.left("prompt", F.lit(80)).alias("name"), F.col("similarity").alias("value"), (F.col("similarity") < threshold).alias("is_drifted")
    )


def golden_verdict(signals: DataFrame, keys: Sequence[str] = (), threshold: float = 0.35) -> DataFrame:
    """Mean similarity with its spread and 1.96 standard-error interval, clamped to [0, 1]."""
    mean, n = F.avg("value"), F.count(F.lit(1))
    sd = F.when(n > 1, F.stddev_samp("value")).otherwise(0.0)
    out = signals.groupBy(*keys).agg(mean.alias("quality_score"), n.alias("n_prompts"), sd.alias("std_dev"))
    out = out.where("n_prompts > 0").withColumn("std_error", F.col("std_dev") / F.sqrt("n_prompts"))
    margin = 1.96 * F.col("std_error")
    return out.select(
        *keys,
        F.greatest(F.lit(0.0), 1 - F.col("quality_score")).alias("drift_score"),
        "quality_score",
        (F.col("quality_score") < threshold).alias("is_drifted"),
        "n_prompts",
        "std_dev",
        "std_error",
        F.greatest(F.lit(0.0), F.col("quality_score") - margin).alias("ci95_low"),
        F.least(F.lit(1.0), F.col("quality_score") + margin).alias("ci95_high"),
    )
