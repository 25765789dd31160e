"""Five-signal check of a retrieval-augmented application over its telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.operators.categorical_drift import two_proportion_test
from lakesignal.operators.detector import BASELINE, CURRENT
from lakesignal.operators.embedding_drift import mmd_test
from lakesignal.operators.numeric_drift import distance_summary, ks_rows, wasserstein_rows
from lakesignal.scale import pinned, stacked

SIGNALS = ("retrieval", "generation_latency", "refusal", "citation_validity", "embedding")


def event_counts(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both windows' counts in one pass; null counters read as 0."""
    aggs = []
    for side, tag in ((BASELINE, "b"), (CURRENT, "c")):
        here = F.col("sample") == side
        aggs += [
            F.count_if(here).alias(f"{tag}_events"),
            F.count_if(here & F.coalesce("grounded", F.lit(False))).alias(f"{tag}_grounded"),
            F.sum(F.when(here, F.coalesce("citations", F.lit(0))).otherwise(0)).alias(f"{tag}_valid"),
            F.sum(F.when(here, F.coalesce("citations_requested", F.lit(0))).otherwise(0)).alias(f"{tag}_requested"),
        ]
    return events.groupBy(*keys).agg(*aggs)


def pooled_samples(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Retrieval scores pooled over events, and one generation latency per event, as long rows."""
    scores = F.transform(F.coalesce("retrieval_scores", F.array().cast("array<double>")), lambda v: F.struct(F.lit("retrieval").alias("signal"), v.cast("double").alias("value")))
    latency = F.array(F.struct(F.lit("generation_latency").alias("signal"), F.coalesce(F.col("generation_latency_ms").cast("double"), F.lit(0.0)).alias("value")))
    return events.select(*keys, "sample", F.inline(F.concat(scores, latency)))


def rag_signals(
    events: DataFrame,
    keys: Sequence[str],
    alpha: float = 0.05,
    min_events: int = 8,
    event_id: str = "event_id",
    permutations: int = 200,
    buckets: int | None = None,
    mmd_method: str = "exact",
) -> DataFrame:
    """One row per (key, signal).  ``events`` carries a ``sample`` column with both windows."""
    keys = list(keys)
    summary = distance_summary(pooled_samples(events, keys), [*keys, "signal"], buckets)
    vectors = events.where(F.size("question_embedding") > 0).select(*keys, "sample", F.col(event_id).alias("id"), F.col("question_embedding").alias("embedding"))
    return signals_of(event_counts(events, keys), summary, vectors, keys, alpha, min_events, permutations, mmd_method)


def signals_of(
    counts: DataFrame, summary: DataFrame, vectors: DataFrame, keys: Sequence[str], alpha: float = 0.05, min_events: int = 8, permutations: int = 200, mmd_method: str = "exact"
) -> DataFrame:
    """The signals from ``event_counts``, the summary of the pooled samples by signal, and the vectors of both windows."""
    keys = list(keys)
    summary = pinned(summary)  # read by both tests; a row per key and signal
    ks = ks_rows(summary, [*keys, "signal"], alpha)
    wass = wasserstein_rows(summary, [*keys, "signal"])
    cols = ["statistic", "p_value", "effect_size", "drift_detected", "confidence", "insufficient_sample"]
    both = ks.select(*keys, F.col("signal").alias("name"), *cols).join(
        wass.select(*keys, F.col("signal").alias("name"), F.col("drift_detected").alias("w_drift"), F.col("confidence").alias("w_confidence")), [*keys, "name"]
    )
    is_retrieval = F.col("name") == "retrieval"
    numeric = both.select(
        *keys,
        "name",
        F.col("effect_size").alias("value"),
        F.when(is_retrieval, F.col("drift_detected") | F.col("w_drift")).otherwise(F.col("drift_detected")).alias("raw_drift"),
        F.when(is_retrieval, F.greatest("confidence", "w_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        "p_value",
        "insufficient_sample",
    )
    one = F.lit(1).cast("bigint")
    pairs = counts.select(
        *keys,
        stacked(
            ["name", "baseline_successes", "baseline_n", "current_successes", "current_n"],
            [
                (F.lit("refusal"), F.col("b_events") - F.col("b_grounded"), F.col("b_events"), F.col("c_events") - F.col("c_grounded"), F.col("c_events")),
                (F.lit("citation_validity"), F.col("b_valid"), F.greatest("b_requested", one), F.col("c_valid"), F.greatest("c_requested", one)),
            ],
        ),
    )
    rates = two_proportion_test(pairs, [*keys, "name"], alpha)
    proportion = rates.select(
        *keys,
        "name",
        F.when(F.col("insufficient_sample"), 0.0).otherwise(F.col("detail")["current_rate"]).alias("value"),
        F.col("drift_detected").alias("raw_drift"),
        "confidence",
        "p_value",
        "insufficient_sample",
    )
    mmd = mmd_test(vectors, keys, permutations, alpha, method=mmd_method)
    found = counts.select(*keys).join(mmd, keys, "left")
    embedding = found.select(
        *keys,
        F.lit("embedding").alias("name"),
        F.coalesce("effect_size", F.lit(0.0)).alias("value"),
        F.coalesce("drift_detected", F.lit(False)).alias("raw_drift"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "p_value",
        F.coalesce("insufficient_sample", F.lit(True)).alias("insufficient_sample"),
    )
    signals = numeric.unionByName(proportion).unionByName(embedding)
    enough = counts.select(*keys, ((F.col("b_events") >= min_events) & (F.col("c_events") >= min_events)).alias("sufficient_sample"))
    return signals.join(enough, keys).withColumn("is_drifted", F.col("sufficient_sample") & F.col("raw_drift")).drop("raw_drift")


def rag_verdict(signals: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """drift_score over the five signals; quality is the grounded rate of the current window."""
    quality = events.where(F.col("sample") == CURRENT).groupBy(*keys).agg(F.avg(F.coalesce("grounded", F.lit(False)).cast("double")).alias("quality_score"))
    verdict = signals.groupBy(*keys).agg(
        (F.count_if("is_drifted") / len(SIGNALS)).alias("drift_score"),
        F.bool_or("is_drifted").alias("is_drifted"),
        F.count_if("is_drifted").alias("n_signals_drifted"),
        F.bool_and("sufficient_sample").alias("sufficient_sample"),
    )
    return verdict.join(quality, list(keys), "left")
