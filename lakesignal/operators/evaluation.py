"""Evaluation of retrieval and answers: case scores, summaries, regression gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.operators.numeric_drift import nearest_rank_percentile
from lakesignal.scale import stacked

LATENCIES = ("latency_ms", "retrieval_latency_ms", "generation_latency_ms")

# Gated metric, whether higher is better, tolerance.
GATED_METRICS = (
    ("retrieval_hit_rate", True, 0.10),
    ("citation_correctness", True, 0.15),
    ("mean_semantic_similarity", True, 0.10),
    ("refusal_rate", False, 0.15),
)


def first_hit(retrieved: Column, relevant: Column) -> Column:
    """1-based position of the first retrieved chunk that is relevant; null when none is."""
    at = F.array_min(F.filter(F.transform(relevant, lambda r: F.array_position(retrieved, r)), lambda p: p > 0))
    return at.cast("int")


def score_cases(cases: DataFrame) -> DataFrame:
    """Per case: hit, rank, citation correctness (grounded answers only), refusal, similarity.

    Needs relevant_chunks, retrieved_chunks, cited_chunks (arrays), grounded,
    answer, expected_answer and a ``similarity`` from the caller's vectors.
    """
    blank = (F.trim(F.coalesce("answer", F.lit(""))) == "") | (F.trim(F.coalesce("expected_answer", F.lit(""))) == "")
    return cases.withColumns(
        {
            "retrieval_hit": F.coalesce(F.arrays_overlap("relevant_chunks", "retrieved_chunks"), F.lit(False)),
            "retrieval_rank": first_hit(F.col("retrieved_chunks"), F.col("relevant_chunks")),
            "citation_correct": F.col("grounded") & F.coalesce(F.arrays_overlap("relevant_chunks", "cited_chunks"), F.lit(False)),
            "refused": ~F.col("grounded"),
            "semantic_similarity": F.when(blank, F.lit(0.0)).otherwise(F.coalesce("similarity", F.lit(0.0))),
        }
    )


def _rates() -> list[Column]:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return [
        F.count(F.lit(1)).alias("n_cases"),
        share("retrieval_hit").alias("retrieval_hit_rate"),
        F.coalesce(F.avg(F.when(~F.col("refused"), F.col("citation_correct").cast("double"))), F.lit(0.0)).alias("citation_correctness"),
        share("refused").alias("refusal_rate"),
        share("parse_error").alias("parse_error_rate"),
        F.avg("semantic_similarity").alias("mean_semantic_similarity"),
    ]


def summarize(results: DataFrame, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Overall summary per key (a run, a variant, ...) with three exact nearest-rank p95 latencies."""
    keys = list(keys)
    long = results.select(*keys, stacked(["_metric", "_ms"], [(F.lit(c), F.col(c).cast("double")) for c in LATENCIES]))
    p95 = nearest_rank_percentile(long, [*keys, "_metric"], "_ms", 95, "p95", buckets)
    wide = p95.groupBy(*keys).agg(*[F.max(F.when(F.col("_metric") == c, F.col("p95"))).alias(c.replace("_ms", "_p95_ms")) for c in LATENCIES])
    rates = results.groupBy(*keys).agg(*_rates())
    if keys:
        return rates.join(wide, keys)
    from lakesignal.scale import attach_row

    return attach_row(rates, wide)


def by_category(results: DataFrame, category: str = "category", keys: Sequence[str] = ()) -> DataFrame:
    """Overall and per-category rows in one grouping-sets pass; the overall row has category null."""
    every = [F.col(k) for k in keys]
    grouped = results.groupingSets([every, [*every, F.col(category)]], *every, F.col(category))
    return grouped.agg(
        F.grouping(category).alias("is_total"),
        F.count(F.lit(1)).alias("n_cases"),
        F.avg(F.col("retrieval_hit").cast("double")).alias("retrieval_hit_rate"),
        F.avg("semantic_similarity").alias("mean_semantic_similarity"),
    )


def quality_gate(baseline: DataFrame, current: DataFrame, keys: Sequence[str] = (), metrics=GATED_METRICS, tolerance: float | None = None) -> DataFrame:
    """Each gated metric of two summaries with PASS or REGRESSION."""
    keys = list(keys)

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, stacked(["metric", name], [(F.lit(m), F.col(m).cast("double")) for m, _, _ in metrics]))

    both = long(baseline, "baseline_value").join(long(current, "current_value"), [*keys, "metric"])
    delta = F.col("current_value") - F.col("baseline_value")
    bad = F.lit(False)
    for m, higher, tol in metrics:
        tol = tol if tolerance is None else tolerance
        bad = F.when(F.col("metric") == m, (delta < -tol) if higher else (delta > tol)).otherwise(bad)
    return both.withColumn("status", F.when(bad, "REGRESSION").otherwise("PASS"))


def gate_verdict(gate: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return gate.groupBy(*keys).agg(F.bool_or(F.col("status") == "REGRESSION").alias("any_regression"))


def narrowed(cases: DataFrame, top_k: Sequence[int], retrieved: str = "retrieved_chunks") -> DataFrame:
    """The same cases under several top_k values, one row per (case, top_k); the full ranking is computed once."""
    ks = F.array(*[F.lit(int(k)) for k in top_k])
    return cases.withColumn("top_k", F.explode(ks)).withColumn(retrieved, F.slice(F.col(retrieved), F.lit(1), F.col("top_k")))
