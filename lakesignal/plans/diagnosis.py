"""Which subsystem moved: per run from its signals, and per request trace.

The reasoning texts and messages in this module are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A corroborating signal counts for half of its own confidence.
SUPPORTING_WEIGHT = 0.5
#: Similarity bands of a refusal's best retrieved chunk, and the slow-stage limit in ms.
IRRELEVANT_MAX, INSUFFICIENT_MAX, SLOW_MS = 0.30, 0.50, 15_000


def signal_confidence(confidence: Column, ks: Column, wasserstein: Column) -> Column:
    """Own confidence, else the stronger of the two distances, else 0."""
    return F.coalesce(confidence, F.greatest(ks, wasserstein), F.lit(0.0))


def diagnose_runs(signals: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """``signals`` rows: keys, name, is_drifted, confidence.  One diagnosis per key."""

    def has(name: str) -> Column:
        return F.bool_or(F.col("name") == name).alias(f"has_{name}")

    def conf(name: str) -> Column:
        return F.max(F.when((F.col("name") == name) & F.col("is_drifted"), F.coalesce("confidence", F.lit(0.0)))).alias(f"c_{name}")

    names = ["retrieval", "citation_validity", "refusal", "generation_latency"]
    wide = signals.groupBy(*keys).agg(*[has(n) for n in names], *[conf(n) for n in names], F.bool_or("is_drifted").alias("any_drift"))
    c = {n: F.col(f"c_{n}") for n in names}
    zero = F.lit(0.0)
    shifted = c["retrieval"].isNotNull()
    downstream = F.coalesce(c["citation_validity"], zero) + F.coalesce(c["refusal"], zero)
    retrieval = F.when(shifted, c["retrieval"] + SUPPORTING_WEIGHT * downstream).otherwise(zero)
    generation = F.when(shifted, zero).otherwise(downstream)
    operational = F.coalesce(c["generation_latency"], zero)

    def after_retrieval(name: str) -> Column:
        text = name.replace("_", " ")
        return F.when(
            c[name].isNotNull(), F.lit(f"{text} also declined -- consistent with worse retrieved context rather than an independent model change")
        ).when(F.col(f"has_{name}"), F.lit(f"{text} remained stable"))

    def alone(name: str, text: str) -> Column:
        return F.when(
            c[name].isNotNull(),
            F.format_string(
                text + " shifted (confidence=%.2f) while retrieval stayed stable -- consistent with a model/prompt behavior change rather than a retrieval problem",
                c[name],
            ),
        )

    latency = F.when(
        c["generation_latency"].isNotNull(), F.format_string("generation latency distribution shifted (confidence=%.2f)", c["generation_latency"])
    ).when(F.col("has_generation_latency"), F.lit("latency remained stable"))
    with_retrieval = F.array(
        F.format_string("retrieval similarity distribution shifted (confidence=%.2f)", c["retrieval"]),
        after_retrieval("citation_validity"),
        after_retrieval("refusal"),
        latency,
    )
    without = F.array(
        alone("citation_validity", "citation validity"),
        alone("refusal", "refusal rate"),
        F.when(F.col("has_retrieval"), F.lit("retrieval remained stable")),
        latency,
    )
    reasoning = F.when(~F.col("any_drift"), F.array(F.lit("no signals are drifted"))).otherwise(F.array_compact(F.when(shifted, with_retrieval).otherwise(without)))

    def entry(order: int, name: str, score: Column) -> Column:
        return F.struct((-score).alias("neg"), F.lit(order).alias("ord"), F.lit(name).alias("subsystem"), score.alias("score"))

    ranked = F.array_sort(F.array(entry(0, "retrieval", retrieval), entry(1, "generation", generation), entry(2, "operational", operational)))
    out = wide.select(*keys, "any_drift", reasoning.alias("reasoning"), ranked.alias("_ranked"))
    top = F.col("_ranked")[0]
    scored = F.col("any_drift") & (top["score"] > 0)
    return out.select(
        *keys,
        F.when(scored, top["subsystem"]).alias("likely_subsystem"),
        F.when(scored, F.least(F.lit(1.0), top["score"])).otherwise(zero).alias("confidence"),
        "reasoning",
        F.when(F.col("any_drift"), F.transform("_ranked", lambda r: F.struct(r["subsystem"].alias("subsystem"), r["score"].alias("score"))))
        .otherwise(F.array().cast("array<struct<subsystem:string,score:double>>"))
        .alias("ranked"),
    )


def diagnose_traces(traces: DataFrame) -> DataFrame:
    """Add category, reasoning, best_similarity and operational_note to each trace.

    Needs retrieval array<struct<similarity>>, grounded, claims
    array<struct<status>>, citation_score, grounding_score and both latencies.
    """
    size = F.coalesce(F.size(F.coalesce("retrieval", F.array().cast(traces.schema["retrieval"].dataType))), F.lit(0))
    best = F.coalesce(F.array_max(F.transform("retrieval", lambda r: F.coalesce(r["similarity"], F.lit(0.0)))), F.lit(0.0))
    grounded = F.coalesce("grounded", F.lit(False))
    bad = F.coalesce(F.size(F.filter("claims", lambda c: c["status"] == "unsupported")), F.lit(0))
    n_claims = F.coalesce(F.size("claims"), F.lit(0))
    low_citation = F.col("citation_score") < 1.0
    low_grounding = F.col("grounding_score") < 0.5
    category = (
        F.when(size <= 0, "retrieval_miss")
        .when(~grounded & (best < IRRELEVANT_MAX), "irrelevant_retrieval")
        .when(~grounded & (best < INSUFFICIENT_MAX), "insufficient_evidence")
        .when(~grounded, "generation_problem")
        .when(low_citation, "citation_problem")
        .when(bad > 0, "generation_problem")
        .when(low_grounding, "generation_problem")
        .otherwise("none")
    )
    reasoning = (
        F.when(size <= 0, F.lit("no chunks were retrieved at all -- empty index, or the document has no indexed content"))
        .when(
            ~grounded & (best < IRRELEVANT_MAX),
            F.format_string("best retrieval similarity was only %.2f -- even the closest match is a poor fit for the question, so refusing was likely correct", best),
        )
        .when(
            ~grounded & (best < INSUFFICIENT_MAX),
            F.format_string("best retrieval similarity was %.2f -- plausibly related, but not strong enough to answer from, so refusing was a reasonable call", best),
        )
        .when(
            ~grounded,
            F.format_string("best retrieval similarity was %.2f, a good match, but the model refused anyway -- the evidence was there and the model didn't use it", best),
        )
        .when(low_citation, F.format_string("citation score %.2f -- some citations the model named didn't point at a real excerpt", F.col("citation_score")))
        .when(bad > 0, F.format_string("%d of %d claim(s) in the answer don't hold up against the retrieved evidence, despite the answer being marked grounded", bad, n_claims))
        .when(low_grounding, F.format_string("grounding score %.2f is low despite being marked grounded", F.col("grounding_score")))
        .otherwise(F.lit("retrieval, citations and claim verification all look consistent"))
    )
    note = F.when(F.col("retrieval_latency_ms") > SLOW_MS, F.format_string("retrieval took %.0fms, unusually slow", F.col("retrieval_latency_ms"))).when(
        F.col("generation_latency_ms") > SLOW_MS, F.format_string("generation took %.0fms, unusually slow", F.col("generation_latency_ms"))
    )
    return traces.withColumns(
        {"category": category, "reasoning": reasoning, "best_similarity": F.round(best, 4), "retrieved_count": size, "operational_note": note}
    )
