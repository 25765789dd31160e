"""Check protocol and registry of checks by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.plans.golden_check import golden_signals, match_golden
from lakesignal.plans.rag_check import rag_signals
from lakesignal.plans.tabular_check import tabular_signals
from lakesignal.plans.telemetry_check import telemetry_metrics, telemetry_signals


class Check(Protocol):
    """Two steps, both DataFrame to DataFrame: what to keep as baseline, and how to compare against it.

    ``check`` returns signal rows with at least name, value and is_drifted.
    """

    def baseline(self, rows: DataFrame) -> DataFrame: ...

    def check(self, baseline: DataFrame, current: DataFrame) -> DataFrame: ...


def _both(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return baseline.withColumn("sample", F.lit("baseline")).unionByName(current.withColumn("sample", F.lit("current")), allowMissingColumns=True)


@dataclass
class TabularCheck:
    """Long rows (feature, value)."""

    alpha: float = 0.05
    bonferroni: bool = True

    def baseline(self, rows: DataFrame) -> DataFrame:
        return rows.select("feature", "value")

    def check(self, baseline: DataFrame, current: DataFrame) -> DataFrame:
        found = tabular_signals(_both(baseline, current.select("feature", "value")), (), "feature", self.alpha, self.bonferroni)
        return found.select(F.col("feature").alias("name"), F.col("statistic").alias("value"), "is_drifted", "p_value")


@dataclass
class GoldenCheck:
    """Baseline (prompt, expected_answer, position), current (prompt, actual_answer)."""

    threshold: float = 0.35

    def baseline(self, rows: DataFrame) -> DataFrame:
        return rows.select("prompt", "expected_answer", "position")

    def check(self, baseline: DataFrame, current: DataFrame) -> DataFrame:
        return golden_signals(match_golden(baseline, current), ["prompt"], self.threshold).drop("prompt")


@dataclass
class TelemetryCheck:
    """Telemetry events; only the metrics row is kept as baseline."""

    limits: dict = field(default_factory=dict)

    def baseline(self, rows: DataFrame) -> DataFrame:
        return telemetry_metrics(rows.select("*", F.expr("stack(1, 'all') as (scope)")), ["scope"])

    def check(self, baseline: DataFrame, current: DataFrame) -> DataFrame:
        return telemetry_signals(baseline, self.baseline(current), ["scope"], **self.limits).select("name", "value", "is_drifted")


@dataclass
class RagCheck:
    """Telemetry events with raw scores, latencies, counts and question embeddings."""

    alpha: float = 0.05
    min_events: int = 8
    event_id: str = "event_id"

    def baseline(self, rows: DataFrame) -> DataFrame:
        return rows

    def check(self, baseline: DataFrame, current: DataFrame) -> DataFrame:
        events = _both(baseline, current).select("*", F.expr("stack(1, 'all') as (scope)"))
        return rag_signals(events, ["scope"], self.alpha, self.min_events, self.event_id).drop("scope")


CHECKS: dict[str, Callable[..., Check]] = {"classifier": TabularCheck, "llm": GoldenCheck, "live_telemetry": TelemetryCheck, "rag": RagCheck}


def build_check(name: str, **options) -> Check:
    if name not in CHECKS:
        raise KeyError(f"unknown check '{name}', known: {', '.join(sorted(CHECKS))}")
    return CHECKS[name](**options)


def register_check(name: str, factory: Callable[..., Check]) -> None:
    """Add a caller's own check."""
    CHECKS[name] = factory
