"""A telemetry check from stored baseline to run, health, alerts, metrics and outbox, for all models in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.plans.health import alert_message
from lakesignal.plans.telemetry_check import telemetry_metrics, telemetry_signals, telemetry_verdict
from lakesignal.scale import pinned
from lakesignal.sources.registry import Registry, alert_outbox, metric_rows

METRICS = "refusal_rate double, citation_rate double, n_events bigint, latency_p95_ms double"


class NoBaseline(LookupError):
    """A checked model has no stored baseline."""


@dataclass
class Checked:
    """What one call stored and what is left to send."""

    timeline: DataFrame  # one row per new run: verdict, state after it, alert flags
    signals: DataFrame
    metrics: DataFrame
    outbox: DataFrame


def telemetry_baselines(events: DataFrame) -> DataFrame:
    """(model_id, data): what to keep of each model's baseline events, as JSON for the registry; pinned, as that reads it for several tables."""
    kept = telemetry_metrics(events, ["model_id"])
    names = [c.split()[0] for c in METRICS.split(", ")]
    return pinned(kept.select("model_id", F.to_json(F.struct(*names)).alias("data")))


def run_telemetry_checks(registry: Registry, events: DataFrame, limits: dict | None = None, health_limits: tuple[int, int, int] = (1, 1, 1), buckets: int | None = None) -> Checked:
    """Checks every (model_id, run_id) of ``events`` against the model's stored baseline and records the runs.

    A run's time is that of its last event.  A run that is stored already is not checked again, so a repeated call
    changes nothing and sends nothing.
    """
    stored = registry.raw("runs").select("model_id", "run_id")
    new = events.join(stored, ["model_id", "run_id"], "left_anti")
    current = pinned(telemetry_metrics(new, ["model_id", "run_id"], buckets=buckets).join(new.groupBy("model_id", "run_id").agg(F.max("ts").alias("ts")), ["model_id", "run_id"]))
    kept = registry.baselines().select("model_id", F.from_json("data", METRICS).alias("m")).select("model_id", "m.*")
    missing = current.join(kept, "model_id", "left_anti").select("model_id").limit(1).collect()
    if missing:
        raise NoBaseline(f"model '{missing[0][0]}' has no baseline")
    base = current.select("model_id", "run_id").join(kept, "model_id")
    signals = pinned(telemetry_signals(base, current, ["model_id", "run_id"], **(limits or {})).drop("n_events"))
    held = F.sort_array(F.collect_list(F.struct("name", "value", "is_drifted", "baseline", "current")))
    runs = telemetry_verdict(signals, ["model_id", "run_id"]).join(signals.groupBy("model_id", "run_id").agg(held.alias("signals")), ["model_id", "run_id"])
    runs = pinned(runs.join(current, ["model_id", "run_id"]))
    named = [c.split()[0] for c in METRICS.split(", ")]
    rows = runs.select("model_id", "run_id", "ts", "drift_score", "quality_score", "is_drifted", F.to_json("signals").alias("signals"), F.to_json(F.struct(*named)).alias("statistics"))
    timeline = registry.record_runs(rows, *health_limits, buckets=buckets)
    opened = timeline.where("opens_alert").select("model_id", "run_id", F.col("state").alias("health_state"), alert_message().alias("message"))
    recorded = runs.join(timeline.select("model_id", "run_id"), ["model_id", "run_id"], "left_semi")
    return Checked(timeline, signals, metric_rows(recorded), alert_outbox(opened))
