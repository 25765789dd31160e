"""Health of monitored models from their run history.

States: healthy, warning, degraded, recovering.  A run's next state depends on
the state before it and on the length of the current streak of drifted or clean
runs.  Both are written as running aggregates (see ``scale.running``), so a
model that owns most of the runs is still processed in many buckets:

* streaks: position minus the position of the last run with the other verdict;
* a drifted run whose streak reached ``degraded_after`` (or ``warning_after``)
  fixes the state whatever came before: a *reset*;
* between resets the state follows from how many clean runs reached
  ``recovery_after`` since the last reset, and whether a clean run followed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.scale import latest, numbered, previous, running

HEALTHY, WARNING, DEGRADED, RECOVERING = "healthy", "warning", "degraded", "recovering"


def streaks(runs: DataFrame, keys: Sequence[str], order: Sequence[str], drifted: str = "is_drifted", buckets: int | None = None) -> DataFrame:
    """Add ``rn``, ``consecutive_drifted`` and ``consecutive_clean`` (and the positions they come from)."""
    keys = list(keys)
    placed = numbered(runs, keys, order, "rn", buckets)
    seen = running(
        placed,
        keys,
        ["rn"],
        {
            "_last_clean": ("max", F.when(~F.col(drifted), F.col("rn"))),
            "_last_drift": ("max", F.when(F.col(drifted), F.col("rn"))),
        },
    )
    return seen.withColumns(
        {
            "consecutive_drifted": F.col("rn") - F.coalesce("_last_clean", F.lit(0)),
            "consecutive_clean": F.col("rn") - F.coalesce("_last_drift", F.lit(0)),
        }
    )


def health_timeline(
    runs: DataFrame,
    keys: Sequence[str] = ("model_id",),
    order: Sequence[str] = ("ts", "run_id"),
    warning_after: int = 1,
    degraded_after: int = 1,
    recovery_after: int = 1,
    initial: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Every run with the state after it, its streaks, and whether it opens or resolves alerts.

    ``initial`` optionally gives the stored health before the first run:
    keys, state, consecutive_drifted, consecutive_clean.  Default: healthy, 0, 0.
    """
    keys = list(keys)
    seen = streaks(runs, keys, order, "is_drifted", buckets)
    if initial is not None:
        before = initial.select(*keys, F.col("state").alias("_s0"), F.col("consecutive_drifted").alias("_d0"), F.col("consecutive_clean").alias("_c0"))
        seen = seen.join(before, keys, "left")
    else:
        seen = seen.withColumns({"_s0": F.lit(HEALTHY), "_d0": F.lit(0), "_c0": F.lit(0)})
    seen = seen.withColumns(
        {
            "_s0": F.coalesce("_s0", F.lit(HEALTHY)),
            "consecutive_drifted": F.col("consecutive_drifted") + F.when(F.col("_last_clean").isNull(), F.coalesce("_d0", F.lit(0))).otherwise(0),
            "consecutive_clean": F.col("consecutive_clean") + F.when(F.col("_last_drift").isNull(), F.coalesce("_c0", F.lit(0))).otherwise(0),
        }
    )
    kind = (
        F.when(F.col("is_drifted") & (F.col("consecutive_drifted") >= degraded_after), DEGRADED)
        .when(F.col("is_drifted") & (F.col("consecutive_drifted") >= warning_after), WARNING)
    )
    seen = seen.withColumn("_reset", kind).withColumn("_full", ~F.col("is_drifted") & (F.col("consecutive_clean") >= recovery_after))
    seen = running(
        seen,
        keys,
        ["rn"],
        {"_fulls": ("sum", F.col("_full").cast("bigint")), "_last_full": ("max", F.when(F.col("_full"), F.col("rn")))},
    )
    seen = running(
        seen,
        keys,
        ["rn"],
        {"_at": ("max", F.when(F.col("_reset").isNotNull(), F.struct(F.col("rn").alias("rn"), F.col("_reset").alias("kind"), F.col("_fulls").alias("fulls"))))},
    )
    # before any reset the stored state plays the part of one; recovering counts as one full clean run at position 0
    base = F.coalesce(F.col("_at.kind"), F.when(F.col("_s0").isin(DEGRADED, RECOVERING), DEGRADED).otherwise(WARNING))
    carried = F.when(F.col("_at").isNull() & (F.col("_s0") == RECOVERING), 1).otherwise(0)
    fulls = F.col("_fulls") - F.coalesce(F.col("_at.fulls"), F.lit(0)) + carried
    first_full = F.when(carried == 1, F.lit(0)).otherwise(F.col("_last_full"))
    state = (
        F.when(F.col("_reset").isNotNull(), F.col("_reset"))
        .when(base == WARNING, HEALTHY)
        .when(fulls == 0, DEGRADED)
        .when(fulls >= 2, HEALTHY)
        .when(F.coalesce("_last_clean", F.lit(0)) > first_full, HEALTHY)
        .otherwise(RECOVERING)
    )
    seen = seen.withColumn("state", state).withColumns(
        {
            "consecutive_drifted": F.when(F.col("is_drifted"), F.col("consecutive_drifted")).otherwise(0).cast("bigint"),
            "consecutive_clean": F.when(~F.col("is_drifted"), F.col("consecutive_clean")).otherwise(0).cast("bigint"),
        }
    )
    seen = previous(seen, keys, ["rn"], "state", "_was")
    was = F.coalesce("_was", "_s0")
    seen = seen.withColumns(
        {
            "opens_alert": (F.col("state") == DEGRADED) & F.col("is_drifted") & (F.col("_reset") == DEGRADED).eqNullSafe(True) & ~was.isin(DEGRADED, RECOVERING),
            "resolves_alerts": ~F.col("is_drifted") & (was == RECOVERING),
        }
    )
    helper = ["_last_clean", "_last_drift", "_s0", "_d0", "_c0", "_reset", "_full", "_fulls", "_last_full", "_at", "_was"]
    return seen.drop(*helper)


def alert_lifecycle(timeline: DataFrame, keys: Sequence[str] = ("model_id",), ts: str = "ts", run_id: str = "run_id") -> DataFrame:
    """One row per alert: opened_at, and the first recovery after it (null while open).

    A recovery resolves every open alert of its model.  Alerts are matched to
    the recovery with the next ordinal, an equi-join instead of a range join.
    """
    keys = list(keys)
    counted = running(timeline, keys, ["rn"], {"_ord": ("sum", F.col("resolves_alerts").cast("bigint"))})
    opened = counted.where("opens_alert").select(*keys, F.col(run_id).alias("run_id"), F.col(ts).alias("opened_at"), (F.col("_ord") + 1).alias("_ord"))
    closed = counted.where("resolves_alerts").select(*keys, "_ord", F.col(ts).alias("resolved_at"))
    return opened.join(closed, [*keys, "_ord"], "left").drop("_ord").withColumn("resolved", F.col("resolved_at").isNotNull())


def alert_message(model_id="model_id", version="version", drift_score="drift_score", quality_score="quality_score"):
    """Message text; the quality part is left out when there is no quality score."""
    quality = F.coalesce(F.concat(F.lit(", quality_score="), F.format_string("%.3f", F.col(quality_score))), F.lit(""))
    quality = F.when(F.col(quality_score).isNull(), F.lit("")).otherwise(quality)
    return F.concat(
        F.format_string("Drift detected for model '%s' (v%d): drift_score=%.3f", F.col(model_id), F.col(version), F.col(drift_score)), quality
    )


def current_health(health: DataFrame, models: DataFrame, alerts: DataFrame, order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Latest stored health per model by ``order``; without one, degraded with streak 1 if an alert is open, else healthy."""
    names = ["model_id", "state", "consecutive_drifted", "consecutive_clean", "updated_at"]
    newest = latest(health.select(*names, *[c for c in order if c not in names]), ["model_id"], list(order))
    open_alerts = alerts.where(~F.col("resolved")).select("model_id").distinct().withColumn("_open", F.lit(True))
    joined = models.select("model_id").join(newest, "model_id", "left").join(open_alerts, "model_id", "left")
    is_open = F.coalesce("_open", F.lit(False))
    return joined.select(
        "model_id",
        F.coalesce("state", F.when(is_open, DEGRADED).otherwise(HEALTHY)).alias("state"),
        F.coalesce("consecutive_drifted", F.when(is_open, 1).otherwise(0)).cast("bigint").alias("consecutive_drifted"),
        F.coalesce("consecutive_clean", F.lit(0)).cast("bigint").alias("consecutive_clean"),
        "updated_at",
    )


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """Highest version, then highest id, per model."""
    return latest(baselines, ["model_id"], ["version", "id"])


def baseline_as_of(runs: DataFrame, baselines: DataFrame, ts: str = "ts", created: str = "created_at", buckets: int | None = None) -> DataFrame:
    """Each run with the latest baseline created at or before it.

    Both tables are ordered together per model and the baseline is carried
    forward as a running maximum of (version, id): no range join.
    """
    b = baselines.select("model_id", F.col(created).alias("_t"), F.lit(0).alias("_kind"), F.col("id").alias("_tie"), F.struct("version", "id").alias("_base"))
    r = runs.select("model_id", F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.col("run_id").alias("_tie"), F.lit(None).cast(b.schema["_base"].dataType).alias("_base"))
    placed = numbered(b.unionByName(r), ["model_id"], ["_t", "_kind", "_tie"], "rn", buckets)
    carried = running(placed, ["model_id"], ["rn"], {"_found": ("max", F.col("_base"))})
    found = carried.where("_kind = 1").select("model_id", F.col("_tie").alias("run_id"), F.col("_found.version").alias("baseline_version"), F.col("_found.id").alias("baseline_id"))
    return runs.join(found, ["model_id", "run_id"], "left")

