"""Health state per model kept across micro-batches.

``start_health`` runs the batch timeline on each micro-batch from the stored states, so the runs of one model are spread
over all tasks.  ``stream_health`` keeps the states in Spark's state store and folds a model's runs of a micro-batch in
one task, by whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakesignal.plans.health import DEGRADED, HEALTHY, RECOVERING, WARNING, health_timeline
from lakesignal.scale import latest, pinned

OUTPUT = "model_id string, run_id bigint, state string, consecutive_drifted bigint, consecutive_clean bigint, opens_alert boolean, resolves_alerts boolean"
STATE = "state string, consecutive_drifted bigint, consecutive_clean bigint"


def _last(at: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Position of the last hit up to each row, 0 before the first."""
    return np.maximum.accumulate(np.where(hit, at, 0))


def fold_runs(drifted: np.ndarray, stored: tuple[str, int, int], warning_after: int, degraded_after: int, recovery_after: int) -> pd.DataFrame:
    """The batch timeline's formulation (``plans.health``) on one model's ordered runs, whole arrays at a time.

    Streaks are distances to the last run with the other verdict; runs that fix the state are resets; between resets
    the state follows from the number of full clean streaks.  ``stored`` is (state, drifted streak, clean streak) before.
    """
    start, drifted_before, clean_before = stored
    at = np.arange(1, len(drifted) + 1)
    last_clean, last_drift = _last(at, ~drifted), _last(at, drifted)
    bad = np.where(drifted, at - last_clean + np.where(last_clean == 0, drifted_before, 0), 0)
    good = np.where(~drifted, at - last_drift + np.where(last_drift == 0, clean_before, 0), 0)
    reset = np.select([drifted & (bad >= degraded_after), drifted & (bad >= warning_after)], [DEGRADED, WARNING], "")
    full = ~drifted & (good >= recovery_after)
    fulls, last_full, last_reset = np.cumsum(full), _last(at, full), _last(at, reset != "")
    unset = last_reset == 0
    base = np.where(unset, DEGRADED if start in (DEGRADED, RECOVERING) else WARNING, reset[last_reset - 1])
    carried = unset & (start == RECOVERING)
    since = fulls - np.where(unset, 0, fulls[last_reset - 1]) + carried
    clean_after_full = last_clean > np.where(carried, 0, last_full)
    state = np.select(
        [reset != "", base == WARNING, since == 0, (since >= 2) | clean_after_full], [reset, HEALTHY, DEGRADED, HEALTHY], RECOVERING
    )
    was = np.concatenate([[start], state[:-1]])
    opens = (reset == DEGRADED) & ~np.isin(was, (DEGRADED, RECOVERING))
    return pd.DataFrame(
        {"state": state, "consecutive_drifted": bad, "consecutive_clean": good, "opens_alert": opens, "resolves_alerts": ~drifted & (was == RECOVERING)}
    )


def stream_health(runs: DataFrame, warning_after: int = 1, degraded_after: int = 1, recovery_after: int = 1) -> DataFrame:
    """Timeline rows for a stream of runs (model_id, run_id, ts, is_drifted).

    Only the state row (three fields) is kept per model.  The runs of one model
    inside one micro-batch are ordered by (ts, run_id); bound a micro-batch with
    the source's trigger options.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "run_id"], kind="stable")
        stored = held.get if held.exists else (HEALTHY, 0, 0)
        out = fold_runs(rows["is_drifted"].to_numpy(bool), stored, warning_after, degraded_after, recovery_after)
        end = out.iloc[-1]
        held.update((str(end["state"]), int(end["consecutive_drifted"]), int(end["consecutive_clean"])))
        out.insert(0, "model_id", key[0])
        out.insert(1, "run_id", rows["run_id"].to_numpy())
        yield out

    slim = runs.select("model_id", "run_id", "ts", "is_drifted")
    return slim.groupBy("model_id").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def next_states(timeline: DataFrame, before: DataFrame | None, order: Sequence[str] = ("ts", "run_id")) -> DataFrame:
    """(model_id, state, streaks) after a timeline: its last row per model, and what other models had before."""
    names = ["model_id", "state", "consecutive_drifted", "consecutive_clean"]
    after = latest(timeline.select(*names, *order), ["model_id"], list(order)).select(*names)
    return after if before is None else after.unionByName(before.select(*names).join(after, "model_id", "left_anti"))


def replayed_health(parts: Sequence[DataFrame], limits: tuple[int, int, int] = (1, 1, 1), order: Sequence[str] = ("ts", "run_id")) -> DataFrame:
    """The timeline of runs that come in ``parts``, each from the states that the ones before left."""
    states, out = None, None
    for part in parts:
        timeline = pinned(health_timeline(part, ["model_id"], list(order), *limits, initial=states))
        states = pinned(next_states(timeline, states, order))
        out = timeline if out is None else out.unionByName(timeline)
    return out


def _stored(spark: SparkSession, path: str, schema: str, epoch: int) -> DataFrame | None:
    """The newest states written before ``epoch``."""
    try:
        rows = spark.read.schema(f"{schema}, epoch long").parquet(path).where(F.col("epoch") < epoch)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    last = rows.agg(F.max("epoch")).first()[0]
    return None if last is None else rows.where(F.col("epoch") == last).drop("epoch")


def start_health(runs: DataFrame, folder: str, checkpoint: str, limits: tuple[int, int, int] = (1, 1, 1), trigger: dict | None = None) -> StreamingQuery:
    """Timeline of a stream of runs (model_id, run_id, ts, is_drifted) below ``folder``, by epoch.

    A repeated epoch overwrites its own rows and starts from the states before it, so a restart repeats nothing.  Runs of
    a later micro-batch count as later runs.
    """

    def step(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        before = _stored(spark, f"{folder}/states", f"model_id string, {STATE}", epoch)
        timeline = pinned(health_timeline(rows, ["model_id"], ["ts", "run_id"], *limits, initial=before))
        kept = timeline.select("model_id", "run_id", "state", "consecutive_drifted", "consecutive_clean", "opens_alert", "resolves_alerts")
        kept.write.mode("overwrite").parquet(f"{folder}/timeline/epoch={epoch}")
        next_states(timeline, before).write.mode("overwrite").parquet(f"{folder}/states/epoch={epoch}")

    writer = runs.select("model_id", "run_id", "ts", "is_drifted").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
