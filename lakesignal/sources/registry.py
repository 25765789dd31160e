"""Registry tables as append-only Parquet, partitioned by model.

Rows are never changed in place: a later row with the same key supersedes an
earlier one, and readers take the latest (``scale.latest``).  Ids come from the
caller's keys, so re-running an append job cannot invent new ones.

Health rows are ordered by an append sequence, not by the caller's times.  A
batch of runs writes its alerts and health first and its runs last; rows that
name a run which is not stored yet do not count, so the runs are the commit and
a batch that broke off can simply be repeated.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesignal.plans.health import alert_lifecycle, alert_message, current_health, health_timeline, latest_baseline
from lakesignal.scale import latest, pinned


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


#: Table name -> columns.
TABLES = {
    "models": "model_id string, name string, check_name string, current_version int, created_at timestamp, config string",
    "baselines": "model_id string, id bigint, version int, data string, created_at timestamp",
    "runs": "model_id string, run_id bigint, version int, ts timestamp, drift_score double, quality_score double, is_drifted boolean, signals string, statistics string",
    "alerts": "model_id string, run_id bigint, created_at timestamp, message string, resolved boolean, resolved_at timestamp, by_run_id bigint",
    "versions": "model_id string, id bigint, version int, created_at timestamp, reason string",
    "health": "model_id string, state string, consecutive_drifted bigint, consecutive_clean bigint, updated_at timestamp, run_id bigint, seq bigint",
    "experiments": "experiment_id string, name string, kind string, created_at timestamp, config string, results string, status string",
    "traces": "trace_id string, model_id string, created_at timestamp, data string",
    "baseline_values": "model_id string, version int, feature string, value double, n bigint",
    "baseline_answers": "model_id string, version int, prompt string, expected_answer string, position bigint",
    "baseline_vectors": "model_id string, version int, id string, embedding array<double>",
}

#: Natural key of the tables whose rows are superseded, with the order that decides the latest.
CURRENT_ROW = {"models": (["model_id"], ["current_version"]), "health": (["model_id"], ["seq"]), "alerts": (["model_id", "run_id"], ["resolved"])}


class UnknownModel(LookupError):
    """The model is not registered."""


class Registry:
    """Reads and appends registry tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, name: str, rows: DataFrame) -> None:
        schema = _schema(TABLES[name])
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        writer = rows.select(*cols).write.mode("append")
        if name != "experiments":
            writer = writer.partitionBy("model_id")
        writer.parquet(f"{self.path}/{name}")

    def raw(self, name: str) -> DataFrame:
        """Every appended row; columns added later read as null."""
        schema = _schema(TABLES[name])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*schema.names)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            # known to be empty when a plan is made, so that joins with it move no rows
            return self.spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def read(self, name: str) -> DataFrame:
        """Current rows: the latest per key where rows are superseded."""
        rows = self._committed(name)
        return latest(rows, *CURRENT_ROW[name]) if name in CURRENT_ROW else rows

    def _committed(self, name: str) -> DataFrame:
        """Rows without those of a batch whose runs were never stored."""
        rows = self.raw(name)
        by = {"health": "run_id", "alerts": "by_run_id"}.get(name)
        if by is None:
            return rows
        stored = self.raw("runs").select("model_id", F.col("run_id").alias(by)).distinct()
        free = rows.where(F.col(by).isNull())
        return free.unionByName(rows.join(stored, ["model_id", by], "left_semi").select(*rows.columns))

    def _next_seq(self) -> DataFrame:
        return self.raw("health").groupBy("model_id").agg((F.max(F.coalesce("seq", F.lit(0))) + 1).alias("_seq"))

    def _append_health(self, rows: DataFrame) -> None:
        self.append("health", rows.join(self._next_seq(), "model_id", "left").withColumn("seq", F.coalesce("_seq", F.lit(1))))

    # -- actions ------------------------------------------------------------

    def register(self, models: DataFrame, baselines: DataFrame) -> None:
        """Add models (model_id, name, check_name, created_at, config) with baseline version 1; known ids are an error."""
        known = models.join(self.read("models"), "model_id", "left_semi").select("model_id").limit(1).collect()
        if known:
            raise ValueError(f"model '{known[0][0]}' is already registered")
        self.append("models", models.withColumn("current_version", F.lit(1)))
        self.append("baselines", baselines.withColumns({"version": F.lit(1), "id": F.lit(1)}))
        self.append("versions", models.select("model_id", F.lit(1).alias("id"), F.lit(1).alias("version"), "created_at", F.lit("initial registration").alias("reason")))

    def baselines(self) -> DataFrame:
        return latest_baseline(self.read("baselines"))

    def health(self) -> DataFrame:
        return current_health(self.read("health"), self.read("models"), self.read("alerts"), ["seq"])

    def record_runs(self, runs: DataFrame, warning_after: int = 1, degraded_after: int = 1, recovery_after: int = 1, buckets: int | None = None) -> DataFrame:
        """Store check results, fold health from its stored state, open and resolve alerts.

        ``runs`` has the columns of the runs table without ``version``.  All new
        runs of all models are folded in one job; runs stored before are left
        out, so a repeated batch changes nothing.  Returns the new timeline.
        """
        models = self.read("models")
        if runs.join(models, "model_id", "left_anti").limit(1).count():
            raise UnknownModel("a run belongs to a model that is not registered")
        stored = self.raw("runs").select("model_id", "run_id")
        new = runs.join(stored, ["model_id", "run_id"], "left_anti").dropDuplicates(["model_id", "run_id"])
        versioned = new.drop("version").join(models.select("model_id", F.col("current_version").alias("version")), "model_id")
        timeline = pinned(
            health_timeline(versioned, ["model_id"], ["ts", "run_id"], warning_after, degraded_after, recovery_after, initial=self.health(), buckets=buckets)
        )
        last = pinned(latest(timeline.select("model_id", "rn", "run_id", "state", "consecutive_drifted", "consecutive_clean", F.col("ts").alias("updated_at")), ["model_id"], ["rn"]))
        by = last.select("model_id", F.col("run_id").alias("by_run_id"))
        still_open = pinned(self.read("alerts").where(~F.col("resolved")).drop("by_run_id"))
        life = alert_lifecycle(timeline)
        fresh = life.join(timeline.select("model_id", "run_id", alert_message().alias("message")), ["model_id", "run_id"]).join(by, "model_id")
        self.append("alerts", fresh.withColumnRenamed("opened_at", "created_at"))
        first = timeline.where("resolves_alerts").groupBy("model_id").agg(F.min("ts").alias("_resolved_at"))
        closing = still_open.join(first, "model_id").join(by, "model_id").withColumns({"resolved": F.lit(True), "resolved_at": F.col("_resolved_at")})
        self.append("alerts", closing)
        self._append_health(last)
        self.append("runs", timeline.repartition("model_id"))
        return timeline

    def rebaseline(self, baselines: DataFrame, retrain=None) -> None:
        """New baseline for each row (model_id, data, created_at): version + 1, alerts resolved, health reset.

        ``retrain`` is called with the new rows first, as a hook for the caller's own refit.
        """
        models = self.read("models")
        if baselines.join(models, "model_id", "left_anti").limit(1).count():
            raise UnknownModel("a baseline belongs to a model that is not registered")
        if retrain is not None:
            retrain(baselines)
        bumped = pinned(
            models.join(baselines.select("model_id", "data", F.col("created_at").alias("_at")), "model_id").withColumn("current_version", F.col("current_version") + 1)
        )
        new = bumped.select("model_id", F.col("current_version").alias("version"), F.col("current_version").alias("id"), "data", F.col("_at").alias("created_at"))
        still_open = pinned(self.read("alerts").where(~F.col("resolved")).join(bumped.select("model_id", "_at"), "model_id"))
        self.append("baselines", new)
        self.append("versions", new.withColumn("reason", F.lit("retrain")))
        self.append("alerts", still_open.drop("by_run_id").withColumns({"resolved": F.lit(True), "resolved_at": F.col("_at")}))
        self._append_health(
            bumped.select("model_id", F.lit("healthy").alias("state"), F.lit(0).alias("consecutive_drifted"), F.lit(0).alias("consecutive_clean"), F.col("_at").alias("updated_at")),
        )
        self.append("models", bumped)


# -- scans ------------------------------------------------------------------


def history(runs: DataFrame, model_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest runs first; with ``limit`` a distributed top-n."""
    rows = runs if model_id is None else runs.where(F.col("model_id") == model_id)
    rows = rows.orderBy(F.desc("ts"), F.desc("run_id"))
    return rows if limit is None else rows.limit(limit)


def alerts_of(alerts: DataFrame, model_id: str | None = None, active_only: bool = False) -> DataFrame:
    """Newest alerts first; of equal times the one with the greater run_id, then model_id."""
    rows = alerts if model_id is None else alerts.where(F.col("model_id") == model_id)
    rows = rows.where(~F.col("resolved")) if active_only else rows
    return rows.orderBy(F.desc("created_at"), F.desc("run_id"), F.desc("model_id"))


def traces_of(traces: DataFrame, model_id: str | None = None, grounded: bool | None = None, limit: int = 50) -> DataFrame:
    """Filter first, then limit, so the answer is never shorter than it could be."""
    rows = traces if model_id is None else traces.where(F.col("model_id") == model_id)
    if grounded is not None:
        rows = rows.where(F.col("grounded") == grounded)
    return rows.orderBy(F.desc("created_at"), F.desc("trace_id")).limit(limit)


def experiments_of(experiments: DataFrame, kind: str | None = None) -> DataFrame:
    return experiments if kind is None else experiments.where(F.col("kind") == kind)


# -- exports ----------------------------------------------------------------


def metric_rows(runs: DataFrame, keys=("model_id", "run_id")) -> DataFrame:
    """Long ``(keys, metric, value)`` rows from runs with a ``signals`` array<struct<name,value,is_drifted>>."""
    name = lambda s: F.regexp_replace(s["name"], "[/ ]", "_")
    pair = lambda n, v: F.struct(n.alias("metric"), v.cast("double").alias("value"))
    signals = F.flatten(
        F.transform(
            "signals",
            lambda s: F.array(
                pair(F.concat(F.lit("signal."), name(s), F.lit(".value")), s["value"]),
                pair(F.concat(F.lit("signal."), name(s), F.lit(".is_drifted")), s["is_drifted"]),
            ),
        )
    )
    head = F.array(pair(F.lit("drift_score"), F.col("drift_score")), pair(F.lit("quality_score"), F.col("quality_score")))
    return runs.select(*keys, F.inline(F.concat(head, signals))).where(F.col("value").isNotNull())


def alert_outbox(alerts: DataFrame, fmt: str = "generic", source: str = "lakesignal") -> DataFrame:
    """Alerts with a JSON ``payload`` ready for a sender; sending is not done here."""
    if fmt == "slack":
        title = F.concat(F.lit(f":rotating_light: {source} alert — `"), F.col("model_id"), F.lit("` is "), F.col("health_state"))
        body = F.struct(title.alias("text"), F.array(F.struct(F.lit("#e5484d").alias("color"), F.col("message").alias("text"))).alias("attachments"))
    else:
        body = F.struct(F.lit(source).alias("source"), "model_id", "health_state", "message")
    return alerts.withColumn("payload", F.to_json(body))


def new_keys(source: DataFrame, target: DataFrame, keys) -> DataFrame:
    """Rows of ``source`` whose key is not in ``target`` yet (idempotent backfill)."""
    return source.join(target.select(*keys), list(keys), "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")


def replace_rows(existing: DataFrame, incoming: DataFrame, keys) -> DataFrame:
    """Delete-and-insert by key: all incoming rows, plus existing rows of untouched keys."""
    return existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)
