"""Checks of every kind from stored baselines: what each model's ``check_name`` asks for, all models in one job.

A baseline is kept in the registry as state that can be added to, not as rows to be read again:

* ``baseline_values``: how often a feature has a value; equal values of later batches add up.  Distribution tests and
  percentiles need no more.
* ``baseline_answers``: the golden set
* ``baseline_vectors``: embeddings, which a permutation test needs one by one
* ``data`` of the baselines table: counts and rates as JSON

State carries the version it was stored for; readers take a model's current one, so a new baseline never mixes with an old
one.  Each kind turns new rows into runs with signals; ``Registry.record_runs`` then folds the health of all kinds at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.operators.detector import BASELINE, CURRENT
from lakesignal.operators.numeric_drift import ranked_counts, summary_of, weighted_counts
from lakesignal.operators.tfidf import pair_similarity_by
from lakesignal.plans import rag_check, tabular_check
from lakesignal.plans.golden_check import golden_verdict, match_golden
from lakesignal.plans.health import alert_message
from lakesignal.plans.run_check import METRICS, Checked, NoBaseline, telemetry_baselines
from lakesignal.plans.telemetry_check import telemetry_metrics, telemetry_signals, telemetry_verdict
from lakesignal.scale import pinned
from lakesignal.sources.registry import Registry, alert_outbox, metric_rows

RUN = ["model_id", "run_id"]
COUNTS = "events bigint, grounded bigint, valid bigint, requested bigint"
SIGNAL = "array<struct<name:string,value:double,is_drifted:boolean>>"


def _event_counts(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, events, grounded, valid, requested): what the two rate tests of a retrieval check need."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.coalesce("grounded", F.lit(False))).alias("grounded"),
        F.sum(F.coalesce("citations", F.lit(0)).cast("bigint")).alias("valid"),
        F.sum(F.coalesce("citations_requested", F.lit(0)).cast("bigint")).alias("requested"),
    )


def _values(long: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "feature", F.col("value").cast("double").alias("value")).agg(n.alias("n"))


def _pooled(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rag_check.pooled_samples(events.withColumn("sample", F.lit(CURRENT)), keys).select(*keys, F.col("signal").alias("feature"), "value")


def _vectors(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    held = events.where(F.size("question_embedding") > 0)
    return held.select(*keys, F.col("event_id").cast("string").alias("id"), F.col("question_embedding").cast("array<double>").alias("embedding"))


def baseline_data(check_name: str, rows: DataFrame) -> DataFrame:
    """(model_id, data): the JSON part of a baseline, for ``Registry.register`` or ``rebaseline``.

    Pinned, a row per model: the registry reads it for several tables, and the rows are read for it once.
    """
    if check_name == "live_telemetry":
        return telemetry_baselines(rows)
    if check_name == "rag":
        return pinned(_event_counts(rows, ["model_id"]).select("model_id", F.to_json(F.struct("events", "grounded", "valid", "requested")).alias("data")))
    if check_name in ("classifier", "llm"):
        return pinned(rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("rows")).select("model_id", F.to_json(F.struct("rows")).alias("data")))
    raise KeyError(f"unknown check '{check_name}'")


def store_state(registry: Registry, check_name: str, rows: DataFrame) -> None:
    """Append the rest of a baseline for the models' current version; a further batch of rows adds to it.

    ``rows`` by kind: classifier (model_id, feature, value); llm (model_id, prompt, expected_answer, position); rag
    telemetry events with model_id.
    """
    version = registry.read("models").select("model_id", F.col("current_version").alias("version"))
    put = lambda name, df: registry.append(name, df.join(version, "model_id"))
    if check_name == "classifier":
        put("baseline_values", _values(rows, ["model_id"]))
    elif check_name == "llm":
        put("baseline_answers", rows.select("model_id", "prompt", "expected_answer", "position"))
    elif check_name == "rag":
        put("baseline_values", _values(_pooled(rows, ["model_id"]), ["model_id"]))
        put("baseline_vectors", _vectors(rows, ["model_id"]))
    elif check_name != "live_telemetry":
        raise KeyError(f"unknown check '{check_name}'")


def _state(registry: Registry, name: str, models: DataFrame) -> DataFrame:
    """Rows of the models' current version."""
    wanted = models.select("model_id", F.col("current_version").alias("version"))
    return registry.raw(name).join(wanted, ["model_id", "version"], "left_semi").drop("version")


def _both(stored: DataFrame, new: DataFrame, runs: DataFrame) -> DataFrame:
    """Stored rows repeated for each run of their model, beside the new rows."""
    return stored.join(runs.select(*RUN), "model_id").withColumn("sample", F.lit(BASELINE)).unionByName(new.withColumn("sample", F.lit(CURRENT)))


def _with_signals(verdict: DataFrame, signals: DataFrame) -> DataFrame:
    """(model_id, run_id, drift_score, quality_score, is_drifted, signals) with the signals as a sorted array."""
    held = signals.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct(F.col("name"), F.col("value").cast("double").alias("value"), F.coalesce("is_drifted", F.lit(False)).alias("is_drifted")))).alias("signals"))
    return verdict.select(*RUN, "drift_score", F.col("quality_score").cast("double").alias("quality_score"), "is_drifted").join(held, RUN)


def classifier_runs(registry: Registry, models: DataFrame, rows: DataFrame, alpha: float = 0.05, buckets: int | None = None) -> DataFrame:
    """KS per feature against the stored value counts; quality is the share of right predictions where there are any.

    Rows may come counted, with their number in ``_n``.
    """
    weight = "_n" if "_n" in rows.columns else None
    runs = rows.select(*RUN).distinct()
    counts = _both(_state(registry, "baseline_values", models), _values(rows, RUN, weight), runs)
    by = [*RUN, "feature"]
    signals = pinned(tabular_check.signals_of(summary_of(ranked_counts(weighted_counts(counts, by, buckets), by), by), RUN, alpha=alpha))
    verdict = tabular_check.tabular_verdict(signals, RUN)
    if "prediction" in rows.columns:
        verdict = verdict.join(tabular_check.accuracy(rows, RUN, "prediction", "label", weight), RUN, "left")
    else:
        verdict = verdict.withColumn("quality_score", F.lit(None).cast("double"))
    return _with_signals(verdict, signals.select(*RUN, F.col("feature").alias("name"), F.col("statistic").alias("value"), "is_drifted"))


def golden_runs(registry: Registry, models: DataFrame, rows: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Similarity of answers (model_id, run_id, prompt, actual_answer) to the stored golden set, a model per run."""
    golden = _state(registry, "baseline_answers", models)
    keyed = lambda df: df.withColumn("prompt", F.struct("model_id", "prompt"))
    matched = match_golden(keyed(golden), keyed(rows)).withColumn("prompt", F.col("prompt.prompt"))
    scored = pinned(pair_similarity_by(matched, RUN, ["prompt"], "expected_answer", "actual_answer"))
    signals = scored.select(*RUN, F.left("prompt", F.lit(80)).alias("name"), F.col("similarity").alias("value"), (F.col("similarity") < threshold).alias("is_drifted"))
    return _with_signals(golden_verdict(signals, RUN, threshold), signals)


def telemetry_runs(registry: Registry, models: DataFrame, rows: DataFrame, limits: dict | None = None, buckets: int | None = None) -> DataFrame:
    """Rates and latency of events against the stored metrics."""
    kept = registry.baselines().join(models, "model_id", "left_semi").select("model_id", F.from_json("data", METRICS).alias("m")).select("model_id", "m.*")
    current = pinned(telemetry_metrics(rows, RUN, buckets=buckets))
    signals = pinned(telemetry_signals(current.select(*RUN).join(kept, "model_id"), current, RUN, **(limits or {})).drop("n_events"))
    return _with_signals(telemetry_verdict(signals, RUN), signals)


def rag_runs(registry: Registry, models: DataFrame, rows: DataFrame, alpha: float = 0.05, min_events: int = 8, permutations: int = 200, buckets: int | None = None) -> DataFrame:
    """The five signals of a retrieval application from stored counts, values and vectors."""
    runs = pinned(_event_counts(rows, RUN))
    names = ["events", "grounded", "valid", "requested"]
    kept = registry.baselines().join(models, "model_id", "left_semi").select("model_id", F.from_json("data", COUNTS).alias("m")).select("model_id", *[F.col(f"m.{c}").alias(f"b_{c}") for c in names])
    counts = runs.select(*RUN, *[F.col(c).alias(f"c_{c}") for c in names]).join(kept, "model_id")
    by = [*RUN, "feature"]
    values = _both(_state(registry, "baseline_values", models), _values(_pooled(rows, RUN), RUN), runs)
    summary = summary_of(ranked_counts(weighted_counts(values, by, buckets), by), by).withColumnRenamed("feature", "signal")
    vectors = _both(_state(registry, "baseline_vectors", models), _vectors(rows, RUN), runs)
    signals = pinned(rag_check.signals_of(counts, summary, vectors, RUN, alpha, min_events, permutations, "features"))
    quality = rows.withColumn("sample", F.lit(CURRENT))
    return _with_signals(rag_check.rag_verdict(signals, quality, RUN), signals)


#: What a kind reads of its rows beside model_id, run_id and ts.
READS = {
    "classifier": ("feature", "value", "prediction", "label"),
    "llm": ("prompt", "actual_answer"),
    "live_telemetry": ("grounded", "citations", "latency_ms"),
    "rag": ("event_id", "grounded", "citations", "citations_requested", "retrieval_scores", "generation_latency_ms", "question_embedding"),
}


def _read(kind: str, rows: DataFrame) -> DataFrame:
    """What a kind reads of its rows; a classifier's rows are counted (``_n``), as it asks only how often a value comes."""
    if kind not in READS:
        return rows
    kept = rows.select(*[c for c in rows.columns if c.lower() in (*RUN, "ts", *READS[kind])])
    if kind != "classifier":
        return kept
    return kept.groupBy(*[c for c in kept.columns if c.lower() != "ts"]).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("_n"))


KINDS = {"classifier": classifier_runs, "llm": golden_runs, "live_telemetry": telemetry_runs, "rag": rag_runs}


def run_stored_checks(
    registry: Registry, inputs: Mapping[str, DataFrame], options: Mapping[str, dict] | None = None, health_limits: tuple[int, int, int] = (1, 1, 1), buckets: int | None = None
) -> Checked:
    """Check the new runs of all models by the kind each is registered with, record them and fold their health.

    ``inputs`` maps a kind to its rows, with model_id, run_id and ts.  Rows of models of another kind are an error, and
    so is a model without a baseline.  A run that is stored already is not checked again.
    """
    models = pinned(registry.read("models").select("model_id", "check_name", "current_version"))
    stored = registry.raw("runs").select(*RUN)
    based = registry.baselines().select("model_id")
    out, times = None, None
    for kind, rows in inputs.items():
        if kind not in KINDS:
            raise KeyError(f"unknown check '{kind}', known: {', '.join(sorted(KINDS))}")
        own = models.where(F.col("check_name") == kind)
        new = pinned(_read(kind, rows.join(stored, RUN, "left_anti")))  # read several times by every kind
        at = pinned(new.groupBy(*RUN).agg(F.max("ts").alias("ts")))  # a row per run, enough to look for its model
        stranger = at.join(own, "model_id", "left_anti").select("model_id").limit(1).collect()
        if stranger:
            raise LookupError(f"model '{stranger[0][0]}' is not registered with the check '{kind}'")
        bare = at.join(based, "model_id", "left_anti").select("model_id").limit(1).collect()
        if bare:
            raise NoBaseline(f"model '{bare[0][0]}' has no baseline")
        found = KINDS[kind](registry, own, new.drop("ts"), **(options or {}).get(kind, {}))
        out, times = (found, at) if out is None else (out.unionByName(found), times.unionByName(at))
    runs = pinned(out.join(times, RUN))
    by_name: Column = F.to_json("signals")
    rows = runs.select(*RUN, "ts", "drift_score", "quality_score", "is_drifted", by_name.alias("signals"), F.lit("{}").alias("statistics"))
    timeline = registry.record_runs(rows, *health_limits, buckets=buckets)
    opened = timeline.where("opens_alert").select(*RUN, F.col("state").alias("health_state"), alert_message().alias("message"))
    recorded = runs.join(timeline.select(*RUN), RUN, "left_semi")
    return Checked(timeline, runs.select(*RUN, F.inline("signals")), metric_rows(recorded), alert_outbox(opened))
