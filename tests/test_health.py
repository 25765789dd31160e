import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakesignal.plans.calibration import calibrate
from lakesignal.plans.health import alert_lifecycle, baseline_as_of, current_health, health_timeline
from lakesignal.sources.registry import Registry, UnknownModel, alert_outbox, metric_rows, replace_rows
from lakesignal.streaming.health import fold_runs

LIMITS = [(1, 1, 1), (1, 2, 2), (2, 3, 2), (3, 2, 1), (2, 4, 3)]


def run_rows(seed=4):
    r = random.Random(seed)
    sizes = {"hot": 150, "a": 20, "b": 1}
    return [(m, i, 1000 + i, r.random() < 0.55) for m, n in sizes.items() for i in range(n)]


def fold(rows, limits, start=("healthy", 0, 0)):
    """One run at a time, the state handed on, as a stream with one run per micro-batch does."""
    out, held = {}, {}
    for m, i, _, bad in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        row = tuple(fold_runs(np.array([bad]), held.get(m, start), *limits).astype(object).iloc[0])
        held[m], out[(m, i)] = row[:3], row
    return out


@pytest.mark.parametrize("limits", LIMITS)
def test_batch_size_does_not_change_the_fold(limits):
    r = random.Random(8)
    flags = [r.random() < 0.5 for _ in range(200)]
    rows = [("m", i, i, f) for i, f in enumerate(flags)]
    whole = [tuple(x) for x in fold_runs(np.array(flags), ("healthy", 0, 0), *limits).astype(object).to_numpy()]
    assert whole == [fold(rows, limits)[("m", i)] for i in range(200)]


def test_states_by_hand():
    states = lambda flags, *limits: "".join(s[0] for s in fold_runs(np.array([c == "x" for c in flags]), ("healthy", 0, 0), *limits)["state"])
    assert states("x..x...", 1, 1, 1) == "drhdrhh"
    assert states("x.xx....", 1, 2, 2) == "whwddrhh"
    assert states("xx.x..x", 2, 3, 1) == "hwhhhhh"
    assert states("xxx..x.", 2, 3, 2) == "hwddrrh"


@pytest.mark.parametrize("limits", LIMITS)
def test_timeline_equals_the_fold(spark, limits):
    rows = run_rows()
    df = spark.createDataFrame(rows, "model_id string, run_id bigint, ts bigint, is_drifted boolean")
    got = health_timeline(df, ["model_id"], ["ts", "run_id"], *limits, buckets=5).collect()
    assert {(r["model_id"], r["run_id"]): (r["state"], r["consecutive_drifted"], r["consecutive_clean"], r["opens_alert"], r["resolves_alerts"]) for r in got} == fold(rows, limits)


@pytest.mark.parametrize("start", [("degraded", 2, 0), ("recovering", 0, 1), ("warning", 1, 0), ("degraded", 0, 1)])
def test_timeline_goes_on_from_stored_health(spark, start):
    rows = run_rows(9)
    df = spark.createDataFrame(rows, "model_id string, run_id bigint, ts bigint, is_drifted boolean")
    initial = spark.createDataFrame([(m, *start) for m in ("hot", "a", "b")], "model_id string, state string, consecutive_drifted bigint, consecutive_clean bigint")
    for limits in ((1, 2, 2), (2, 3, 3)):
        got = health_timeline(df, ["model_id"], ["ts", "run_id"], *limits, initial=initial, buckets=3).collect()
        want = fold(rows, limits, start)
        assert {(r["model_id"], r["run_id"]): (r["state"], r["consecutive_drifted"], r["consecutive_clean"], r["opens_alert"], r["resolves_alerts"]) for r in got} == want


def test_alert_opens_once_and_recovery_resolves(spark):
    flags = [True, True, False, True, False, False, False, True]
    df = spark.createDataFrame([("m", i, i, f) for i, f in enumerate(flags)], "model_id string, run_id bigint, ts bigint, is_drifted boolean")
    life = {r["run_id"]: (r["resolved"], r["resolved_at"]) for r in alert_lifecycle(health_timeline(df)).collect()}
    assert life == {0: (True, 5), 7: (False, None)}


def test_calibration(spark):
    rows = [("none", 0.0), ("exact", 0.1), ("often", 0.5), ("always", 1.0)]
    got = {r["k"]: r for r in calibrate(spark.createDataFrame(rows, "k string, single_check_fpr double"), 0.01, 4).collect()}
    assert (got["none"]["recommended_consecutive"], got["none"]["capped"]) == (1, False)
    assert got["exact"]["recommended_consecutive"] == 2 and got["exact"]["capped"]  # 0.1 ** 2 is a hair above 0.01
    assert (got["often"]["recommended_consecutive"], got["often"]["capped"]) == (4, True)
    with pytest.raises(ValueError):
        calibrate(spark.createDataFrame(rows, "k string, single_check_fpr double"), 1.5)


def test_current_health_defaults(spark):
    models = spark.createDataFrame([("new",), ("open",), ("known",)], "model_id string")
    health = spark.createDataFrame([("known", "warning", 1, 0, 5), ("known", "healthy", 0, 1, 6)], "model_id string, state string, consecutive_drifted bigint, consecutive_clean bigint, updated_at bigint")
    alerts = spark.createDataFrame([("open", False), ("known", False), ("new", True)], "model_id string, resolved boolean")
    got = {r["model_id"]: (r["state"], r["consecutive_drifted"]) for r in current_health(health, models, alerts).collect()}
    assert got == {"new": ("healthy", 0), "open": ("degraded", 1), "known": ("healthy", 0)}


def test_baseline_as_of(spark):
    b = spark.createDataFrame([("m", 1, 1, 10), ("m", 2, 2, 20), ("m", 3, 2, 30), ("x", 9, 7, 0)], "model_id string, id bigint, version int, created_at bigint")
    r = spark.createDataFrame([("m", 1, 5), ("m", 2, 10), ("m", 3, 25), ("m", 4, 99)], "model_id string, run_id bigint, ts bigint")
    got = {q["run_id"]: (q["baseline_version"], q["baseline_id"]) for q in baseline_as_of(r, b, buckets=3).collect()}
    assert got == {1: (None, None), 2: (1, 1), 3: (2, 2), 4: (2, 3)}


def test_registry_round_trip(spark, tmp_path):
    reg = Registry(spark, str(tmp_path))
    at = lambda n: F.timestamp_seconds(F.lit(n))
    models = spark.createDataFrame([("m", "Model", "rag"), ("n", "Other", "llm")], "model_id string, name string, check_name string").withColumn("created_at", at(0))
    reg.register(models, models.select("model_id", F.lit("{}").alias("data"), "created_at"))
    with pytest.raises(ValueError):
        reg.register(models, models.select("model_id", F.lit("{}").alias("data"), "created_at"))

    def runs(flags, first):
        rows = [("m", first + i, bad, 0.5, None if bad else 0.9) for i, bad in enumerate(flags)]
        df = spark.createDataFrame(rows, "model_id string, run_id bigint, is_drifted boolean, drift_score double, quality_score double")
        return df.withColumn("ts", F.timestamp_seconds(F.col("run_id")))

    reg.record_runs(runs([True, True], 1))
    assert {r["model_id"]: r["state"] for r in reg.health().collect()} == {"m": "degraded", "n": "healthy"}
    alert = reg.read("alerts").collect()
    assert len(alert) == 1 and alert[0]["run_id"] == 1 and not alert[0]["resolved"]
    assert alert[0]["message"] == "Drift detected for model 'm' (v1): drift_score=0.500"
    reg.record_runs(runs([False, False, True], 3))
    state = {r["run_id"]: r["resolved"] for r in reg.read("alerts").collect()}
    assert state == {1: True, 5: False}
    calls = []
    reg.rebaseline(spark.createDataFrame([("m", "{}")], "model_id string, data string").withColumn("created_at", at(99)), retrain=lambda rows: calls.append(rows.count()))
    assert calls == [1]
    assert reg.read("alerts").where("not resolved").count() == 0
    assert {r["model_id"]: r["state"] for r in reg.health().collect()}["m"] == "healthy"
    assert {r["model_id"]: r["version"] for r in reg.baselines().collect()} == {"m": 2, "n": 1}
    assert reg.read("runs").count() == 5 and reg.read("versions").count() == 3
    with pytest.raises((UnknownModel, PySparkException)):
        reg.record_runs(runs([True], 9).withColumn("model_id", F.lit("ghost")))


def test_exports(spark):
    runs = spark.createDataFrame([("m", 1, 0.2, None, [("refusal rate/x", 0.5, True)])], "model_id string, run_id bigint, drift_score double, quality_score double, signals array<struct<name:string,value:double,is_drifted:boolean>>")
    assert {r["metric"]: r["value"] for r in metric_rows(runs).collect()} == {"drift_score": 0.2, "signal.refusal_rate_x.value": 0.5, "signal.refusal_rate_x.is_drifted": 1.0}
    alerts = spark.createDataFrame([("m", "degraded", "text")], "model_id string, health_state string, message string")
    assert alert_outbox(alerts, "slack").first()["payload"].startswith('{"text":":rotating_light: ')
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, replace_rows(old, spark.createDataFrame([(2, "c")], "id int, v string"), ["id"]).collect())) == [(1, "a"), (2, "c")]


def _registered(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    models = spark.sql("select 'm' as model_id, 'n' as name, 'tabular' as check_name, timestamp_seconds(1) as created_at, '{}' as config")
    registry.register(models, spark.sql("select 'm' as model_id, 'b1' as data, timestamp_seconds(1) as created_at"))
    runs = "select 'm' as model_id, {} as run_id, timestamp_seconds({}) as ts, 0.5D as drift_score, 0.5D as quality_score, {} as is_drifted, '[]' as signals, '{{}}' as statistics"
    return registry, lambda *rows: spark.sql(" union all ".join(runs.format(*r) for r in rows))


def _state(registry):
    return registry.health().select("state", "consecutive_drifted").first()


def test_a_rebaseline_dated_before_the_runs_is_not_lost(spark, tmp_path):
    registry, runs = _registered(spark, tmp_path)
    registry.record_runs(runs((1, 100, "true"), (2, 200, "true")), buckets=1)
    assert tuple(_state(registry)) == ("degraded", 2)
    registry.rebaseline(spark.sql("select 'm' as model_id, 'b2' as data, timestamp_seconds(50) as created_at"))
    assert tuple(_state(registry)) == ("healthy", 0) and registry.read("alerts").where("not resolved").count() == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    registry, runs = _registered(spark, tmp_path)
    batch = runs((1, 100, "true"), (2, 200, "true"))
    registry.record_runs(batch, buckets=1)
    assert registry.record_runs(batch, buckets=1).count() == 0
    assert registry.raw("runs").count() == 2 and tuple(_state(registry)) == ("degraded", 2)


def test_a_batch_without_its_runs_does_not_count(spark, tmp_path):
    registry, runs = _registered(spark, tmp_path)
    registry.append("health", spark.sql("select 'm' as model_id, 'degraded' as state, 7 as consecutive_drifted, 0 as consecutive_clean, timestamp_seconds(9) as updated_at, 77 as run_id, 1 as seq"))
    registry.append("alerts", spark.sql("select 'm' as model_id, 77 as run_id, timestamp_seconds(9) as created_at, 'x' as message, false as resolved, 77 as by_run_id"))
    assert tuple(_state(registry)) == ("healthy", 0) and registry.read("alerts").count() == 0
