"""Checks of all kinds from stored baselines."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lakesignal.operators.numeric_drift import distance_summary, ranked_counts, summary_of, weighted_counts
from lakesignal.operators.tfidf import pair_similarity, pair_similarity_by
from lakesignal.plans import stored_checks
from lakesignal.plans.run_check import NoBaseline
from lakesignal.plans.stored_checks import baseline_data, run_stored_checks, store_state
from lakesignal.sources.registry import TABLES, Registry, _schema


def registered(spark, tmp_path, kinds):
    reg = Registry(spark, str(tmp_path / uuid.uuid4().hex))
    for kind, rows in kinds.items():
        data = baseline_data(kind, rows).withColumn("created_at", F.timestamp_seconds(F.lit(0)))
        reg.register(data.select("model_id", F.col("model_id").alias("name"), F.lit(kind).alias("check_name"), "created_at", F.lit("{}").alias("config")), data)
        store_state(reg, kind, rows)
    return reg


def features(spark, model, run, values):
    return spark.createDataFrame([(model, run, "x", float(v)) for v in values], "model_id string, run_id long, feature string, value double").withColumn("ts", F.timestamp_seconds("run_id"))


def test_weighted_counts_equal_rows(spark):
    rng = random.Random(1)
    rows = [(k, s, float(rng.randrange(30))) for k in "ab" for s in ("baseline", "current") for _ in range(200)]
    long = spark.createDataFrame(rows, "k string, sample string, value double")
    counts = long.groupBy("k", "sample", "value").agg(F.count(F.lit(1)).alias("n"))
    split = counts.withColumn("n", F.floor(F.col("n") / 2)).unionByName(counts.withColumn("n", F.col("n") - F.floor(F.col("n") / 2)))
    got = summary_of(ranked_counts(weighted_counts(split, ["k"], 3), ["k"]), ["k"]).orderBy("k").collect()
    assert [tuple(round(float(x), 9) if not isinstance(x, str) else x for x in r) for r in got] == [tuple(round(float(x), 9) if not isinstance(x, str) else x for x in r) for r in distance_summary(long, ["k"]).orderBy("k").collect()]


def test_similarity_by_key_fits_each_key_alone(spark):
    rows = [("r1", 1, "red blue green", "red blue"), ("r1", 2, "blue sky", "green sky"), ("r2", 1, "red blue green", "red blue"), ("r2", 2, "", "x yy"), ("r2", 3, None, None)]
    pairs = spark.createDataFrame(rows, "run string, i int, l string, r string")
    got = {(r["run"], r["i"]): round(r["similarity"], 9) for r in pair_similarity_by(pairs, ["run"], ["i"], "l", "r").collect()}
    for run in ("r1", "r2"):
        alone = pair_similarity(pairs.where(F.col("run") == run), ["i"], "l", "r").collect()
        assert {(run, r["i"]): round(r["similarity"], 9) for r in alone} == {k: v for k, v in got.items() if k[0] == run}


def test_models_are_checked_by_their_kind(spark, tmp_path):
    rng = random.Random(2)
    base = features(spark, "m", 0, [rng.gauss(0, 1) for _ in range(150)]).drop("run_id", "ts")
    golden = spark.createDataFrame([("g", f"p{i}", f"answer number {i} about rent", i) for i in range(4)], "model_id string, prompt string, expected_answer string, position long")
    reg = registered(spark, tmp_path, {"classifier": base, "llm": golden})
    new = features(spark, "m", 1, [rng.gauss(0, 1) for _ in range(100)]).unionByName(features(spark, "m", 2, [rng.gauss(3, 1) for _ in range(100)]))
    new = new.withColumn("prediction", F.lit(1)).withColumn("label", F.when(F.col("run_id") == 1, 1).otherwise(F.lit(None)))
    answers = [("g", 5, f"p{i}", f"answer number {i} about rent") for i in range(4)] + [("g", 6, f"p{i}", "nothing alike") for i in range(4)]
    asked = spark.createDataFrame(answers, "model_id string, run_id long, prompt string, actual_answer string").withColumn("ts", F.timestamp_seconds("run_id"))
    out = run_stored_checks(reg, {"classifier": new, "llm": asked})
    got = {(r["model_id"], r["run_id"]): (r["is_drifted"], r["quality_score"] and round(r["quality_score"], 6), r["state"]) for r in out.timeline.collect()}
    assert got == {("m", 1): (False, 1.0, "healthy"), ("m", 2): (True, None, "degraded"), ("g", 5): (False, 1.0, "healthy"), ("g", 6): (True, 0.0, "degraded")}
    assert {r["model_id"] for r in out.outbox.collect()} == {"m", "g"} and out.metrics.where("metric = 'signal.x.value'").count() == 2
    assert run_stored_checks(reg, {"classifier": new, "llm": asked}).timeline.count() == 0  # stored runs are left alone
    stored = reg.raw("baseline_values").agg(F.sum("n")).first()[0]
    assert stored == 150
    # a new baseline is another version: the old state no longer counts, a further batch adds to the new one
    later = features(spark, "m", 0, [rng.gauss(3, 1) for _ in range(120)]).drop("run_id", "ts")
    reg.rebaseline(baseline_data("classifier", later).withColumn("created_at", F.timestamp_seconds(F.lit(50))))
    for part in later.randomSplit([0.5, 0.5], 1):
        store_state(reg, "classifier", part)
    moved = run_stored_checks(reg, {"classifier": features(spark, "m", 60, [rng.gauss(3, 1) for _ in range(100)])})
    assert [(r["is_drifted"], r["version"], r["state"]) for r in moved.timeline.collect()] == [(False, 2, "healthy")]


def test_what_cannot_be_checked(spark, tmp_path):
    base = features(spark, "m", 0, range(50)).drop("run_id", "ts")
    reg = registered(spark, tmp_path, {"classifier": base})
    with pytest.raises(KeyError):
        run_stored_checks(reg, {"weather": base})
    with pytest.raises(KeyError):
        baseline_data("weather", base)
    with pytest.raises(LookupError, match="not registered with the check"):
        run_stored_checks(reg, {"llm": features(spark, "m", 1, [1])})
    reg.append("models", spark.createDataFrame([("bare", "bare", "classifier", 1)], "model_id string, name string, check_name string, current_version int"))
    with pytest.raises(NoBaseline):
        run_stored_checks(reg, {"classifier": features(spark, "bare", 1, [1])})


def test_rows_are_read_once_and_counts_are_kept(spark, tmp_path, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x

    seen = seen.asNondeterministic()  # not to be copied by the optimizer

    def rows(run):
        n = spark.range(600).select(F.lit("m").alias("model_id"), F.lit(run).cast("bigint").alias("run_id"), F.lit("x").alias("feature"), (F.col("id") % 5).cast("double").alias("value"), F.col("id").alias("other"))
        return n.withColumn("value", seen("value"))

    reg = Registry(spark, str(tmp_path / uuid.uuid4().hex))
    data = baseline_data("classifier", rows(0).where("value >= 0")).withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    reg.register(data.select("model_id", F.col("model_id").alias("name"), F.lit("classifier").alias("check_name"), "created_at", F.lit("{}").alias("config")), data)
    assert read.value == 600  # once for each table of the registry before
    store_state(reg, "classifier", rows(0))
    sizes, keep = [], stored_checks.pinned
    monkeypatch.setattr(stored_checks, "pinned", lambda df: sizes.append((out := keep(df)).count()) or out)
    before = read.value
    out = run_stored_checks(reg, {"classifier": rows(1).withColumn("ts", F.timestamp_seconds(F.col("other")))})
    assert read.value - before == 600 and max(sizes) == 5  # all 600 rows were written before
    got = out.timeline.select("model_id", "run_id", "is_drifted", F.unix_timestamp("ts").alias("ts")).collect()
    assert [tuple(r) for r in got] == [("m", 1, False, 599)]


def test_counted_rows_have_the_quality_of_rows(spark, tmp_path):
    reg = registered(spark, tmp_path, {"classifier": features(spark, "m", 0, range(40)).drop("run_id", "ts")})
    rng = random.Random(4)
    told = [("m", run, "x", rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for run in (1, 2, 3) for _ in range(90)]
    told += [("m", 4, "x", float(v), 1, None) for v in range(20)] + [("m", 5, "x", None, 1, 1)]  # without labels; without values
    rows = spark.createDataFrame(told, "model_id string, run_id long, feature string, value double, prediction int, label int").withColumn("ts", F.timestamp_seconds("run_id"))
    got = {r["run_id"]: r["quality_score"] for r in run_stored_checks(reg, {"classifier": rows}).timeline.collect()}
    wanted = {}
    for run in (1, 2, 3, 4):
        labelled = [(p, y) for _, r, _, _, p, y in told if r == run and y is not None]
        wanted[run] = sum(p == y for p, y in labelled) / len(labelled) if labelled else None
    assert got == wanted


def test_joins_with_a_table_not_yet_written_move_no_rows(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "none"))
    runs = reg.raw("runs")
    assert runs.count() == 0 and [(f.name, f.dataType) for f in runs.schema] == [(f.name, f.dataType) for f in _schema(TABLES["runs"])]
    new = spark.range(10).select(F.lit("m").alias("model_id"), F.col("id").alias("run_id")).join(runs.select("model_id", "run_id"), ["model_id", "run_id"], "left_anti")
    assert new.count() == 10 and "Join" not in new._jdf.queryExecution().optimizedPlan().toString()
