import random

import pytest
from pyspark.sql import functions as F

from lakesignal.sources import datasets
from lakesignal.sources.files import validate_files
from lakesignal.sources.telemetry import append_events, read_events, record_events, stream_events
from lakesignal.streaming.health import OUTPUT, replayed_health, start_health, stream_health
from lakesignal.streaming.retention import STATE_STORE, buffer_of, newest_per_key, pruned, stream_newest
from lakesignal.streaming.telemetry import micro_batches, start_micro_batches, start_trace_forwarding, windowed_metrics
from tests.test_health import fold, run_rows


def events(spark, n=60, seed=0):
    r = random.Random(seed)
    rows = [(i, r.random() < 0.7, r.randrange(3), round(r.random() * 100, 3), f"t{i:03d}", "{}" if i % 4 == 0 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, grounded boolean, citations int, latency_ms double, trace_id string, full_trace string")
    return df.withColumn("at", F.timestamp_seconds(F.col("i") * 300)).drop("i")


def test_recording_and_reading_back(spark, tmp_path):
    df = spark.createDataFrame([(1.26, [0.123456, 0.5], None)], "latency_ms double, retrieval_scores array<double>, question_embedding array<double>")
    r = record_events(df).first()
    assert r["latency_ms"] == 1.3 and r["retrieval_scores"] == [0.1235, 0.5] and r["question_embedding"] == []
    append_events(events(spark, 5), str(tmp_path / "e"))
    assert read_events(spark, str(tmp_path / "e")).count() == 5


def test_windows_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    events(spark).repartition(1).write.parquet(src)
    batch = windowed_metrics(events(spark), at="at", width="1 hour")
    stream = windowed_metrics(stream_events(spark, src), at="at", width="1 hour", watermark="10 minutes", percentile="sketch")
    q = stream.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((str(r["window_start"]), r["n_events"], round(r["refusal_rate"], 9), r["latency_p95_ms"]) for r in df.collect())
    sketched = windowed_metrics(events(spark), at="at", width="1 hour", percentile="sketch")
    assert key(spark.table("win")) == key(sketched) and len(key(batch)) == 5
    latencies = {}
    for r in events(spark).collect():
        latencies.setdefault(r["at"].replace(minute=0, second=0), []).append(r["latency_ms"])
    rank = lambda n: max(1, min(n, round(0.95 * n + 0.5)))
    assert {r["window_start"]: r["latency_p95_ms"] for r in batch.collect()} == {w: sorted(v)[rank(len(v)) - 1] for w, v in latencies.items()}


def test_exact_windows_stream_equals_batch(spark, tmp_path):
    """Closed windows only: a last event far ahead closes the others, a late one is left out."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    keyed = lambda df: df.withColumn("g", F.when(F.col("citations") > 0, "a"))  # noqa: E731 (null is a key too)
    rows = keyed(events(spark, 60))
    rows.coalesce(1).write.mode("append").parquet(src)
    far = rows.limit(1).withColumn("at", F.expr("timestamp'1980-01-01'"))
    for extra in (far, rows.limit(1), far.withColumn("at", F.expr("timestamp'1981-01-01'"))):
        extra.coalesce(1).write.mode("append").parquet(src)
    stream = windowed_metrics(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src), ["g"], watermark="1 minute")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    key = lambda df: sorted(map(str, df.where("window_start < '1979-01-01'").collect()))
    assert key(spark.read.parquet(out)) == key(windowed_metrics(rows, ["g"])) and len(key(windowed_metrics(rows, ["g"]))) > 5


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_retention_over_a_restart(spark, tmp_path, state_store):
    src, out, cp = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), t * 10 + rng.randrange(8), f"e{t:04d}") for t in range(400)] + [("idle", 5, "x"), ("idle", 7, "y")]
    df = spark.createDataFrame(rows, "k string, t int, event_id string").select("k", F.timestamp_seconds("t").alias("at"), "event_id")

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = stream_newest(stream, "k", 12, idle_seconds=600, watermark="1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
        q = q.outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    first = F.unix_timestamp("at") < 1000
    df.where(first).coalesce(1).write.mode("append").parquet(src)
    run()
    for lo, hi in ((1000, 2500), (2500, 5000)):
        df.where((F.unix_timestamp("at") >= lo) & (F.unix_timestamp("at") < hi)).coalesce(1).write.mode("append").parquet(src)
    held = run()  # goes on from the checkpoint
    changes = spark.read.parquet(out)
    got = sorted(map(tuple, buffer_of(changes, "k").collect()), key=repr)
    assert got == sorted(map(tuple, newest_per_key(df.where("k is null or k <> 'idle'"), "k", 12).collect()), key=repr)
    assert changes.where("change = 'expired'").select("k", "event_id").orderBy("event_id").collect() == [("idle", "x"), ("idle", "y")]
    assert changes.agg(F.max("n_held")).first()[0] == 12 and held <= 3 * 12 + 10
    assert changes.groupBy("k", "event_id", "change").count().where("count > 1").count() == 0


def test_pruning_keeps_the_newest(spark):
    df = spark.range(5000).select((F.col("id") % 2).cast("string").alias("k"), F.timestamp_seconds("id").alias("at"), F.col("id").cast("string").alias("event_id"))
    few = pruned(df.repartition(4), "k", 5)
    assert few.count() < 200 and sorted(map(tuple, newest_per_key(few, "k", 5).collect())) == sorted(map(tuple, newest_per_key(df, "k", 5).collect()))


@pytest.mark.parametrize("limits", [(1, 1, 1), (2, 3, 2)])
def test_replayed_health_equals_the_whole_timeline(spark, tmp_path, limits):
    rows = run_rows(5)
    df = spark.createDataFrame(rows, "model_id string, run_id bigint, ts bigint, is_drifted boolean")
    cuts = [(0, 3), (3, 40), (40, 41), (41, 999)]
    pick = lambda t: {(r["model_id"], r["run_id"]): (r["state"], r["consecutive_drifted"], r["consecutive_clean"], r["opens_alert"], r["resolves_alerts"]) for r in t.collect()}
    parts = [df.where((F.col("run_id") >= lo) & (F.col("run_id") < hi)) for lo, hi in cuts]
    assert pick(replayed_health(parts, limits)) == fold(rows, limits)
    if limits == (1, 1, 1):
        return
    src, folder, cp = str(tmp_path / "runs"), str(tmp_path / "health"), str(tmp_path / "cp")
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(src)
    run = lambda: start_health(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), folder, cp, limits).awaitTermination(240)
    run()
    for part in parts[2:]:
        part.coalesce(1).write.mode("append").parquet(src)
    run()
    assert pick(spark.read.parquet(f"{folder}/timeline")) == fold(rows, limits)


def test_micro_batches(spark, tmp_path):
    numbered = micro_batches(events(spark, 23), ["at", "trace_id"], 5, buckets=3)
    got = {r["batch_no"]: (r["n"], r["c"]) for r in numbered.groupBy("batch_no").agg(F.count("*").alias("n"), F.max("complete").alias("c")).collect()}
    assert got == {0: (5, True), 1: (5, True), 2: (5, True), 3: (5, True), 4: (3, False)}
    src = str(tmp_path / "src")
    for k in range(4):  # four files of three events
        events(spark, 12).where(F.col("trace_id").between(f"t{3 * k:03d}", f"t{3 * k + 2:03d}")).coalesce(1).write.mode("append").parquet(src)
    seen = []
    q = start_micro_batches(stream_events(spark, src, files_per_trigger=1), str(tmp_path / "held"), str(tmp_path / "cp"), lambda rows, no: seen.append((no, rows.count())), 5)
    q.awaitTermination(120)
    assert seen == [(0, 6), (1, 6)]
    out = str(tmp_path / "traces")
    start_trace_forwarding(stream_events(spark, src), "app", out, str(tmp_path / "cp2")).awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(out).select("trace_id").collect()) == ["t000", "t004", "t008"]


def test_health_stream_equals_batch(spark, tmp_path):
    rows, src = run_rows(2), str(tmp_path / "runs")
    df = spark.createDataFrame(rows, "model_id string, run_id bigint, ts bigint, is_drifted boolean")
    for lo, hi in ((0, 40), (40, 90), (90, 999)):
        df.where((F.col("run_id") >= lo) & (F.col("run_id") < hi)).coalesce(1).write.mode("append").parquet(src)
    # one file per trigger, in the order they were written
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    stream_health(stream, 1, 2, 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    got = {(r["model_id"], r["run_id"]): (r["state"], r["consecutive_drifted"], r["consecutive_clean"], r["opens_alert"], r["resolves_alerts"]) for r in spark.read.schema(OUTPUT).parquet(out).collect()}
    assert got == fold(rows, (1, 2, 2))


def test_files_and_datasets(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"hello", "c.tif": b"MM\x00*x", "d.bmp": b"", "e.txt": b"any", "f.png": b"\x89PNG\r\n\x1a\nx", "g.txt": b"x" * 1100000}.items():
        (up / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["accepted"], r["reason"]) for r in validate_files(spark, str(up), max_mb=1).collect()}
    assert {k for k, v in got.items() if v[0]} == {"a.pdf", "c.tif", "e.txt", "f.png"}
    assert got["b.pdf"][1] == "file content doesn't match a valid .pdf file (failed signature check)" and got["g.txt"][1] == "file is 1.0MB, exceeding the 1MB limit"
    src = tmp_path / "src"
    src.mkdir()
    (src / "x.json").write_text('{"doc_id": "1"}\n{"doc_id": "2"}\nbroken\n{"doc_id": "3"}\n')
    raw = datasets.read_raw_json(spark, str(src), "doc_id string")
    plan = datasets.backfill_plan(raw, spark.createDataFrame([("2",)], "doc_id string"), "doc_id")
    assert tuple(datasets.backfill_counts(plan).first()) == (2, 1, 1)
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "group_id string")
    assert {r[0]: r[1] for r in datasets.pending_groups(groups, spark.createDataFrame([("a",)] * 4 + [("b",)], "group_id string"), 4).collect()} == {"b": 3, "c": 4}
    cases = spark.createDataFrame([("dir/Lease v1.pdf", 2), ("dir/Lease v1.pdf", 1), ("x.pdf", 1)], "doc string, n int")
    assert sorted(r["id"] for r in datasets.numbered_cases(cases, "doc", ["n"]).collect()) == ["Lease v1-01", "Lease v1-02", "x-01"]
