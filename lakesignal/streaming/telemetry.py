"""Telemetry streams: windowed metrics, count-based micro-batches, trace forwarding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakesignal.functions.stats import nearest_rank
from lakesignal.operators.numeric_drift import nearest_rank_percentile
from lakesignal.scale import numbered
from lakesignal.sources.telemetry import traced


def windowed_metrics(
    events: DataFrame,
    keys: Sequence[str] = (),
    at: str = "at",
    width: str = "1 hour",
    slide: str | None = None,
    watermark: str | None = "10 minutes",
    percentile: str = "exact",
) -> DataFrame:
    """Refusal rate, citation rate, p95 latency and count per event-time window.

    Works on a batch table and on a stream; on a stream rows later than the
    watermark are dropped.  The percentile is the nearest rank with
    ``percentile="exact"``, and a mergeable sketch with "sketch".

    The exact one works on counts per distinct value.  On a stream these counts
    are the state, a window is given out once it is closed (append mode), and
    its distinct values then meet in one row; the sketch also suits the other
    output modes.
    """
    if percentile not in ("exact", "sketch"):
        raise ValueError(f"unknown percentile {percentile}")
    rows = events.withWatermark(at, watermark) if watermark and events.isStreaming else events
    span = F.window(at, width, slide) if slide else F.window(at, width)
    slim = rows.select(
        span.alias("window"),
        *keys,
        (~F.coalesce("grounded", F.lit(False))).cast("long").alias("refused"),
        (F.coalesce("citations", F.lit(0)) > 0).cast("long").alias("cited"),
        F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)).alias("latency"),
    )
    rates = [(F.sum("refused") / F.sum("n")).alias("refusal_rate"), (F.sum("cited") / F.sum("n")).alias("citation_rate"), F.sum("n").alias("n_events")]
    names = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "refusal_rate", "citation_rate", "latency_p95_ms", "n_events"]
    if percentile == "sketch":
        sketch = F.percentile_approx("latency", 0.95, 10_000).alias("latency_p95_ms")
        return slim.withColumn("n", F.lit(1).cast("long")).groupBy("window", *keys).agg(*rates, sketch).select(*names)
    if not events.isStreaming:
        named = slim.withColumn("_group", F.to_json(F.struct("window", *keys))).withColumn("n", F.lit(1).cast("long"))  # one key that is never null
        held = named.groupBy("_group", "window", *keys).agg(*rates)
        return held.join(nearest_rank_percentile(named, ["_group"], "latency", 95, "latency_p95_ms").drop("n"), "_group").select(*names)
    counted = slim.groupBy("window", *keys, "latency").agg(F.count(F.lit(1)).alias("n"), F.sum("refused").alias("refused"), F.sum("cited").alias("cited"))
    closed = counted.groupBy("window", *keys).agg(*rates, F.array_sort(F.collect_list(F.struct("latency", "n"))).alias("values"))
    rank = nearest_rank(F.col("n_events"), 95)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v"))
    step = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.coalesce(a["v"], F.when(a["n"] + x["n"] > rank, x["latency"])).alias("v"))
    return closed.withColumn("latency_p95_ms", F.aggregate("values", start, step)["v"]).select(*names)


def micro_batches(events: DataFrame, order: Sequence[str], min_batch: int = 5, buckets: int | None = None) -> DataFrame:
    """Replay form: add ``batch_no`` (0 is the baseline) and ``complete``.

    Rows are numbered over the whole table in order by range partitions, so no
    task sorts everything.
    """
    placed = numbered(events, [], order, "_rn", buckets)
    batch = F.floor((F.col("_rn") - 1) / min_batch)
    n = events.agg(F.count(F.lit(1)).alias("n"))
    total = n.select("n").scalar()
    return placed.withColumn("batch_no", batch).withColumn("complete", (F.col("batch_no") + 1) * min_batch <= total).drop("_rn", "_bucket")


def start_micro_batches(
    stream: DataFrame, folder: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None], min_batch: int = 5, trigger: dict | None = None
) -> StreamingQuery:
    """Hold events until at least ``min_batch`` are pending, then hand all of them to ``on_batch(rows, number)``.

    Each micro-batch is written under its own epoch (overwriting a replayed
    one); a report covers the epochs after the last reported one.  Number 0 is
    the baseline.  A failure after the hand-over repeats the same report with
    the same number, so ``on_batch`` should write idempotently by number.
    """

    def read(spark, name: str, schema) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    def step(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{folder}/pending/epoch={epoch}")
        done = read(spark, "reported", "number bigint, upto bigint").where(F.col("upto") < epoch)
        last = done.agg(F.count(F.lit(1)).alias("n"), F.max("upto").alias("upto")).first()
        held = read(spark, "pending", T.StructType([*rows.schema.fields, T.StructField("epoch", T.LongType())])).where((F.col("epoch") > (-1 if last["upto"] is None else last["upto"])) & (F.col("epoch") <= epoch))
        if held.limit(min_batch).count() < min_batch:
            return
        on_batch(held.drop("epoch"), last["n"])
        spark.createDataFrame([(last["n"], epoch)], "number bigint, upto bigint").write.mode("overwrite").parquet(f"{folder}/reported/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def start_trace_forwarding(stream: DataFrame, model_id: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A second query on the same source: every traced event goes to the traces table at once."""
    writer = traced(stream, model_id).writeStream.format("parquet").partitionBy("model_id").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
