"""Request telemetry: schema, append, batch and stream reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesignal.functions.vectors import rounded

TELEMETRY_SCHEMA = T.StructType(
    [
        T.StructField("at", T.TimestampType()),
        T.StructField("grounded", T.BooleanType()),
        T.StructField("citations", T.IntegerType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("parse_error", T.BooleanType()),
        T.StructField("retrieved", T.IntegerType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("retrieval_scores", T.ArrayType(T.DoubleType())),
        T.StructField("retrieval_latency_ms", T.DoubleType()),
        T.StructField("generation_latency_ms", T.DoubleType()),
        T.StructField("citations_requested", T.IntegerType()),
        T.StructField("full_trace", T.StringType()),
        T.StructField("question_embedding", T.ArrayType(T.DoubleType())),
    ]
)

#: Decimals kept per column when an event is recorded.
DECIMALS = {"latency_ms": 1, "retrieval_latency_ms": 1, "generation_latency_ms": 1}
ARRAY_DECIMALS = {"retrieval_scores": 4, "question_embedding": 6}


def record_events(events: DataFrame) -> DataFrame:
    """Round measurements the way they are stored; absent arrays become empty ones."""
    cols = {c: F.round(c, d) for c, d in DECIMALS.items() if c in events.columns}
    cols |= {c: rounded(F.col(c), d) for c, d in ARRAY_DECIMALS.items() if c in events.columns}
    return events.withColumns(cols)


def append_events(events: DataFrame, path: str) -> None:
    record_events(events).write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_events(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """The same directory as a stream.  Each event is read once: the checkpoint's offsets replace a drain flag."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_embedding(events: DataFrame, column: str = "question_embedding") -> DataFrame:
    """Events that carry a vector; the others are left out, never zero-filled."""
    return events.where(F.size(column) > 0)


def with_defaults(events: DataFrame) -> DataFrame:
    """Null counters, latencies and flags read as 0 / false, null arrays as empty."""
    defaults = {
        "grounded": F.lit(False),
        "citations": F.lit(0),
        "citations_requested": F.lit(0),
        "latency_ms": F.lit(0.0),
        "generation_latency_ms": F.lit(0.0),
        "retrieval_scores": F.array().cast("array<double>"),
    }
    return events.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in events.columns})


def traced(events: DataFrame, model_id: str) -> DataFrame:
    """Events that carry a full trace, as rows for the traces table."""
    return events.where(F.col("full_trace").isNotNull()).select("trace_id", F.lit(model_id).alias("model_id"), F.col("at").alias("created_at"), F.col("full_trace").alias("data"))


def newest(events: DataFrame, n: int = 500, order: str = "at", tie: str = "trace_id") -> DataFrame:
    """The n most recent events (the bounded buffer): a distributed top-n."""
    return events.orderBy(F.desc(order), F.desc(tie)).limit(n)
