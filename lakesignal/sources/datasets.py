"""Evaluation cases and labelled clauses as JSON lines; idempotent and resumable writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesignal.functions.text import strip

EVAL_SCHEMA = "id string, question string, expected_answer string, relevant_document string, category string, relevant_chunks array<int>, expected_citations array<int>"
CLAUSE_SCHEMA = "text string, label string, source_document string, chunk_index int, group_id string, is_synthetic boolean"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; absent list fields read as empty lists."""
    empty = F.array().cast("array<int>")
    rows = spark.read.schema(EVAL_SCHEMA).json(path)
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("relevant_chunks", "expected_citations")})


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def labelled_clauses(chunks: DataFrame) -> DataFrame:
    """Rows (text, label, source_document, chunk_index) with blank clauses left out."""
    rows = chunks.select(strip(F.col("text")).alias("text"), "label", "source_document", "chunk_index")
    return rows.where(F.col("text") != "")


def with_groups(clauses: DataFrame) -> DataFrame:
    """group_id ties a clause to its paraphrases: ``source_document:chunk_index``."""
    return clauses.withColumns(
        {"group_id": F.concat_ws(":", "source_document", F.col("chunk_index").cast("string")), "is_synthetic": F.lit(False)}
    )


def combined(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    return with_groups(real).unionByName(synthetic.withColumn("is_synthetic", F.lit(True)), allowMissingColumns=True)


def pending_groups(groups: DataFrame, existing: DataFrame, per_group: int, key: str = "group_id") -> DataFrame:
    """Groups that do not have ``per_group`` rows yet, with the number still missing."""
    done = existing.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    left = groups.select(key).distinct().join(done, key, "left").withColumn("missing", per_group - F.coalesce("_n", F.lit(0)))
    return left.where("missing > 0").drop("_n")


def numbered_cases(cases: DataFrame, document: str, order: Sequence[str]) -> DataFrame:
    """Case ids ``stem-01``, ``stem-02``, ... per document in the given order."""
    from lakesignal.scale import numbered

    stem = F.regexp_replace(F.substring_index(F.col(document), "/", -1), r"\.[^.]*$", "")
    number = F.col("_no").cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return numbered(cases, [document], order, "_no").withColumn("id", F.concat_ws("-", stem, padded)).drop("_no", "_bucket")


def read_raw_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with broken lines kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def backfill_plan(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Each source row with its outcome: failed (broken), skipped (key exists) or migrated."""
    known = target.select(key).distinct().withColumn("_known", F.lit(True))
    broken = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in source.columns else F.lit(False)
    outcome = F.when(broken | F.col(key).isNull(), "failed").when(F.col("_known"), "skipped").otherwise("migrated")
    return source.join(known, key, "left").withColumn("outcome", outcome).drop("_known")


def backfill_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("migrated", "skipped", "failed")])
