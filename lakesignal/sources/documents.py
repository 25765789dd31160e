"""Document registry and chunk index tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.scale import latest, numbered


def current_documents(rows: DataFrame, order: Sequence[str] = ("uploaded_at",)) -> DataFrame:
    """Latest appended row per doc_id; rows from before versioning are their own group, version 1."""
    out = latest(rows, ["doc_id"], list(order))
    return with_version_defaults(out)


def with_version_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"version_group_id": F.coalesce("version_group_id", F.col("doc_id").cast(dict(rows.dtypes)["version_group_id"])), "version_number": F.coalesce("version_number", F.lit(1))}
    )


def next_version(existing: DataFrame, uploads: DataFrame) -> DataFrame:
    """Version group and number of new uploads (doc_id, new_version_of nullable): group maximum + 1, or a new group."""
    known = with_version_defaults(existing)
    top = known.groupBy("version_group_id").agg(F.max("version_number").alias("_top"))
    parents = known.select(F.col("doc_id").alias("new_version_of"), "version_group_id")
    joined = uploads.join(parents, "new_version_of", "left").join(top, "version_group_id", "left")
    return joined.withColumns(
        {"version_group_id": F.coalesce("version_group_id", F.col("doc_id").cast(dict(known.dtypes)["version_group_id"])), "version_number": F.coalesce("_top", F.lit(0)) + 1}
    ).drop("_top")


def version_chain(rows: DataFrame) -> DataFrame:
    """Documents of each group in version order, then upload time; a large group is numbered in several tasks."""
    placed = numbered(with_version_defaults(rows), ["version_group_id"], ["version_number", "uploaded_at", "doc_id"], "position")
    return placed.withColumn("position", F.col("position").cast("int")).drop("_bucket")


def can_access(user: str | None, admin: bool = False, owner: str = "owner") -> Column:
    """No owner, own row, or administrator."""
    own = F.col(owner).isNull() | (F.col(owner) == "")
    return F.lit(True) if admin else (own if user is None else own | (F.col(owner) == user))


def index_rows(chunks: DataFrame, embedding: str | None = None) -> DataFrame:
    """Chunk index rows with ids ``doc::index`` and an empty heading for none."""
    rows = chunks.withColumns(
        {"id": F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), "heading": F.coalesce("heading", F.lit(""))}
    )
    return rows if embedding is None else rows.withColumnRenamed(embedding, "embedding")


def upsert_index(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows replaced by id; ids that are not incoming stay."""
    return existing.join(incoming.select("id"), "id", "left_anti").unionByName(incoming)


def drop_documents(index: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return index.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def answer_event(answers: DataFrame) -> DataFrame:
    """An answer as a telemetry row: counts of cited and retrieved chunks and their distances."""
    return answers.select(
        "*",
        F.size("cited_chunks").alias("citations"),
        F.size("retrieved_chunks").alias("retrieved"),
        F.transform("retrieved_chunks", lambda c: F.round(c["distance"], 4)).alias("retrieval_scores"),
    )
