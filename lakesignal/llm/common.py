"""What several operators share: text defaults, masks, tables written in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesignal.scale import pinned, shared_folder

__all__ = ["SPACE_CLASS", "SPACES", "bounded_broadcast", "load", "pinned", "shared_folder", "text_or_empty"]

#: The white space of every contract here: blank, tab, newline, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Texts that go to Python workers at once; the session's default of 10,000 is meant for short rows.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size for rows with whole texts, unless it was set to something else."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


#: Bytes that are broadcast at most.
BROADCAST_BYTES = 32 << 20


def bounded_broadcast(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast when its counted ``rows`` are within ``limit`` and BROADCAST_BYTES; else as it is, for a shuffled join.

    For tables of numbers and short strings: a row counts 16 bytes, a number 8 and any other column 48.
    """
    width = 16 + sum(8 if kind in ("int", "bigint", "double", "boolean") else 48 for _, kind in df.dtypes)
    return F.broadcast(df) if rows <= min(limit, BROADCAST_BYTES // width) else df


def fresh_names(taken: Sequence[str], *names: str) -> list[str]:
    """Working names that no column of the caller has: underscores are put before until none clashes."""
    out = []
    for name in names:
        while name.lower() in {t.lower() for t in taken}:
            name = f"_{name}"
        out.append(name)
    return out
