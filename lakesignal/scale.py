"""Building blocks that keep a hot key from landing in one task.

All three ideas used across the library live here:

* ``pinned``: a small derived table is written once to the shared checkpoint
  folder, so later stages (and retries after a lost executor) all read the same
  rows.
* ``value_cuts`` / ``with_bucket``: cut points per key so that an ordered computation over one
  hot key runs in many buckets instead of one sort.
* ``running``: running sums, minima and maxima per key in two levels: inside a
  bucket by a window, across buckets by a window over one row per bucket.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or ``spark.lakesignal.work_dir``.

    A local master may do without both and then uses the warehouse folder.  On a cluster that is an error: a folder of
    one machine would lose rows.
    """
    for name in ("spark.checkpoint.dir", "spark.lakesignal.work_dir"):
        if folder := spark.conf.get(name, None):
            return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir (or spark.lakesignal.work_dir) to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives executor loss, and gives the optimizer exact
    sizes, so it decides by size whether to broadcast.  Texts take about half
    the room in zstd that they take in the session's usual codec.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lakesignal/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def value_cuts(df: DataFrame, keys: Sequence[str], value: str, buckets: int | None = None) -> DataFrame | None:
    """``(keys, _cuts)``: cut points of ``value`` per key for ``buckets`` rank-balanced buckets.

    The cuts come from a quantile sketch that is merged map-side (no data
    shuffle) and are pinned, so every stage that follows sees the same ones.
    With one bucket there is nothing to cut: None.
    """
    n = default_buckets(df.sparkSession) if buckets is None else buckets
    if n <= 1:
        return None
    probs = [i / n for i in range(1, n)]
    return pinned(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.percentile_approx(value, probs, max(1000, 20 * n)).alias("_cuts"))
        .withColumn("_cuts", F.array_distinct("_cuts"))
    )


def with_bucket(df: DataFrame, cuts: DataFrame | None, keys: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``: the number of cuts below ``value``, an order-preserving bucket.

    Binary search, one projection per step, so it stays in generated code.
    """
    if cuts is None:
        return df.withColumn("_bucket", F.lit(0))
    n = default_buckets(df.sparkSession) if buckets is None else buckets
    out = df.join(cuts, list(keys), "left").withColumn("_bucket", F.lit(0))
    for i in range(max(1, math.ceil(math.log2(n + 1))) - 1, -1, -1):
        nxt = F.col("_bucket") + (1 << i)
        out = out.withColumn("_bucket", F.when(F.get("_cuts", nxt - 1) < F.col(value), nxt).otherwise(F.col("_bucket")))
    return out.drop("_cuts")


def ordered_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Range-partition by (keys, order), pin, and add ``_bucket`` and ``_pos``.

    Range partitioning on the full ordering splits a hot key over many
    partitions even when it holds most rows.  ``_bucket`` is the partition and
    ``_pos`` the row's place inside it, both frozen by the pinned table.
    """
    n = default_buckets(df.sparkSession) if buckets is None else buckets
    cols = [*keys, *order]
    return pinned(
        df.repartitionByRange(max(1, n), *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_bucket", F.shiftright("_id", 33).cast("int"))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    totals: Mapping[str, tuple[str, Column]],
    bucket: str = "_bucket",
) -> DataFrame:
    """Running aggregates per key, inclusive of the current row.

    ``totals`` maps an output column to ``(kind, expression)`` with kind one of
    sum, max, min.  ``bucket`` must not decrease along the order.  The window
    over all rows is partitioned by (keys, bucket); the window per key sees one
    row per bucket.
    """
    inner = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    per_bucket = df.groupBy(*keys, bucket).agg(*[_COMBINE[kind][0](expr).alias(f"_in_{name}") for name, (kind, expr) in totals.items()])
    carried = per_bucket.select(
        *keys,
        bucket,
        *[_COMBINE[kind][0](f"_in_{name}").over(before).alias(f"_in_{name}") for name, (kind, _) in totals.items()],
    )
    local = df.withColumns({f"_loc_{name}": _COMBINE[kind][0](expr).over(inner) for name, (kind, expr) in totals.items()})
    joined = local.join(carried, [*keys, bucket])
    out = joined.withColumns({name: _COMBINE[kind][1](F.col(f"_loc_{name}"), F.col(f"_in_{name}")) for name, (kind, _) in totals.items()})
    return out.drop(*[f"_loc_{n}" for n in totals], *[f"_in_{n}" for n in totals])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", buckets: int | None = None) -> DataFrame:
    """``row_number`` per key (or over the whole table with no keys) without one big sort task."""
    ranged = ordered_buckets(df, keys, order, buckets)
    starts = ranged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(*keys, "_bucket", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_pos") - F.col("_first") + 1)
        .drop("_before", "_first", "_pos")
    )


def salted_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table`` (unique on ``keys``) with each table row repeated ``salts`` times.

    A key that holds a large share of ``rows`` is then spread over ``salts``
    tasks; no row is dropped.  The salt is a hash of the whole row, so a retried
    task repeats it exactly.
    """
    if salts <= 1:
        return rows.join(table, list(keys), how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank", spread: int = 16) -> DataFrame:
    """Rows ranked 1..k per key, pruned inside ``spread`` sub-groups first.

    A hot key is cut to k rows per sub-group before its rows meet in one task,
    so the final window holds at most k x spread rows per key.
    """
    narrow = df
    if spread > 1:
        sub = W.partitionBy(*keys, "_sub").orderBy(*order)
        narrow = (
            df.withColumn("_sub", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map" not in t and "variant" not in t]), F.lit(spread)))
            .withColumn("_r", F.row_number().over(sub))
            .where(F.col("_r") <= k)
            .drop("_sub", "_r")
        )
    final = W.partitionBy(*keys).orderBy(*order)
    return narrow.withColumn(name, F.row_number().over(final)).where(F.col(name) <= k)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], column: str, name: str, bucket: str = "_bucket") -> DataFrame:
    """``lag(column)`` along the order, in the same two levels as ``running``."""
    inner = W.partitionBy(*keys, bucket).orderBy(*order)
    last = df.groupBy(*keys, bucket).agg(F.max_by(column, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, bucket, F.lag("_last").over(W.partitionBy(*keys).orderBy(bucket)).alias("_before"))
    out = df.withColumn("_lag", F.lag(column).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    out = out.join(carried, [*keys, bucket]).withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")))
    return out.drop("_lag", "_first", "_before")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery."""
    names = one_row.columns
    value = one_row.select(F.struct(*names).alias("_one")).scalar()
    return df.withColumn("_one", value).withColumns({n: F.col("_one")[n] for n in names}).drop("_one")


def stacked(names: Sequence[str], rows: Sequence[Sequence[Column]]) -> Column:
    """``inline`` of literal rows: one input row becomes one output row per entry."""
    return F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, row)]) for row in rows]))


def small_rows(df: DataFrame, limit: int) -> list:
    """Collect a configuration-sized table; more than ``limit`` rows is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows of configuration, got more")
    return rows
