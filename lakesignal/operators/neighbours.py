"""Exact nearest neighbours without a cross join.

Queries and items of one scope are cut into blocks of at most about
``block_rows`` rows.  A (query block, item block) pair is one task: it compares
the two small matrices in numpy and returns only k rows per query.  A scope
that holds a third of all rows becomes many block pairs, never one group.

A row is sent once per block of the other side, so blocks grow from
``BLOCK_ROWS`` to ``MOST_BLOCK_ROWS`` with the scope.  Inside a pair, strips of
queries meet all items in one matrix product; what this estimate leaves among
the k nearest is measured again entry by entry, so distances and ties are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakesignal.scale import pinned, top_per_key

BLOCK_ROWS, MOST_BLOCK_ROWS = 2048, 16384
#: Blocks a side before blocks grow, and distances held at once by a task.
FEW_BLOCKS, STRIP = 8, 1 << 21


def _blocked(df: DataFrame, scope: Sequence[str], row_id: str, name: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    # one row per scope, written once: its exact size lets Spark broadcast it without shuffling the vectors by scope
    n = F.count(F.lit(1))
    grown = F.greatest(F.lit(FEW_BLOCKS), F.ceil(n / (block_rows * (MOST_BLOCK_ROWS // BLOCK_ROWS))))
    counts = pinned(df.groupBy(*scope).agg(F.least(F.ceil(n / block_rows), grown).cast("int").alias(f"n_{name}")))
    return df.join(counts, list(scope)).withColumn(name, F.pmod(F.xxhash64(row_id), F.col(f"n_{name}")).cast("int")), counts


def nearest(
    queries: DataFrame,
    items: DataFrame,
    scope: Sequence[str],
    k: int,
    metric: str = "euclidean",
    exclude: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k items per query inside each scope: (scope, query_id, rank, item_id, distance).

    ``queries`` has scope, query_id, vector; ``items`` scope, item_id, vector.
    ``exclude`` names a column present on both sides whose equal values are
    never neighbours (an id for leave-one-out, a group for leave-one-group-out).
    Ties go to the smaller item_id.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    scope = list(scope)
    extra = ["_exclude"] if exclude else []
    kinds = {dict(df.dtypes)["vector"] for df in (queries, items)}
    sent = "array<float>" if kinds == {"array<float>"} else "array<double>"  # floats are widened where they are compared
    q = queries.select(*scope, "query_id", F.col("vector").cast(sent).alias("vector"), *([F.col(exclude).alias("_exclude")] if exclude else []))
    i = items.select(*scope, "item_id", F.col("vector").cast(sent).alias("vector"), *([F.col(exclude).alias("_exclude")] if exclude else []))
    q, q_counts = _blocked(q, scope, "query_id", "qb", block_rows)
    i, i_counts = _blocked(i, scope, "item_id", "ib", block_rows)
    left = q.join(i_counts, scope).withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("n_ib") - 1))).select(*scope, "qb", "ib", "query_id", "vector", *extra)
    right = i.join(q_counts, scope).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1))).select(
        *[F.col(c).alias(c) for c in (*scope, "qb", "ib", "item_id", "vector", *extra)]
    )
    types = dict(queries.dtypes) | dict(items.dtypes)
    names = [*scope, "query_id", "item_id", "distance"]
    schema = "".join(f"`{s}` {types[s]}, " for s in scope) + f"query_id {types['query_id']}, item_id {types['item_id']}, distance double"

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        b = b.sort_values("item_id", kind="stable")
        m = np.array(b["vector"].tolist(), dtype=float)
        squares = (m * m).sum(axis=1)
        norms = np.sqrt(squares)
        ids = b["item_id"].to_numpy()
        groups = b["_exclude"].to_numpy() if exclude else None
        out_q, out_i, out_d = [], [], []
        own = a["_exclude"].to_numpy() if exclude else None
        asked = a["query_id"].to_numpy()
        step = max(1, STRIP // len(m))
        for start in range(0, len(a), step):
            vs = np.array(a["vector"].iloc[start : start + step].tolist(), dtype=float)
            own_squares = (vs * vs).sum(axis=1)
            with np.errstate(invalid="ignore", over="ignore"):
                products = vs @ m.T
                estimates = products if metric == "cosine" else np.add.outer(own_squares, squares) - 2.0 * products
            for at, v in enumerate(vs):
                keep = np.flatnonzero(groups != own[start + at]) if exclude else np.arange(len(m))
                if len(keep) > k and np.isfinite(estimates[at]).all():  # only what can be among the k nearest is measured
                    if metric == "cosine":
                        scale = norms * np.sqrt(own_squares[at])
                        rough = 1.0 - np.divide(estimates[at], scale, out=np.zeros(len(m)), where=scale > 0)[keep]
                        slack = 1e-9
                    else:
                        rough = estimates[at][keep]
                        # rounding of the squares, and of distances to 12 digits
                        slack = 1e-9 * (own_squares[at] + squares.max()) + 1e-9
                    keep = keep[rough <= np.partition(rough, k - 1)[k - 1] + slack]
                part = m[keep]
                if metric == "cosine":
                    scale = norms[keep] * np.sqrt((v * v).sum())
                    near = 1.0 - np.divide(part @ v, scale, out=np.zeros(len(part)), where=scale > 0)
                else:
                    near = np.sqrt(((part - v) ** 2).sum(axis=1))
                if len(keep) > k:
                    some = near <= np.partition(near, k - 1)[k - 1] + 1e-11
                    keep, near = keep[some], near[some]
                best = np.lexsort((keep, np.round(near, 12)))[:k]
                out_q += [asked[start + at]] * len(best)
                out_i += ids[keep[best]].tolist()
                out_d += near[best].tolist()
        frame = pd.DataFrame({"query_id": out_q, "item_id": out_i, "distance": out_d})
        for s in scope:
            frame[s] = a[s].iloc[0]
        return frame[names]

    by = [*scope, "qb", "ib"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(block, schema)
    return top_per_key(found, [*scope, "query_id"], [F.round("distance", 12), F.col("item_id")], k, spread=1)


def neighbour_vote(neighbours: DataFrame, labels: DataFrame, keys: Sequence[str] = ("query_id",), weighted: bool = True) -> DataFrame:
    """Predicted label per query.  ``labels``: item_id, label.

    Distance weighting is 1/d; neighbours at distance 0 then decide alone.
    Ties go to the smaller label.
    """
    joined = neighbours.join(labels, "item_id")
    if weighted:
        exact = F.max((F.col("distance") == 0).cast("int")).over(W.partitionBy(*keys))
        weight = F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    else:
        weight = F.lit(1.0)
    votes = joined.withColumn("_w", weight).groupBy(*keys, "label").agg(F.sum("_w").alias("_w"))
    return votes.groupBy(*keys).agg(F.min_by("label", F.struct(-F.round("_w", 9), F.col("label"))).alias("prediction"))
