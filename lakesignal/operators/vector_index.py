"""Corpus-wide vector search through routed lists.

Centroids are fitted on a bounded sample; every row is put in the list of its nearest centroid.  A query visits the lists
of its ``probes`` nearest centroids, and the rows of these are ranked by their exact distance.  ``calibrated`` chooses the
number of probes: it asks a bounded sample of queries of all rows exactly and counts in which of a query's lists the true
neighbours lie, so the recall of every number of probes is read off one exact search.

A list that holds a third of all rows is cut into blocks like any scope of ``neighbours.nearest``; no list meets in one
task.  Every row is indexed, and the exact search over all rows stays available as ``nearest``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.operators.neighbours import nearest
from lakesignal.scale import pinned, top_per_key

#: Rows that centroids are fitted on, and queries that the number of probes is chosen by, at most about.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 256
MOST_LISTS = 4096
_PARTS = 1 << 30


def hashed_sample(df: DataFrame, row_id: str, rows: int, total: int, seed: int = 0) -> DataFrame:
    """About ``rows`` of the ``total`` rows, by a hash of their id: the same on every retry."""
    return df.where(F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(_PARTS)) < math.ceil(_PARTS * min(1.0, rows / max(total, 1))))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def ranked_lists(vectors: pd.Series, centroids: np.ndarray, metric: str, most: int) -> np.ndarray:
    """The ``most`` nearest lists of each vector, nearest first."""
    if not centroids.shape[1]:  # an index of no rows
        return np.zeros((len(vectors), 1), np.int32)
    v = np.array(vectors.tolist(), dtype=float)
    if metric == "cosine":
        far = -(_unit(v) @ centroids.T)
    else:
        far = (centroids**2).sum(axis=1) - 2 * (v @ centroids.T)
    most = min(most, far.shape[1])
    some = np.argpartition(far, most - 1, axis=1)[:, :most]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` is the stored table (item_id, vector, list, other columns); ``probes`` lists are visited by a query."""

    rows: DataFrame
    centroids: np.ndarray
    metric: str
    probes: int

    def routed(self, df: DataFrame, most: int, name: str = "lists") -> DataFrame:
        """``df`` with ``name``: the nearest lists of ``vector``."""
        centroids, metric = self.centroids, self.metric

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(**{name: ranked_lists(batch["vector"], centroids, metric, most).astype(np.int32).tolist()})

        fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return df.mapInPandas(run, f"{fields}, `{name}` array<int>")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exclude: str | None = None) -> DataFrame:
        """(query_id, rank, item_id, distance) for rows (query_id, vector); ``exclude`` as in ``nearest``."""
        extra = [exclude] if exclude else []
        asked = self.routed(queries.select("query_id", "vector", *extra), probes or self.probes)
        asked = pinned(asked.select("query_id", "vector", *extra, F.explode("lists").alias("list")))
        found = nearest(asked, self.rows.select("list", "item_id", "vector", *extra), ["list"], k, self.metric, exclude)
        found = found.select("query_id", "item_id", "distance")
        return top_per_key(found, ["query_id"], [F.round("distance", 12), F.col("item_id")], k, spread=1)

    def calibrated(self, queries: DataFrame, k: int, recall: float = 0.95, sample: int = SAMPLE_QUERIES, exclude: str | None = None) -> VectorIndex:
        """The index with the smallest number of probes that finds this share of a query sample's true neighbours."""
        extra = [exclude] if exclude else []
        few = pinned(hashed_sample(queries, "query_id", sample, queries.count(), 1).select("query_id", "vector", *extra))
        whole = lambda df: df.withColumn("all", F.lit(0))
        truth = nearest(whole(few), whole(self.rows.select("item_id", "vector", *extra)), ["all"], k, self.metric, exclude)
        order = self.routed(few, len(self.centroids)).select("query_id", "lists")
        places = truth.select("query_id", "item_id").join(self.rows.select("item_id", "list"), "item_id").join(order, "query_id")
        counts = places.groupBy(F.array_position("lists", F.col("list")).cast("int").alias("at")).count().collect()  # one row per list
        hits = np.zeros(len(self.centroids) + 1)
        for r in counts:
            hits[r["at"]] += r["count"]
        if not hits.sum():
            return self
        return replace(self, probes=int(np.searchsorted(np.cumsum(hits) / hits.sum(), recall - 1e-12).clip(1, len(self.centroids))))


def fit_index(items: DataFrame, metric: str = "euclidean", lists: int | None = None, probes: int = 8, sample: int = SAMPLE_ROWS, seed: int = 0) -> VectorIndex:
    """Index of rows (item_id, vector, other columns); null vectors have no distance and are left out.

    ``lists`` is the root of the number of rows unless given, at most MOST_LISTS.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    items = items.where(F.col("vector").isNotNull()).withColumn("vector", F.col("vector").cast("array<double>"))
    total = items.count()
    lists = min(MOST_LISTS, lists or max(1, math.isqrt(total)))
    few = hashed_sample(items, "item_id", sample, total, seed)
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        few = few.select(F.transform("vector", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("vector"))
    training = pinned(few.select("vector").distinct())  # copies would only draw centroids to one spot
    lists = min(lists, training.count())
    if lists == 1:
        centroids = np.array([training.first()["vector"]], dtype=float)
    elif lists:
        model = KMeans(k=lists, maxIter=8, seed=seed, featuresCol="features").fit(training.select(array_to_vector("vector").alias("features")))
        centroids = np.array(model.clusterCenters(), dtype=float)
    else:
        centroids = np.zeros((1, 0))
    index = VectorIndex(items, centroids, metric, min(probes, len(centroids)))
    rows = index.routed(items, 1).withColumn("list", F.col("lists")[0]).drop("lists")
    return replace(index, rows=pinned(rows))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, item_id) pairs that were found."""
    pairs = truth.select("query_id", "item_id")
    hit = pairs.join(found.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi").count()
    return hit / max(1, pairs.count())
