"""Stored postings with block maxima, and exact top-k that stops early: lexical, dense, and fused.

Postings (scope, term, block, item, weight) are built once per collection; ``block`` is a run of items, and the largest
weight of a term in a block is stored beside them.  A query first adds up these maxima: an upper bound of every score in
a block.  The blocks with the highest bounds are scored, their k-th score is a threshold, and of all other blocks only
those that can reach it are opened.  The k best are exact; no ranking of all items is made.

Fusion by reciprocal ranks needs no full ranking either.  With lists cut at ``constant`` + 2 k places nothing outside both
can be among the k best, as k items of one list alone already score more.  For what stands in one list only, the place in
the other one is counted, if it can still matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakesignal.functions.vectors import cosine
from lakesignal.operators.retrieval import FUSION_K, all_candidates, bm25_index, query_terms, query_words
from lakesignal.scale import pinned, salted_lookup, top_per_key

BLOCK_ITEMS = 64
#: Digits that scores and distances are compared by.
SCORE_DIGITS, DISTANCE_DIGITS = 9, 12


@dataclass(frozen=True)
class Postings:
    """``weights`` (scope, term, block, item, weight), ``maxima`` (scope, term, block, top), ``items`` (scope, item)."""

    weights: DataFrame
    maxima: DataFrame
    items: DataFrame
    scope: tuple[str, ...]
    item: str

    def bounds(self, asked: DataFrame, query: str) -> DataFrame:
        """(scope, query, block, bound): at least the score of every item of the block."""
        keys = [*self.scope, query]
        held = asked.join(self.maxima, [*self.scope, "term"])
        return held.groupBy(*keys, "block").agg(F.sum(F.col("times") * F.greatest("top", F.lit(0.0))).alias("bound"))

    def scores(self, asked: DataFrame, query: str, blocks: DataFrame | None = None) -> DataFrame:
        """(scope, query, item, score) of the items that share a term with the query, in ``blocks`` (scope, query, block) if given."""
        keys = [*self.scope, query]
        held = asked.join(self.weights, [*self.scope, "term"])
        held = held if blocks is None else held.join(blocks.select(*keys, "block"), [*keys, "block"], "left_semi")
        return held.groupBy(*keys, self.item).agg(F.sum(F.col("weight") * F.col("times")).alias("score"))

    def top_k(self, queries: DataFrame, k: int, query: str = "query_id", text: str = "text", lead: int = 2) -> DataFrame:
        """(scope, query, item, score, rank): the k best items of each query's scope.

        Items without a shared term follow with score 0 in item order.  Items of a scope are numbered from 0 without
        gaps, as the chunker does, so that no more than needed are fetched for that.
        """
        keys = [*self.scope, query]
        best = [F.desc(F.round("score", SCORE_DIGITS)), F.col(self.item)]
        asked = pinned(query_words(queries, self.scope, query, text))
        bounds = pinned(self.bounds(asked, query))
        leading = pinned(top_per_key(bounds, keys, [F.desc("bound"), F.col("block")], lead).select(*keys, "block"))
        first = pinned(self.scores(asked, query, leading))
        kth = top_per_key(first, keys, best, k).where(F.col("rank") == k).select(*keys, F.col("score").alias("kth")).where("kth > 0")
        # a threshold of zero or less stops nothing: items without a shared term come before negative scores
        others = bounds.join(leading, [*keys, "block"], "left_anti").join(kth, keys, "left")
        others = pinned(others.where("kth is null or bound >= kth - 1e-8").select(*keys, "block"))
        scored = pinned(first.unionByName(self.scores(asked, query, others)))
        positive = F.count_if(F.round("score", SCORE_DIGITS) > 0)
        seen = scored.groupBy(*keys).agg(positive.alias("positive"), F.count(F.lit(1)).alias("seen"))
        short = queries.select(*keys).distinct().join(seen, keys, "left").na.fill(0, ["positive", "seen"]).where(F.col("positive") < k)
        short = short.select(*keys, (k + F.col("seen")).alias("most"))
        rest = self.items.join(short, list(self.scope)).where(F.col(self.item) < F.col("most")).select(*keys, self.item).join(scored, [*keys, self.item], "left_anti")
        every = scored.unionByName(rest.withColumn("score", F.lit(0.0)))
        return top_per_key(every, keys, best, k)

    def every_score(self, queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
        """(scope, query, item, value): all items, by falling score in ``value``; for counting places."""
        asked = query_words(queries, self.scope, query, text)
        all_items = all_candidates(queries, self.items, self.scope, self.item, query)
        scored = all_items.join(self.scores(asked, query), [*self.scope, query, self.item], "left")
        return scored.select(*self.scope, query, self.item, (-F.round(F.coalesce("score", F.lit(0.0)), SCORE_DIGITS)).alias("value"))


def build_postings(
    chunks: DataFrame, scope: Sequence[str] = ("doc_id",), item: str = "chunk_index", text: str = "text", queries: DataFrame | None = None, block_items: int = BLOCK_ITEMS
) -> Postings:
    """Postings of all terms, or with ``queries`` (scope, text) of those that they ask for."""
    index = bm25_index(chunks, scope, item, text, terms=None if queries is None else query_terms(queries, scope))
    weights = pinned(index.withColumn("block", F.floor(F.col(item) / block_items)))
    maxima = pinned(weights.groupBy(*scope, "term", "block").agg(F.max("weight").alias("top")))
    return Postings(weights, maxima, chunks.select(*scope, item), tuple(scope), item)


def dense_distances(queries: DataFrame, items: DataFrame, scope: Sequence[str] = ("doc_id",), item: str = "chunk_index", query: str = "query_id") -> DataFrame:
    """(scope, query, item, distance): cosine distance of ``vector`` to each item of the query's scope."""
    q = queries.select(*scope, query, F.col("vector").alias("_q"))
    held = salted_lookup(items.select(*scope, item, F.col("vector").alias("_v")), q, list(scope), 4)
    return held.select(*scope, query, item, (1 - cosine(F.col("_q"), F.col("_v"))).alias("distance"))


def dense_top_k(distances: DataFrame, keys: Sequence[str], k: int, item: str = "chunk_index") -> DataFrame:
    """The k nearest items per query; equal distances by item."""
    return top_per_key(distances, list(keys), [F.round("distance", DISTANCE_DIGITS), F.col(item)], k)


def places(values: DataFrame, wanted: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, item, place): the place of the ``wanted`` (keys, item) among all ``values`` (keys, item, value), by value and item.

    Counted, not ranked: partial counts are added up before the shuffle, so no query's items meet in one task.
    """
    keys = list(keys)
    own = wanted.join(values, [*keys, item]).select(*keys, F.col(item).alias("_item"), F.col("value").alias("_value"))
    own = pinned(own)
    before = (F.col("value") < F.col("_value")) | ((F.col("value") == F.col("_value")) & (F.col(item) <= F.col("_item")))
    counted = values.join(own, keys).groupBy(*keys, "_item").agg(F.count_if(before).alias("place"))
    return counted.withColumnRenamed("_item", item)


def fused_top_k(
    dense: DataFrame, lexical_top, lexical_values, keys: Sequence[str], k: int, item: str = "chunk_index", constant: int = FUSION_K
) -> DataFrame:
    """(keys, item, score, rank): the k best by the sum of 1 / (constant + place) over both rankings.

    ``dense`` (keys, item, distance) has every item; ``lexical_top(n)`` gives (keys, item, rank) of the n best, and
    ``lexical_values(keys)`` (keys, item, value) of all items of some queries.  Equal sums keep the dense order.
    """
    keys = list(keys)
    dense = pinned(dense)  # read for the nearest and for the places of others: distances are taken once
    depth = constant + 2 * k
    gain = lambda place: F.coalesce(1.0 / (constant + place), F.lit(0.0))
    near = dense_top_k(dense, keys, depth, item).select(*keys, item, F.col("rank").alias("d"), F.lit(None).cast("int").alias("l"))
    top = lexical_top(depth).select(*keys, item, F.lit(None).cast("int").alias("d"), F.col("rank").cast("int").alias("l"))
    both = pinned(near.unionByName(top).groupBy(*keys, item).agg(F.max("d").alias("d"), F.max("l").alias("l")))
    least: Column = gain(F.col("d")) + gain(F.col("l"))
    kth = top_per_key(both.withColumn("least", least), keys, [F.desc("least"), F.col(item)], k)
    kth = kth.groupBy(*keys).agg(F.min("least").alias("kth"), F.count(F.lit(1)).alias("n"))
    # a list that is shorter than its depth has every item, so a place that is missing lies beyond the depth
    missing = both.where("d is null or l is null").join(kth, keys).where((F.col("n") < k) | (least + 1.0 / (constant + depth + 1) >= F.col("kth") - 1e-9))
    missing = pinned(missing.select(*keys, item, "d", "l"))
    if missing.limit(1).count():
        far = missing.where("d is null").select(*keys, item)
        unshared = missing.where("l is null").select(*keys, item)
        distances = dense.join(far.select(*keys).distinct(), keys, "left_semi").select(*keys, item, F.round("distance", DISTANCE_DIGITS).alias("value"))
        counted_d = places(distances, far, keys, item).select(*keys, item, F.col("place").cast("int").alias("d2"))
        counted_l = places(lexical_values(unshared.select(*keys).distinct()), unshared, keys, item).select(*keys, item, F.col("place").cast("int").alias("l2"))
        both = both.join(counted_d, [*keys, item], "left").join(counted_l, [*keys, item], "left")
        both = both.select(*keys, item, F.coalesce("d", "d2").alias("d"), F.coalesce("l", "l2").alias("l"))
    fused = both.withColumn("score", least)
    return top_per_key(fused, keys, [F.desc(F.round("score", DISTANCE_DIGITS)), F.asc_nulls_last("d"), F.col(item)], k).drop("d", "l")


def asked_of_documents(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per (query_id, doc_id) of rows (query_id, text) and document lists (query_id, position, doc_id, label)."""
    return lists.join(queries.select("query_id", "text"), "query_id")


def merged_excerpts(top: DataFrame, lists: DataFrame, item: str = "chunk_index") -> DataFrame:
    """(query_id, excerpt, doc_id, label, item): each listed document's best items, in list order, numbered from 1 per query.

    ``top`` has (doc_id, query_id, item, rank), a few rows per pair; a document that is listed twice comes twice.
    """
    held = lists.join(top.select("doc_id", "query_id", item, "rank"), ["doc_id", "query_id"])
    order = W.partitionBy("query_id").orderBy("position", "rank")
    return held.select("query_id", F.row_number().over(order).alias("excerpt"), "doc_id", "label", item)
