"""Lexical, dense and fused ranking of chunks inside the document a query names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakesignal.scale import pinned, salted_lookup, top_per_key

K1, B, EPSILON, FUSION_K = 1.5, 0.75, 0.25, 60


def _words(text: str):
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\S+"), F.lit(0))


#: Chunks of a scope whose words are counted in one place; the words of larger scopes are dealt by their hash.
TOGETHER, MOST_PARTS = 256, 64


def _frequencies(sized: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, term, _df): in how many chunks of the scope a term occurs.

    A chunk is dealt as one row with its distinct words, which takes far less room than one row a word; the chunks of a
    large scope are dealt once per part, each with the words of that part, so that the scope is spread over many tasks.
    """
    large = pinned(sized.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TOGETHER))
    parts = large.select(*scope, F.least(F.ceil(F.col("_n") / TOGETHER), F.lit(MOST_PARTS)).cast("int").alias("_parts"))
    dealt = sized.select(*scope, F.array_distinct("_w").alias("_w")).join(parts, scope, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = F.filter("_w", lambda w: F.pmod(F.xxhash64(w), F.col("_parts")) == F.col("_part"))
    dealt = dealt.select(*scope, "_part", F.when(F.col("_parts") == 1, F.col("_w")).otherwise(own).alias("_w")).repartition(*scope, "_part")
    counts = dealt.select(*scope, "_part", F.explode("_w").alias("term")).groupBy(*scope, "_part", "term").agg(F.count(F.lit(1)).alias("_df"))
    return counts.drop("_part")


def bm25_index(chunks: DataFrame, scope: Sequence[str] = ("doc_id",), item: str = "chunk_index", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """Term weights (scope, item, term, weight): built once per collection, not per query.

    With ``terms`` (scope, term) only the weights of those terms are kept, for
    a one-off set of queries.

    Okapi weights inside each scope; a negative idf is replaced by a quarter of
    the scope's mean idf over its distinct terms.
    """
    scope = list(scope)
    sized = pinned(chunks.select(*scope, item, _words(text).alias("_w")).withColumn("_len", F.size("_w")))  # texts are split once
    stats = sized.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))
    df = _frequencies(sized, scope)
    raw_idf = F.ln(F.col("_n") - F.col("_df") + 0.5) - F.ln(F.col("_df") + 0.5)
    # the mean idf of a scope only needs how many terms have each frequency
    shape = df.groupBy(*scope, "_df").agg(F.count(F.lit(1)).alias("_m")).join(stats, scope)
    per_scope = shape.groupBy(*scope).agg(
        (EPSILON * F.sum(F.col("_m") * raw_idf) / F.sum("_m")).alias("_eps"), F.max("_n").alias("_n"), F.max("_avg").alias("_avg")
    )
    held = sized
    if terms is not None:
        # chunks meet the terms that their scope is asked for, and only those leave a row
        asked = terms.select(*scope, "term").distinct().groupBy(*scope).agg(F.collect_set("term").alias("_asked")).hint("shuffle_hash")
        wanted = F.filter("_w", lambda w: F.array_contains("_asked", w))
        held = pinned(sized.join(asked, scope).select(*scope, item, "_len", wanted.alias("_w")).where(F.size("_w") > 0))
        df = held.select(*scope, F.explode(F.array_distinct("_w")).alias("term")).groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("_df"))
    tokens = held.select(*scope, item, "_len", F.explode("_w").alias("term"))
    tf = tokens.groupBy(*scope, item, "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))
    idf = df.join(per_scope, scope).select(*scope, "term", "_avg", F.when(raw_idf < 0, F.col("_eps")).otherwise(raw_idf).alias("_idf"))
    saturation = F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return tf.join(idf, [*scope, "term"]).select(*scope, item, "term", (F.col("_idf") * saturation).alias("weight"))


def query_terms(queries: DataFrame, scope: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    return queries.select(*scope, F.explode(F.array_distinct(_words(text))).alias("term"))


def query_words(queries: DataFrame, scope: Sequence[str] = ("doc_id",), query: str = "query_id", text: str = "text") -> DataFrame:
    """(scope, query, term, times): the words of each query and how often it has them."""
    return queries.select(*scope, query, F.explode(_words(text)).alias("term")).groupBy(*scope, query, "term").agg(F.count(F.lit(1)).alias("times"))


def bm25_scores(index: DataFrame, queries: DataFrame, scope: Sequence[str] = ("doc_id",), item: str = "chunk_index", query: str = "query_id", text: str = "text") -> DataFrame:
    """Scores of the chunks that share a term with the query (repeated query words count again)."""
    q = query_words(queries, scope, query, text)
    return q.join(index, [*scope, "term"]).groupBy(*scope, query, item).agg(F.sum(F.col("weight") * F.col("times")).alias("score"))


def all_candidates(queries: DataFrame, chunks: DataFrame, scope: Sequence[str] = ("doc_id",), item: str = "chunk_index", query: str = "query_id") -> DataFrame:
    """Every chunk of the document a query is asked of (never of other documents)."""
    return salted_lookup(queries.select(*scope, query), chunks.select(*scope, item), scope, 4)


def bm25_ranking(scores: DataFrame, candidates: DataFrame, scope: Sequence[str] = ("doc_id",), item: str = "chunk_index", query: str = "query_id") -> DataFrame:
    """Full lexical ranking: chunks without a shared term follow with score 0, in chunk order."""
    keys = [*scope, query]
    scored = candidates.join(scores, [*keys, item], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), item)))


def fuse(rankings: DataFrame, keys: Sequence[str] = ("query_id",), item: str = "item_id", k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of rows (keys, item, rank): sum of 1 / (k + rank), rank from 1."""
    return rankings.groupBy(*keys, item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def hybrid_top_k(dense: DataFrame, lexical: DataFrame, keys: Sequence[str], item: str = "chunk_index", k: int = 6) -> DataFrame:
    """Fused top-k of two full rankings; ties keep the dense order."""
    cols = [*keys, item, "rank"]
    both = dense.select(*cols, F.lit(True).alias("_d")).unionByName(lexical.select(*cols, F.lit(False).alias("_d")))
    fused = both.groupBy(*keys, item).agg(F.sum(1.0 / (FUSION_K + F.col("rank"))).alias("score"), F.min(F.when(F.col("_d"), F.col("rank"))).alias("dense_rank"))
    return top_per_key(fused, list(keys), [F.desc(F.round("score", 12)), F.asc_nulls_last("dense_rank"), F.col(item)], k)


def first_relevant_rank(ranked: DataFrame, relevant: DataFrame, keys: Sequence[str] = ("query_id",), item: str = "item_id") -> DataFrame:
    """Lowest rank of a relevant item per query; null when none was retrieved."""
    hit = ranked.join(relevant.select(*keys, item).distinct(), [*keys, item], "left_semi").groupBy(*keys).agg(F.min("rank").alias("first_relevant_rank"))
    return ranked.select(*keys).distinct().join(hit, list(keys), "left")
