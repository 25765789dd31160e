"""Early-stopping retrieval against full rankings, and the routed vector index against all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesignal.operators.neighbours import nearest
from lakesignal.operators.postings import asked_of_documents, build_postings, dense_distances, dense_top_k, fused_top_k, merged_excerpts, places
from lakesignal.operators.retrieval import all_candidates, bm25_index, bm25_ranking, bm25_scores, hybrid_top_k
from lakesignal.operators.vector_index import fit_index, hashed_sample, recall

WORDS = [f"w{i}" for i in range(40)]
KEYS = ["doc_id", "query_id"]


@pytest.fixture(scope="module")
def collection(spark):
    rng = random.Random(3)
    odds = [1 / (i + 1) for i in range(len(WORDS))]
    chunks = [(d, i, " ".join(rng.choices(WORDS, odds, k=rng.choice([1, 4, 25])))) for d, n in ((1, 150), (2, 3), (3, 40), (4, 1)) for i in range(n)]
    queries = [(d, q, " ".join(rng.choices(WORDS, k=rng.choice([1, 3, 6])))) for q, d in enumerate([1, 1, 1, 2, 2, 3, 3, 4])] + [(1, 90, "nowhere"), (2, 91, "W0 w0 w1"), (9, 92, "w1"), (3, 93, "")]
    c = spark.createDataFrame(chunks, "doc_id long, chunk_index int, text string").repartition(3).cache()
    q = spark.createDataFrame(queries, "doc_id long, query_id long, text string").cache()
    return c, q


def full(c, q):
    return bm25_ranking(bm25_scores(bm25_index(c), q), all_candidates(q, c))


@pytest.mark.parametrize("k, block, stored", [(6, 64, False), (3, 4, True), (200, 8, True)])
def test_lexical_top_k_equals_the_full_ranking(spark, collection, k, block, stored):
    c, q = collection
    postings = build_postings(c, queries=None if stored else q, block_items=block)
    cut = lambda df: sorted((r["doc_id"], r["query_id"], r["rank"], r["chunk_index"], round(r["score"], 9) + 0.0) for r in df.where(F.col("rank") <= k).collect())
    assert cut(postings.top_k(q, k)) == cut(full(c, q))


def test_few_blocks_are_opened(spark, collection):
    c, q = collection
    postings = build_postings(c, block_items=4)
    asked = q.where("query_id in (0, 1, 2)")
    from lakesignal.operators.retrieval import query_words

    words = query_words(asked, ["doc_id"])
    bounds, scores = postings.bounds(words, "query_id"), postings.scores(words, "query_id")
    over = scores.withColumn("block", F.floor(F.col("chunk_index") / 4)).join(bounds, [*KEYS, "block"]).where("score > bound + 1e-9")
    assert over.count() == 0
    kth = postings.top_k(asked, 3).where("rank = 3").select(*KEYS, F.col("score").alias("kth"))
    share = bounds.join(kth, KEYS).agg(F.avg((F.col("bound") >= F.col("kth") - 1e-8).cast("double"))).first()[0]
    assert share < 0.8


@pytest.mark.parametrize("k, constant", [(6, 60), (2, 1), (4, 5)])
def test_fused_top_k_equals_the_full_ranking(spark, collection, k, constant):
    c, q = collection
    rng = np.random.default_rng(1)
    with_vector = lambda df, n: df.withColumn("vector", F.array(*[(F.pmod(F.xxhash64(*df.columns, F.lit(i)), F.lit(1000)) / 100.0 - 5) for i in range(n)]))
    distances = dense_distances(with_vector(q, 4), with_vector(c, 4)).cache()
    postings = build_postings(c, block_items=8)
    got = fused_top_k(distances, lambda n: postings.top_k(q, n), lambda some: postings.every_score(q.join(some, KEYS, "left_semi")), KEYS, k, constant=constant)
    dense = dense_top_k(distances, KEYS, 10**6)
    rows = dense.select(*KEYS, "chunk_index", F.col("rank").alias("d")).join(full(c, q).select(*KEYS, "chunk_index", F.col("rank").alias("l")), [*KEYS, "chunk_index"]).collect()
    want = []
    for key in {(r["doc_id"], r["query_id"]) for r in rows}:
        own = [(-round(1 / (constant + r["d"]) + 1 / (constant + r["l"]), 12), r["d"], r["chunk_index"]) for r in rows if (r["doc_id"], r["query_id"]) == key]
        want += [(*key, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(own)[:k], 1)]
    assert sorted((r["doc_id"], r["query_id"], r["rank"], r["chunk_index"], round(r["score"], 12)) for r in got.collect()) == sorted(want)
    if constant == 60:
        old = hybrid_top_k(dense, full(c, q), KEYS, "chunk_index", k)
        assert sorted(map(tuple, old.select(*KEYS, "rank", "chunk_index").collect())) == sorted(w[:4] for w in want)


def test_places_are_counted(spark):
    values = spark.createDataFrame([(1, i, float(i % 4)) for i in range(12)], "q int, item int, value double")
    got = {r["item"]: r["place"] for r in places(values, spark.createDataFrame([(1, 0), (1, 7), (1, 10)], "q int, item int"), ["q"], "item").collect()}
    order = sorted(range(12), key=lambda i: (i % 4, i))
    assert got == {i: order.index(i) + 1 for i in (0, 7, 10)}


def test_excerpts_of_listed_documents(spark):
    lists = spark.createDataFrame([(5, 0, 2, "B"), (5, 1, 1, "A"), (6, 0, 1, "A")], "query_id long, position int, doc_id long, label string")
    queries = spark.createDataFrame([(5, "x"), (6, "y"), (7, "z")], "query_id long, text string")
    assert sorted((r["query_id"], r["doc_id"], r["text"]) for r in asked_of_documents(queries, lists).collect()) == [(5, 1, "x"), (5, 2, "x"), (6, 1, "y")]
    top = spark.createDataFrame([(1, 5, 3, 1), (1, 5, 0, 2), (2, 5, 8, 1), (1, 6, 4, 1)], "doc_id long, query_id long, chunk_index int, rank int")
    assert sorted(map(tuple, merged_excerpts(top, lists).collect())) == [(5, 1, 2, "B", 8), (5, 2, 1, "A", 3), (5, 3, 1, "A", 0), (6, 1, 1, "A", 4)]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_routed_search(spark, metric):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (12, 8))
    points = np.concatenate([rng.normal(0, 1, (700, 8)) + centres[rng.integers(0, 12, 700)], rng.normal(0, 0.05, (350, 8)) + 2])  # a third of all rows in one spot
    items = spark.createDataFrame([(i, p.tolist(), i) for i, p in enumerate(points)] + [(5000, None, 5000)], "item_id long, vector array<double>, own long").repartition(4)
    queries = items.where("item_id % 20 = 0 and vector is not null").select(F.col("item_id").alias("query_id"), "vector", "own")
    index = fit_index(items, metric, lists=24, probes=1)
    assert index.rows.count() == len(points) and index.rows.where("list is null or list >= 24").count() == 0
    whole = lambda df: df.withColumn("all", F.lit(0))
    truth = nearest(whole(queries), whole(items.where("vector is not null")), ["all"], 5, metric, "own").select("query_id", "rank", "item_id", "distance").cache()
    better = index.calibrated(queries, 5, 0.95, exclude="own")
    assert index.probes == 1 <= better.probes < 24
    found = better.search(queries, 5, exclude="own")
    assert recall(found, truth) >= 0.9 > 0 and recall(truth, truth) == 1
    every = index.search(queries, 5, probes=24, exclude="own")  # all lists visited: the exact answer
    rounded = lambda df: sorted((r["query_id"], r["rank"], round(r["distance"], 9)) for r in df.collect())
    assert rounded(every) == rounded(truth) and every.where("query_id = item_id").count() == 0


def test_vector_index_of_few_rows(spark):
    none = spark.createDataFrame([], "item_id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert fit_index(none).search(asked, 3).count() == 0
    one = fit_index(spark.createDataFrame([(7, [0.0, 2.0])], "item_id long, vector array<double>"), "cosine")
    assert [tuple(r) for r in one.search(asked, 3).collect()] == [(1, 7, 1.0, 1)]
    with pytest.raises(ValueError):
        fit_index(none, "dot")
    rows = spark.range(5000).withColumnRenamed("id", "item_id")
    assert 800 < hashed_sample(rows, "item_id", 1000, 5000).count() < 1200


def test_distances_are_taken_once(spark):
    from pyspark.sql import functions as F

    from lakesignal.operators.postings import fused_top_k

    items = spark.range(12).select(F.lit(1).alias("q"), F.col("id").cast("int").alias("chunk_index"))
    dense = items.withColumn("distance", F.sin(F.col("chunk_index") / 20))  # rising
    ranked = items.withColumn("rank", 12 - F.col("chunk_index"))
    values = items.withColumn("value", -F.col("chunk_index").cast("double"))
    out = fused_top_k(dense, lambda n: ranked.where(F.col("rank") <= n), lambda some: values.join(some, "q", "left_semi"), ["q"], 2, constant=1)
    want = sorted(((-(1 / (2 + i) + 1 / (1 + 12 - i)), i + 1, i) for i in range(12)))[:2]
    assert [(r["chunk_index"], round(r["score"], 9)) for r in out.orderBy("rank").collect()] == [(i, round(-s, 9)) for s, _, i in want]
    assert "SIN(" not in out._jdf.queryExecution().optimizedPlan().toString().upper()
