"""Figures that must not grow faster than the input: where rows are dealt to, how often they are repeated."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesignal.operators import classify, neighbours, quote_index, retrieval, trace
from lakesignal.operators.grounding import ground_quotes


@pytest.fixture
def no_small_tables(spark):
    """Joins as on large tables: nothing is broadcast by its size alone."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_class_weights_leave_rows_where_they_are(spark, no_small_tables):
    df = spark.range(0, 400, 1, 8).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("label"))
    out = classify.balanced_weights(df)
    used = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(used) == 8 and {r["count"] for r in used} == {50}
    assert {(r["label"], r["weight"]) for r in out.select("label", "weight").distinct().collect()} == {("a", 2.0), ("b", 400 / 600)}



@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_sends_rows_to_few_blocks_and_stays_exact(spark, kind):
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(120, 6)) * 1000).astype(np.float32)
    points[40:80] = points[0]  # copies: ties at distance 0
    rows = [(0, i, [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, f"scope int, query_id long, vector array<{kind}>").withColumn("item_id", F.col("query_id")).withColumn("own", F.col("query_id"))
    blocked, _ = neighbours._blocked(df, ["scope"], "item_id", "ib", 2)
    assert blocked.agg(F.max("n_ib")).first()[0] == 8  # 60 blocks before: each row was sent 60 times
    m = points.astype(float)
    found = neighbours.nearest(df, df, ["scope"], 4, exclude="own", block_rows=2).collect()
    assert len(found) == 480
    for r in found:
        d = np.sqrt(((m - m[r["query_id"]]) ** 2).sum(axis=1))
        order = sorted((round(x, 12), j) for j, x in enumerate(d) if j != r["query_id"])
        assert order[r["rank"] - 1][1] == r["item_id"] and abs(d[r["item_id"]] - r["distance"]) < 1e-12


def test_terms_are_counted_inside_the_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"])], "id int, t array<string>")
    got = {r["id"]: [tuple(c) for c in r["c"]] for r in df.select("id", trace._counted("t").alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 3), ("c", 1)], 2: [], 3: [("x", 1)]}


def test_quotes_meet_their_document_in_bounded_arrays(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    asked = quote_index.asked_of_documents(rows, ["word"], 100)
    sizes = [r[0] for r in asked.select(F.size("_asked")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 250


def test_many_quotes_of_one_document_as_by_the_stored_index(spark):
    words = [f"word{i % 37}x{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing to see here at all today")], "doc_id int, text string")
    chunks = spark.createDataFrame([(1, i, " ".join(words[i * 100 : i * 100 + 100])) for i in range(4)] + [(2, 0, "nothing to see here at all today")], "doc_id int, chunk_index int, text string")
    spans = [(1, f"q{i}", " ".join(words[i * 4 : i * 4 + 2 + i % 9])) for i in range(90)] + [(1, "part", words[7][2:] + " " + words[8][:3]), (1, "none", "word1x word2x word3x word4x word5x word6x word7x"), (2, "own", "see here")]
    quotes = spark.createDataFrame(spans, "doc_id int, quote_id string, quote string")
    once = {tuple(r) for r in ground_quotes(quotes, chunks, docs).collect()}
    stored = {tuple(r) for r in ground_quotes(quotes, None, None, index=quote_index.QuoteIndex.of(chunks, docs).stored()).collect()}
    assert once == stored and len(once) == 93 and sum(r[3] for r in once) == 92


def test_frequencies_of_a_large_scope_come_in_parts(spark):
    sized = spark.range(700).select(F.when(F.col("id") < 600, 1).otherwise(2).alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col("id") * 7 + i) % 50).cast("string")).alias("_w"))
    wanted = {}
    for r in sized.collect():
        for w in set(r["_w"]):
            wanted[(r["doc_id"], w)] = wanted.get((r["doc_id"], w), 0) + 1
    found = retrieval._frequencies(sized, ["doc_id"]).collect()
    assert {(r["doc_id"], r["term"]): r["_df"] for r in found} == wanted and len(found) == len(wanted)
