"""LSH forest, whitening and ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesignal.llm import common, lsh_forest, ngram_join, queries, ranked_search, whitening
from tests.llm.test_table_operators import WORDS, edited, plain_components, plain_sets

DOCS = "doc_id long, text string, lang string"


def near_copies(seed=5, base=6, copies=25):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three", "Éa b c", "éa b c", "one two three"]
    for length in (8, 30, 60, 200):
        for _ in range(base):
            words = [rng.choice(WORDS) for _ in range(length)]
            texts += [" ".join(words)] + [" ".join(edited(rng, words, rng.choice([0.01, 0.03, 0.05, 0.08]))) for _ in range(copies // 4)]
    long = [rng.choice(WORDS) for _ in range(40)]
    texts += [" ".join(edited(rng, long, 0.05)) for _ in range(150)] + [" ".join(long + [rng.choice(WORDS) for _ in range(12)]) for _ in range(60)]
    return [(i, t, "en") for i, t in enumerate(texts)]


# --- op11 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small, block_sets, block", [(128, 512, 2048), (4, 16, 24)])
def test_forest_equals_all_pairs(spark, monkeypatch, small, block_sets, block):
    monkeypatch.setattr(lsh_forest, "SMALL", small)
    monkeypatch.setattr(lsh_forest, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    rows = near_copies()
    sets = plain_sets([(i, t) for i, t, _ in rows], 3)
    want, _ = plain_components(sets, 85)
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(rows) - 100


def test_forest_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for shared in (3700, 3000, 1000):
        other = np.concatenate([base[:shared], rng.integers(0, 1 << 63, 4000 - shared).astype(np.uint64)])
        share = (lsh_forest.signature(base) == lsh_forest.signature(other)).mean()
        assert abs(share - shared / (8000 - shared)) < 0.12
    assert lsh_forest.fewest_equal(85) == 135


def test_forest_odd_tables(spark):
    empty = lsh_forest.near_duplicates(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0
    rows = [(None, "a b c d", "x"), (7, "A b c d", "x"), (7, "a b c d", "x"), (None, "q r s t", None), (3, None, None), (3, "", None)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("sig", F.lit("x")).withColumn("n", F.lit(1)).withColumn("_key", F.lit(2))
    got = sorted(map(tuple, lsh_forest.near_duplicates(clash).collect()), key=repr)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 2, None, True), (3, 0, 3, True), (3, 0, 3, True)], key=repr)
    assert lsh_forest.near_duplicates(spark.createDataFrame([(1, "w " * 50_000), (2, "w " * 50_000 + "v")], "doc_id long, text string")).count() == 2


# --- op12 ------------------------------------------------------------------------------------------------------------

VECS = "vec_id long, embedding array<float>, label int"


def plain_whitening(vectors, components=16):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, unit = np.linalg.eigh(c.T @ c / n)
    values, unit = values[::-1][:components], unit[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, (x - s / n) @ unit / np.sqrt(values), values / np.trace(c.T @ c / n)


def whitened(df, k):
    rows = df.orderBy("vec_id", "component").collect()
    return rows, np.array([r["whitened"] for r in rows]).reshape(-1, k)


@pytest.mark.parametrize("dims, rows, scale", [(24, 300, None), (5, 60, None), (40, 400, 0.6)])
def test_whitening_equals_dense_eigenvectors(spark, dims, rows, scale):
    rng = np.random.default_rng(dims)
    spread = np.ones(dims) if scale is None else scale ** np.arange(dims)  # a fast falling spectrum ends early
    vectors = (rng.standard_normal((rows, dims)) * spread * 40).astype(np.float32).tolist()
    vectors += vectors[:50]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], VECS).repartition(3)
    k = min(16, dims)
    n, deviation, want, explained = plain_whitening(vectors, k)
    got, values = whitened(whitening.whitened(df), k)
    assert len(got) == len(vectors) * k and {r["n"] for r in got} == {n} == {rows}
    assert [r["deviation"] for r in got[::k]] == deviation
    assert np.abs(np.abs(values) - np.abs(want)).max() < 1e-6
    assert np.abs(np.array([r["explained"] for r in got[:k]]) / explained - 1).max() < 1e-9
    assert {r["identity_error"] for r in got}.pop() < 1e-8
    signs = np.sign(values * want)
    assert (signs == signs[0]).all() or (np.abs(signs - signs[0]) * np.abs(want)).max() < 1e-6  # either sign, same for all rows


def test_whitening_ends_early_and_finds_repeated_values():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    for values in (np.concatenate([10.0 ** -np.arange(20.0), np.zeros(40)]), np.concatenate([[9, 9, 9, 4, 4, 1, 1, 1, 1], np.full(51, 1e-30)])):
        x = np.diag(values) @ q.T
        squares, vectors, steps = whitening.bidiagonalise(lambda w, x=x: x.T @ (x @ w), 60, 9)
        k = len(squares)
        assert np.allclose(np.sqrt(squares), np.sort(values)[::-1][:k], rtol=1e-6) and k >= 7 and steps < 60
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9


def test_whitening_odd_tables(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, 0), (2, [], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]):
        out = whitening.whitened(spark.createDataFrame(rows, VECS))
        assert out.columns == columns and out.count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [3.0, 1.0], 0), (3, [0.5, 7.0], 0), (4, [nan, 1.0], 0), (5, [1.0, inf], 0), (6, [None, 1.0], 0), (7, None, 0), (8, [1.0], 0), (None, [1.0, 2.0], 0), (9, [1e38, 0.0], 0), (1, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, VECS).withColumn("n", F.lit("x")).withColumn("component", F.lit(None).cast("string"))
    out = whitening.whitened(df).collect()
    assert Counter(r["vec_id"] for r in out) == {1: 4, 2: 2, 3: 2, None: 2} and {r["n"] for r in out} == {3}
    big = [(i, [float(i) * 1e6, float(i % 7) * 1e6], 0) for i in range(2000)]
    assert {r["deviation"] for r in whitening.whitened(spark.createDataFrame(big, VECS)).where("vec_id = 0").collect()} == {None}
    whole = whitening.distinct_vectors(spark.createDataFrame([(1, [1.0, -2.5], 0), (2, [1.001, -2.5], 0), (3, [600.0, 1.0], 0)], VECS), "embedding").collect()
    assert sorted(len(r["packed"]) for r in whole) == [5, 9]  # equal after scaling: one vector, two bytes an entry


# --- op13 ------------------------------------------------------------------------------------------------------------


def plain_ranking(docs, items, k=20):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    texts = [(i, Counter(w)) for i, t in docs if (w := words(t))]
    total, length, df = len(texts), sum(c.total() for _, c in texts), Counter(w for _, c in texts for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in texts:
            m = 100 - 25 + (25 * c.total() * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w in words(text) if c[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("shard, seeds", [(1_000_000, 32), (300, 3), (40, 1)])
def test_search_equals_scoring_everything(spark, monkeypatch, shard, seeds):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranked_search, "SEED_SHARE", seeds)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "ÜNÏ", "x y", "a-b", "_"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 300])))) for i in range(250)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(500, None), (501, ""), (502, " ,;")]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 30])))) for i in range(12)] + [(90, "w1 w1 W1"), (91, "nowhere"), (92, None), (93, "!!"), (94, docs[3][1])]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["score"] == "bigint"
    assert sorted(map(tuple, got.collect())) == sorted(plain_ranking(docs, items))


def test_search_prunes(monkeypatch):
    """A shard with one good document: few of the others are scored."""
    rng = np.random.default_rng(4)
    n, terms = 4000, 30
    sizes = np.full(n, 3)
    codes = np.concatenate([np.sort(rng.choice(terms, 3, replace=False)) for _ in range(n)]).astype(np.int32)
    shard = ranked_search.Shard(np.full(n, 50), codes, np.ones(len(codes), np.int64), sizes, np.full(terms, 1000), n, n * 50)
    calls = []
    peaks = shard.peaks
    monkeypatch.setattr(shard, "peaks", lambda *a: (calls.append(len(a[0])), peaks(*a))[1])
    scores, _ = shard.search(np.array([0, 1]), np.array([1, 1]), 3)
    assert len(scores) == 3 and sum(calls) < n // 2
    assert len(shard.search(np.array([0, 1]), np.array([1, 1]), 3, int(scores[-1]) + 10**9)[0]) == 0


def test_search_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "a a", "y")], "doc_id long, text string, score string").withColumn("codes", F.lit(1))
    items = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (None, "b", 2)], "item_id long, text string, rank int")
    none, nothing = docs.limit(0), items.limit(0)
    assert ranked_search.search(none, items).count() == 0 and ranked_search.search(docs, nothing).count() == 0
    got = ranked_search.search(docs, items).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: (r["item_id"] is None, r["rank"]))] == [(1, 1, None), (1, 2, 1), (1, 3, 1), (None, 1, 1), (None, 2, 1)]
    one = ranked_search.search(spark.createDataFrame([(1, "q " * 100_000), (2, "r")], "doc_id long, text string"), spark.createDataFrame([("x", "q " * 5000)], "item_id string, text string"))
    assert [(r["item_id"], r["doc_id"]) for r in one.collect()] == [("x", 1)]


def test_labels_are_taken_apart_once_for_all_regions(spark, monkeypatch):
    """Small and large regions read the stored rows of their nodes: the plan of the pairs has no label in it."""
    monkeypatch.setattr(lsh_forest, "SMALL", 2)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[i % 3 :], rng.integers(0, 1 << 63, i % 4).astype(np.uint64)])) for i in range(12)]
    rows = [(i, len(s), bytearray(lsh_forest.signature(s).tobytes())) for i, s in enumerate(sets)]
    nodes = common.pinned(spark.createDataFrame(rows, "node long, n long, sig binary"))
    pairs = lsh_forest.between_components(nodes, spark.createDataFrame([], "node long, label long"), 85)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" in plan and "explode(array" not in plan
    joined = lsh_forest.components(pairs).groupBy("label").count().collect()
    assert [tuple(r) for r in joined] == [(0, 12)]


@pytest.mark.parametrize("name", ["op11_lsh_forest", "op12_whitening", "op13_ranked_search"])
def test_registered(name):
    assert name in queries.QUERIES and (name in queries.ORACLE) == (name != "op12_whitening")


# --- op5: odd sketches -----------------------------------------------------------------------------------------------


def test_sketches_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(9)
    for n in (1, 5, 40, 700):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for change in (0, 1, n // 3, n):
            other = np.unique(np.concatenate([base[change:], rng.integers(0, 1 << 63, rng.integers(0, n + 1)).astype(np.uint64)]))
            apart = len(np.setxor1d(base, other))
            a, b = ngram_join.sketch(base), ngram_join.sketch(other)
            for size in {min(len(a), len(b)), 8}:
                assert np.bitwise_count(ngram_join.folded(a, size) ^ ngram_join.folded(b, size)).sum() <= apart
    assert len(ngram_join.sketch(base)) == 256 and ngram_join.sketch(np.zeros(0, np.uint64)) == bytes(8)


def test_texts_are_cut_by_rows_and_length(monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_CHARS", 10)
    rows = pd.DataFrame({"_text": ["a" * 4, "b" * 4, "c" * 4, "d" * 30, "", "e"], "x": range(6)})
    assert [list(p["x"]) for p in ngram_join._sliced(iter([rows, rows.iloc[:0]]), 500)] == [[0, 1], [2], [3], [4, 5]]
    assert [len(p) for p in ngram_join._sliced(iter([rows[["x"]]]), 4)] == [4, 2]


# --- shared helpers ---------------------------------------------------------------------------------------------------


def test_broadcasts_are_bounded_by_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    numbers, texts = spark.range(3), spark.range(3).select(F.col("id").cast("string"))
    assert hinted(common.bounded_broadcast(numbers, 1_000_000)) and not hinted(common.bounded_broadcast(numbers, 1_000_001))
    assert hinted(common.bounded_broadcast(texts, 500_000)) and not hinted(common.bounded_broadcast(texts, 600_000))


def test_batches_of_texts_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", str(common.BATCH_ROWS)), ("77", "77")):
            spark.conf.set(name, given)
            common.bounded_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
