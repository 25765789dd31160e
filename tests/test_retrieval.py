import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lakesignal.operators.classify import class_names, class_scores, out_of_fold_classes, out_of_fold_probabilities, principal_components, stratified_split, text_classifier
from lakesignal.operators.evaluation import by_category, narrowed, quality_gate, score_cases, summarize
from lakesignal.operators.neighbours import nearest, neighbour_vote
from lakesignal.operators.retrieval import all_candidates, bm25_index, bm25_ranking, bm25_scores, first_relevant_rank, fuse, hybrid_top_k
from lakesignal.operators.scoring import class_report, confusion, detector_scores, majority_class, threshold_sweep
from lakesignal.operators.tfidf import nearest_texts, pair_similarity

CHUNKS = [(1, 0, "rent rent deposit owner"), (1, 1, "notice period of thirty days"), (1, 2, "rent is due rent is paid"), (1, 3, "owner"), (2, 0, "force majeure clause"), (2, 1, "clause clause end")]


def brute_bm25(doc, query):
    texts = {c: t.split() for d, c, t in CHUNKS if d == doc}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {}
    for t in texts.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: eps if v < 0 else v for w, v in idf.items()}
    return {c: sum(idf[q] * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in query.lower().split() if q in idf) for c, t in texts.items()}


def test_bm25_and_hybrid(spark):
    chunks = spark.createDataFrame(CHUNKS, "doc_id int, chunk_index int, text string")
    queries = spark.createDataFrame([("a", 1, "Rent rent owner"), ("b", 2, "force clause"), ("c", 1, "nothing shared")], "query_id string, doc_id int, text string")
    ranked = bm25_ranking(bm25_scores(bm25_index(chunks), queries), all_candidates(queries, chunks)).collect()
    for q, doc, text in (("a", 1, "Rent rent owner"), ("b", 2, "force clause"), ("c", 1, "nothing shared")):
        want = brute_bm25(doc, text)
        got = {r["chunk_index"]: r["score"] for r in ranked if r["query_id"] == q}
        assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-9 for c in want)
        order = [r["chunk_index"] for r in sorted((r for r in ranked if r["query_id"] == q), key=lambda r: r["rank"])]
        assert order == sorted(want, key=lambda c: (-round(want[c], 9), c))
    rows = lambda xs: spark.createDataFrame([("q", i, r) for r, i in enumerate(xs, 1)], "query_id string, chunk_index int, rank int")
    got = [r["chunk_index"] for r in hybrid_top_k(rows([1, 2, 3]), rows([3, 2, 1]), ["query_id"], k=3).orderBy("rank").collect()]
    assert got == [1, 3, 2]  # 1 and 3 tie, the dense order decides
    fused = {r["item_id"]: r["score"] for r in fuse(rows([5, 6]).withColumnRenamed("chunk_index", "item_id")).collect()}
    assert fused == {5: 1 / 61, 6: 1 / 62}
    found = first_relevant_rank(rows([5, 6, 7]).withColumnRenamed("chunk_index", "item_id"), spark.createDataFrame([("q", 7), ("q", 6)], "query_id string, item_id int"))
    assert found.first()["first_relevant_rank"] == 2


def brute_tfidf(fit, x, y):
    import re

    tok = lambda t: re.findall(r"\w\w+", t.lower())
    df = {}
    for t in fit:
        for w in set(tok(t)):
            df[w] = df.get(w, 0) + 1
    vec = lambda t: {w: tok(t).count(w) * (math.log((1 + len(fit)) / (1 + df[w])) + 1) for w in tok(t) if w in df}
    a, b = vec(x), vec(y)
    na, nb = (math.sqrt(sum(v * v for v in d.values())) for d in (a, b))
    return sum(a[w] * b.get(w, 0) for w in a) / (na * nb) if na and nb else 0.0


@pytest.mark.parametrize("salts", [1, 3])
def test_tfidf(spark, salts):
    pairs = [(1, "The rent is due", "rent due monthly"), (2, "Same words", "same words"), (3, "", "blank other"), (4, "a b", "éclair über")]
    df = spark.createDataFrame(pairs, "id int, l string, r string")
    fit = [t for _, a, b in pairs for t in (a, b)]
    for r in pair_similarity(df, ["id"], "l", "r", salts).collect():
        assert abs(r["similarity"] - brute_tfidf(fit, r["l"], r["r"])) < 1e-9
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["pay the rent", "return the deposit", "the capital"])], "corpus_id int, text string")
    queries = spark.createDataFrame([("x", "how to pay the rent"), ("y", "unrelated")], "query_id string, text string")
    got = {(r["query_id"], r["rank"]): r for r in nearest_texts(corpus, queries, stopwords=("the", "to")).collect()}
    assert got[("x", 1)]["corpus_id"] == 0 and got[("x", 1)]["grounded"] and not got[("y", None)]["grounded"] and ("x", 2) not in got


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_in_many_blocks(spark, metric):
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 5)).round(1)
    x[10] = x[3]  # a copy
    group = [i % 7 for i in range(90)]
    rows = [("s" if i < 70 else "t", i, i, i, group[i], x[i].tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "scope string, query_id int, item_id int, own int, grp int, vector array<double>")
    for exclude in ("own", "grp"):
        got = {}
        for n in nearest(df, df, ["scope"], 4, metric, exclude=exclude, block_rows=16).collect():
            got.setdefault(n["query_id"], {})[n["rank"]] = (n["item_id"], n["distance"])
        for q in range(90):
            pool = [i for i in range(90) if (i < 70) == (q < 70) and (i != q if exclude == "own" else group[i] != group[q])]
            d = {i: float(np.sqrt(((x[i] - x[q]) ** 2).sum())) if metric == "euclidean" else 1 - float(x[i] @ x[q]) / float(np.linalg.norm(x[i]) * np.linalg.norm(x[q])) for i in pool}
            want = sorted(pool, key=lambda i: (round(d[i], 12), i))[:4]
            assert [got[q][k][0] for k in (1, 2, 3, 4)] == want
    labels = df.select("item_id", (F.col("item_id") % 2).alias("label"))
    one = neighbour_vote(nearest(df, df, ["scope"], 3, exclude="own"), labels)
    assert {r["query_id"]: r["prediction"] for r in one.collect()}[10] == 1  # its copy, row 3, decides alone


def test_scoring(spark):
    t = [(True, "a", True), (True, "a", False), (True, "b", True), (False, None, True), (False, None, False)]
    df = spark.createDataFrame([("m", *x) for x in t], "method string, drift_injected boolean, drift_type string, predicted boolean")
    s = detector_scores(df).first()
    assert (s["tp"], s["fp"], s["fn"], s["tn"]) == (2, 1, 1, 1) and s["f1"] == pytest.approx(2 / 3) and s["false_positive_rate"] == 0.5
    quiet = detector_scores(df.withColumn("predicted", F.lit(False))).first()
    assert (quiet["precision"], quiet["recall"], quiet["f1"]) == (0, 0, 0)
    y = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, pred string")
    rep = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in class_report(confusion(y, "label", "pred")).collect()}
    assert rep == {"a": (1.0, 0.5, 2), "b": (pytest.approx(1 / 3), 1.0, 1), "c": (0.0, 0.0, 1)}
    m = majority_class(spark.createDataFrame([("b", 3), ("a", 3), ("c", 1)], "label string, n bigint")).first()
    assert m["majority"] == "a" and m["accuracy"] == 3 / 7
    sweep = threshold_sweep(spark.createDataFrame([(True, 0.9), (False, 0.6), (True, 0.3)], "y boolean, s double"), F.col("y"), F.col("s")).collect()
    assert [r["n_predicted_flagged"] for r in sweep] == [3, 3, 3, 2, 2, 2, 1, 1, 1] and sweep[0]["recall"] == 1.0


def test_evaluation(spark):
    rows = [
        ("x", [1, 2], [5, 2, 1], [2], True, False, "yes", "want", 0.8, 10.0),
        ("x", [9], [5, 2], [5], True, False, "yes", "want", 0.4, 20.0),
        ("y", [1], [1], [], False, True, " ", "want", 0.9, 30.0),
    ]
    schema = "category string, relevant_chunks array<int>, retrieved_chunks array<int>, cited_chunks array<int>, grounded boolean, parse_error boolean, answer string, expected_answer string, similarity double, latency_ms double"
    df = spark.createDataFrame(rows, schema).withColumns({"retrieval_latency_ms": F.col("latency_ms"), "generation_latency_ms": F.col("latency_ms")})
    s = score_cases(df)
    got = [(r["retrieval_hit"], r["retrieval_rank"], r["citation_correct"], r["refused"], r["semantic_similarity"]) for r in s.collect()]
    assert got == [(True, 2, True, False, 0.8), (False, None, False, False, 0.4), (True, 1, False, True, 0.0)]
    r = summarize(s).first()
    assert r["retrieval_hit_rate"] == pytest.approx(2 / 3) and r["citation_correctness"] == 0.5 and r["latency_p95_ms"] == 30.0
    assert {x["category"]: x["n_cases"] for x in by_category(s).collect()} == {None: 3, "x": 2, "y": 1}
    worse = summarize(s).withColumn("refusal_rate", F.lit(0.9))
    gate = {x["metric"]: x["status"] for x in quality_gate(summarize(s).withColumn("k", F.lit(1)), worse.withColumn("k", F.lit(1)), ["k"]).collect()}
    assert gate == {"retrieval_hit_rate": "PASS", "citation_correctness": "PASS", "mean_semantic_similarity": "PASS", "refusal_rate": "REGRESSION"}
    hits = {x["top_k"]: x["h"] for x in score_cases(narrowed(df, [1, 3])).groupBy("top_k").agg(F.sum(F.col("retrieval_hit").cast("int")).alias("h")).collect()}
    assert hits == {1: 1, 3: 2}


def test_splits_and_models(spark):
    r = np.random.default_rng(3)
    rows = [(i, i // 2, "flagged" if i % 4 < 2 else "none", (r.normal(size=3) + (2 if i % 4 < 2 else 0)).tolist(), ("bad clause risk" if i % 4 < 2 else "plain fine text") + f" word{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "id int, grp int, label string, vector array<double>, text string")
    split = stratified_split(df, "id", "label")
    assert {x["label"]: x["n"] for x in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {"flagged": 10, "none": 10}
    oof = out_of_fold_probabilities(df, "grp", 3)
    assert oof.count() == 80 and oof.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    right = oof.where((F.col("probability") > 0.5) == (F.col("label") == "flagged")).count()
    assert right > 64
    scored = text_classifier(split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test"))
    assert scored.where("label = prediction").count() == 20
    pts = np.array([p["point"] for p in principal_components(df, "id", "vector").orderBy("id").collect()])
    x = np.array([v[3] for v in rows])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(pts), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    assert principal_components(df.limit(2), "id", "vector").count() == 0


def test_multinomial_text_classes(spark):
    rng = np.random.default_rng(3)
    words = {"none": "rent lease tenant", "high": "penalty forfeit seize", "medium": "notice renew period", "low": "colour paint carpet"}
    rows = [(i, f"g{i % 13}", label, " ".join(rng.choice((w + " shared common words").split(), 12))) for i in range(160) for label, w in [list(words.items())[i % 4]]] + [(900, "g1", "none", None), (901, "g2", "none", "")]
    df = spark.createDataFrame(rows, "id long, grp string, label string, text string").na.fill("", ["text"])
    assert class_names(df) == ["none", "high", "low", "medium"]
    found = out_of_fold_classes(df, "grp", 4, buckets=1 << 10).collect()
    assert sorted(r["id"] for r in found) == sorted(r[0] for r in rows)
    by_group = {}
    for r in found:
        by_group.setdefault(r["grp"], set()).add(r["fold"])
        assert abs(sum(r["probabilities"]) - 1) < 1e-9 and len(r["probabilities"]) == 4
    assert all(len(f) == 1 for f in by_group.values()) and len(set().union(*by_group.values())) > 1
    assert np.mean([r["prediction"] == r["label"] for r in found if r["id"] < 900]) > 0.9
    one = class_scores(df.where("label = 'none'"), df.limit(3)).collect()
    assert {r["prediction"] for r in one} == {"none"}


def test_softmax_fit_is_a_stationary_point(spark):
    """The gradient of the weighted, regularised loss vanishes at the fitted coefficients."""
    from lakesignal.operators import classify

    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    y = np.argmax(x[:, :4] + rng.normal(size=(120, 4)), axis=1)
    df = spark.createDataFrame([(str(k), v.tolist()) for v, k in zip(x, y)], "label string, v array<double>")
    ready = classify._numbered(classify.balanced_weights(df), "label", ["0", "1", "2", "3"]).withColumn("features", array_to_vector("v"))
    model = classify._fit_lr(ready, "multinomial", 1e-12)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weight = (120 / (4 * np.bincount(y)))[y]
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p = p / p.sum(axis=1, keepdims=True)
    error = (p - np.eye(4)[y]) * weight[:, None]
    gradient = error.T @ x / weight.sum() + w / 120
    assert np.abs(gradient).max() < 1e-4 and np.abs(error.sum(axis=0) / weight.sum()).max() < 1e-4


def test_folds_share_the_term_counts(spark):
    from lakesignal.operators import classify

    words = {"none": ["rent", "roof", "tenant"], "de": ["und", "das", "haus"], "fr": ["le", "toit", "loyer"]}
    rows = [(i, i % 7, k, " ".join([*w[: 2 + i % 2], f"n{i % 4}"])) for k, w in words.items() for i in range(12)]
    df = spark.createDataFrame(rows, "id int, grp int, label string, text string")
    out = classify.out_of_fold_classes(df, "grp", 3, buckets=1 << 10)
    assert out.columns == ["id", "grp", "label", "text", "fold", "prediction", "probabilities"] and out.count() == len(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_tok" not in plan and "_bi" not in plan  # no fold takes the texts apart again
    # each fold's model is that of its own rows
    fold = out.where("fold = 0")
    train = out.where("fold <> 0").select("id", "label", "text")
    alone = classify.class_scores(train, fold.select("id", "label", "text"), classes=classify.class_names(df), buckets=1 << 10)
    assert {(r["id"], r["label"]): r["prediction"] for r in alone.collect()} == {(r["id"], r["label"]): r["prediction"] for r in fold.collect()}
