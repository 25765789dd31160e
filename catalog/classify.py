"""Classifier jobs over embeddings, labels and documents."""

from pyspark.sql import functions as F

from catalog import query, table
from lakesignal.operators.classify import (
    binary_label,
    folds,
    majority_prediction,
    out_of_fold_probabilities,
    out_of_fold_classes,
    principal_components,
    review_sample,
    stratified_split,
    text_classifier,
)
from lakesignal.operators.neighbours import nearest, neighbour_vote
from lakesignal.operators.scoring import threshold_sweep
from lakesignal.scale import attach_row, pinned
from lakesignal.sources.datasets import combined, pending_groups


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.expr("stack(1, 'all') as (scope)"), F.col("vec_id").alias("query_id"), F.col("vec_id").alias("item_id"), F.col("vec_id").alias("own"), (F.col("vec_id") % 60).alias("group_id"), "label", F.col("embedding").alias("vector")
    )


def _knn_sql(condition, k):
    return f"""with p as (select a.vec_id as q, b.vec_id as i, b.label, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda x: (a.embedding[x]::double - b.embedding[x]::double) ** 2))) as d
  from embeddings a join embeddings b on {condition}),
n as (select *, row_number() over (partition by q order by round(d, 12), i) as rank from p qualify rank <= {k})"""


@query("knn_neighbours", _knn_sql("a.vec_id <> b.vec_id", 5) + " select q as query_id, i as item_id, round(d, 6) as distance, rank::int as rank from n")
def knn_neighbours(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return nearest(v, v, ["scope"], 5, exclude="own").select("query_id", "item_id", F.round("distance", 6).alias("distance"), "rank")


_VOTE = """, w as (select q, label, case when max((d = 0)::int) over (partition by q) = 1 then (d = 0)::int::double else 1 / d end as w from n),
s as (select q, label, round(sum(w), 9) as w from w group by 1, 2)
select q as query_id, arg_min(label, (-w, label)) as prediction from s group by 1"""


def _vote(spark, sf_dir, k, exclude, weighted=True):
    v = vectors(spark, sf_dir)
    found = nearest(v, v, ["scope"], k, exclude=exclude)
    return neighbour_vote(found, v.select("item_id", "label"), ["query_id"], weighted)


@query("knn_predictions", _knn_sql("a.vec_id <> b.vec_id", 5) + _VOTE)
def knn_predictions(spark, sf_dir):
    """Leave-one-out 5-NN, distance weighted."""
    return _vote(spark, sf_dir, 5, "own")


@query("nearest_neighbour_predictions", _knn_sql("a.vec_id <> b.vec_id", 1) + " select q as query_id, label as prediction from n")
def nearest_neighbour_predictions(spark, sf_dir):
    return _vote(spark, sf_dir, 1, "own", weighted=False)


@query("group_knn", _knn_sql("a.vec_id % 60 <> b.vec_id % 60", 5) + _VOTE)
def group_knn(spark, sf_dir):
    """Leave-one-group-out: rows of the query's own group are never neighbours."""
    return _vote(spark, sf_dir, 5, "group_id")


@query("binary_labels", "select vec_id, case when label = 0 then 'none' else 'flagged' end as label from embeddings")
def binary_labels(spark, sf_dir):
    name = F.when(F.col("label") == 0, "none").otherwise(F.col("label").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", binary_label(name).alias("label"))


@query(
    "majority_predictions",
    "select vec_id, (select arg_min(label, (-n, label)) from (select label, count(*) as n from embeddings group by 1)) as prediction from embeddings",
)
def majority_predictions(spark, sf_dir):
    return majority_prediction(table(spark, sf_dir, "embeddings").select("vec_id", "label")).select("vec_id", "prediction")


@query("stratified_split", "select label, count(*)::bigint as n, ceil(count(*) * 0.25)::bigint as n_test from embeddings group by 1")
def stratified_split_query(spark, sf_dir):
    """Sizes of the split per label (which rows are picked depends on the hash function)."""
    s = stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query("group_folds", "select count(distinct source)::bigint as groups, 0::bigint as leaking from documents")
def group_folds(spark, sf_dir):
    """No source ends up in two folds."""
    f = folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5).groupBy("source").agg(F.count_distinct("fold").alias("n"))
    return f.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("leaking"))


@query("review_sample", "select case when label = 0 then 'none' else 'flagged' end as label, case when label = 0 then least(20, count(*)) else count(*) end::bigint as n from (select case when label = 0 then 0 else 1 end as label from embeddings) group by label")
def review_sample_query(spark, sf_dir):
    """All flagged rows and 20 of the others."""
    named = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 0, "none").otherwise("flagged").alias("label"))
    return review_sample(named, "vec_id", "label", 20).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "combined_clauses",
    """select source || ':' || doc_id as group_id, false as is_synthetic from documents union all
select d.source || ':' || d.doc_id, true from documents d join labels l using (doc_id) where l.quality = 0""",
)
def combined_clauses(spark, sf_dir):
    """Documents plus one paraphrase row for each low-quality one, sharing its group."""
    d = table(spark, sf_dir, "documents").select("text", F.col("source").alias("source_document"), F.col("doc_id").alias("chunk_index"))
    low = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("chunk_index"))
    synthetic = d.join(low, "chunk_index").select(F.concat(F.lit("again: "), "text").alias("text"), F.concat_ws(":", "source_document", F.col("chunk_index").cast("string")).alias("group_id"))
    return combined(d, synthetic).select("group_id", "is_synthetic")


@query("pending_groups", "with d as (select o_custkey, count(*) as n from orders group by 1) select c_custkey as group_id, 10 - coalesce(n, 0) as missing from customer left join d on o_custkey = c_custkey where coalesce(n, 0) < 10")
def pending_groups_query(spark, sf_dir):
    """Customers that do not have ten orders yet."""
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"))
    return pending_groups(groups, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id")), 10)


@query("pca_points")
def pca_points(spark, sf_dir):
    p = principal_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return p.select("vec_id", F.round(F.col("point")[0], 4).alias("x"), F.round(F.col("point")[1], 4).alias("y"))


def _flagged(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", (F.col("vec_id") % 60).alias("group_id"), F.when(F.col("label") < 3, "flagged").otherwise("none").alias("label"), F.col("embedding").alias("vector"))


@query("lr_out_of_fold")
def lr_out_of_fold(spark, sf_dir):
    """Pooled out-of-fold probabilities of a balanced logistic regression, by group folds."""
    return out_of_fold_probabilities(_flagged(spark, sf_dir), "group_id").select("vec_id", "label", F.round("probability", 4).alias("probability"))


@query("lr_threshold_sweep")
def lr_threshold_sweep(spark, sf_dir):
    oof = pinned(out_of_fold_probabilities(_flagged(spark, sf_dir), "group_id"))
    return threshold_sweep(oof, F.col("label") == "flagged", F.col("probability"))


@query("text_classes", "select lang, count(*)::bigint as n, true as mostly_right, 0::bigint as leaking from documents where lang is not null group by 1")
def text_classes(spark, sf_dir):
    """Four languages told apart out of fold, by sources: every row once, nine of ten of all right, no source on both sides."""
    d = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "source", "text", F.col("lang").alias("label"))
    found = pinned(out_of_fold_classes(d, "source", 3, buckets=1 << 14).select("doc_id", "source", "label", "fold", "prediction"))
    leaking = found.groupBy("source").agg(F.count_distinct("fold").alias("f")).agg(F.count_if(F.col("f") > 1).alias("leaking"))
    right = found.agg((F.avg((F.col("prediction") == F.col("label")).cast("double")) >= 0.9).alias("mostly_right"))
    return attach_row(attach_row(found.groupBy(F.col("label").alias("lang")).agg(F.count(F.lit(1)).alias("n")), right), leaking)


@query("text_classifier")
def text_classifier_query(spark, sf_dir):
    """TF-IDF and balanced logistic regression on document quality, 75/25 stratified split."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "flagged").otherwise("none").alias("label"))
    split = pinned(stratified_split(lab.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "label"))
    scored = text_classifier(split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test"))
    return scored.select("doc_id", "label", "prediction", F.round("probability", 4).alias("probability"))
