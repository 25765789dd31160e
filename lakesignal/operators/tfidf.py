"""TF-IDF with smoothed idf ``ln((1+n)/(1+df)) + 1`` and unit-length vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.scale import attach_row, pinned, salted_lookup, top_per_key

#: Fixed value: tokens are runs of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def document_frequencies(terms: DataFrame, n_docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """``(term, idf)`` from rows ``(..., term)`` that are distinct per document; ``n_docs`` is one row."""
    df = terms.groupBy("term").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("df"))
    return attach_row(df, n_docs).select("term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def pair_similarity(pairs: DataFrame, pair_id: Sequence[str], left: str, right: str, salts: int = 1) -> DataFrame:
    """Cosine of the two texts of every row, the model fitted on all texts of both columns.

    The lookup of a frequent term is a skewed join; a regrouping follows it, so
    adaptive execution may split the skewed partitions.  ``salts`` > 1 splits
    every term up front instead.
    """
    ids = list(pair_id)
    pairs = pinned(pairs)  # read for the terms, their number and the result: whatever made the pairs runs once
    both = pairs.select(*ids, tokens(F.col(left)).alias("_l"), tokens(F.col(right)).alias("_r"))
    n_docs = pairs.agg((F.count(F.lit(1)) * 2).alias("n_docs"))
    exploded = both.select(
        *ids,
        F.explode(
            F.concat(
                F.transform("_l", lambda t: F.struct(t.alias("term"), F.lit(True).alias("is_left"))),
                F.transform("_r", lambda t: F.struct(t.alias("term"), F.lit(False).alias("is_left"))),
            )
        ).alias("t"),
    )
    counts = pinned(
        exploded.groupBy(*ids, F.col("t.term").alias("term")).agg(F.count_if("t.is_left").alias("tl"), F.count_if(~F.col("t.is_left")).alias("tr"))
    )
    idf = document_frequencies(counts, n_docs, (F.col("tl") > 0).cast("int") + (F.col("tr") > 0).cast("int"))
    weighted = salted_lookup(counts, idf, ["term"], salts)
    w2 = F.col("idf") * F.col("idf")
    dots = weighted.groupBy(*ids).agg(
        F.sum(F.col("tl") * F.col("tr") * w2).alias("_dot"),
        F.sqrt(F.sum(F.col("tl") * F.col("tl") * w2)).alias("_nl"),
        F.sqrt(F.sum(F.col("tr") * F.col("tr") * w2)).alias("_nr"),
    )
    scored = dots.select(*ids, F.when((F.col("_nl") > 0) & (F.col("_nr") > 0), F.col("_dot") / (F.col("_nl") * F.col("_nr"))).otherwise(0.0).alias("similarity"))
    return pairs.join(scored, ids, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def pair_similarity_by(pairs: DataFrame, keys: Sequence[str], pair_id: Sequence[str], left: str, right: str) -> DataFrame:
    """``pair_similarity`` with a model of its own for each key: fitted on the texts of both columns of the key's pairs.

    Weights are looked up by (key, term), so neither a frequent term nor a key with most pairs meets in one task.
    """
    keys, ids = list(keys), [*keys, *pair_id]
    both = pinned(pairs.select(*ids, tokens(F.col(left)).alias("_l"), tokens(F.col(right)).alias("_r")))
    sides = F.concat(
        F.transform("_l", lambda t: F.struct(t.alias("term"), F.lit(True).alias("is_left"))), F.transform("_r", lambda t: F.struct(t.alias("term"), F.lit(False).alias("is_left")))
    )
    counts = both.select(*ids, F.explode(sides).alias("t")).groupBy(*ids, F.col("t.term").alias("term"))
    counts = pinned(counts.agg(F.count_if("t.is_left").alias("tl"), F.count_if(~F.col("t.is_left")).alias("tr")))
    sizes = both.groupBy(*keys).agg((F.count(F.lit(1)) * 2).alias("n_docs"))
    seen = counts.groupBy(*keys, "term").agg(F.sum((F.col("tl") > 0).cast("int") + (F.col("tr") > 0).cast("int")).alias("df")).join(sizes, keys)
    idf = pinned(seen.select(*keys, "term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")))
    w2 = F.col("idf") * F.col("idf")
    dots = counts.join(idf, [*keys, "term"]).groupBy(*ids).agg(
        F.sum(F.col("tl") * F.col("tr") * w2).alias("_dot"), F.sqrt(F.sum(F.col("tl") * F.col("tl") * w2)).alias("_nl"), F.sqrt(F.sum(F.col("tr") * F.col("tr") * w2)).alias("_nr")
    )
    cosine = F.when((F.col("_nl") > 0) & (F.col("_nr") > 0), F.col("_dot") / (F.col("_nl") * F.col("_nr"))).otherwise(0.0)
    return pairs.join(dots.select(*ids, cosine.alias("similarity")), ids, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def _kept(text: Column, stopwords: Sequence[str]) -> Column:
    toks = tokens(text)
    return F.filter(toks, lambda t: ~t.isin(list(stopwords))) if stopwords else toks


def _terms(df: DataFrame, ids: Sequence[str], text: str, stopwords: Sequence[str]) -> DataFrame:
    return df.select(*ids, F.explode(_kept(F.col(text), stopwords)).alias("term")).groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))


def nearest_texts(
    corpus: DataFrame,
    queries: DataFrame,
    corpus_id: str = "corpus_id",
    query_id: str = "query_id",
    text: str = "text",
    top_k: int = 3,
    stopwords: Sequence[str] = (),
    floor: float = 0.05,
) -> DataFrame:
    """Top-k corpus texts per query by TF-IDF cosine; the model is fitted on the corpus only.

    Only pairs sharing a term are formed.  Columns: query_id, rank, corpus_id,
    similarity (clamped to [0,1]), grounded (top similarity >= floor).  A query
    with no shared term at all gives one row with a null corpus_id.
    """
    c = _terms(corpus, [corpus_id], text, stopwords)
    n_docs = corpus.agg(F.count(F.lit(1)).alias("n_docs"))
    idf = pinned(document_frequencies(c, n_docs))  # the fitted model: its size decides how it is joined
    # the weighted corpus is small beside the queries: its size decides the join, so that a frequent term of the queries need not meet in one task
    cw = pinned(c.join(idf, "term").select(corpus_id, "term", (F.col("tf") * F.col("idf")).alias("w")))
    cn = cw.groupBy(corpus_id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("cn"))
    known = queries.select(query_id, F.explode(_kept(F.col(text), stopwords)).alias("term")).join(idf, "term")
    qw = known.groupBy(query_id, "term").agg((F.count(F.lit(1)) * F.first("idf")).alias("qw"))
    qn = qw.groupBy(query_id).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = cw.join(qw, "term").groupBy(query_id, corpus_id).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dots.join(cn, corpus_id).join(qn, query_id)
    scored = scored.select(query_id, corpus_id, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dot") / (F.col("cn") * F.col("qn")))).alias("similarity"))
    best = top_per_key(scored, [query_id], [F.desc(F.round("similarity", 12)), F.col(corpus_id)], top_k)
    out = queries.select(query_id).join(best, query_id, "left")
    top = best.where("rank = 1").select(query_id, (F.col("similarity") >= floor).alias("grounded"))
    return out.join(top, query_id, "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
