"""Lexical, dense and fused retrieval; nearest neighbours."""

from pyspark.sql import functions as F

from catalog import query, table
from catalog.text import CHUNKS, chunk_table, docs
from lakesignal.functions.text import first_words
from lakesignal.operators.neighbours import nearest
from lakesignal.operators.postings import asked_of_documents, build_postings, dense_distances, dense_top_k, fused_top_k, merged_excerpts
from lakesignal.operators.retrieval import first_relevant_rank, fuse
from lakesignal.operators.tfidf import nearest_texts
from lakesignal.operators.vector_index import fit_index, recall
from lakesignal.scale import attach_row, pinned

_QUERY = "array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[4:9], ' ')"
_CH = f"{CHUNKS}, qu as (select doc_id, doc_id as query_id, {_QUERY} as text from documents)"

_BM25 = f"""{_CH},
sz as (select doc_id, chunk_index, regexp_extract_all(lower(text), '\\S+') as w, len(regexp_extract_all(lower(text), '\\S+')) as ln from chunks),
stt as (select doc_id, count(*) as n, avg(ln) as al from sz group by 1),
btf as (select doc_id, chunk_index, ln, term, count(*) as tf from (select doc_id, chunk_index, ln, unnest(w) as term from sz) group by 1, 2, 3, 4),
bdf as (select doc_id, term, ln(max(n) - count(*) + .5) - ln(count(*) + .5) as idf, max(al) as al from btf join stt using (doc_id) group by 1, 2),
bix as (select *, case when idf < 0 then 0.25 * avg(idf) over (partition by doc_id) else idf end as idf2 from bdf),
bw as (select doc_id, chunk_index, term, idf2 * tf * 2.5 / (tf + 1.5 * (.25 + .75 * ln / al)) as w from btf join bix using (doc_id, term)),
bq as (select doc_id, query_id, unnest(regexp_extract_all(lower(text), '\\S+')) as term from qu),
bs as (select doc_id, query_id, chunk_index, sum(w) as score from bq join bw using (doc_id, term) group by 1, 2, 3),
br as (select q.doc_id, q.query_id, c.chunk_index, coalesce(score, 0) as score, row_number() over (partition by q.query_id order by round(coalesce(score, 0), 9) desc, c.chunk_index) as rank
       from qu q join chunks c using (doc_id) left join bs using (doc_id, query_id, chunk_index))"""


def questions(spark, sf_dir):
    """A question per document: six words from its beginning."""
    words = F.slice(first_words(F.col("text"), 9), 4, 6)
    return docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("query_id"), F.array_join(words, " ").alias("text"))


@query("bm25_topk", f"with {_BM25} select doc_id, chunk_index::int as chunk_index, round(score, 6) as score, rank::int as rank from br where rank <= 6")
def bm25_topk(spark, sf_dir):
    chunks = pinned(chunk_table(spark, sf_dir))
    q = pinned(questions(spark, sf_dir))
    return build_postings(chunks, queries=q).top_k(q, 6).select("doc_id", "chunk_index", F.round("score", 6).alias("score"), "rank")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VEC = "list_transform(string_split('" + _LETTERS + "', ''), lambda l: (length(lower({x})) - length(replace(lower({x}), l, '')))::double)"


def letter_vector(text):
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(ch), F.lit("")))).cast("double") for ch in _LETTERS])


_DENSE = f"""{_BM25},
dq as (select doc_id, query_id, {_VEC.replace('{x}', 'text')} as v from qu),
dc as (select doc_id, chunk_index, {_VEC.replace('{x}', 'text')} as v from chunks),
dd as (select dq.doc_id, query_id, chunk_index, case when list_dot_product(dq.v, dq.v) = 0 or list_dot_product(dc.v, dc.v) = 0 then 1.0
         else 1 - list_dot_product(dq.v, dc.v) / (sqrt(list_dot_product(dq.v, dq.v)) * sqrt(list_dot_product(dc.v, dc.v))) end as distance from dq join dc using (doc_id)),
dr as (select *, row_number() over (partition by query_id order by round(distance, 12), chunk_index) as rank from dd),
fu as (select query_id, doc_id, chunk_index, sum(1 / (60 + rank)) as score, max(case when d then rank end) as dense_rank from
        (select query_id, doc_id, chunk_index, rank, true as d from dr union all select query_id, doc_id, chunk_index, rank, false from br) group by 1, 2, 3),
hy as (select *, row_number() over (partition by query_id order by round(score, 12) desc, dense_rank, chunk_index) as rank from fu)"""


def _distances(q, chunks):
    """Dense distances inside the document, on letter-count vectors (no embedding model is needed for the operator)."""
    vectors = lambda df, *cols: df.select("doc_id", *cols, letter_vector(F.col("text")).alias("vector"))
    return dense_distances(vectors(q, "query_id"), vectors(chunks, "chunk_index"))


@query("dense_in_document", f"with {_DENSE} select doc_id, chunk_index::int as chunk_index, round(distance, 6) as distance, rank::int as rank from dr where rank <= 6")
def dense_in_document(spark, sf_dir):
    distances = _distances(questions(spark, sf_dir), chunk_table(spark, sf_dir))
    return dense_top_k(distances, ["doc_id", "query_id"], 6).select("doc_id", "chunk_index", F.round("distance", 6).alias("distance"), "rank")


def _hybrid(spark, sf_dir, k):
    chunks = pinned(chunk_table(spark, sf_dir))
    q = pinned(questions(spark, sf_dir))
    return _fused(q, chunks, build_postings(chunks, queries=q), k)


def _fused(q, chunks, postings, k):
    keys = ["doc_id", "query_id"]
    return fused_top_k(_distances(q, chunks), lambda n: postings.top_k(q, n), lambda some: postings.every_score(q.join(some, keys, "left_semi")), keys, k)


@query("hybrid_topk", f"with {_DENSE} select doc_id, chunk_index::int as chunk_index, round(score, 6) as score, rank::int as rank from hy where rank <= 6")
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, 6).select("doc_id", "chunk_index", F.round("score", 6).alias("score"), "rank")


@query(
    "cross_document_topk",
    f"with {_DENSE} select d.source, doc_id, chunk_index::int as chunk_index, rank::int as rank from hy join documents d using (doc_id) where rank <= 4",
)
def cross_document_topk(spark, sf_dir):
    """Four excerpts per document, merged and labelled with the document's source."""
    top = _hybrid(spark, sf_dir, 4)
    return top.join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id").select("source", "doc_id", "chunk_index", "rank")


_LISTED = "ls as (select d.doc_id as query_id, p as position, o.doc_id, o.source as label from documents d, (select unnest([0, 1, 2]) as p) join documents o on o.doc_id = (d.doc_id + p * 7) where d.doc_id % 5 = 0)"
_LISTED_DENSE = _DENSE.replace(f"qu as (select doc_id, doc_id as query_id, {_QUERY} as text from documents)", f"{_LISTED}, qu as (select ls.doc_id, ls.query_id * 10 + position as query_id, {_QUERY} as text from ls join documents d on d.doc_id = ls.query_id)")


@query(
    "cross_document_excerpts",
    f"""with {_LISTED_DENSE}
select ls.query_id, row_number() over (partition by ls.query_id order by position, rank)::int as excerpt, ls.doc_id, label, chunk_index::int as chunk_index
from hy join ls on hy.query_id = ls.query_id * 10 + position where rank <= 4""",
)
def cross_document_excerpts(spark, sf_dir):
    """A question asked of three documents each: four excerpts of every one, merged in list order and numbered."""
    d = docs(spark, sf_dir).select("doc_id", "source")
    asked = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("position"))
    asked = asked.withColumn("doc_id", F.col("query_id") + F.col("position") * 7)
    lists = pinned(asked.join(d, "doc_id").select("query_id", "position", "doc_id", F.col("source").alias("label")))
    q = pinned(asked_of_documents(questions(spark, sf_dir).drop("doc_id"), lists))
    chunks = pinned(chunk_table(spark, sf_dir).join(lists.select("doc_id").distinct(), "doc_id", "left_semi"))
    return merged_excerpts(_fused(q, chunks, build_postings(chunks, queries=q), 4), lists)


@query(
    "rrf_fusion",
    """with r as (select o_orderpriority as query_id, o_custkey as item_id, row_number() over (partition by o_orderpriority order by sum(o_totalprice) desc, o_custkey) as rank from orders group by 1, 2 union all
  select o_orderpriority, o_custkey, row_number() over (partition by o_orderpriority order by count(*) desc, o_custkey) from orders group by 1, 2)
select query_id, item_id, round(sum(1 / (60 + rank)), 8) as score from r group by 1, 2""",
)
def rrf_fusion(spark, sf_dir):
    """Customers ranked by spend and by order count, fused per priority; ranks come from a distributed numbering."""
    from lakesignal.scale import numbered

    per = pinned(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("item_id")).agg((-F.sum("o_totalprice")).alias("s"), (-F.count(F.lit(1))).alias("c")))
    a = numbered(per, ["query_id"], ["s", "item_id"], "rank").select("query_id", "item_id", "rank")
    b = numbered(per, ["query_id"], ["c", "item_id"], "rank").select("query_id", "item_id", "rank")
    return fuse(a.unionByName(b)).select("query_id", "item_id", F.round("score", 8).alias("score"))


@query(
    "first_relevant_rank",
    f"""with {_BM25} select br.query_id, min(rank) filter (where chunk_index % 3 = 1)::int as first_relevant_rank from br where rank <= 6 group by 1""",
)
def first_relevant_rank_query(spark, sf_dir):
    """Chunks with index 1, 4, 7, ... count as relevant."""
    chunks = pinned(chunk_table(spark, sf_dir))
    q = pinned(questions(spark, sf_dir))
    ranked = build_postings(chunks, queries=q).top_k(q, 6)
    ranked = pinned(ranked.select("query_id", F.col("chunk_index").alias("item_id"), "rank"))
    relevant = chunks.where("chunk_index % 3 = 1").select(F.col("doc_id").alias("query_id"), F.col("chunk_index").alias("item_id"))
    return first_relevant_rank(ranked, relevant)


_STOPS = ("the", "of", "and", "to", "in", "is", "that", "for", "on", "with")


@query(
    "tfidf_nearest",
    r"""with c as (select item_id as cid, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda t: not list_contains(['the','of','and','to','in','is','that','for','on','with'], t))) as term from benchmark),
ctf as (select cid, term, count(*) as tf from c group by 1, 2),
idf as (select term, ln((1 + (select count(*) from benchmark)) / (1 + count(*))) + 1 as idf from ctf group by 1),
cw as (select cid, term, tf * idf as w from ctf join idf using (term)), cn as (select cid, sqrt(sum(w * w)) as n from cw group by 1),
q as (select doc_id as qid, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda t: not list_contains(['the','of','and','to','in','is','that','for','on','with'], t))) as term from documents),
qtf as (select qid, term, count(*) as tf from q group by 1, 2), qw as (select qid, term, tf * idf as w from qtf join idf using (term)), qn as (select qid, sqrt(sum(w * w)) as n from qw group by 1),
s as (select qid, cid, sum(cw.w * qw.w) / (max(cn.n) * max(qn.n)) as sim from cw join qw using (term) join cn using (cid) join qn using (qid) group by 1, 2),
r as (select *, row_number() over (partition by qid order by round(sim, 12) desc, cid) as rank from s)
select d.doc_id as query_id, rank::int as rank, cid as corpus_id, case when sim is not null then round(greatest(0, least(1, sim)), 6) end as similarity,
  coalesce(max(sim) over (partition by d.doc_id) >= 0.05, false) as grounded from documents d left join (select * from r where rank <= 3) on qid = d.doc_id""",
)
def tfidf_nearest(spark, sf_dir):
    """Every document against the benchmark passages, model fitted on the passages."""
    corpus = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("corpus_id"), "text")
    q = docs(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "text")
    return nearest_texts(corpus, q, stopwords=_STOPS).select("query_id", "rank", "corpus_id", F.round("similarity", 6).alias("similarity"), "grounded")


@query(
    "dense_topk",
    """with p as (select a.label, a.vec_id as query_id, b.vec_id as item_id, 1 - list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))) as d
  from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id)
select label, query_id, item_id, round(d, 6) + 0.0 as distance, row_number() over (partition by query_id order by round(d, 12), item_id)::int as rank from p qualify rank <= 6""",
)
def dense_topk(spark, sf_dir):
    """Six nearest vectors of the same label for every vector, by cosine distance."""
    v = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("query_id"), F.col("vec_id").alias("item_id"), F.col("vec_id").alias("own"), F.col("embedding").alias("vector"))
    return nearest(v, v, ["label"], 6, "cosine", exclude="own").select("label", "query_id", "item_id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def _routed(spark, sf_dir):
    """Index of all vectors by cosine, and as queries those whose id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings").where("embedding is not null")
    items = v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("own"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").alias("own"))
    index = fit_index(items, "cosine")
    return index.calibrated(asked, 10, exclude="own"), asked


@query("routed_topk")
def routed_topk(spark, sf_dir):
    """Ten nearest vectors through the routed index; which list a row is in depends on the fit, so SQL has no equal."""
    index, asked = _routed(spark, sf_dir)
    return index.search(asked, 10, exclude="own")


@query(
    "routed_recall",
    "select count(*)::bigint as items, count(*) filter (where vec_id % 20 = 0)::bigint as queries, 10 * count(*) filter (where vec_id % 20 = 0)::bigint as wanted, true as enough from embeddings where embedding is not null",
)
def routed_recall(spark, sf_dir):
    """Whether the routed index finds nine tenths of the true neighbours, measured against all rows."""
    index, asked = _routed(spark, sf_dir)
    whole = lambda df: df.withColumn("all", F.lit(0))
    truth = pinned(nearest(whole(asked), whole(index.rows.select("item_id", "vector", "own")), ["all"], 10, "cosine", exclude="own"))
    share = recall(index.search(asked, 10, exclude="own"), truth)
    counts = index.rows.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("item_id") % 20 == 0).alias("queries"))
    return attach_row(counts, truth.agg(F.count(F.lit(1)).alias("wanted"))).withColumn("enough", F.lit(share >= 0.9))
