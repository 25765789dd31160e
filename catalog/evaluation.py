"""Case scores, summaries, regression gate, classifier reports."""

from pyspark.sql import functions as F

from catalog import query, table
from catalog.drift import halves
from lakesignal.functions.text import keyword_category
from lakesignal.operators.evaluation import by_category, gate_verdict, narrowed, quality_gate, score_cases, summarize
from lakesignal.operators.scoring import class_report, confusion, label_distribution, majority_class, report_summary, threshold_sweep
from lakesignal.scale import pinned
from lakesignal.sources.datasets import numbered_cases


def cases(spark, sf_dir):
    """One evaluation case per event; chunk lists follow the number in its props."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.select(
        F.col("event_id").alias("case_id"),
        F.col("event_type").alias("category"),
        halves("ts", "2024-01-16").alias("sample"),
        F.array(F.col("k") % 5, F.col("k") % 7).alias("relevant_chunks"),
        F.array(F.col("k") % 3, (F.col("k") + 1) % 6, (F.col("k") * 2) % 9).alias("retrieved_chunks"),
        F.array((F.col("k") + 1) % 6).alias("cited_chunks"),
        (F.col("user_id") % 6 != 0).alias("grounded"),
        (F.col("user_id") % 31 == 0).alias("parse_error"),
        F.col("value").alias("latency_ms"),
        (F.col("value") * 0.1).alias("retrieval_latency_ms"),
        (F.col("value") * 0.9).alias("generation_latency_ms"),
        F.when(F.col("k") % 10 == 0, " ").otherwise("yes").alias("answer"),
        F.lit("text").alias("expected_answer"),
        (F.col("value") / (F.col("value") + 50)).alias("similarity"),
    )


CASES = """
k as (select *, (props->>'$.k')::int as k from events),
ca as (select event_id as case_id, event_type as category, case when ts < timestamp '2024-01-16' then 'baseline' else 'current' end as sample,
   [k % 5, k % 7] as rel, [k % 3, (k + 1) % 6, (k * 2) % 9] as ret, [(k + 1) % 6] as cit, user_id % 6 <> 0 as grounded, user_id % 31 = 0 as parse_error, value as l, value * 0.1 as rl, value * 0.9 as gl,
   case when k % 10 = 0 then 0.0 else value / (value + 50) end as sim from k),
sc as (select *, list_has_any(rel, ret) as hit, list_min(list_filter(list_transform(rel, lambda r: list_position(ret, r)), lambda p: p is not null and p > 0)) as rk,
   grounded and list_has_any(rel, cit) as cc from ca)"""

_P95 = "list_sort(list({x}))[greatest(1, least(count(*), round_even(0.95 * count(*) + 0.5, 0)::bigint))]"
_SUMMARY = f"""round(avg(hit::int), 6) as retrieval_hit_rate, round(coalesce(avg(cc::int) filter (where grounded), 0), 6) as citation_correctness,
  round(avg((not grounded)::int), 6) as refusal_rate, round(avg(parse_error::int), 6) as parse_error_rate, round(avg(sim), 6) as mean_semantic_similarity,
  round({_P95.replace('{x}', 'l')}, 6) as latency_p95_ms, round({_P95.replace('{x}', 'rl')}, 6) as retrieval_latency_p95_ms, round({_P95.replace('{x}', 'gl')}, 6) as generation_latency_p95_ms"""


def _rounded(df, keep=("n_cases",)):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("case_scores", f"with {CASES} select case_id, hit as retrieval_hit, rk::int as retrieval_rank, cc as citation_correct, not grounded as refused, round(sim, 6) as semantic_similarity from sc")
def case_scores(spark, sf_dir):
    s = score_cases(cases(spark, sf_dir))
    return s.select("case_id", "retrieval_hit", "retrieval_rank", "citation_correct", "refused", F.round("semantic_similarity", 6).alias("semantic_similarity"))


@query("eval_summary", f"with {CASES} select count(*)::bigint as n_cases, {_SUMMARY} from sc")
def eval_summary(spark, sf_dir):
    return _rounded(summarize(score_cases(cases(spark, sf_dir))))


@query(
    "eval_by_category",
    f"""with {CASES} select category, grouping(category)::int as is_total, count(*)::bigint as n_cases, round(avg(hit::int), 6) as retrieval_hit_rate, round(avg(sim), 6) as mean_semantic_similarity
from sc group by grouping sets ((), (category))""",
)
def eval_by_category(spark, sf_dir):
    return _rounded(by_category(score_cases(cases(spark, sf_dir)))).withColumn("is_total", F.col("is_total").cast("int"))


_GATE = f"""with {CASES}, s as (select sample, category, {_SUMMARY} from sc group by 1, 2),
l as (select sample, category, metric, v from s unpivot (v for metric in (retrieval_hit_rate, citation_correctness, mean_semantic_similarity, refusal_rate))),
g as (select b.category, b.metric, b.v as baseline_value, c.v as current_value from l b join l c on b.category = c.category and b.metric = c.metric and b.sample = 'baseline' and c.sample = 'current'),
gg as (select *, case when metric = 'refusal_rate' then current_value - baseline_value > 0.02 else current_value - baseline_value < -0.02 end as bad from g)
"""


def _gate(spark, sf_dir):
    s = pinned(_rounded(summarize(score_cases(cases(spark, sf_dir)), ["sample", "category"])))
    return quality_gate(s.where("sample = 'baseline'"), s.where("sample = 'current'"), ["category"], tolerance=0.02)


@query("quality_gate", _GATE + "select category, metric, baseline_value, current_value, case when bad then 'REGRESSION' else 'PASS' end as status from gg")
def quality_gate_query(spark, sf_dir):
    return _gate(spark, sf_dir)


@query("gate_verdict", _GATE + "select category, bool_or(bad) as any_regression from gg group by 1")
def gate_verdict_query(spark, sf_dir):
    return gate_verdict(_gate(spark, sf_dir), ["category"])


@query(
    "variant_comparison",
    f"""with {CASES}, v as (select ca.* exclude (ret), top_k, ret[1:top_k] as ret from ca, (values (1), (2), (3)) t(top_k)),
w as (select *, list_has_any(rel, ret) as hit, list_min(list_filter(list_transform(rel, lambda r: list_position(ret, r)), lambda p: p is not null and p > 0)) as rk from v)
select top_k, count(*)::bigint as n_cases, round(avg(hit::int), 6) as retrieval_hit_rate, round(avg(rk), 6) as mean_rank from w group by 1""",
)
def variant_comparison(spark, sf_dir):
    """The same cases with the retrieval narrowed to 1, 2 and 3 chunks."""
    s = score_cases(narrowed(cases(spark, sf_dir), [1, 2, 3]))
    return s.groupBy("top_k").agg(
        F.count(F.lit(1)).alias("n_cases"), F.round(F.avg(F.col("retrieval_hit").cast("double")), 6).alias("retrieval_hit_rate"), F.round(F.avg("retrieval_rank"), 6).alias("mean_rank")
    )


_KEYWORDS = [(" the ", "english"), (" und ", "german"), (" le ", "french"), (" que ", "spanish"), ("http", "link")]


@query(
    "question_category",
    """select conv_id, turn, case when contains(lower(text), ' the ') then 'english' when contains(lower(text), ' und ') then 'german' when contains(lower(text), ' le ') then 'french'
  when contains(lower(text), ' que ') then 'spanish' when contains(lower(text), 'http') then 'link' else 'general' end as category from conversations""",
)
def question_category(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", keyword_category(F.col("text"), _KEYWORDS).alias("category"))


@query(
    "numbered_cases",
    """with n as (select doc_id, source, row_number() over (partition by source order by doc_id) as rn from documents)
select doc_id, source || '-' || case when rn < 10 then '0' || rn else rn::varchar end as id from n""",
)
def numbered_cases_query(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("corpus/"), "source", F.lit(".pdf")).alias("path"))
    return numbered_cases(d, "path", ["doc_id"]).select("doc_id", "id")


# -- classifier reports ----------------------------------------------------------------

_PRED = """
pr as (select l.doc_id, case when quality = 1 then 'good' else 'bad' end as label,
  case when length(regexp_replace(d.text, '[^a-zA-Z]', '', 'g')) > 0.6 * length(d.text) then 'good' else 'bad' end as prediction,
  1 - toxic * 0.5 - (l.doc_id % 10) / 25 as score from labels l join documents d using (doc_id))"""


def predictions(spark, sf_dir):
    """A letter-share rule as classifier of document quality, against the labels table."""
    letters = F.length(F.regexp_replace("text", "[^a-zA-Z]", ""))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(letters > 0.6 * F.length("text"), "good").otherwise("bad").alias("prediction"))
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), (1 - F.col("toxic") * 0.5 - (F.col("doc_id") % 10) / 25).alias("score")
    )
    return lab.join(d, "doc_id")


@query("confusion", f"with {_PRED} select label, prediction, count(*)::bigint as n from pr group by 1, 2")
def confusion_query(spark, sf_dir):
    return confusion(predictions(spark, sf_dir), "label", "prediction")


_REPORT = f"""with {_PRED}, c as (select c as class, count(*) filter (where label = c) as support, count(*) filter (where prediction = c) as chosen, count(*) filter (where label = c and prediction = c) as hit
  from pr, (values ('good'), ('bad')) t(c) group by 1),
r as (select class, coalesce(hit / nullif(chosen, 0), 0) as p, coalesce(hit / nullif(support, 0), 0) as r, support from c),
f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from r)"""


@query("class_report", _REPORT + " select class, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, support::bigint as support from f")
def class_report_query(spark, sf_dir):
    return _rounded(class_report(confusion(predictions(spark, sf_dir), "label", "prediction")))


@query("report_summary", _REPORT + " select round((select avg((label = prediction)::int) from pr), 6) as accuracy, round(avg(f1), 6) as macro_f1 from f")
def report_summary_query(spark, sf_dir):
    cells = pinned(confusion(predictions(spark, sf_dir), "label", "prediction"))
    return _rounded(report_summary(cells, class_report(cells)))


@query(
    "threshold_sweep",
    f"""with {_PRED}, t as (select threshold, count(*) filter (where score >= threshold) as f, count(*) filter (where score >= threshold and label = 'good') as tp, count(*) filter (where label = 'good') as pos
  from pr, (values (0.1), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) v(threshold) group by 1)
select threshold::double as threshold, round(coalesce(tp / nullif(f, 0), 0), 6) as precision, round(coalesce(tp / nullif(pos, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(f + pos, 0), 0), 6) as f1, f::bigint as n_predicted_flagged from t""",
)
def threshold_sweep_query(spark, sf_dir):
    return _rounded(threshold_sweep(predictions(spark, sf_dir), F.col("label") == "good", F.col("score")))


@query("label_distribution", f"with {_PRED} select label, count(*)::bigint as n from pr group by 1")
def label_distribution_query(spark, sf_dir):
    return label_distribution(predictions(spark, sf_dir), "label")


@query("majority_class", "with c as (select label, quality, count(*) as n from embeddings join labels on vec_id = doc_id group by 1, 2) select label, arg_min(quality, (-n, quality)) as majority, round(max(n) / sum(n), 6) as accuracy from c group by 1")
def majority_class_query(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("segment"))
    joined = e.join(table(spark, sf_dir, "labels"), "doc_id")
    m = majority_class(label_distribution(joined, "quality", ["segment"]), ["segment"])
    return m.select(F.col("segment").alias("label"), "majority", F.round("accuracy", 6).alias("accuracy"))


@query("classifier_accuracy", f"with {_PRED} select label, round(avg((label = prediction)::int), 6) as quality_score from pr group by 1")
def classifier_accuracy(spark, sf_dir):
    from lakesignal.plans.tabular_check import accuracy

    a = accuracy(predictions(spark, sf_dir).withColumn("segment", F.col("label")), ["segment"], "prediction", "label")
    return a.select(F.col("segment").alias("label"), F.round("quality_score", 6).alias("quality_score"))
