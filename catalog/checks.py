"""Telemetry, retrieval-application and golden-set checks."""

from pyspark.sql import functions as F

from catalog import query, table
from catalog.drift import _KS_P, halves
from lakesignal.operators.embedding_drift import mmd_test
from lakesignal.operators.tfidf import pair_similarity
from lakesignal.plans.golden_check import golden_signals, golden_verdict, match_golden
from lakesignal.plans.rag_check import pooled_samples, rag_signals, rag_verdict
from lakesignal.plans.telemetry_check import telemetry_metrics, telemetry_signals, telemetry_verdict
from lakesignal.scale import pinned
from lakesignal.sources.telemetry import record_events, with_embedding


def telemetry(spark, sf_dir):
    """Request telemetry read off the events table: an 'error' is a refusal, ``value`` the latency."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        (F.col("user_id") % 5).alias("segment"),
        (F.col("event_type") != "error").alias("grounded"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.least(k % 3, k % 4)).alias("citations"),
        (k % 4).alias("citations_requested"),
        F.col("value").alias("latency_ms"),
        (F.col("value") * 0.8).alias("generation_latency_ms"),
        F.array(k / 100.0, F.col("value") / 500.0).alias("retrieval_scores"),
        halves("ts", "2024-01-16").alias("sample"),
    )


TEL = """
k as (select *, (props->>'$.k')::int as k from events),
tel as (
  select event_id, ts, user_id % 5 as segment, event_type <> 'error' as grounded,
         case when event_type = 'error' then 0 else least(k % 3, k % 4) end as citations, k % 4 as citations_requested,
         value as latency_ms, value * 0.8 as generation_latency_ms, k / 100 as score1, value / 500 as score2,
         case when ts < timestamp '2024-01-16' then 'baseline' else 'current' end as sample
  from k)"""

_METRICS = """
  round(avg((not grounded)::int), 6) as refusal_rate, round(avg((citations > 0)::int), 6) as citation_rate,
  round(list_sort(list(latency_ms))[greatest(1, least(count(*), round_even(0.95 * count(*) + 0.5, 0)::bigint))], 6) as latency_p95_ms,
  count(*)::bigint as n_events"""


@query(
    "telemetry_metrics_daily",
    f"with {TEL} select strftime(ts, '%Y-%m-%d') as day, {_METRICS} from tel group by 1",
)
def telemetry_metrics_daily(spark, sf_dir):
    events = telemetry(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return _rounded_metrics(telemetry_metrics(events, ["day"]), "day")


def _rounded_metrics(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("refusal_rate", "citation_rate", "latency_p95_ms")], "n_events")


_TCHECK = f"""with {TEL},
m as (select segment, sample, avg((not grounded)::int) as r, avg((citations > 0)::int) as c,
      list_sort(list(latency_ms))[greatest(1, least(count(*), round_even(0.95 * count(*) + 0.5, 0)::bigint))] as l, count(*) as n
      from tel group by 1, 2),
j as (select c.segment, c.r, c.c, c.l, c.n, b.r as br, b.c as bc, b.l as bl, case when b.l > 0 then c.l / b.l else 1.0 end as ratio
      from m c join m b on c.segment = b.segment and c.sample = 'current' and b.sample = 'baseline'),
s as (
  select segment, 'refusal rate' as name, r as value, n >= 5 and r - br > 0.20 as is_drifted, br as baseline, r as cur from j union all
  select segment, 'citation rate', c, n >= 5 and bc - c > 0.25, bc, c from j union all
  select segment, 'latency p95', least(1.0, ratio / 5), n >= 5 and ratio > 2.5, bl, l from j)
"""


def _telemetry_check(spark, sf_dir):
    metrics = pinned(telemetry_metrics(telemetry(spark, sf_dir), ["segment", "sample"]))
    base = metrics.where("sample = 'baseline'").drop("sample")
    return telemetry_signals(base, metrics.where("sample = 'current'").drop("sample"), ["segment"])


@query("telemetry_check", _TCHECK + 'select segment, name, round(value, 6) as value, is_drifted, round(baseline, 6) as baseline, round(cur, 6) as "current" from s')
def telemetry_check(spark, sf_dir):
    return _telemetry_check(spark, sf_dir).select(
        "segment", "name", F.round("value", 6).alias("value"), "is_drifted", F.round("baseline", 6).alias("baseline"), F.round("current", 6).alias("current")
    )


@query(
    "telemetry_verdict",
    _TCHECK
    + """select segment, round(avg(is_drifted::int), 6) as drift_score, round(1 - max(case when name = 'refusal rate' then value end), 6) as quality_score,
  bool_or(is_drifted) as is_drifted from s group by 1""",
)
def telemetry_verdict_query(spark, sf_dir):
    return telemetry_verdict(_telemetry_check(spark, sf_dir), ["segment"]).select(
        "segment", F.round("drift_score", 6).alias("drift_score"), F.round("quality_score", 6).alias("quality_score"), "is_drifted"
    )


def _events_with_vectors(spark, sf_dir):
    """Every 20th event carries a question embedding, the others none."""
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 20).alias("event_id"), F.col("embedding").cast("array<double>").alias("question_embedding"))
    return telemetry(spark, sf_dir).join(vectors, "event_id", "left")


_POOLED = """
pool as (select segment, sample, 'retrieval' as name, score1 as value from tel union all
         select segment, sample, 'retrieval', score2 from tel union all
         select segment, sample, 'generation_latency', generation_latency_ms from tel),
cnt as (select segment, name, value, count(*) filter (where sample = 'baseline') as nb, count(*) filter (where sample = 'current') as nc from pool group by 1, 2, 3),
rk as (select *, sum(nb) over w as cb, sum(nc) over w as cc, sum(nb) over p as n_b, sum(nc) over p as n_c, lead(value) over (partition by segment, name order by value) as nxt
       from cnt window w as (partition by segment, name order by value rows unbounded preceding), p as (partition by segment, name)),
d as (select segment, name, max(abs(cb / n_b - cc / n_c)) as d, sum(abs(cb / n_b - cc / n_c) * (nxt - value)) as w, max(n_b) as n_b, max(n_c) as n_c from rk group by 1, 2),
iqr as (select segment, name, greatest(quantile_cont(value, .75) - quantile_cont(value, .25), 1e-9) as iqr from pool where sample = 'baseline' group by 1, 2)"""

_MMD_SQL = """
pairs as (select a.g, a.sample as sa, b.sample as sb, a.id = b.id as self, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) ** 2)) as sq
          from vec a join vec b on a.g = b.g),
gam as (select g, 1 / (2 * coalesce(median(sq) filter (where sq > 0), 1)) as gamma from pairs group by 1),
ker as (select g, sum(exp(-gamma * sq)) filter (where sa = 'baseline' and sb = 'baseline' and not self) as xx,
               sum(exp(-gamma * sq)) filter (where sa = 'current' and sb = 'current' and not self) as yy,
               sum(exp(-gamma * sq)) filter (where sa = 'baseline' and sb = 'current') as xy, max(gamma) as gamma
        from pairs join gam using (g) group by 1),
siz as (select g, count(*) filter (where sample = 'baseline') as m, count(*) filter (where sample = 'current') as n from vec group by 1),
mmd as (select g, m, n, gamma, xx / (m * (m - 1)) + yy / (n * (n - 1)) - 2 * xy / (m * n) as mmd2 from ker join siz using (g))"""


_RAG_SQL = f"""{TEL}, {_POOLED},
ksp as ({_KS_P.format(src="d")}),
prop as (select segment, 'refusal' as name, count(*) filter (where sample = 'baseline' and not grounded) as xb, count(*) filter (where sample = 'baseline') as nb,
                count(*) filter (where sample = 'current' and not grounded) as xc, count(*) filter (where sample = 'current') as nc from tel group by 1
         union all
         select segment, 'citation_validity', sum(citations) filter (where sample = 'baseline'), sum(citations_requested) filter (where sample = 'baseline'),
                sum(citations) filter (where sample = 'current'), sum(citations_requested) filter (where sample = 'current') from tel group by 1),
vec as (select e.segment as g, e.event_id as id, e.sample, v.embedding::double[] as v from tel e join embeddings v on e.event_id = v.vec_id * 20)"""


@query(
    "rag_signals",
    f"""with {_RAG_SQL},
{_MMD_SQL}
select segment, name, round(d, 6) as value, p < 0.05 or (name = 'retrieval' and w / iqr > 0.2) as is_drifted from ksp join iqr using (segment, name)
union all
select segment, name, round(xc / nc, 6), abs((xc / nc - xb / nb) / sqrt((xb + xc) / (nb + nc) * (1 - (xb + xc) / (nb + nc)) * (1 / nb + 1 / nc))) > 1.959963984540054 from prop
union all
select s.segment, 'embedding', round(case when m >= 8 and n >= 8 then mmd2 else 0 end, 6), null from (select distinct segment from tel) s left join mmd on mmd.g = s.segment""",
)
def rag_signals_query(spark, sf_dir):
    signals = rag_signals(_events_with_vectors(spark, sf_dir), ["segment"])
    return signals.select(
        "segment", "name", F.round("value", 6).alias("value"), F.when(F.col("name") != "embedding", F.col("is_drifted")).alias("is_drifted")
    )


@query("rag_verdict")
def rag_verdict_query(spark, sf_dir):
    """The embedding verdict is a permutation test over exact pairs, so the whole-check row has no SQL form."""
    events = _events_with_vectors(spark, sf_dir)
    return rag_verdict(rag_signals(events, ["segment"]), events, ["segment"])


@query(
    "mmd_observed",
    f"""with vec as (select 'all' as g, vec_id as id, case when label < 5 then 'baseline' else 'current' end as sample, embedding::double[] as v from embeddings), {_MMD_SQL}
select round(mmd2, 8) as statistic, round(gamma, 8) as gamma, m::bigint as n_baseline, n::bigint as n_current from mmd""",
)
def mmd_observed(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.expr("stack(1, 'all') as (g)"),
        F.when(F.col("label") < 5, "baseline").otherwise("current").alias("sample"),
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return mmd_test(vectors, ["g"]).select(
        F.round("statistic", 8).alias("statistic"), F.round(F.col("detail")["gamma"], 8).alias("gamma"), "n_baseline", "n_current"
    )


# The features' frequencies and the permutations, as lakesignal.operators.mean_embedding draws them.
def _mixed_sql(x: str) -> str:
    x = f"(({x})::ubigint % 4294967296)"
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = f"(list_transform([{x}], lambda x: (xor(x, x >> {shift}) * {factor}::ubigint) % 4294967296)[1])"
    return f"(list_transform([{x}], lambda x: xor(x, x >> 16))[1])"


def _feature_mmd_sql(permutations: int, count: int = 256) -> str:
    u = lambda i: f"(({_mixed_sql(f'2 * c + {i}')})::double + 0.5) / 4294967296"
    return f"""
dim as (select max(len(v)) as d from vec),
wave as (select c // d as j, list(sqrt(-2 * ln({u(1)})) * cos(2 * pi() * {u(2)}) order by c) as w from (select unnest(range({count} * d)) as c, d from dim) group by 1),
spr as (select g, 2 * (n * squares - list_dot_product(total, total)) / (n * (n - 1)) as spread from
  (select g, max(n) as n, max(squares) as squares, list(s order by i) as total from (select g, i, sum(x) as s from (select g, generate_subscripts(v, 1) as i, unnest(v) as x from vec) group by 1, 2)
   join (select g, count(*) as n, sum(list_dot_product(v, v)) as squares from vec group by 1) using (g) group by 1)),
gam as (select g, case when spread > 0 then 1 / (2 * spread) else 0.5 end as gamma from spr),
siz as (select g, count(*) filter (where sample = 'baseline') as m, count(*) filter (where sample = 'current') as n from vec group by 1),
fea as (select g, id, j, cos(sqrt(2 * gamma) * list_dot_product(v, w)) as re, sin(sqrt(2 * gamma) * list_dot_product(v, w)) as im from vec join gam using (g), wave),
turn as (select p, {_mixed_sql('p')} as t from (select unnest(range(1, {permutations} + 1)) as p)),
lab as (select g, id, 0 as p, sample = 'baseline' as b from vec union all
  select g, id, p, {_mixed_sql("xor(('0x' || substr(md5(id::varchar), 1, 8))::ubigint, t)")}::double < m / (m + n) * 4294967296 as b from vec join siz using (g), turn),
num as (select g, p, count(*) filter (where b)::double as m, count(*) filter (where not b)::double as n from lab group by 1, 2),
sid as (select g, p, j, sum(re) filter (where b) as rb, sum(im) filter (where b) as ib, sum(re) filter (where not b) as rc, sum(im) filter (where not b) as ic from lab join fea using (g, id) group by 1, 2, 3),
sta as (select g, p, avg((rb * rb + ib * ib - m) / (m * (m - 1)) + (rc * rc + ic * ic - n) / (n * (n - 1)) - 2 * (rb * rc + ib * ic) / (m * n)) as mmd2 from sid join num using (g, p) group by 1, 2),
fmmd as (select o.g, o.mmd2, gamma, siz.m, siz.n, (1 + count(*) filter (where s.p > 0 and s.mmd2 >= o.mmd2)) / ({permutations} + 1) as p_value
  from sta o join sta s using (g) join gam using (g) join siz using (g) where o.p = 0 group by all)"""


@query(
    "mmd_features",
    f"""with vec as (select label % 3 as g, vec_id as id, case when label < 5 then 'baseline' else 'current' end as sample, embedding::double[] as v from embeddings), {_feature_mmd_sql(100)}
select g, round(mmd2, 8) as statistic, round(gamma, 8) as gamma, p_value, m::bigint as n_baseline, n::bigint as n_current from fmmd""",
)
def mmd_features(spark, sf_dir):
    """Three drift tests by random features, p-values included."""
    vectors = table(spark, sf_dir, "embeddings").select(
        (F.col("label") % 3).alias("g"),
        F.when(F.col("label") < 5, "baseline").otherwise("current").alias("sample"),
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return mmd_test(vectors, ["g"], permutations=100, method="features").select(
        "g", F.round("statistic", 8).alias("statistic"), F.round(F.col("detail")["gamma"], 8).alias("gamma"), "p_value", "n_baseline", "n_current"
    )


@query(
    "rag_verdict_linear",
    f"""with {_RAG_SQL}, {_feature_mmd_sql(100)},
sig as (select segment, p < 0.05 or (name = 'retrieval' and w / iqr > 0.2) as drifted from ksp join iqr using (segment, name) union all
  select segment, abs((xc / nc - xb / nb) / sqrt((xb + xc) / (nb + nc) * (1 - (xb + xc) / (nb + nc)) * (1 / nb + 1 / nc))) > 1.959963984540054 from prop union all
  select segment, coalesce(m >= 8 and n >= 8 and p_value < 0.05, false) from (select distinct segment from tel) left join fmmd on g = segment)
select segment, count(*) filter (where drifted) / 5 as drift_score, bool_or(drifted) as is_drifted, count(*) filter (where drifted)::bigint as n_signals_drifted, true as sufficient_sample,
  (select round(avg(grounded::int), 6) from tel t where t.segment = sig.segment and t.sample = 'current') as quality_score from sig group by segment""",
)
def rag_verdict_linear(spark, sf_dir):
    """The whole check with the linear-time embedding test, whose permutations SQL can repeat."""
    events = _events_with_vectors(spark, sf_dir)
    verdict = rag_verdict(rag_signals(events, ["segment"], permutations=100, mmd_method="features"), events, ["segment"])
    return verdict.withColumn("quality_score", F.round("quality_score", 6))


@query(
    "embedding_width_reasons",
    """with v as (select label as g, case when vec_id % 2 = 0 then 'baseline' else 'current' end as s, len(embedding) - case when label = 3 and vec_id % 2 = 1 then 1 else 0 end as w from embeddings where label <> 5 or vec_id < 40),
c as (select g, count(*) filter (where s = 'baseline') as m, count(*) filter (where s = 'current') as n, array_to_string(list_sort(list_distinct(list(w) filter (where s = 'baseline'))), '/') as b,
  array_to_string(list_sort(list_distinct(list(w) filter (where s = 'current'))), '/') as d, count(distinct w) > 1 as mixed from v group by 1)
select g, m::bigint as n_baseline, n::bigint as n_current, m < 8 or n < 8 or mixed as insufficient_sample,
  case when m < 8 or n < 8 then 'fewer than 8 vectors on a side' when mixed then 'vectors of different widths: baseline ' || b || ', current ' || d end as reason from c""",
)
def embedding_width_reasons(spark, sf_dir):
    """Label 3 lost a dimension in its current half, label 5 has few vectors."""
    from lakesignal.operators.embedding_drift import width_reasons

    odd = F.col("vec_id") % 2 == 1
    v = table(spark, sf_dir, "embeddings").where("label <> 5 or vec_id < 40")
    cut = F.when((F.col("label") == 3) & odd, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding"))
    return width_reasons(v.select(F.col("label").alias("g"), F.when(odd, "current").otherwise("baseline").alias("sample"), cut.alias("embedding")), ["g"])


@query(
    "embedding_width_check",
    """select label, count(distinct len(embedding)) > 1 as width_mismatch, count(*)::bigint as n from embeddings group by 1""",
)
def embedding_width_check(spark, sf_dir):
    from lakesignal.operators.embedding_drift import _counted

    vectors = table(spark, sf_dir, "embeddings").select("label", F.lit("baseline").alias("sample"), "embedding")
    return _counted(vectors, ["label"], 1024).select("label", "width_mismatch", F.col("n_baseline").alias("n"))


@query(
    "record_telemetry",
    f"""with {TEL} select event_id, round(latency_ms, 1) as latency_ms, round(generation_latency_ms, 1) as generation_latency_ms,
  round(score1, 4) as score1, round(score2, 4) as score2 from tel""",
)
def record_telemetry(spark, sf_dir):
    """Rounding at append time: latencies to one decimal, scores to four."""
    rec = record_events(telemetry(spark, sf_dir))
    return rec.select("event_id", "latency_ms", "generation_latency_ms", rec.retrieval_scores[0].alias("score1"), rec.retrieval_scores[1].alias("score2"))


@query(
    "events_with_embedding",
    f"with {TEL} select event_id, len(embedding)::int as width from tel join embeddings on event_id = vec_id * 20 where len(embedding) > 0",
)
def events_with_embedding(spark, sf_dir):
    return with_embedding(_events_with_vectors(spark, sf_dir)).select("event_id", F.size("question_embedding").alias("width"))


@query(
    "pooled_scores",
    f"""with {TEL}, {_POOLED.split('cnt as')[0].rstrip().rstrip(',')}
select sample, name as signal, count(*)::bigint as n, round(sum(value), 4) as total from pool group by 1, 2""",
)
def pooled_scores(spark, sf_dir):
    return pooled_samples(telemetry(spark, sf_dir), []).groupBy("sample", "signal").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_TURNS = """
turns as (select u.conv_id, u.turn, u.text as prompt, a.text as answer from conversations u
          join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user'),
gold as (select prompt, arg_max(answer, conv_id * 1000 + turn) as expected from turns group by 1),
matched as (select conv_id, turn, t.prompt, expected, answer from turns t join gold g on t.prompt = g.prompt)"""

_SIM = r"""
tok as (
  select conv_id, turn, true as l, unnest(regexp_extract_all(lower(expected), '[\p{L}\p{N}_]{2,}')) as term from {src} union all
  select conv_id, turn, false, unnest(regexp_extract_all(lower(answer), '[\p{L}\p{N}_]{2,}')) from {src}),
tf as (select conv_id, turn, l, term, count(*) as tf from tok group by 1, 2, 3, 4),
idf as (select term, ln((1 + (select 2 * count(*) from {src})) / (1 + count(*))) + 1 as idf from tf group by 1),
w as (select conv_id, turn, l, term, tf * idf as w from tf join idf using (term)),
nrm as (select conv_id, turn, l, sqrt(sum(w * w)) as nrm from w group by 1, 2, 3),
dot as (select a.conv_id, a.turn, sum(a.w * b.w) as dot from w a join w b using (conv_id, turn, term) where a.l and not b.l group by 1, 2),
sim as (select m.conv_id, m.turn, m.prompt, coalesce(dot / (x.nrm * y.nrm), 0.0) as sim from {src} m left join dot using (conv_id, turn)
        left join nrm x on x.conv_id = m.conv_id and x.turn = m.turn and x.l left join nrm y on y.conv_id = m.conv_id and y.turn = m.turn and not y.l)"""


def _turns(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    user = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"])


def _matched(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    golden = turns.select("prompt", F.col("answer").alias("expected_answer"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"))
    return match_golden(golden, turns.withColumnRenamed("answer", "actual_answer"))


@query("golden_match", f"with {_TURNS} select conv_id, turn, md5(expected) as expected, md5(answer) as actual from matched")
def golden_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("conv_id", "turn", F.md5("expected_answer").alias("expected"), F.md5("actual_answer").alias("actual"))


@query(
    "tfidf_similarity",
    "with src as (select conv_id, turn, prompt, prompt as expected, answer from turns), ".replace("with src", f"with {_TURNS}, src")
    + _SIM.replace("{src}", "src")
    + " select conv_id, turn, round(sim, 6) as similarity from sim",
)
def tfidf_similarity(spark, sf_dir):
    """How lexically close each assistant turn is to the user turn it answers."""
    return pair_similarity(_turns(spark, sf_dir), ["conv_id", "turn"], "prompt", "answer").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@query(
    "golden_check",
    f"with {_TURNS}, {_SIM.replace('{src}', 'matched')} select conv_id, turn, left(prompt, 80) as name, round(sim, 6) as value, sim < 0.35 as is_drifted from sim",
)
def golden_check(spark, sf_dir):
    s = golden_signals(_matched(spark, sf_dir), ["conv_id", "turn"])
    return s.select("conv_id", "turn", "name", F.round("value", 6).alias("value"), "is_drifted")


@query(
    "golden_verdict",
    f"""with {_TURNS}, {_SIM.replace('{src}', 'matched')},
a as (select avg(sim) as m, case when count(*) > 1 then stddev_samp(sim) else 0 end as sd, count(*) as n from sim)
select round(greatest(0, 1 - m), 6) as drift_score, round(m, 6) as quality_score, m < 0.35 as is_drifted, n::bigint as n_prompts, round(sd, 6) as std_dev,
  round(sd / sqrt(n), 6) as std_error, round(greatest(0, m - 1.96 * sd / sqrt(n)), 6) as ci95_low, round(least(1, m + 1.96 * sd / sqrt(n)), 6) as ci95_high from a""",
)
def golden_verdict_query(spark, sf_dir):
    v = golden_verdict(golden_signals(_matched(spark, sf_dir), ["conv_id", "turn"]))
    return v.select(*[F.round(c, 6).alias(c) if c not in ("is_drifted", "n_prompts") else F.col(c) for c in v.columns])
