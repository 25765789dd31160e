"""Run history, health, alerts, calibration and diagnosis."""

from pyspark.sql import functions as F

from catalog import query, table
from catalog.checks import TEL, telemetry
from lakesignal.operators.scoring import ablation_verdicts, detector_scores, recall_by_type
from lakesignal.plans.calibration import calibrate, single_check_fpr
from lakesignal.plans.diagnosis import diagnose_runs, diagnose_traces, signal_confidence
from lakesignal.plans.health import alert_lifecycle, alert_message, baseline_as_of, current_health, health_timeline, latest_baseline, streaks
from lakesignal.scale import pinned
from lakesignal.sources import registry
from lakesignal.streaming.health import replayed_health


def hourly_runs(spark, sf_dir):
    """One check per event type and hour: drifted when the mean value is above 55."""
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)")
    mean = F.avg("value")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("model_id"), hour.alias("run_id"))
        .agg(
            F.round(mean / 97, 6).alias("drift_score"),
            F.when(F.count(F.lit(1)) > 2, F.round(1 - mean / 593, 6)).alias("quality_score"),
            (mean > 55).alias("is_drifted"),
        )
    )


RUNS = """
runs as (select event_type as model_id, datediff('hour', timestamp '2024-01-01', ts) as run_id, round(avg(value) / 97, 6) as drift_score,
                case when count(*) > 2 then round(1 - avg(value) / 593, 6) end as quality_score, avg(value) > 55 as is_drifted
         from events group by 1, 2)"""


def _fold(warn, degr, rec):
    """The state machine as a recursive query, one run at a time."""
    return f"""recursive {RUNS},
o as (select *, row_number() over (partition by model_id order by run_id) as rn from runs),
h as (
  select model_id, 0::bigint as run_id, 0::bigint as rn, 'healthy' as state, 0::bigint as cd, 0::bigint as cc, false as opens, false as resolves
  from (select distinct model_id from runs)
  union all
  select o.model_id, o.run_id, o.rn,
    case when o.is_drifted then
           case when h.cd + 1 >= {degr} then 'degraded' when h.cd + 1 >= {warn} then 'warning'
                when h.state in ('degraded', 'recovering') then h.state else 'healthy' end
         when h.state = 'degraded' then case when h.cc + 1 >= {rec} then 'recovering' else 'degraded' end
         else 'healthy' end,
    case when o.is_drifted then h.cd + 1 else 0 end, case when o.is_drifted then 0 else h.cc + 1 end,
    o.is_drifted and h.cd + 1 >= {degr} and h.state not in ('degraded', 'recovering'),
    not o.is_drifted and h.state = 'recovering'
  from h join o on o.model_id = h.model_id and o.rn = h.rn + 1),
tl as (select * from h where rn > 0)"""


_TL = "model_id, run_id, state, cd as consecutive_drifted, cc as consecutive_clean, opens as opens_alert, resolves as resolves_alerts"


def _timeline(spark, sf_dir, *limits):
    t = health_timeline(hourly_runs(spark, sf_dir), ["model_id"], ["run_id"], *limits)
    return t.select("model_id", "run_id", "state", "consecutive_drifted", "consecutive_clean", "opens_alert", "resolves_alerts")


@query("health_timeline", f"with {_fold(1, 1, 1)} select {_TL} from tl")
def health_timeline_default(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query("health_timeline_hysteresis", f"with {_fold(1, 2, 2)} select {_TL} from tl")
def health_timeline_hysteresis(spark, sf_dir):
    return _timeline(spark, sf_dir, 1, 2, 2)


@query("health_replay", f"with {_fold(1, 2, 2)} select {_TL} from tl")
def health_replay(spark, sf_dir):
    """The same runs in three parts, as micro-batches bring them: each part starts from the states before it."""
    runs = pinned(hourly_runs(spark, sf_dir))
    cut = lambda lo, hi: runs.where((F.col("run_id") >= lo) & (F.col("run_id") < hi))
    t = replayed_health([cut(-(10**9), 240), cut(240, 250), cut(250, 10**9)], (1, 2, 2), ["run_id"])
    return t.select("model_id", "run_id", "state", "consecutive_drifted", "consecutive_clean", "opens_alert", "resolves_alerts")


@query("health_timeline_three_strikes", f"with {_fold(2, 3, 2)} select {_TL} from tl")
def health_timeline_three_strikes(spark, sf_dir):
    return _timeline(spark, sf_dir, 2, 3, 2)


@query(
    "drift_streaks",
    f"""with {RUNS}, o as (select *, row_number() over (partition by model_id order by run_id) as rn,
  row_number() over (partition by model_id, is_drifted order by run_id) as rv from runs)
select model_id, run_id, case when is_drifted then row_number() over (partition by model_id, is_drifted, rn - rv order by run_id) else 0 end as consecutive_drifted,
  case when not is_drifted then row_number() over (partition by model_id, is_drifted, rn - rv order by run_id) else 0 end as consecutive_clean from o""",
)
def drift_streaks(spark, sf_dir):
    return streaks(hourly_runs(spark, sf_dir), ["model_id"], ["run_id"]).select("model_id", "run_id", "consecutive_drifted", "consecutive_clean")


@query(
    "alert_lifecycle",
    f"""with {_fold(1, 2, 2)}
select a.model_id, a.run_id, min(r.run_id) as resolved_at, min(r.run_id) is not null as resolved
from tl a left join tl r on r.model_id = a.model_id and r.resolves and r.rn > a.rn where a.opens group by 1, 2""",
)
def alert_lifecycle_query(spark, sf_dir):
    timeline = pinned(health_timeline(hourly_runs(spark, sf_dir), ["model_id"], ["run_id"], 1, 2, 2))
    return alert_lifecycle(timeline, ts="run_id").select("model_id", "run_id", "resolved_at", "resolved")


@query(
    "alert_messages",
    f"""with {_fold(1, 1, 1)}
select model_id, run_id, 'Drift detected for model ''' || model_id || ''' (v1): drift_score=' || printf('%.3f', drift_score)
  || coalesce(', quality_score=' || printf('%.3f', quality_score), '') as message
from tl join runs using (model_id, run_id) where opens""",
)
def alert_messages(spark, sf_dir):
    t = health_timeline(hourly_runs(spark, sf_dir).withColumn("version", F.lit(1)), ["model_id"], ["run_id"])
    return t.where("opens_alert").select("model_id", "run_id", alert_message().alias("message"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model_id"),
        F.col("o_orderkey").alias("id"),
        (F.year("o_orderdate") - 1990).alias("version"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
    )


@query(
    "latest_baseline",
    """select o_orderpriority as model_id, (max((year(o_orderdate) - 1990) * 1000000000 + o_orderkey) // 1000000000)::int as version,
  max((year(o_orderdate) - 1990) * 1000000000 + o_orderkey) % 1000000000 as id from orders group by 1""",
)
def latest_baseline_query(spark, sf_dir):
    return latest_baseline(_orders(spark, sf_dir).drop("status")).select("model_id", "version", "id")


@query(
    "baseline_as_of",
    """with u as (select o_orderpriority as model_id, o_orderdate as t, case when o_orderstatus = 'F' then 0 else 1 end as kind, o_orderkey as tie,
  case when o_orderstatus = 'F' then (year(o_orderdate) - 1990) * 1000000000 + o_orderkey end as b from orders),
w as (select *, max(b) over (partition by model_id order by t, kind, tie rows unbounded preceding) as found from u)
select model_id, tie as run_id, (found // 1000000000)::int as baseline_version, found % 1000000000 as baseline_id from w where kind = 1""",
)
def baseline_as_of_query(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    runs = orders.where("status <> 'F'").select("model_id", F.col("id").alias("run_id"), F.col("created_at").alias("ts"))
    return baseline_as_of(runs, orders.where("status = 'F'")).select("model_id", "run_id", "baseline_version", "baseline_id")


@query(
    "current_health",
    """with o as (select o_custkey as model_id, o_orderstatus, o_orderkey from orders),
h as (select model_id, arg_max(o_orderstatus, o_orderkey) as st, max(o_orderkey) as u from o where o_orderstatus <> 'P' group by 1),
a as (select distinct model_id from o where o_orderstatus = 'P')
select c.c_custkey as model_id, case when st = 'F' then 'warning' when st = 'O' then 'recovering' when a.model_id is not null then 'degraded' else 'healthy' end as state,
  case when st is not null then u when a.model_id is not null then 1 else 0 end as consecutive_drifted
from customer c left join h on h.model_id = c.c_custkey left join a on a.model_id = c.c_custkey""",
)
def current_health_query(spark, sf_dir):
    """Customers as models: F/O orders are stored health rows, P orders are open alerts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model_id"), "o_orderstatus", "o_orderkey")
    stored = o.where("o_orderstatus <> 'P'").select(
        "model_id",
        F.when(F.col("o_orderstatus") == "F", "warning").otherwise("recovering").alias("state"),
        F.col("o_orderkey").alias("consecutive_drifted"),
        F.lit(0).cast("bigint").alias("consecutive_clean"),
        F.col("o_orderkey").alias("updated_at"),
    )
    alerts = o.where("o_orderstatus = 'P'").select("model_id", F.lit(False).alias("resolved"))
    models = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"))
    return current_health(stored, models, alerts).select("model_id", "state", "consecutive_drifted")


_CLEAN = f"with {RUNS}, f as (select model_id, avg(is_drifted::int) as p from runs group by 1)"


@query("single_check_fpr", _CLEAN + " select model_id, round(p, 6) as single_check_fpr from f")
def single_check_fpr_query(spark, sf_dir):
    return single_check_fpr(hourly_runs(spark, sf_dir), ["model_id"]).select("model_id", F.round("single_check_fpr", 6).alias("single_check_fpr"))


@query(
    "calibrate_k",
    _CLEAN
    + """, k as (select model_id, p, case when p <= 0 then 1 else coalesce(list_min(list_filter(range(1, 6), lambda k: p ** k <= 0.01 + 1e-12)), 5) end as k from f)
select model_id, k::bigint as recommended_consecutive, round(case when p <= 0 then 0 else p ** k end, 6) as achieved_incident_fpr, (case when p <= 0 then 0 else p ** k end) > 0.01 as capped from k""",
)
def calibrate_k(spark, sf_dir):
    out = calibrate(single_check_fpr(hourly_runs(spark, sf_dir), ["model_id"]), 0.01, 5)
    return out.select("model_id", "recommended_consecutive", F.round("achieved_incident_fpr", 6).alias("achieved_incident_fpr"), "capped")


# -- diagnosis ----------------------------------------------------------------

_NAMES = "case event_type when 'click' then 'retrieval' when 'view' then 'generation_latency' when 'error' then 'refusal' when 'purchase' then 'citation_validity' else 'embedding' end"
SIG = f"""
sig as (select user_id, day(ts)::int as day, {_NAMES} as name, avg(value) > 50 as is_drifted, least(1.0, avg(value) / 97.123457) as confidence
        from events group by 1, 2, 3)"""


def _signals(spark, sf_dir):
    """One run per user and day; every event type stands for one signal."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.dayofmonth("ts").alias("day"), F.expr(_NAMES).alias("name"))
        .agg((F.avg("value") > 50).alias("is_drifted"), F.least(F.lit(1.0), F.avg("value") / 97.123457).alias("confidence"))
    )


@query(
    "diagnose_runs",
    f"""with {SIG},
w as (select user_id, day, bool_or(is_drifted) as any_drift,
  max(confidence) filter (where is_drifted and name = 'retrieval') as r, max(confidence) filter (where is_drifted and name = 'citation_validity') as c,
  max(confidence) filter (where is_drifted and name = 'refusal') as f, max(confidence) filter (where is_drifted and name = 'generation_latency') as l,
  bool_or(name = 'retrieval') as hr, bool_or(name = 'citation_validity') as hc, bool_or(name = 'refusal') as hf, bool_or(name = 'generation_latency') as hl
  from sig group by 1, 2),
s as (select *, case when r is not null then r + .5 * (coalesce(c, 0) + coalesce(f, 0)) else 0 end as sr,
  case when r is null then coalesce(c, 0) + coalesce(f, 0) else 0 end as sg, coalesce(l, 0) as so from w),
t as (select *, greatest(sr, sg, so) as top from s)
select user_id, day, case when not any_drift or top <= 0 then null when sr = top then 'retrieval' when sg = top then 'generation' else 'operational' end as likely_subsystem,
  round(case when any_drift then least(1.0, top) else 0 end, 6) as confidence,
  case when not any_drift then 'no signals are drifted'
    when r is not null then concat_ws(' | ', 'retrieval similarity distribution shifted (confidence=' || printf('%.2f', r) || ')',
      case when c is not null then 'citation validity also declined -- consistent with worse retrieved context rather than an independent model change' when hc then 'citation validity remained stable' end,
      case when f is not null then 'refusal also declined -- consistent with worse retrieved context rather than an independent model change' when hf then 'refusal remained stable' end,
      case when l is not null then 'generation latency distribution shifted (confidence=' || printf('%.2f', l) || ')' when hl then 'latency remained stable' end)
    else concat_ws(' | ',
      case when c is not null then 'citation validity shifted (confidence=' || printf('%.2f', c) || ') while retrieval stayed stable -- consistent with a model/prompt behavior change rather than a retrieval problem' end,
      case when f is not null then 'refusal rate shifted (confidence=' || printf('%.2f', f) || ') while retrieval stayed stable -- consistent with a model/prompt behavior change rather than a retrieval problem' end,
      case when hr then 'retrieval remained stable' end,
      case when l is not null then 'generation latency distribution shifted (confidence=' || printf('%.2f', l) || ')' when hl then 'latency remained stable' end)
  end as reasoning
from t""",
)
def diagnose_runs_query(spark, sf_dir):
    d = diagnose_runs(_signals(spark, sf_dir), ["user_id", "day"])
    return d.select("user_id", "day", "likely_subsystem", F.round("confidence", 6).alias("confidence"), F.array_join("reasoning", " | ").alias("reasoning"))


@query(
    "ranked_subsystems",
    f"""with {SIG},
w as (select user_id, day, max(confidence) filter (where is_drifted and name = 'retrieval') as r,
  coalesce(max(confidence) filter (where is_drifted and name = 'citation_validity'), 0) + coalesce(max(confidence) filter (where is_drifted and name = 'refusal'), 0) as d,
  coalesce(max(confidence) filter (where is_drifted and name = 'generation_latency'), 0) as l from sig group by 1, 2 having bool_or(is_drifted)),
s as (select user_id, day, 'retrieval' as subsystem, 0 as o, case when r is null then 0 else r + .5 * d end as score from w union all
      select user_id, day, 'generation', 1, case when r is null then d else 0 end from w union all select user_id, day, 'operational', 2, l from w)
select user_id, day, subsystem, round(score, 6) as score, row_number() over (partition by user_id, day order by score desc, o)::int as rank from s""",
)
def ranked_subsystems(spark, sf_dir):
    d = diagnose_runs(_signals(spark, sf_dir), ["user_id", "day"]).select("user_id", "day", F.posexplode("ranked").alias("pos", "r"))
    return d.select("user_id", "day", "r.subsystem", F.round("r.score", 6).alias("score"), (F.col("pos") + 1).alias("rank"))


@query(
    "signal_confidence",
    """select user_id, round(coalesce(max(value) filter (where event_type = 'click'), greatest(max(value) filter (where event_type = 'view'),
  max(value) filter (where event_type = 'error')), 0), 6) as confidence from events group by 1""",
)
def signal_confidence_query(spark, sf_dir):
    of = lambda t: F.max(F.when(F.col("event_type") == t, F.col("value")))
    conf = signal_confidence(of("click"), of("view"), of("error"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(conf, 6).alias("confidence"))


def _traces(spark, sf_dir):
    sim = lambda x: F.struct(x.alias("similarity"))
    claim = lambda s: F.struct(F.lit(s).alias("status"))
    k = F.get_json_object("props", "$.k").cast("int")
    t = telemetry(spark, sf_dir).drop("grounded").join(table(spark, sf_dir, "events").select("event_id", "event_type", "value", k.alias("k")), "event_id")
    return t.select(
        "event_id",
        F.when(F.col("k") >= 5, F.array(sim(F.col("k") / 100.0), sim(F.col("value") / 510.0)))
        .otherwise(F.array().cast("array<struct<similarity:double>>"))
        .alias("retrieval"),
        (F.col("event_type") != "error").alias("grounded"),
        F.when(F.col("value") > 80, F.array(claim("unsupported"), claim("supported"))).otherwise(F.array(claim("supported"))).alias("claims"),
        F.when(F.col("citations_requested") > 0, F.col("citations") / F.col("citations_requested")).alias("citation_score"),
        (1 - F.col("value") / 131).alias("grounding_score"),
        (F.col("value") * 60).alias("retrieval_latency_ms"),
        (F.col("value") * 100).alias("generation_latency_ms"),
    )


@query(
    "diagnose_traces",
    f"""with {TEL},
t as (select event_id, k, value, event_type <> 'error' as g, case when k >= 5 then greatest(k / 100, value / 510) else 0 end as best,
  case when citations_requested > 0 then citations / citations_requested end as cs, 1 - value / 131 as gs
  from tel join k using (event_id))
select event_id,
  case when k < 5 then 'retrieval_miss' when not g and best < 0.3 then 'irrelevant_retrieval' when not g and best < 0.5 then 'insufficient_evidence'
       when not g then 'generation_problem' when cs < 1 then 'citation_problem' when value > 80 then 'generation_problem' when gs < 0.5 then 'generation_problem' else 'none' end as category,
  case when k < 5 then 'no chunks were retrieved at all -- empty index, or the document has no indexed content'
       when not g and best < 0.3 then 'best retrieval similarity was only ' || printf('%.2f', best) || ' -- even the closest match is a poor fit for the question, so refusing was likely correct'
       when not g and best < 0.5 then 'best retrieval similarity was ' || printf('%.2f', best) || ' -- plausibly related, but not strong enough to answer from, so refusing was a reasonable call'
       when not g then 'best retrieval similarity was ' || printf('%.2f', best) || ', a good match, but the model refused anyway -- the evidence was there and the model didn''t use it'
       when cs < 1 then 'citation score ' || printf('%.2f', cs) || ' -- some citations the model named didn''t point at a real excerpt'
       when value > 80 then '1 of 2 claim(s) in the answer don''t hold up against the retrieved evidence, despite the answer being marked grounded'
       when gs < 0.5 then 'grounding score ' || printf('%.2f', gs) || ' is low despite being marked grounded'
       else 'retrieval, citations and claim verification all look consistent' end as reasoning,
  case when value * 60 > 15000 then 'retrieval took ' || printf('%.0f', value * 60) || 'ms, unusually slow'
       when value * 100 > 15000 then 'generation took ' || printf('%.0f', value * 100) || 'ms, unusually slow' end as operational_note
from t""",
)
def diagnose_traces_query(spark, sf_dir):
    return diagnose_traces(_traces(spark, sf_dir)).select("event_id", "category", "reasoning", "operational_note")


# -- detector scoring -----------------------------------------------------------

TRIALS = f"""
tr as (select user_id * 31 + day as trial_id, bool_or(name = 'embedding') as injected,
   case when bool_or(name = 'embedding') then case (user_id % 4) when 0 then 'citation' when 1 then 'retrieval' when 2 then 'latency' else 'refusal' end end as drift_type
   from sig group by user_id, day)"""


def _trial_signals(spark, sf_dir):
    return _signals(spark, sf_dir).withColumn("trial_id", F.col("user_id") * 31 + F.col("day"))


def _trials(spark, sf_dir):
    """A trial counts as injected when its day has a signup event; the type follows the user."""
    injected = F.bool_or(F.col("name") == "embedding")
    kind = F.element_at(F.array(*[F.lit(s) for s in ("citation", "retrieval", "latency", "refusal")]), (F.col("user_id") % 4 + 1).cast("int"))
    t = _trial_signals(spark, sf_dir).groupBy("trial_id", "user_id").agg(injected.alias("drift_injected"))
    return t.select("trial_id", "drift_injected", F.when(F.col("drift_injected"), kind).alias("drift_type"))


_VARIANTS = "(values ('full', null), ('without_retrieval', 'retrieval'), ('without_generation_latency', 'generation_latency'), ('without_refusal', 'refusal'), ('without_citation_validity', 'citation_validity')) v(method, left_out)"
_SCORED = f"""with {SIG}, {TRIALS},
pr as (select method, user_id * 31 + day as trial_id, bool_or(is_drifted and name is distinct from left_out and name <> 'embedding') as predicted
       from sig, {_VARIANTS} group by 1, 2),
c as (select method, count(*) filter (where injected and predicted) as tp, count(*) filter (where not injected and predicted) as fp,
      count(*) filter (where injected and not predicted) as fn, count(*) filter (where not injected and not predicted) as tn from pr join tr using (trial_id) group by 1)"""

ABLATION = {
    "full": None,
    "without_retrieval": "retrieval",
    "without_generation_latency": "generation_latency",
    "without_refusal": "refusal",
    "without_citation_validity": "citation_validity",
}


def _predictions(spark, sf_dir):
    signals = _trial_signals(spark, sf_dir).where("name <> 'embedding'")
    return ablation_verdicts(signals, _trials(spark, sf_dir), ABLATION)


@query(
    "ablation_scores",
    _SCORED
    + """ select method, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
  round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as false_positive_rate from c""",
)
def ablation_scores(spark, sf_dir):
    s = detector_scores(_predictions(spark, sf_dir))
    return s.select("method", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "false_positive_rate")])


@query(
    "recall_by_drift_type",
    _SCORED + " select method, drift_type, round(avg(predicted::int), 6) as recall from pr join tr using (trial_id) where injected group by 1, 2",
)
def recall_by_drift_type(spark, sf_dir):
    return recall_by_type(_predictions(spark, sf_dir)).select("method", "drift_type", F.round("recall", 6).alias("recall"))


# -- registry scans ---------------------------------------------------------------


@query("history_limit", f"with {RUNS} select run_id, is_drifted from runs where model_id = 'error' order by run_id desc limit 20")
def history_limit(spark, sf_dir):
    runs = hourly_runs(spark, sf_dir).withColumn("ts", F.col("run_id"))
    return registry.history(runs, "error", 20).select("run_id", "is_drifted")


@query(
    "alerts_active",
    f"""with {_fold(1, 2, 2)}
select a.model_id, a.run_id from tl a where a.opens and not exists (select 1 from tl r where r.model_id = a.model_id and r.resolves and r.rn > a.rn)""",
)
def alerts_active(spark, sf_dir):
    timeline = pinned(health_timeline(hourly_runs(spark, sf_dir), ["model_id"], ["run_id"], 1, 2, 2))
    alerts = alert_lifecycle(timeline, ts="run_id").withColumnRenamed("opened_at", "created_at")
    return registry.alerts_of(alerts, active_only=True).select("model_id", "run_id")


@query("traces_refused", f"with {TEL} select event_id as trace_id from tel where segment = 2 and not grounded order by ts desc, event_id desc limit 50")
def traces_refused(spark, sf_dir):
    t = telemetry(spark, sf_dir).select(F.col("segment").alias("model_id"), F.col("event_id").alias("trace_id"), F.col("ts").alias("created_at"), "grounded")
    return registry.traces_of(t, 2, False).select("trace_id")


@query("experiments_by_kind", "select o_orderkey as experiment_id, o_orderstatus as status from orders where o_orderpriority = '1-URGENT'")
def experiments_by_kind(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("experiment_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"))
    return registry.experiments_of(e, "1-URGENT").drop("kind")


@query(
    "metric_export",
    f"""with {RUNS}
select model_id, run_id, 'drift_score' as metric, round(drift_score, 6) as value from runs union all
select model_id, run_id, 'quality_score', round(quality_score, 6) from runs where quality_score is not null union all
select model_id, run_id, 'signal.mean_value_per_hour.value', round(drift_score, 6) from runs union all
select model_id, run_id, 'signal.mean_value_per_hour.is_drifted', is_drifted::int::double from runs""",
)
def metric_export(spark, sf_dir):
    signal = F.array(F.struct(F.lit("mean value/per hour").alias("name"), F.col("drift_score").alias("value"), "is_drifted"))
    return registry.metric_rows(hourly_runs(spark, sf_dir).withColumn("signals", signal)).withColumn("value", F.round("value", 6))


@query(
    "alert_outbox",
    f"""with {_fold(1, 1, 1)}
select model_id, run_id, '{{"source":"lakesignal","model_id":"' || model_id || '","health_state":"' || state || '","message":"opened at ' || run_id || '"}}' as payload from tl where opens""",
)
def alert_outbox(spark, sf_dir):
    t = _timeline(spark, sf_dir).where("opens_alert")
    t = t.select("model_id", "run_id", F.col("state").alias("health_state"), F.concat(F.lit("opened at "), "run_id").alias("message"))
    return registry.alert_outbox(t).select("model_id", "run_id", "payload")
