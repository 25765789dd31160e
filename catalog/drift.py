"""Drift detectors over lineitem, orders and events."""

from pyspark.sql import functions as F

from catalog import query, table
from lakesignal.functions.stats import ks_p_value
from lakesignal.operators.categorical_drift import category_counts, chi_square_test, jensen_shannon_test, two_proportion_test
from lakesignal.operators.numeric_drift import (
    distance_summary,
    nearest_rank_percentile,
    psi_band,
    psi_test,
    unpivot_features,
    wasserstein_rows,
)
from lakesignal.plans.tabular_check import missing_features, tabular_signals, tabular_verdict
from lakesignal.scale import attach_row, pinned

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def halves(column: str, day: str):
    """Rows before ``day`` are the baseline sample, the rest the current one."""
    return F.when(F.col(column) < F.lit(day).cast("timestamp_ntz"), F.lit("baseline")).otherwise(F.lit("current"))


def lineitem_long(spark, sf_dir, *keep):
    rows = table(spark, sf_dir, "lineitem").select(*FEATURES, "l_shipdate", *keep)
    return unpivot_features(rows, FEATURES, halves("l_shipdate", "1998-07-01"), keep)


_LONG = """
long as (
  select feature, value, case when l_shipdate < timestamp '1998-07-01' then 'baseline' else 'current' end as sample
  from lineitem unpivot (value for feature in (l_quantity, l_extendedprice, l_discount, l_tax))
)"""
_RANKED = _LONG + """,
cnt as (
  select feature, value, count(*) filter (where sample = 'baseline') as nb, count(*) filter (where sample = 'current') as nc
  from long group by 1, 2
),
ranked as (
  select *, sum(nb) over w as cb, sum(nc) over w as cc,
         sum(nb) over (partition by feature) as n_b, sum(nc) over (partition by feature) as n_c,
         lead(value) over (partition by feature order by value) as nxt
  from cnt window w as (partition by feature order by value rows unbounded preceding)
)"""

#: KS p-value for large samples, from columns d, n_b, n_c (same formula as the library)
_KS_P = """
select *, case when lam < 0.3 then 1.0 else greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
         lambda k: (case when k % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0 * k * k * lam * lam))))) end as p
from (select *, z + 1 / (6 * sqrt(en)) + (z - 1) / (4 * en) as lam
      from (select *, d * sqrt(en) as z from (select *, n_b * n_c / (n_b + n_c) as en from {src})))
"""


@query(
    "ks_by_feature",
    f"""with {_RANKED}
select feature, round(max(abs(cb / n_b - cc / n_c)), 6) as statistic,
       max(n_b)::bigint as n_baseline, max(n_c)::bigint as n_current
from ranked group by feature""",
)
def ks_by_feature(spark, sf_dir):
    return distance_summary(lineitem_long(spark, sf_dir), ["feature"]).select(
        "feature", F.round("ks", 6).alias("statistic"), "n_baseline", "n_current"
    )


@query(
    "ks_asymptotic",
    f"""with {_RANKED}, d as (select feature, max(abs(cb / n_b - cc / n_c)) as d, max(n_b) as n_b, max(n_c) as n_c from ranked group by feature), p as ({_KS_P.format(src="d")})
select feature, round(d, 6) as statistic, round(p, 6) as p_value from p""",
)
def ks_asymptotic(spark, sf_dir):
    """One law for every sample size."""
    s = distance_summary(lineitem_long(spark, sf_dir), ["feature"])
    return s.select("feature", F.round("ks", 6).alias("statistic"), F.round(ks_p_value(F.col("ks"), F.col("n_baseline"), F.col("n_current"), "asymptotic"), 6).alias("p_value"))


@query(
    "wasserstein_by_feature",
    f"""with {_RANKED},
w as (select feature, sum(abs(cb / n_b - cc / n_c) * (nxt - value)) as w, max(n_b)::bigint as n_b, max(n_c)::bigint as n_c from ranked group by 1),
q as (select feature, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-9) as iqr
      from long where sample = 'baseline' group by 1)
select feature, round(w, 6) as statistic, round(iqr, 6) as baseline_iqr, w / iqr > 0.2 as drift_detected,
       round(greatest(0.0, least(1.0, w / iqr / 0.4)), 6) as confidence, n_b as n_baseline, n_c as n_current
from w join q using (feature)""",
)
def wasserstein_by_feature(spark, sf_dir):
    rows = wasserstein_rows(distance_summary(lineitem_long(spark, sf_dir), ["feature"]), ["feature"])
    return rows.select(
        "feature",
        F.round("statistic", 6).alias("statistic"),
        F.round(F.col("detail")["baseline_iqr"], 6).alias("baseline_iqr"),
        "drift_detected",
        F.round("confidence", 6).alias("confidence"),
        "n_baseline",
        "n_current",
    )


@query(
    "psi_by_feature",
    f"""with {_LONG},
q as (
  select feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e
  from long where sample = 'baseline' group by 1
),
b as (
  select feature, len(e) - 1 as k, len(list_filter(e[2:len(e) - 1], lambda x: x < value)) as bucket,
         count(*) filter (where sample = 'baseline') as nb, count(*) filter (where sample = 'current') as nc
  from long join q using (feature) group by 1, 2, 3
),
f as (
  select a.feature, a.k, i.bucket, coalesce(nb, 0) as nb, coalesce(nc, 0) as nc, n_b, n_c
  from (select feature, k, sum(nb) as n_b, sum(nc) as n_c from b group by 1, 2) a,
       lateral (select unnest(range(0, a.k)) as bucket) i
  left join b on b.feature = a.feature and b.bucket = i.bucket
),
p as (
  select feature, k, n_b, n_c, sum(((nc + .5) / (n_c + .5 * k) - (nb + .5) / (n_b + .5 * k))
         * ln(((nc + .5) / (n_c + .5 * k)) / ((nb + .5) / (n_b + .5 * k)))) as psi
  from f group by 1, 2, 3, 4
)
select feature, k::bigint as bins, round(case when k >= 2 then psi else 0 end, 6) as statistic,
       k >= 2 and psi >= 0.1 as drift_detected,
       case when psi < 0.1 then 'no significant shift' when psi < 0.25 then 'moderate shift' else 'significant shift' end as band
from p""",
)
def psi_by_feature(spark, sf_dir):
    rows = psi_test(lineitem_long(spark, sf_dir), ["feature"])
    return rows.select(
        "feature",
        F.col("detail")["bins"].cast("bigint").alias("bins"),
        F.round("statistic", 6).alias("statistic"),
        "drift_detected",
        psi_band(F.col("statistic")).alias("band"),
    )


_FAMILY = f"""with {_RANKED},
d as (select feature, max(abs(cb / n_b - cc / n_c)) as d, max(n_b) as n_b, max(n_c) as n_c from ranked group by 1),
p as ({_KS_P.format(src="d")}),
s as (select feature, d, p, 0.05 / count(*) over () as threshold, p < 0.05 / count(*) over () as is_drifted from p)
"""


@query(
    "tabular_check",
    _FAMILY
    + """select feature, round(d, 6) as statistic, round(p, 6) as p_value, round(threshold, 6) as threshold, is_drifted,
       round(avg(is_drifted::int) over (), 6) as drift_score, avg(is_drifted::int) over () >= 0.3 as check_drifted
from s""",
)
def tabular_check(spark, sf_dir):
    signals = pinned(tabular_signals(lineitem_long(spark, sf_dir)))
    verdict = tabular_verdict(signals).select("drift_score", F.col("is_drifted").alias("check_drifted"))
    return attach_row(signals, verdict).select(
        "feature",
        F.round("statistic", 6).alias("statistic"),
        F.round("p_value", 6).alias("p_value"),
        F.round("threshold", 6).alias("threshold"),
        "is_drifted",
        F.round("drift_score", 6).alias("drift_score"),
        "check_drifted",
    )


@query(
    "tabular_check_by_flag",
    """with long as (
  select l_returnflag, feature, value, case when l_shipdate < timestamp '1998-07-01' then 'b' else 'c' end as s
  from lineitem unpivot (value for feature in (l_quantity, l_extendedprice, l_discount, l_tax))),
cnt as (select l_returnflag, feature, value, count(*) filter (where s = 'b') as nb, count(*) filter (where s = 'c') as nc from long group by 1, 2, 3),
ranked as (select *, sum(nb) over w as cb, sum(nc) over w as cc, sum(nb) over p as n_b, sum(nc) over p as n_c
           from cnt window w as (partition by l_returnflag, feature order by value rows unbounded preceding), p as (partition by l_returnflag, feature))
select l_returnflag, feature, round(max(abs(cb / n_b - cc / n_c)), 6) as statistic, round(0.05 / 4, 6) as threshold
from ranked group by 1, 2""",
)
def tabular_check_by_flag(spark, sf_dir):
    """The same check per segment: every (segment, feature) pair in one job."""
    signals = tabular_signals(lineitem_long(spark, sf_dir, "l_returnflag"), ["l_returnflag"])
    return signals.select("l_returnflag", "feature", F.round("statistic", 6).alias("statistic"), F.round("threshold", 6).alias("threshold"))


@query(
    "missing_features",
    """select feature from (
  select 'shipped_' || year(l_shipdate) as feature, l_shipdate < timestamp '1998-07-01' as base from lineitem)
group by 1 having bool_or(base) and not bool_or(not base)""",
)
def missing_features_query(spark, sf_dir):
    name = F.concat(F.lit("shipped_"), F.year("l_shipdate"))
    long = table(spark, sf_dir, "lineitem").select(name.alias("feature"), halves("l_shipdate", "1998-07-01").alias("sample"))
    return missing_features(long)


_EVENT_SIDE = "case when ts < timestamp '2024-01-16' then 'baseline' else 'current' end"


@query(
    "chi_square_returnflag",
    """with c as (select l_linestatus, l_returnflag, count(*) filter (where l_shipdate < timestamp '1998-07-01') as nb,
       count(*) filter (where l_shipdate >= timestamp '1998-07-01') as nc from lineitem group by 1, 2),
t as (select *, sum(nb) over p as n_b, sum(nc) over p as n_c, count(*) over p as k from c window p as (partition by l_linestatus)),
e as (select *, (nb + nc) * n_b / (n_b + n_c) as eb, (nb + nc) * n_c / (n_b + n_c) as ec from t),
x as (select l_linestatus, sum((nb - eb) ** 2 / eb + (nc - ec) ** 2 / ec) as chi2, max(n_b) as n_b, max(n_c) as n_c, max(k) as k from e group by 1)
select l_linestatus, round(chi2, 6) as statistic, round(sqrt(chi2 / (n_b + n_c)), 6) as effect_size,
       round(exp(-chi2 / 2), 6) as p_value, exp(-chi2 / 2) < 0.05 as drift_detected, (k - 1)::bigint as dof
from x""",
)
def chi_square_returnflag(spark, sf_dir):
    """Three categories, so two degrees of freedom, where the tail is exp(-x/2)."""
    counts = category_counts(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag", halves("l_shipdate", "1998-07-01"))
    return chi_square_test(counts, ["l_linestatus"]).select(
        "l_linestatus",
        F.round("statistic", 6).alias("statistic"),
        F.round("effect_size", 6).alias("effect_size"),
        F.round("p_value", 6).alias("p_value"),
        "drift_detected",
        F.col("detail")["degrees_of_freedom"].cast("bigint").alias("dof"),
    )


@query(
    "chi_square_two_categories",
    """with c as (select o_orderpriority, o_orderstatus = 'F' as done, count(*) filter (where o_orderdate < timestamp '1998-01-01') as nb,
       count(*) filter (where o_orderdate >= timestamp '1998-01-01') as nc from orders group by 1, 2),
t as (select *, sum(nb) over p as n_b, sum(nc) over p as n_c from c window p as (partition by o_orderpriority)),
e as (select *, abs(nb - (nb + nc) * n_b / (n_b + n_c)) as gap, (nb + nc) * n_b / (n_b + n_c) as eb, (nb + nc) * n_c / (n_b + n_c) as ec from t)
select o_orderpriority, round(sum((gap - least(0.5, gap)) ** 2 / eb + (gap - least(0.5, gap)) ** 2 / ec), 6) as statistic,
       sum(nb)::bigint as n_baseline, sum(nc)::bigint as n_current
from e group by 1""",
)
def chi_square_two_categories(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("done", (F.col("o_orderstatus") == "F").cast("string"))
    counts = category_counts(orders, ["o_orderpriority"], "done", halves("o_orderdate", "1998-01-01"))
    return chi_square_test(counts, ["o_orderpriority"]).select(
        "o_orderpriority", F.round("statistic", 6).alias("statistic"), "n_baseline", "n_current"
    )


@query(
    "js_event_type",
    f"""with c as (select event_type, count(*) filter (where s = 'baseline') as nb, count(*) filter (where s = 'current') as nc
           from (select event_type, {_EVENT_SIDE} as s from events) group by 1),
p as (select nb / sum(nb) over () as p, nc / sum(nc) over () as q, sum(nb) over () as n_b, sum(nc) over () as n_c from c)
select 'event_type' as feature, round(sum(case when p > 0 then .5 * p * log2(p / ((p + q) / 2)) else 0 end
       + case when q > 0 then .5 * q * log2(q / ((p + q) / 2)) else 0 end), 6) as statistic,
       max(n_b)::bigint as n_baseline, max(n_c)::bigint as n_current from p""",
)
def js_event_type(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.expr("stack(1, 'event_type', event_type) as (feature, category)"), "ts")
    counts = category_counts(events, ["feature"], "category", halves("ts", "2024-01-16"))
    return jensen_shannon_test(counts, ["feature"]).select("feature", F.round("statistic", 6).alias("statistic"), "n_baseline", "n_current")


@query(
    "union_of_categories",
    f"""select event_type as category, count(*) filter (where s = 'baseline')::bigint as nb, count(*) filter (where s = 'current')::bigint as nc
from (select event_type, {_EVENT_SIDE} as s from events) group by 1""",
)
def union_of_categories(spark, sf_dir):
    return category_counts(table(spark, sf_dir, "events"), [], "event_type", halves("ts", "2024-01-16"))


@query(
    "ztest_error_rate",
    f"""with c as (select user_id, count(*) filter (where s = 'baseline' and event_type = 'error') as xb, count(*) filter (where s = 'baseline') as nb,
       count(*) filter (where s = 'current' and event_type = 'error') as xc, count(*) filter (where s = 'current') as nc
       from (select *, {_EVENT_SIDE} as s from events) group by 1),
se as (select *, (xb + xc) / (nb + nc) as p, xb / nullif(nb, 0) as pb, xc / nullif(nc, 0) as pc from c),
z as (select *, sqrt(p * (1 - p) * (1 / nb + 1 / nc)) as se from se where nb >= 8 and nc >= 8)
select c.user_id, round(coalesce(case when se > 0 then (pc - pb) / se else 0 end, 0), 6) as statistic,
       coalesce(case when se > 0 then abs((pc - pb) / se) > 1.959963984540054 else false end, false) as drift_detected,
       z.user_id is null as insufficient_sample
from c left join z using (user_id)""",
)
def ztest_error_rate(spark, sf_dir):
    side = table(spark, sf_dir, "events").select("user_id", halves("ts", "2024-01-16").alias("s"), (F.col("event_type") == "error").alias("x"))
    base, cur = F.col("s") == "baseline", F.col("s") == "current"
    pairs = side.groupBy("user_id").agg(
        F.count_if(base & F.col("x")).alias("baseline_successes"),
        F.count_if(base).alias("baseline_n"),
        F.count_if(cur & F.col("x")).alias("current_successes"),
        F.count_if(cur).alias("current_n"),
    )
    return two_proportion_test(pairs, ["user_id"]).select(
        "user_id", F.round("statistic", 6).alias("statistic"), "drift_detected", "insufficient_sample"
    )


@query(
    "nearest_rank_p95",
    """with r as (select event_type, value, row_number() over (partition by event_type order by value) as rn,
                count(*) over (partition by event_type) as n from events)
select event_type, round(value, 6) as p95, n::bigint as n from r
where rn = greatest(1, least(n, round_even(0.95 * n + 0.5, 0)::bigint))""",
)
def nearest_rank_p95(spark, sf_dir):
    return nearest_rank_percentile(table(spark, sf_dir, "events"), ["event_type"], "value").select(
        "event_type", F.round("p95", 6).alias("p95"), "n"
    )
