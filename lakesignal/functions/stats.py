"""Distribution tails and percentile positions as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: With method auto, the exact two-sample KS distribution is used up to this sample size.
KS_EXACT_LIMIT = 10_000
_ERF_TERMS = 240


def erf_positive(x: Column) -> Column:
    """erf for x >= 0 by the all-positive series 2/sqrt(pi) e^(-x^2) sum 2^n x^(2n+1)/(2n+1)!!.

    Accurate to about 1e-15 up to x = 6.5; 1 beyond (the tail there is < 1e-19).
    """
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * F.lit(2.0) * x * x / (F.lit(2.0) * n + F.lit(1.0))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(_ERF_TERMS)), start, add, lambda a: a["total"])
    return F.when(x > 6.5, F.lit(1.0)).otherwise(F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x * x) * series)


def normal_two_sided(z: Column) -> Column:
    """P(|N(0,1)| > |z|)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - erf_positive(F.abs(z) / F.lit(math.sqrt(2.0))))


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(chi2_dof > x), closed finite series for integer degrees of freedom."""
    half = x / 2

    def even_step(acc: Column, i: Column) -> Column:
        term = acc["term"] * half / i
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    one = F.lit(1.0)
    even = F.exp(-half) * F.when(dof <= 2, one).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.floor(dof / 2) - 1, F.lit(1)).cast("int")),
            F.struct(one.alias("term"), one.alias("total")),
            even_step,
            lambda a: a["total"],
        )
    )
    # odd: first term h^(1/2) / gamma(3/2), the i-th one is the one before times h / (i - 1/2), h = x / 2
    first = F.sqrt(half) / F.lit(math.gamma(1.5))

    def odd_step(acc: Column, i: Column) -> Column:
        term = acc["term"] * half / (i - F.lit(0.5))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    odd_sum = F.when(dof <= 1, F.lit(0.0)).when(dof <= 3, first).otherwise(
        F.aggregate(
            F.sequence(F.lit(2), F.greatest(F.floor((dof - 1) / 2), F.lit(2)).cast("int")),
            F.struct(first.alias("term"), first.alias("total")),
            odd_step,
            lambda a: a["total"],
        )
    )
    odd = (F.lit(1.0) - erf_positive(F.sqrt(half))) + F.exp(-half) * odd_sum
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(dof % 2 == 0, even).otherwise(odd)))


def kolmogorov_tail(d: Column, n: Column, m: Column) -> Column:
    """Large-sample two-sample KS p-value.

    Kolmogorov series at z + 1/(6 sqrt(N)) + (z - 1)/(4 N), z = D sqrt(N),
    N = nm/(n+m): the published finite-sample correction of the limit law.
    """
    en = n * m / (n + m)
    z = d * F.sqrt(en)
    lam = z + 1 / (6 * F.sqrt(en)) + (z - 1) / (4 * en)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * total)))


def _ks_exact(d: float, n: int, m: int) -> float:
    """P(D_nm >= d): the share of lattice paths from (0, 0) to (n, m) that leave the band |i/n - j/m| < d.

    Recurrence of J. L. Hodges, "The significance probability of the Smirnov two-sample test" (1958), for shares in
    place of counts: a path reaches (i, j) from (i-1, j) with weight i/(i+j), otherwise from (i, j-1).  Points with
    equal i + j are computed together, so a test takes n + m vector steps of at most n + 1 entries.
    """
    reach = math.ceil(d * n * m - 1e-7)
    i = np.arange(n + 1)
    left = np.zeros(n + 1)
    left[0] = float(reach <= 0)
    for s in range(1, n + m + 1):
        share = i / s
        left = (1 - share) * left + share * np.concatenate([[0.0], left[:-1]])
        left[np.abs(i * m - (s - i) * n) >= reach] = 1.0
    return float(left[n])


@F.pandas_udf(T.DoubleType())
def ks_exact_tail(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Exact p-values, null for rows without both samples; the work of one test is n times m."""
    usable = [dd == dd and nn and mm for dd, nn, mm in zip(d, n, m)]
    return pd.Series([_ks_exact(float(dd), int(nn), int(mm)) if ok else None for ok, dd, nn, mm in zip(usable, d, n, m)], dtype="float64")


def ks_p_value(d: Column, n: Column, m: Column, method: str = "auto") -> Column:
    """Two-sample KS p-value, one per test.

    ``exact`` and ``asymptotic`` use one law for every sample size.  ``auto`` is the reference behaviour: exact up to
    ``KS_EXACT_LIMIT`` rows a side and the large-sample law beyond, so its p-values change law at that size.
    """
    if method == "exact":
        return ks_exact_tail(d, n, m)
    if method == "asymptotic":
        return kolmogorov_tail(d, n, m)
    if method != "auto":
        raise ValueError(f"unknown method {method!r}: exact, asymptotic or auto")
    large = F.greatest(n, m) > KS_EXACT_LIMIT
    return F.when(large, kolmogorov_tail(d, n, m)).otherwise(ks_exact_tail(F.when(~large, d), n, m))


def nearest_rank(n: Column, pct: float) -> Column:
    """0-based index of the nearest-rank percentile with half-even rounding."""
    k = F.bround(F.lit(pct / 100.0) * n + F.lit(0.5), 0).cast("bigint") - 1
    return F.greatest(F.lit(0).cast("bigint"), F.least(n - 1, k))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
