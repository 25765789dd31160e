import itertools
import math

from pyspark.sql import functions as F

from lakesignal.functions import stats
from lakesignal.functions.stats import _ks_exact


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_normal_tail_matches_erfc(spark):
    zs = [0.0, 0.1, 0.5, 1.0, 1.959963984540054, 2.5, 3.3, 5.0, 8.0, 12.0, -1.7]
    got = column(spark, [(z,) for z in zs], "z double", stats.normal_two_sided(F.col("z")))
    for z, p in zip(zs, got):
        assert abs(p - math.erfc(abs(z) / math.sqrt(2))) < 1e-13


def test_chi_square_tail_five_percent_points(spark):
    points = [(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (9.487729036781154, 4), (11.070497693516351, 5), (18.307038053275146, 10), (24.995790139728616, 15)]
    got = column(spark, points, "x double, k int", stats.chi_square_tail(F.col("x"), F.col("k")))
    assert all(abs(p - 0.05) < 1e-10 for p in got)


def brute_ks(d, n, m):
    """P(D >= d) over every ordering of n + m labels."""
    hits = total = 0
    for chosen in itertools.combinations(range(n + m), n):
        s, i, j, worst = set(chosen), 0, 0, 0.0
        for t in range(n + m):
            if t in s:
                i += 1
            else:
                j += 1
            worst = max(worst, abs(i / n - j / m))
        total += 1
        hits += worst >= d - 1e-12
    return hits / total


def test_exact_ks_against_enumeration():
    for n, m in ((3, 4), (5, 5), (2, 7), (6, 4)):
        for k in range(1, n * m + 1, 3):
            d = k / (n * m)
            assert abs(_ks_exact(d, n, m) - brute_ks(d, n, m)) < 1e-12


def test_large_sample_ks_is_close_to_exact(spark):
    rows = [(d, 900, 1100) for d in (0.02, 0.04, 0.05, 0.0609, 0.08)]
    got = column(spark, rows, "d double, n bigint, m bigint", stats.kolmogorov_tail(F.col("d"), F.col("n"), F.col("m")))
    for (d, n, m), p in zip(rows, got):
        assert abs(p - _ks_exact(d, n, m)) < 0.02
    assert column(spark, [(0.0, 20000, 20000)], "d double, n bigint, m bigint", stats.kolmogorov_tail(F.col("d"), F.col("n"), F.col("m"))) == [1.0]


def test_nearest_rank_uses_half_even_rounding(spark):
    ns = list(range(1, 101))
    got = column(spark, [(n,) for n in ns], "n bigint", stats.nearest_rank(F.col("n"), 95))
    assert got == [max(0, min(n - 1, int(round(0.95 * n + 0.5)) - 1)) for n in ns]
    assert got[19] == 19 and got[39] == 37
