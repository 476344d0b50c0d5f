import math

import pytest

from kinfold.functions import stats


def binomial_by_sum(k, n, p):
    pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    return min(1.0, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-7)))


@pytest.mark.parametrize("n", [1, 2, 7, 40, 200])
@pytest.mark.parametrize("p", [0.01, 0.3, 0.5, 0.77])
def test_binomial(n, p):
    for k in range(0, n + 1, max(1, n // 13)):
        assert stats.binomial_two_sided(k, n, p) == pytest.approx(binomial_by_sum(k, n, p), rel=1e-8, abs=1e-13)


@pytest.mark.parametrize("expected", [0.1, 1.0, 3.7, 25.0, 300.0])
def test_poisson(expected):
    def cdf(k):
        return math.fsum(math.exp(i * math.log(expected) - expected - math.lgamma(i + 1)) for i in range(int(k) + 1)) if k >= 0 else 0.0
    for k in range(0, int(expected * 2) + 3, max(1, int(expected / 7))):
        want = min(2 * (1 - cdf(k - 1)) if k >= expected else 2 * cdf(k), 1.0)
        assert stats.poisson_two_sided(k, expected) == pytest.approx(want, rel=1e-8, abs=1e-12)
    assert stats.poisson_two_sided(0, 0.0) == 1.0


@pytest.mark.parametrize("df", [1, 2, 5, 30, 1000])
def test_student_t(df):
    def density(x):
        c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
        return math.exp(c - (df + 1) / 2 * math.log1p(x * x / df))
    for t in (0.0, 0.3, 1.7, 4.2):
        steps = 20_000
        inside = sum(density(-t + 2 * t * (i + 0.5) / steps) for i in range(steps)) * 2 * t / steps
        assert stats.t_two_sided(t, df) == pytest.approx(1 - inside, abs=1e-7)
    assert stats.t_two_sided(math.inf, df) == 0.0


def test_udfs_keep_missing_values(spark):
    df = spark.createDataFrame([(3, 10, 0.2, 1.5, 8), (0, 10, 0.2, None, 8)], "k int, n int, p double, t double, df int")
    rows = df.select(
        stats.binomial_test("k", "n", "p").alias("b"), stats.poisson_test("k", "p").alias("q"), stats.t_test("t", "df").alias("t")).collect()
    assert rows[0]["b"] == pytest.approx(stats.binomial_two_sided(3, 10, 0.2))
    assert rows[1]["b"] == 1.0 and rows[1]["t"] is None
