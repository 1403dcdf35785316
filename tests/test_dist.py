import math

import pytest

from custlens.functions import dist


def test_normal_quantiles():
    assert dist.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert dist.norm_ppf(0.5) == 0.0 or abs(dist.norm_ppf(0.5)) < 1e-14
    assert dist.norm_sf(dist.norm_ppf(1e-10)) == pytest.approx(1 - 1e-10, rel=1e-12)


def test_t_closed_forms():
    # df = 1 is Cauchy: P(|T| > t) = 1 - 2 atan(t) / pi
    for t in (0.3, 1.0, 4.0):
        assert dist.t_two_sided(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-12)
    # df = 2: P(T > t) = 1/2 - t / (2 sqrt(t^2 + 2))
    for t in (0.5, 2.0):
        assert dist.t_sf(t, 2) == pytest.approx(0.5 - t / (2 * math.sqrt(t * t + 2)), rel=1e-12)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138851986, abs=1e-9)


def test_f_and_chi2_closed_forms():
    for f, d2 in ((3.0, 10), (0.5, 57), (12.0, 3)):
        assert dist.f_sf(f, 2, d2) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-12)
    for x in (0.5, 7.3, 40.0):
        assert dist.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        even = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(4))
        assert dist.chi2_sf(x, 8) == pytest.approx(even, rel=1e-11)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)


def test_studentized_range_against_tables():
    # published 5 % critical values of the studentised range
    assert dist.qtukey(0.95, 3, 10) == pytest.approx(3.877, abs=2e-3)
    assert dist.qtukey(0.95, 5, 20) == pytest.approx(4.232, abs=2e-3)
    assert dist.qtukey(0.95, 3, 1e9) == pytest.approx(3.314, abs=2e-3)
    # k = 2 reduces to sqrt(2) times Student's t
    assert dist.qtukey(0.95, 2, 5) == pytest.approx(math.sqrt(2) * dist.t_ppf(0.975, 5), rel=1e-8)
