"""Binomials and the splitting tree against definitions."""

from hashlib import md5
from math import comb, lgamma

import numpy as np

from pulseforge.functions import draws


def test_log_factorials():
    k = np.array([0, 1, 2, 15, 16, 17, 100, 12345, 10**7])
    assert np.allclose(draws.log_factorial(k), [lgamma(x + 1) for x in k.tolist()], rtol=1e-14, atol=1e-12)


def test_binomials_by_inversion():
    for m, p in ((1, 0.5), (7, 0.3), (20, 0.05), (40, 0.9)):
        cdf = np.cumsum([comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)])
        for u in np.linspace(0.001, 0.999, 200):
            assert draws.binomial(m, p, u) == int((cdf < u).sum())
    assert draws.binomial(0, 0.5, 0.4) == 0 and draws.binomial(9, 0.0, 0.4) == 0 and draws.binomial(9, 1.0, 0.4) == 9
    many = np.array([draws.binomial(10**6, 0.25, (k + 0.5) / 2000) for k in range(2000)])
    assert abs(many.mean() - 250000) < 5 and abs(many.std() - np.sqrt(187500)) < 5


def test_leaves_add_up_and_are_multinomial():
    counts, n = np.array([50, 0, 200, 10, 40, 300, 0, 400]), 4000
    of = np.array([draws.draws_of_leaf(counts, leaf, n, 3) for leaf in range(8)])
    assert (of.sum(axis=0) == 1000).all() and (of[[1, 6]] == 0).all()
    share = counts / 1000
    assert np.allclose(of.mean(axis=1), 1000 * share, atol=1.5)
    assert np.allclose(of.std(axis=1), np.sqrt(1000 * share * (1 - share)), rtol=0.06)
    assert abs(np.cov(of[2], of[5])[0, 1] + 1000 * 0.2 * 0.3) < 8


def test_local_draws_are_uniform():
    drawn = draws.local_counts(np.full(300, 1000), 2, 8, 50, 5)
    assert (drawn.sum(axis=1) == 1000).all()
    assert abs(drawn.var() - 1000 * (1 / 50) * (49 / 50)) < 1.0
    assert abs(np.corrcoef(drawn)[np.triu_indices(300, 1)]).mean() < 0.14  # 1 / sqrt(50) is chance alone
    assert draws.local_counts(np.zeros(3, int), 0, 1, 4, 5).sum() == 0 and draws.local_counts(np.full(3, 5), 0, 1, 0, 5).shape == (3, 0)


def test_poisson_counts_are_those_of_md5():
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
    keys = [str(k).encode() for k in range(500)] + [b"", b"a\0", "ü€".encode()] + [b"x" * k for k in (47, 48, 49, 50, 51, 111, 112, 200, 201, 1000)]
    u = lambda it, key: (int(md5(b"42|%d|%s" % (it, key)).hexdigest()[:8], 16) + 0.5) / 2.0**32
    want = [[sum(u(it, key) > c for c in cdf) for key in keys] for it in range(101)]
    assert draws.poisson_counts(keys, 101, 42, cdf).tolist() == want
    assert draws.poisson_counts([], 3, 42, cdf).shape == (3, 0)
