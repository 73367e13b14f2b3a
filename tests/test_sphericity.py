"""Mauchly's test, Greenhouse-Geisser correction and effect sizes against plain numpy."""

import numpy as np
import pytest

from evalframe.functions.dist import chi2_upper_p, f_upper_p, mauchly
from evalframe.operators import stats as T


def contrasts(k):
    """Orthonormal contrasts of k levels."""
    q, _ = np.linalg.qr(np.column_stack([np.ones(k), np.eye(k)[:, :-1]]))
    return q[:, 1:].T


def plain(y):
    """(epsilon, W) of a subjects x levels matrix."""
    c = contrasts(y.shape[1])
    s = c @ np.cov(y.T) @ c.T
    d = len(s)
    return np.trace(s) ** 2 / (d * np.trace(s @ s)), np.linalg.det(s) / (np.trace(s) / d) ** d


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    y = rng.standard_normal((30, 4, 3)) * np.array([1, 2, 4, 0.5])[None, :, None] + rng.standard_normal((30, 1, 1)) * 3
    y[:, 0] += 1.5
    return y


@pytest.fixture(scope="module")
def cells(spark, data):
    rows = [(f"s{s}", f"c{i}", f"t{j}", float(data[s, i, j])) for s in range(30) for i in range(4) for j in range(3)]
    return spark.createDataFrame(rows, "user_id string, condition string, task string, mean_value double").repartition(4)


def test_chi_square_tail():
    # tabled 5 % and 1 % points
    for df, x, p in ((1, 3.841459, 0.05), (5, 11.0705, 0.05), (9, 21.66599, 0.01), (13, 27.68825, 0.01)):
        assert chi2_upper_p(x, df) == pytest.approx(p, abs=1e-6)
    assert chi2_upper_p(0, 3) == 1.0


def test_two_way_effects(cells, data):
    got = {r.source: r for r in T.rm_anova(cells, "condition", "task").collect()}
    views = {"condition": data.mean(2), "task": data.mean(1)}
    for source, y in views.items():
        eps, w = plain(y)
        r = got[source]
        assert (r.epsilon, r.w_spher) == pytest.approx((eps, w))
        grand, n, k = y.mean(), *y.shape
        other = data.shape[1] * data.shape[2] / k
        ss = other * n * ((y.mean(0) - grand) ** 2).sum()
        err = other * ((y - y.mean(0) - y.mean(1)[:, None] + grand) ** 2).sum()
        f = (ss / (k - 1)) / (err / ((k - 1) * (n - 1)))
        assert (r.ss, r.ss_error, r.f_statistic) == pytest.approx((ss, err, f))
        assert r.p_gg == pytest.approx(f_upper_p(f, (k - 1) * eps, (k - 1) * (n - 1) * eps))
    z = np.kron(contrasts(4), contrasts(3)) @ np.cov(data.reshape(30, 12).T) @ np.kron(contrasts(4), contrasts(3)).T
    assert got["condition:task"].epsilon == pytest.approx(np.trace(z) ** 2 / (6 * np.trace(z @ z)))
    assert got["condition:task"].w_spher == pytest.approx(np.linalg.det(z) / (np.trace(z) / 6) ** 6)
    assert not got["condition"].spherical and got["condition"].p_reported == got["condition"].p_gg


def test_one_way_and_paired(cells, data, spark):
    one = {r.task: r for r in T.rm_anova_oneway(cells, "condition", ["task"]).collect()}
    for j in range(3):
        eps, w = plain(data[:, :, j])
        assert (one[f"t{j}"].epsilon, one[f"t{j}"].w_spher) == pytest.approx((eps, w))
    means = cells.groupBy("user_id", "condition").agg({"mean_value": "avg"}).withColumnRenamed("avg(mean_value)", "mean_value")
    pairs = {(r.level_a, r.level_b): r for r in T.ttest_paired(means, "condition", [f"c{i}" for i in range(4)]).collect()}
    y = data.mean(2)
    for (a, b), r in pairs.items():
        u, v = y[:, int(a[1])], y[:, int(b[1])]
        assert r.cohen_d == pytest.approx((u.mean() - v.mean()) / np.sqrt((u.var(ddof=1) + v.var(ddof=1)) / 2))


def test_degenerate_cases(spark):
    assert mauchly([], 10, 1) == (None, None) and mauchly([(0, 0, 1.0)], 2, 3) == (None, None)
    two = spark.createDataFrame([(s, c, "t", v) for s, c, v in (("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 2.0), ("b", "y", 4.0))],
                                "user_id string, condition string, task string, mean_value double")
    r = T.rm_anova_oneway(two, "condition", ["task"]).collect()[0]
    assert r.epsilon == 1.0 and r.w_spher is None and r.spherical and r.p_reported == r.p_value
    assert T.rm_anova_oneway(two.limit(0), "condition", ["task"]).count() == 0
