import numpy as np
import pytest

from matchup.llm import mixing as m

TARGETS = {"a": 0.90, "b": 0.02, "c": 0.08}


def shares(spark, w, p):
    n = len(w)
    table = spark.createDataFrame([(i, int(w[i]), *map(float, p[i])) for i in range(n)], "id long, tokens long, p_a double, p_b double, p_c double")
    r = np.array([x.rate for x in m.fitted(m.staged(table, "t"), TARGETS, anchor=m.LAST).orderBy("id").select("rate").collect()])
    return r, (w * r) @ p / w.sum()


def test_rare_domains_reach_their_targets(spark):
    rng = np.random.default_rng(2)
    n = 2000
    w, kind = rng.integers(1, 500, n), rng.choice(3, n, p=[0.986, 0.004, 0.01])
    p = np.full((n, 3), 0.001)
    p[np.arange(n), kind] = 0.998
    r, got = shares(spark, w, p)
    assert (r >= 0).all() and np.abs(got / list(TARGETS.values()) - 1).max() < 1e-4
    soft = rng.dirichlet([5, 0.02, 0.05], n)
    r, got = shares(spark, w, soft)
    assert (r >= 0).all() and np.abs(got / list(TARGETS.values()) - 1).max() < 1e-4


def test_a_target_that_no_rate_reaches_is_reported(spark):
    w, p = np.array([10, 20, 30]), np.array([[1.0, 0, 0], [0.5, 0, 0.5], [0, 0, 1.0]])
    with pytest.warns(UserWarning, match="no rates reach all targets.*'b': 0.0"):
        _, got = shares(spark, w, p)
    assert np.abs(got - [0.90, 0, 0.08]).max() < 1e-4


def test_targets_out_of_reach_together_are_reported(spark):
    w, p = np.array([10, 20]), np.array([[0.5, 0.25, 0.25], [0.4, 0.3, 0.3]])
    with pytest.warns(UserWarning, match="no rates reach"):
        r, _ = shares(spark, w, p)
    assert np.isfinite(r).all()
