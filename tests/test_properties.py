"""Property tests: operators against brute force on random small inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from matchup.operators import calibrate, reshape

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

facts = st.lists(
    st.tuples(st.sampled_from(["A", "B"]), st.integers(1, 6), st.one_of(st.none(), st.integers(0, 9))),
    min_size=1, max_size=25,
)


@SETTINGS
@given(facts)
def test_cumulate_matches_brute_force(spark, rows):
    df = spark.createDataFrame([(e, 2026, p, None if v is None else float(v)) for e, p, v in rows],
                               "e string, s int, p int, v double")
    got = {(r["e"], r["p"]): r["v"] for r in reshape.cumulate(df, "e", "s", "p", ["v"], 5).collect()}
    want = {}
    for e in {r[0] for r in rows}:
        ps = [p for ee, p, _ in rows if ee == e and p <= 5]
        if not ps:
            continue
        for p in range(min(ps), 6):
            vals = [v for ee, pp, v in rows if ee == e and pp <= p and v is not None]
            want[(e, p)] = float(sum(vals)) if vals else None
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["k1", "k2"]), st.sampled_from(["a", "b", "c"]),
                          st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=20))
def test_pivot_first_matches_brute_force(spark, rows):
    data = [(k, n, None if v is None else float(v), i) for i, (k, n, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, n string, v double, o int")
    got = {r["k"]: (r["a"], r["b"]) for r in reshape.pivot_first(df, ["k"], "n", "v", ["a", "b"], "o").collect()}
    want = {}
    for k in {r[0] for r in data if r[1] in ("a", "b")}:
        first = {}
        for kk, n, v, _ in data:
            if kk == k and v is not None and n not in first:
                first[n] = v
        want[k] = (first.get("a"), first.get("b"))
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=2, max_size=40))
def test_isotonic_is_monotone_and_in_range(spark, rows):
    df = spark.createDataFrame([(x / 20.0, y) for x, y in rows], "x double, y int")
    xs, ys = calibrate.fit_isotonic(df, "x", "y")
    fitted = [r["f"] for r in calibrate.interpolate(df, "x", xs, ys, "f").orderBy("x").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(fitted, fitted[1:]))
    assert all(0.0 <= f <= 1.0 for f in fitted)
