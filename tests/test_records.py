"""Flattening of JSON records of unknown shape against a plain walk of each record."""

import json
import random

import pytest

from matchup.operators.records import flatten_variant

ODD = ["we ird", 'q"uote', "a.b", "", "ä", "it's", "]"]


def walk(d, at=()):
    for k, v in d.items():
        if isinstance(v, dict):
            yield from walk(v, (*at, k))
        elif v is None or isinstance(v, (bool, int, float)):
            yield (*at, k), v


def record(rng, depth=0):
    out = {}
    for k in rng.sample(["a", "b", "c", "d", *ODD], rng.randint(0, 5)):
        pick = rng.random()
        if pick < 0.3 and depth < 3:
            out[k] = record(rng, depth + 1)
        else:
            out[k] = rng.choice([1, -7, 2.5, 1e30, 12345678901234567890, True, False, None, "12", "x", [1, 2], [{"a": 1}]])
    return out


def test_mixed_shapes_against_a_walk(spark):
    rng = random.Random(6)
    records = [record(rng) for _ in range(300)]
    texts = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(1000, None), (1001, ""), (1002, "{broken"), (1003, "[1, 2]"), (1004, "7")]
    got = {r["id"]: r.asDict() for r in flatten_variant(spark.createDataFrame(texts, "id long, o string"), "o", "o").collect()}
    want = {i: {} for i, _ in texts}
    for i, r in enumerate(records):
        for path, v in sorted(walk(r), reverse=True):  # of equal names the first path that is not null
            name = "_".join(("o", *path))
            want[i][name] = v if v is not None else want[i].get(name)
    names = {n for w in want.values() for n in w}
    assert set(got[0]) == {"id", *names} and len(names) > 50
    for i, w in want.items():
        for n in names:
            v = w.get(n)
            assert (got[i][n] is None) if v is None else got[i][n] == pytest.approx(float(v)), (i, n)


def test_types_clashes_and_bounds(spark):
    df = spark.createDataFrame([('{"n": 1, "r": 1, "t": true}', "x"), ('{"n": 2, "r": 1.5, "t": null}', "y")], "o string, o_n string")
    out = flatten_variant(df, "o", "o")
    assert dict(out.dtypes) == {"o_n": "bigint", "o_r": "double", "o_t": "boolean"}
    assert sorted(map(tuple, out.collect())) == [(1, 1.0, True), (2, 1.5, None)]
    assert flatten_variant(df.limit(0), "o", "o").columns == ["o_n"]
    with pytest.raises(ValueError, match="more than 2"):
        flatten_variant(df, "o", "o", max_paths=2)
