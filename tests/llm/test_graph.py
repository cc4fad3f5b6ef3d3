"""Components against a sequential union-find."""

import random

import pytest

from matchup.llm.graph import components

RANDOM = random.Random(7)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(40)],
    "random": [(RANDOM.randrange(150), RANDOM.randrange(150)) for _ in range(100)],
    "hub with repeats and loops": [(99, i) for i in range(30)] * 2 + [(5, 5), (200, 200)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_match_union_find(spark, name):
    edges, parent = GRAPHS[name], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    rows = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(rows) == len(nodes)
    assert dict(rows) == {x: root(x) for x in nodes}
