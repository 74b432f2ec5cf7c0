import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spikeloom.llm.components import components, forest_of


def brute(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        root.setdefault(a, a), root.setdefault(b, b)
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def run(spark, edges, **kw):
    return {r.node: r.group_key for r in components(spark.createDataFrame(edges, "a long, b long, node string, group_key string"), "a", "b", **kw).collect()}


def pad(edges):
    return [(a, b, "n", "g") for a, b in edges]


def test_dirt_and_empty(spark):
    edges = [(5, 3), (3, 5), (5, 3), (7, 7), (None, 1), (2, None), (3, 9), (20, 21)]
    assert run(spark, pad(edges)) == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20}
    assert run(spark, []) == {}


def test_levels_with_small_bounds(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 60)]
    loose = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = chain + hub + loose
    want = brute(edges)
    for bound in (15, 80, 10_000):
        assert run(spark, pad(edges), bound=bound) == want, bound


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 30), st.integers(-5, 30)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=60))
def test_forest(edges):
    a, b = np.array(edges).T
    node, root = forest_of(a, b)
    want = brute(edges)
    assert {**{int(r): int(r) for r in root}, **{int(n): int(r) for n, r in zip(node, root)}} == want
    assert len(node) == len(want) - len(set(want.values()))  # a spanning forest, no more
