import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import components
from graphloom.operators.components import connected_components


def union_find(edges, vertices):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in [*vertices, *parent]}


@pytest.mark.parametrize("seed", range(3))
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(9999,), (5,)], "v long")).collect()
    want = union_find(edges, [9999, 5])
    assert len(got) == len(want) and all(want[r.vertex] == r.component for r in got)


def test_strings_nulls_and_no_edges(spark):
    e = spark.createDataFrame([("b", "a"), ("c", None), ("b", "d")], "x string, y string")
    assert {tuple(r) for r in connected_components(e).collect()} == {("a", "a"), ("b", "a"), ("d", "a")}
    assert connected_components(e.limit(0)).collect() == []


def test_long_chains_by_contraction(spark, monkeypatch):
    """Chains whose names are in no order along them, stars and singletons; tasks of a few edges, so that rounds are needed."""
    monkeypatch.setattr(components, "TASK_EDGES", 40)
    seen = []
    moves = components._moves
    monkeypatch.setattr(components, "_moves", lambda edges, seed: seen.append(seed) or moves(edges, seed))
    names = [f"v{i}" for i in range(1500)]
    random.Random(5).shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(700) if i % 350 != 349] + [(names[800], names[801 + i]) for i in range(200)] + [(names[1100], names[1100])] + [(names[3], names[2])] * 5
    rows = spark.createDataFrame(edges, "a string, b string").repartition(8)
    got = {r.vertex: r.component for r in connected_components(rows, spark.createDataFrame([(names[1200],), (names[0],)], "v string")).collect()}
    assert got == union_find(edges, [names[1200], names[0]])
    assert 0 < len(seen) < 20  # halved each time, not by one vertex


def test_mixing_is_a_permutation(spark):
    v = F.col("v")
    rows = spark.createDataFrame([(0,), (1,), (-1,), (2**63 - 1,), (-(2**63),), (5 << 33,)], "v long")
    for seed in range(3):
        assert rows.where(components._restored(components._mixed(v, seed), seed) != v).count() == 0
