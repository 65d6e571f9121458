import math

import numpy as np
import pytest

from graphloom.llm import ann
from graphloom.llm.ann import ann_search, exact_search, hadamard, rotate


def brute(rows, queries, k):
    good = {i: np.array(v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, vec string")


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [(r, i) for r, i, _ in a[q]] == [(r, i) for r, i, _ in b[q]]
        assert np.allclose([s for *_, s in a[q]], [s for *_, s in b[q]], rtol=1e-12, atol=1e-15)


def test_odd_vectors_ties_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(6)] + [(10 + i, [1.0, 0.0, 0.0]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 0.0]), (104, [float("nan"), 1.0, 0.0]), (105, [float("inf"), 0.0, 0.0]), (None, [1.0, 2.0, 3.0]), (106, [1e-200, 0.0, 0.0]), (107, [3.0])]
    df = frame(spark, rows)
    want = brute(rows, [i for i, _ in rows], 10)
    want.pop(107)  # nothing of its length
    same(result(exact_search(df, df)), want)
    got = result(ann_search(df, df))
    same({q: got[q] for q in (*range(6), 106)}, {q: want[q] for q in (*range(6), 106)})
    assert all(len(got[q]) == 10 and {s for *_, s in got[q]} == {0.0} for q in range(10, 50))
    same({q: got[q] for q in range(10, 50)}, {q: want[q] for q in range(10, 50)})
    assert ann_search(df.limit(0), df).collect() == [] and ann_search(df, df.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    queries = rows.where("vec_id % 20 = 0")
    got, want = result(ann_search(rows, queries)), result(exact_search(rows, queries))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.93
    for q in want:
        true = {i: s for _, i, s in want[q]}
        assert all(s == true[i] for _, i, s in got[q] if i in true)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(4, 6))
    assert np.allclose(np.linalg.norm(rotate(x, 0, 1), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(np.eye(8))), np.eye(8))
