"""Similarity joins that stream one side past chunks of the other; vectors that items share; what a written table leaves behind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import search, similarity
from graphloom.scratch import CLEANUP, materialize
from test_similarity import clustered, cosines, frame


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("within", [None, "book"])
def test_several_chunks(spark, monkeypatch, within):
    """Chunks of 25 vectors: each pair is still met once, and nothing is shuffled."""
    monkeypatch.setattr(similarity, "CHUNK_BYTES", 25 * 8 * 8)
    x, y = clustered(1, 150), clustered(4, 70)
    s, t = cosines(x, x), cosines(y, x)
    same = lambda i, j: within is None or i % 3 == j % 3
    clear = lambda v, cut: abs(v - cut) > 1e-9
    met = similarity.self_pairs(frame(spark, x), 0.85, block=16, within=within)
    assert "Exchange" not in _plan(met)
    out = met.collect()
    got = [(r.a, r.b) for r in out if r.a is not None]
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.85 and same(i, j)}
    assert len(got) == len(set(got)) and not {p for p in set(got) ^ want if clear(s[p], 0.85)}
    pairs = sum(same(i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    assert sum(r.pairs for r in out if r.a is None) <= pairs
    for k in (None, 3):
        met = similarity.pairs_above(frame(spark, y), frame(spark, x), 0.7, "id", "id", k=k, within=within).where("a is not null")
        assert "Exchange" not in _plan(met)
        got = {(r.a, r.b) for r in met.collect()}
        every = {(i, j) for i in range(len(y)) for j in range(len(x)) if t[i, j] >= 0.7 and same(i, j)}
        if k is None:
            assert not {p for p in got ^ every if clear(t[p], 0.7)}
        else:
            assert not {p for p in got - every if clear(t[p], 0.7)}
            for i in range(len(y)):
                best = sorted((t[p] for p in every if p[0] == i), reverse=True)[:k]
                assert np.allclose(sorted((t[p] for p in got if p[0] == i), reverse=True)[:k], best)
    found = similarity.nearest(frame(spark, y), frame(spark, x), 4, "id", "id", within=within, block=16).where("a is not null").collect()
    for i in range(len(y)):
        want = sorted((t[i, j] for j in range(len(x)) if same(i, j)), reverse=True)[:4]
        assert np.allclose(sorted((r.score for r in found if r.a == i), reverse=True)[:4], want)


@pytest.mark.parametrize("within", [None, "book"])
def test_shared_vectors_give_what_own_ones_give(spark, within):
    """Items that share vectors, and different vectors of equal score: the same ranks as with a vector in each row."""
    v = clustered(6, 40)  # vectors 3 to 39 are equal
    v[10:] = clustered(7, 30, noise=0.4)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vector_id long, embedding array<double>")
    items = spark.range(400).select(F.sha1(F.col("id").cast("string")).alias("uuid"), (F.col("id") * 7 % 40).alias("vector_id"), (F.col("id") % 3).cast("int").alias("book"))
    queries = frame(spark, clustered(8, 30), "q")
    rank = lambda df: {(r.query_id, r["rank"]): r.item_id for r in df.collect()}
    shared = rank(search.knn_join(queries, items, 9, "q", "uuid", within=within, vectors=vectors))
    assert len(shared) == 9 * 30 and shared == rank(search.knn_join(queries, items.join(vectors, "vector_id"), 9, "q", "uuid", within=within))


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: sum("shuffle_" in str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    spark._jvm.System.gc()
    rows = spark.range(1000).groupBy(F.col("id") % 10).count()
    before = files()
    assert materialize(rows, "counts").count() == 10
    import time

    for _ in range(50):
        if files() <= before + 8:
            break
        time.sleep(0.1)
    assert files() <= before + 8  # those of the count itself
    assert spark.conf.get(CLEANUP) == "false"


def test_links_are_no_more_than_vectors(spark, monkeypatch):
    """Alike vectors make a pair for each two, but an edge for each one in a task; components stay."""
    monkeypatch.setattr(similarity, "CHUNK_BYTES", 60 * 8 * 8)
    x = clustered(9, 200)
    s = cosines(x, x)
    links = similarity.self_links(frame(spark, x).coalesce(1), 0.8).collect()
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.8]
    assert len(links) < 2000 < len(pairs)

    def groups(edges):
        label = list(range(len(x)))
        for _ in range(len(x)):
            before = list(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    assert groups([(r.a, r.b) for r in links]) == groups(pairs)
