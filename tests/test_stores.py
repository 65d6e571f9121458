import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import canonical
from graphloom.operators.components import connected_components
from graphloom.streaming import incremental, stores


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    store = incremental.NodeStore(spark, str(tmp_path), buckets=50, stretch=4)
    pages = lambda ids, text: spark.createDataFrame([("s", i, f"{text} {i}") for i in ids], incremental.PAGE_SCHEMA)
    written = store.upsert(incremental.page_nodes(pages(range(400), "old")))
    first = store.manifest()
    assert set(written) == set(first) and len(first) > 30
    touched = store.upsert(incremental.page_nodes(pages(range(8, 12), "new")))  # one stretch of pages, 1 % of the keys
    assert len(touched) == 1
    assert {b for b, v in store.manifest().items() if first[b] != v} == set(touched)
    got = {r.segment_index: r.content for r in store.read().collect()}
    assert got == {i: f"{'new' if 8 <= i < 12 else 'old'} {i}" for i in range(400)}
    store.upsert(incremental.page_nodes(pages(range(8, 12), "new")))  # a replay changes stamps only
    again = store.read().collect()
    assert {r.segment_index: r.content for r in again} == got and len(again) == 400
    assert {r.segment_index for r in again if r.modified_at > r.created_at} == set(range(8, 12))
    for k in range(3):
        store.upsert(incremental.page_nodes(pages(range(8, 12), f"v{k}")))
    versions = {tuple(int(x.name.partition("=")[2]) for x in (p.parent, p)) for p in (tmp_path / "Node" / "data").glob("_store_version=*/_store_bucket=*")}
    assert sum(b in touched for _, b in versions) == 2 and len(versions) == len(first) + 1  # the last two manifests' only


def test_nothing_published_is_not_read(spark, tmp_path):
    store = stores.BucketStore(spark, str(tmp_path), "t", F.col("k") % 4)
    assert store.read() is None and store.merge(spark.createDataFrame([], "k int, v string"), stores.replace_rows("k")) == []
    store.merge(spark.createDataFrame([(k, "a") for k in range(8)], "k int, v string"), stores.replace_rows("k"))
    try:
        store.merge(spark.createDataFrame([(1, "b")], "k int, v string"), lambda c, r: r.withColumn("v", F.raise_error(F.lit("broken")).cast("string")))
    except Exception as e:
        assert "broken" in str(e)
    assert {(r.k, r.v) for r in store.read().collect()} == {(k, "a") for k in range(8)}
    store.merge(spark.createDataFrame([(1, "c")], "k int, v string"), stores.replace_rows("k"))
    assert {(r.k, r.v) for r in store.read([1]).collect()} == {(1, "c"), (5, "a")}


def test_components_equal_a_full_run_after_each_batch(spark, tmp_path):
    rnd = random.Random(5)
    store = stores.ComponentStore(spark, str(tmp_path), buckets=8)
    edges, vertices = [], set()
    for size in (30, 25, 0, 60):
        new = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(size)]
        alone = [rnd.randrange(200, 220) for _ in range(5)]
        edges, vertices = edges + new, vertices | set(alone)
        store.add(spark.createDataFrame(new, "x int, y int"), spark.createDataFrame([(v,) for v in alone], "v int"))
        want = connected_components(spark.createDataFrame(edges, "x int, y int"), spark.createDataFrame([(v,) for v in vertices], "v int"))
        assert sorted(map(tuple, store.labels().collect())) == sorted(map(tuple, want.collect()))


def test_clusters_of_arriving_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(7, 6))
    x = centres[rng.integers(0, 7, 90)] + 0.4 * rng.normal(size=(90, 6))
    store, seen = stores.ClusterStore(spark, str(tmp_path), 0.9, buckets=4), []
    for batch in (range(0, 40), range(40, 41), range(41, 90), range(30, 50)):  # the last is a replay
        seen += [i for i in batch if i not in seen]
        store.add(spark.createDataFrame([(i, x[i].tolist()) for i in batch], "id long, embedding array<double>"))
        want = canonical.clusters(spark.createDataFrame([(i, x[i].tolist()) for i in seen], "id long, embedding array<double>"), 0.9)
        assert sorted(map(tuple, store.labels().collect())) == sorted(map(tuple, want.collect()))
