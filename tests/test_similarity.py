import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import canonical, search, similarity


def clustered(seed, n, d=8, centres=6, noise=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, d))
    x[:3] = 0  # zero vectors
    x[3:40] = x[3]  # copies
    return x


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(10**6, None, 0)], f"{name} long, embedding array<double>, book int").repartition(5)


def cosines(x, y):
    u, v = (z / np.where((n := np.linalg.norm(z, axis=1, keepdims=True)) == 0, 1, n) for z in (x, y))
    return u @ v.T


@pytest.mark.parametrize(("threshold", "block"), [(0.85, 16), (0.99, 50), (0.3, 40), (-0.1, 64), (0.85, 2048)])
def test_self_pairs(spark, threshold, block):
    x = clustered(1, 230)
    s = cosines(x, x)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= threshold}
    near = {(i, j) for i, j in zip(*np.nonzero(np.abs(s - threshold) < 1e-9), strict=True)}
    out = similarity.self_pairs(frame(spark, x), threshold, block=block).collect()
    got = [(r.a, r.b) for r in out if r.a is not None]
    assert len(got) == len(set(got)) and set(got) ^ want <= near
    assert all(abs(r.score - s[r.a, r.b]) < 1e-9 for r in out if r.a is not None)
    met, every = sum(r.pairs for r in out if r.a is None), len(x) * (len(x) - 1) // 2
    assert met <= every
    if block < 100 and threshold >= 0.85:
        assert met < 0.6 * every and sum(r.multiplied for r in out if r.a is None) < 0.3 * every


@pytest.mark.parametrize("within", [None, "book"])
def test_nearest(spark, within):
    x, y = clustered(2, 300), clustered(2, 60)[20:]
    s = np.round(cosines(y, x), 12)
    items, queries = frame(spark, x, "item"), frame(spark, y, "q")
    met = similarity.nearest(queries, items, 4, "q", "item", within=within, block=20)
    found = met.where("a is not null").collect()
    for q in range(len(y)):
        known = [i for i in range(len(x)) if within is None or i % 3 == q % 3]
        want = sorted(known, key=lambda i: (-s[q, i], i))[:4]
        got = sorted(((r.b, r.score) for r in found if r.a == q), key=lambda r: (-round(r[1], 12), r[0]))[:4]
        assert np.allclose([r[1] for r in got], [s[q, i] for i in want], atol=1e-9)
    whole = search.knn_join(queries, items, 4, "q", "item", within=within)
    assert whole.groupBy("query_id").count().where("count <> 4").count() == 0
    if within is None:
        assert similarity.report(met).first().pairs < 0.8 * len(x) * len(y)


def test_candidates_of_clusters(spark):
    x, hubs = clustered(3, 120), clustered(3, 30)
    s = np.round(cosines(x, hubs), 12)
    left = frame(spark, x, "cluster_id").withColumnRenamed("embedding", "centroid").where("centroid is not null")
    right = frame(spark, hubs, "k").where("embedding is not null").select(F.concat(F.lit("h"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("hub_uuid"), "embedding")
    got = {}
    for r in canonical.candidate_hubs(left, right, 3, 0.7).collect():
        got.setdefault(r.cluster_id, []).append((r["rank"], int(r.hub_uuid[1:])))
    for c in range(len(x)):
        want = [h for h in sorted(range(len(hubs)), key=lambda h: (-s[c, h], h)) if s[c, h] >= 0.7][:3]
        have = [h for _, h in sorted(got.get(c, []))]
        assert np.allclose([s[c, h] for h in have], [s[c, h] for h in want])


def test_share_multiplied_at_the_default_threshold(spark):
    """The given vectors are barely similar: cells prune nothing there, the bound does."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    r = similarity.report(similarity.self_pairs(v, 0.85, block=512)).first()
    n = v.count()
    assert r.pairs <= n * (n - 1) // 2 and r.multiplied <= 0.3 * n * (n - 1) / 2


def test_empty_tables(spark):
    none = frame(spark, np.zeros((0, 3))).where("embedding is not null")
    some = frame(spark, clustered(1, 50))
    assert similarity.self_pairs(none, 0.5).where("a is not null").count() == 0
    for a, b in ((none, some), (some, none)):
        assert search.knn_join(a, b, 3, "id", "id").count() == 0
        assert search.block_scores(a, b, 0.5, "id", "id").count() == 0


def test_canonicalize_by_book_and_kind(spark):
    v = {"a": [1.0, 0.0, 0.0], "b": [0.99, 0.1, 0.0], "c": [0.0, 1.0, 0.0]}
    rows = [("u1", "x", "entity", "Alpha", "first", v["a"]), ("u2", "x", "entity", "alpha", "again", v["b"]), ("u3", "x", "entity", "C", "", v["c"]), ("u4", "y", "entity", "Alpha", "first", v["a"]), ("u5", "x", "predicate", "is", "", v["a"]), ("u6", "x", "entity", "none", "", None)]
    spokes = spark.createDataFrame(rows, "uuid string, source string, kind string, name string, description string, embedding array<double>")
    hubs = spark.createDataFrame([("h1", "x", "entity", "old", v["a"]), ("h2", "y", "entity", "other", v["c"])], "hub_uuid string, source string, kind string, text string, embedding array<double>")

    def run(**how):
        out = canonical.canonicalize_spokes(spokes, hubs, 0.9, 0.9, **how)
        edges = {r.src: r.dst for r in out["edges"].collect()}
        return edges, {r.hub_uuid: (r.text, r.merged) for r in out["definitions"].collect()}, {r.kind: tuple(r)[1:] for r in out["report"].collect()}

    import uuid

    key = lambda source, kind, *spokes: uuid.uuid5(uuid.NAMESPACE_URL, f"{source}#{kind}_hub#{'#'.join(spokes)}").hex
    edges, texts, report = run()
    assert edges == {"u1": "h1", "u2": "h1", "u3": key("x", "entity", "u3"), "u4": key("y", "entity", "u4"), "u5": key("x", "predicate", "u5")}
    assert texts == {"h1": ("old again first", True), edges["u3"]: ("C", False), edges["u4"]: ("first", False), edges["u5"]: ("is", False)}
    assert report == {"entity": (1, 2, 0, 4), "predicate": (0, 1, 0, 1)}
    edges, texts, report = run(cross_source=True, kinds=("entity",))
    assert edges == {"u1": "h1", "u2": "h1", "u3": "h2", "u4": "h1"} and report == {"entity": (3, 0, 0, 4)}
    assert texts["h1"] == ("old again first", True) and texts["h2"] == ("other", True)
    assert set(run(source="y")[0]) == {"u4"}
