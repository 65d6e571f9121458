import uuid

from pyspark.sql import functions as F

from graphloom.operators import communities, graph, keys


def reference_key(text):
    return uuid.uuid5(uuid.NAMESPACE_URL, text).hex


def test_hub_keys_of_sorted_spokes(spark):
    groups = {("a", "x"): ["s2", "s10", "s1"], ("a", "y"): ["é", "z"], ("b", "x"): ["only"]}
    rows = [(s, c, m, "Name" if k else "Nm") for (s, c), ms in groups.items() for k, m in enumerate(ms)]
    clusters = spark.createDataFrame(rows, "source string, component string, uuid string, name string").repartition(5)
    for kind in ("entity", "predicate"):
        got = {(r.source, r.component): r for r in graph.hubs(clusters, kind).collect()}
        assert {k: r.uuid for k, r in got.items()} == {(s, c): reference_key(f"{s}#{kind}_hub#{'#'.join(sorted(ms))}") for (s, c), ms in groups.items()}
        assert {k: r.n_spokes for k, r in got.items()} == {k: len(m) for k, m in groups.items()}
        assert (got["a", "x"].name, got["a", "x"].aliases) == ("Name", ["Nm"]) and got["b", "x"].aliases == []
    one = spark.createDataFrame([("a", ["s2", "s10", "s1"])], "source string, spokes array<string>")
    assert one.select(keys.hub_key(F.col("source"), "entity", F.col("spokes")).alias("k")).first().k == reference_key("a#entity_hub#s1#s10#s2")


def test_a_hub_of_a_million_spokes(spark):
    n = 1_000_000
    spokes = spark.range(n).select(F.lit("book").alias("source"), F.lit(1).alias("component"), F.md5(F.col("id").cast("string")).alias("uuid"), (F.col("id") % 3).cast("string").alias("name"))
    got = graph.hubs(spokes, "entity").collect()
    import hashlib

    every = sorted(hashlib.md5(str(i).encode(), usedforsecurity=False).hexdigest() for i in range(n))
    assert [(r.uuid, r.n_spokes, r.name) for r in got] == [(reference_key("book#entity_hub#" + "#".join(every)), n, "0")]


def test_communities_members_and_evidence(spark):
    t = spark.createDataFrame([("b", "t1", "h1", "p1", "h2"), ("b", "t2", "h2", "p1", "h3"), ("b", "t3", "h7", "p7", "h7"), ("c", "t4", "h1", "p1", "h2")], "source string, triplet_uuid string, subj_hub string, pred_hub string, obj_hub string")
    m = communities.community_of_hubs(t)
    table = graph.communities(m)
    want = {reference_key(f"b#community#{'#'.join(x)}"): (set(x), e) for x, e in ((("h1", "h2", "h3", "p1"), {"t1", "t2"}), (("h7", "p7"), {"t3"}))} | {reference_key("c#community#h1#h2#p1"): ({"h1", "h2", "p1"}, {"t4"})}
    assert {r.uuid: r.n_members for r in table.collect()} == {k: len(v) for k, (v, _) in want.items()}
    for edges, at in ((graph.community_members(m, table), 0), (graph.community_evidence(communities.community_triplets(t, m), table), 1)):
        got = {}
        for r in edges.collect():
            got.setdefault(r.src, set()).add(r.dst)
        assert got == {k: v[at] for k, v in want.items()}


def test_summary_of_a_community_with_many_and_long_lines(spark):
    lines = spark.range(200_000).select(F.lit("s").alias("source"), F.lit("c").alias("component"), F.concat(F.lit("line "), F.lpad(F.col("id").cast("string"), 7, "0")).alias("line"))
    other = spark.createDataFrame([("s", "d", "x" * 100_000), ("s", "d", "a"), ("s", "e", "")], lines.schema)
    defs = spark.createDataFrame([("s", "c", "what c is"), ("s", "z", "no triplets"), ("s", "d", "")], "source string, component string, definition string")
    got = {r.component: r.summary_text for r in communities.community_summary(defs, lines.unionByName(other), 300).collect()}
    assert got == {"c": "\n".join(["what c is", *(f"line {i:07d}" for i in range(60))])[:300], "d": ("\na\n" + "x" * 400)[:300], "e": ""}


def test_spokes_move_into_hubs(spark):
    y = lambda n: F.to_timestamp(F.lit(f"{n}-01-01"))
    edges = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h2")], "src string, dst string").withColumns({"created_at": y(2019), "modified_at": y(2019)})
    moved = spark.createDataFrame([("a", "h2"), ("b", "h1"), ("d", "h1")], "uuid string, hub string")
    first = graph.move_spokes(edges, moved, y(2020))
    got = {(r.src, r.dst, r.created_at.year, r.modified_at.year) for r in first.collect()}
    assert got == {("a", "h2", 2020, 2020), ("b", "h1", 2019, 2020), ("c", "h2", 2019, 2019), ("d", "h1", 2020, 2020)}
    again = graph.move_spokes(first, moved, y(2021)).collect()
    assert {(r.src, r.dst, r.created_at.year) for r in again} == {x[:3] for x in got}
