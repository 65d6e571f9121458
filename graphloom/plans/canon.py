"""Queries over clusters, hubs, communities, search, checks and user functions (2.H to 2.M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import providers
from graphloom.operators import canonical, checks, communities, graph, search, semantics
from graphloom.plans.base import NODES, STAR, nodes, query, star_triplets, uuid5_sql
from graphloom.scratch import materialize
from graphloom.streaming import incremental
from graphloom.tables import table

C = F.col
COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
T = 0.35


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(C("vec_id").alias("id"), "embedding", "label")


@query("h1_uncanonicalized_entities", "SELECT vec_id AS uuid FROM embeddings WHERE vec_id % 5 <> 0")
def h1(spark, sf):
    v = _vectors(spark, sf).select(C("id").alias("uuid"), "embedding")
    return canonical.uncanonicalized(v, v.where("uuid % 5 = 0").select(C("uuid").alias("src"))).select("uuid")


@query("h2_uncanonicalized_predicates", "SELECT vec_id AS uuid FROM embeddings WHERE vec_id % 5 <> 0 AND label = 3")
def h2(spark, sf):
    v = _vectors(spark, sf).select(C("id").alias("uuid"), "embedding", C("label").cast("string").alias("source"))
    return canonical.uncanonicalized(v, v.where("uuid % 5 = 0").select(C("uuid").alias("src")), "3").select("uuid")


@query("h3_require_embeddings", "SELECT vec_id AS uuid, len(embedding)::INT AS n FROM embeddings")
def h3(spark, sf):
    return canonical.require_embeddings(_vectors(spark, sf).withColumnRenamed("id", "uuid")).select("uuid", F.size("embedding").alias("n"))


@query("h4_cosine", f"SELECT a.vec_id, round({COS}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h4(spark, sf):
    v = _vectors(spark, sf)
    b = v.select((C("id") - 1).alias("id"), C("embedding").alias("other"))
    return v.join(b, "id").select(C("id").alias("vec_id"), F.round(canonical.cosine(C("embedding"), C("other")), 6).alias("score"))


PAIRS = f"pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {COS} >= {T})"
COMPONENTS = f"RECURSIVE {PAIRS}, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT vec_id AS v, vec_id AS w FROM embeddings UNION SELECT v, b FROM reach JOIN edges ON w = a), comp AS (SELECT v AS vertex, min(w) AS component FROM reach GROUP BY v)"


@query("h5_similar_pairs", f"WITH {PAIRS} SELECT a, b FROM pairs")
def h5(spark, sf):
    return canonical.similar_pairs(_vectors(spark, sf), T).select("a", "b")


@query("h6_connected_components", f"WITH {COMPONENTS} SELECT * FROM comp")
def h6(spark, sf):
    return canonical.clusters(_vectors(spark, sf), T)


@query("h7_display_name", "WITH f AS (SELECT o_orderpriority AS component, o_orderstatus || (o_custkey % 7) AS name, count(*) AS n, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2) SELECT component, arg_min(name, {'a': -n, 'l': length(name), 'p': pos}) AS display_name FROM f GROUP BY component")
def h7(spark, sf):
    o = table(spark, sf, "orders").select(C("o_orderpriority").alias("component"), F.concat("o_orderstatus", (C("o_custkey") % 7).cast("string")).alias("name"), C("o_orderkey").alias("pos"))
    return canonical.display_name(o)


@query("h8_centroid", "SELECT label AS component, dim, round(avg(x), 6) AS x FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def h8(spark, sf):
    c = canonical.centroid(_vectors(spark, sf).withColumnRenamed("label", "component"))
    return c.select("component", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("h9_descriptions_of", "SELECT source AS component, list_sort(list(DISTINCT lang)) AS descriptions FROM documents WHERE doc_id % 3 <> 0 GROUP BY source")
def h9(spark, sf):
    d = table(spark, sf, "documents").select(C("source").alias("component"), F.when(C("doc_id") % 3 == 0, " ").otherwise(C("lang")).alias("description"))
    return canonical.descriptions_of(d)


HUBV = "hubv AS (SELECT label, list(x ORDER BY dim) AS v FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY label)"
HCOS = "list_cosine_similarity(a.embedding::DOUBLE[], b.v)"
CAND = f"{HUBV}, cand AS (SELECT * FROM (SELECT a.vec_id AS cluster_id, 'hub' || b.label AS hub_uuid, {HCOS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {HCOS} DESC, 'hub' || b.label) AS rank FROM embeddings a CROSS JOIN hubv b WHERE {HCOS} >= 0.2) WHERE rank <= 5)"


def _hub_vectors(spark, sf):
    """A hub for each label: the centroid of all its vectors."""
    c = canonical.centroid(_vectors(spark, sf).withColumnRenamed("label", "component"))
    return c.select(F.concat(F.lit("hub"), C("component").cast("string")).alias("hub_uuid"), C("centroid").alias("embedding"))


def _candidates(spark, sf):
    """Every vector is a cluster of its own."""
    v = _vectors(spark, sf).select(C("id").alias("cluster_id"), C("embedding").alias("centroid"))
    return canonical.candidate_hubs(v, _hub_vectors(spark, sf), 5, 0.2)


@query("h10_candidate_hubs", f"WITH {CAND} SELECT cluster_id, hub_uuid, rank FROM cand")
def h10(spark, sf):
    return _candidates(spark, sf).select("cluster_id", "hub_uuid", "rank")


def _aligned(spark, sf):
    c = _candidates(spark, sf)
    d = c.select("cluster_id", "hub_uuid", F.when(C("score") >= 0.3, "Merge").when(C("score") >= 0.25, "Review").otherwise("New").alias("decision"))
    return canonical.align_clusters(_vectors(spark, sf).select(C("id").alias("cluster_id")), c, d)


ALIGNED = f"WITH {CAND}, al AS (SELECT e.vec_id AS cluster_id, arg_min(hub_uuid, rank) FILTER (score >= 0.3) AS hub_uuid, count(*) FILTER (score < 0.3 AND score >= 0.25) AS review FROM embeddings e LEFT JOIN cand ON cluster_id = e.vec_id GROUP BY e.vec_id)"


@query("h11_align_cluster", f"{ALIGNED} SELECT * FROM al")
def h11(spark, sf):
    return _aligned(spark, sf)


@query("h12_new_definition", "WITH d AS (SELECT source, list_sort(list(DISTINCT lang) FILTER (doc_id % 40 = 0)) AS l FROM documents GROUP BY source) SELECT source, CASE WHEN len(coalesce(l, [])) = 0 THEN source ELSE array_to_string(l, ' ') END AS definition FROM d")
def h12(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.collect_set(F.when(C("doc_id") % 40 == 0, C("lang"))).alias("l"))
    return d.select("source", canonical.new_definition(C("l"), C("source")).alias("definition"))


@query("h13_update_definition", "WITH d AS (SELECT source, list_sort(list(DISTINCT lang) FILTER (lang <> 'en')) AS l FROM documents GROUP BY source) SELECT source, CASE WHEN len(coalesce(l, [])) = 0 THEN 'en' ELSE 'en ' || array_to_string(l, ' ') END AS definition FROM d")
def h13(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    return d.select("source", canonical.update_definition(F.lit("en"), C("l")).alias("definition"))


def _spokes(spark, sf):
    return _vectors(spark, sf).select("id", C("label").cast("string").alias("name"), F.concat(F.lit("about "), C("label").cast("string")).alias("description"), "embedding", C("id").alias("pos"))


@query("h15_canonicalize")
def h15(spark, sf):
    return canonical.canonicalize(_spokes(spark, sf), _hub_vectors(spark, sf), T, 0.9).drop("centroid")


@query("h16_canonicalize_report", f"{ALIGNED} SELECT count(hub_uuid) AS merged, count(*) - count(hub_uuid) AS new, count(*) FILTER (review > 0) AS review, count(*) AS total FROM al")
def h16(spark, sf):
    return canonical.canonicalize_report(_aligned(spark, sf))


_SPOKES = "spokes AS (SELECT vec_id AS id, 's' || vec_id AS uuid, 'b' || (vec_id % 2) AS source, CASE WHEN label < 5 THEN 'entity' ELSE 'predicate' END AS kind, label, embedding FROM embeddings)"


def _run_sql(cross: bool) -> str:
    """Clusters of each book and kind, aligned with the centroids of labels, of a book by parity."""
    near = "list_cosine_similarity(c.v, h.v)"
    return f"""WITH RECURSIVE {_SPOKES}, {HUBV}, hubs AS (SELECT 'hub' || label AS hub, 'b' || (label % 2) AS source, CASE WHEN label < 5 THEN 'entity' ELSE 'predicate' END AS kind, v FROM hubv),
pairs AS (SELECT a.id AS a, b.id AS b FROM spokes a JOIN spokes b ON a.source = b.source AND a.kind = b.kind AND a.id <> b.id AND {COS} >= {T}),
reach AS (SELECT id AS v, id AS w FROM spokes UNION SELECT v, b FROM reach JOIN pairs ON w = a), comp AS (SELECT v AS id, min(w) AS component FROM reach GROUP BY v),
cl AS (SELECT component, source, kind, count(*) AS n_spokes, string_agg(uuid, '#' ORDER BY uuid) AS block FROM comp JOIN spokes USING (id) GROUP BY ALL),
centre AS (SELECT component, list(x ORDER BY dim) AS v FROM (SELECT component, dim, avg(x) AS x FROM (SELECT component, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM comp JOIN spokes USING (id)) GROUP BY ALL) GROUP BY component),
cand AS (SELECT component, h.hub, {near} AS score FROM cl JOIN centre c USING (component) JOIN hubs h ON h.kind = cl.kind AND {'true' if cross else 'h.source = cl.source'} WHERE {near} >= 0.2 QUALIFY row_number() OVER (PARTITION BY component ORDER BY round({near}, 12) DESC, h.hub) <= 5),
best AS (SELECT component, arg_max(hub, score) AS hub FROM cand WHERE score >= 0.3 GROUP BY component)
SELECT {cross} AS cross_source, source, kind, n_spokes, coalesce(hub, {uuid5_sql("source || '#' || kind || '_hub#' || block")}) AS hub_uuid, hub IS NOT NULL AS merged FROM cl LEFT JOIN best USING (component)"""


def _run(spark, sf, cross: bool):
    v = _vectors(spark, sf)
    kind = F.when(C("label") < 5, "entity").otherwise("predicate")
    spokes = v.select(F.concat(F.lit("s"), C("id").cast("string")).alias("uuid"), F.concat(F.lit("b"), (C("id") % 2).cast("string")).alias("source"), kind.alias("kind"), C("label").cast("string").alias("name"), F.lit("").alias("description"), "embedding")
    label = F.substring("hub_uuid", 4, 5).cast("int")
    hubs = _hub_vectors(spark, sf).select("hub_uuid", F.concat(F.lit("b"), (label % 2).cast("string")).alias("source"), F.when(label < 5, "entity").otherwise("predicate").alias("kind"), C("hub_uuid").alias("text"), "embedding")
    return canonical.canonicalize_spokes(spokes, hubs, T, 0.3, 5, 0.2, cross_source=cross)


for _name, _cross in (("h15_canonicalize_by_source", False), ("h15_canonicalize_across_sources", True)):

    def _canonicalized(spark, sf, cross=_cross):
        """All clusters of each book and kind, with the hub that they join or become."""
        return _run(spark, sf, cross)["clusters"].select(F.lit(cross).alias("cross_source"), "source", "kind", "n_spokes", "hub_uuid", "merged")

    query(_name, _run_sql(_cross))(_canonicalized)


def _graph(spark, sf):
    """Each name of the star triplets is a hub of its own; half of the hubs have definitions."""
    t = materialize(star_triplets(spark, sf).withColumn("uuid", F.concat("source", F.lit("#"), C("fact_index").cast("string"))), "star")
    ends = {r: t.select(C("uuid").alias("src"), F.concat_ws("#", "uuid", F.lit(r)).alias("dst")) for r, _ in communities.ROLES}
    hub = lambda r: F.concat(F.lit(r[0]), C(r))
    canon = t.select(F.explode(F.array(*(F.struct(F.concat_ws("#", "uuid", F.lit(r)).alias("src"), hub(r).alias("dst")) for r, _ in communities.ROLES))).alias("e")).select("e.*")
    hubs = t.select(F.explode(F.array(*(F.struct(hub(r).alias("uuid"), C(r).alias("name")) for r, _ in communities.ROLES))).alias("h")).select("h.*").distinct()
    hubs = materialize(hubs, "star-hubs")
    defs = hubs.where(F.length("name") % 2 == 0).select(C("uuid").alias("hub"), F.concat(F.lit("def "), "name").alias("text"))
    return t, ends, canon, hubs, defs


def _hub_triplets(spark, sf):
    return communities.canonical_hub_triplets(*_graph(spark, sf))


HUBT = STAR + """, ht AS (
  SELECT source, source || '#' || fact_index AS triplet_uuid, 's' || subject AS subj_hub, subject AS subj_name, 'p' || predicate AS pred_hub, predicate AS pred_name,
    'o' || object AS obj_hub, object AS obj_name, CASE WHEN length(subject) % 2 = 0 THEN 'def ' || subject END AS subj_def, CASE WHEN length(predicate) % 2 = 0 THEN 'def ' || predicate END AS pred_def, CASE WHEN length(object) % 2 = 0 THEN 'def ' || object END AS obj_def
  FROM star)"""


THUB = uuid5_sql("source || '#triplet_hub#' || subj_hub || '#' || pred_hub || '#' || obj_hub")


@query("i1_canonical_hub_triplets", f"WITH {HUBT} SELECT * FROM ht")
def i1(spark, sf):
    return _hub_triplets(spark, sf)


@query("i2_triplet_hubs", f"WITH {HUBT} SELECT source, subj_hub, pred_hub, obj_hub, count(DISTINCT triplet_uuid) AS support, min(concat_ws(' ', subj_name, pred_name, obj_name)) AS fact_text FROM ht GROUP BY ALL")
def i2(spark, sf):
    return communities.triplet_hubs(_hub_triplets(spark, sf)).drop("uuid")


@query("i3_supported_by", f"WITH {HUBT} SELECT DISTINCT {THUB} AS src, triplet_uuid AS dst FROM ht")
def i3(spark, sf):
    return communities.supported_by(_hub_triplets(spark, sf)).select("src", "dst")


@query("i4_support_count", f"WITH {HUBT} SELECT count(DISTINCT (source, subj_hub, pred_hub, obj_hub)) AS assertions, count(DISTINCT triplet_uuid) AS triplets FROM ht")
def i4(spark, sf):
    return communities.support_count(_hub_triplets(spark, sf))


ADJ = f"{HUBT}, adj AS (SELECT source, subj_hub AS a, obj_hub AS b FROM ht UNION SELECT source, obj_hub, subj_hub FROM ht UNION SELECT source, subj_hub, pred_hub FROM ht UNION SELECT source, pred_hub, subj_hub FROM ht UNION SELECT source, obj_hub, pred_hub FROM ht UNION SELECT source, pred_hub, obj_hub FROM ht)"


@query("i5_hub_adjacency", f"WITH {ADJ} SELECT * FROM adj")
def i5(spark, sf):
    return communities.hub_adjacency(_hub_triplets(spark, sf))


def _order_triplets(spark, sf):
    """A graph of many components: each customer with their orders and what state these are in."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    key, order = C("c_custkey").cast("string"), C("o_orderkey").cast("string")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        C("c_mktsegment").alias("source"), order.alias("triplet_uuid"), F.concat(F.lit("c"), key).alias("subj_hub"), C("c_name").alias("subj_name"), F.concat(F.lit("p"), key, "o_orderstatus").alias("pred_hub"), C("o_orderstatus").alias("pred_name"),
        F.concat(F.lit("o"), order).alias("obj_hub"), F.concat(F.lit("order "), order).alias("obj_name"), F.lit(None).cast("string").alias("subj_def"), F.lit(None).cast("string").alias("pred_def"), C("o_orderpriority").alias("obj_def"),
    )


OT = "ot AS (SELECT c_mktsegment AS source, c_custkey AS g, o_orderkey AS k, c_name AS name, o_orderstatus AS st, o_orderpriority AS pr FROM orders JOIN customer ON o_custkey = c_custkey)"
LINE = "'(' || name || ') --[' || st || ']--> (order ' || k || ')'"
N_HUBS = "1 + count(DISTINCT st) + count(DISTINCT k)"
COMMUNITY = f"{OT}, cm AS (SELECT source, g, {N_HUBS} AS n_hubs, count(DISTINCT k) AS n_triplets, array_to_string(list_concat(list_sort(list(DISTINCT pr)), list_sort(list(DISTINCT {LINE}))), chr(10))[1:2000] AS summary_text FROM ot GROUP BY ALL)"


@query("i6_communities", f"WITH {OT} SELECT source, 'c' || g AS component, {N_HUBS} AS n_hubs FROM ot GROUP BY source, g")
def i6(spark, sf):
    return communities.community_of_hubs(_order_triplets(spark, sf)).groupBy("source", "component").agg(F.count("*").alias("n_hubs"))


def _chain_triplets(spark, sf):
    """Each order with the next: the first third is one chain, after it a chain ends at every fiftieth customer."""
    o = table(spark, sf, "orders").select(C("o_orderkey").alias("k"), "o_custkey")
    n = o.count()
    near = o.join(o.select((C("k") - 1).alias("k")), "k").where((C("k") < n // 3) | (C("o_custkey") % 50 != 0))
    hub = lambda kind, k: F.concat(F.lit(kind), k.cast("string"))
    return near.select(F.lit("orders").alias("source"), C("k").cast("string").alias("triplet_uuid"), hub("o", C("k")).alias("subj_hub"), hub("n", C("k")).alias("pred_hub"), hub("o", C("k") + 1).alias("obj_hub"))


@query("i6_communities_of_chains", """WITH edges AS (SELECT a.o_orderkey AS k FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey < (SELECT count(*) FROM orders) // 3 OR a.o_custkey % 50 <> 0),
chains AS (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM edges),
hubs AS (SELECT DISTINCT g, unnest(['o' || k, 'n' || k, 'o' || (k + 1)]) AS hub FROM chains)
SELECT 'orders' AS source, min(hub) AS component, count(*) AS n_hubs FROM hubs GROUP BY g""")
def i6_chains(spark, sf):
    t = materialize(_chain_triplets(spark, sf), "chains")
    return communities.community_of_hubs(t).groupBy("source", "component").agg(F.count("*").alias("n_hubs"))


@query("i7_community_triplets", f"WITH {OT} SELECT DISTINCT source, 'c' || g AS component, k::VARCHAR AS triplet_uuid FROM ot")
def i7(spark, sf):
    t = _order_triplets(spark, sf)
    return communities.community_triplets(t, communities.community_of_hubs(t))


@query("i8_community_definitions", f"WITH {OT} SELECT DISTINCT source, 'c' || g AS component, pr AS definition FROM ot")
def i8(spark, sf):
    t = _order_triplets(spark, sf)
    return communities.community_definitions(t, communities.community_of_hubs(t))


@query("i9_community_triplet_strings", f"WITH {OT} SELECT DISTINCT source, 'c' || g AS component, {LINE} AS line FROM ot")
def i9(spark, sf):
    t = _order_triplets(spark, sf)
    return communities.community_triplet_strings(t, communities.community_of_hubs(t))


@query("i11_build_communities", f"WITH {COMMUNITY} SELECT source, 'c' || g AS component, n_hubs, n_triplets, summary_text FROM cm")
def i11(spark, sf):
    return communities.build_communities(_order_triplets(spark, sf))


KNN = f"knn AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 12) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0) WHERE rank <= 5)"


def _knn(spark, sf):
    v = _vectors(spark, sf)
    return search.knn_join(v.where("id % 20 = 0"), v, 5, "id", "id")


@query("j2_knn_join", f"WITH {KNN} SELECT * FROM knn")
def j2(spark, sf):
    return _knn(spark, sf).select("query_id", "item_id", "rank")


def _asked(threshold: str, k: int, where: str = "true") -> str:
    return f"SELECT query_id, uuid, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS uuid, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 12) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND {where} WHERE {COS} >= {threshold}) WHERE rank <= {k}"


@query("j1_top_k", _asked("0.1", 10))
def j1(spark, sf):
    v = _vectors(spark, sf)
    found = search.knn_join(v.where("id % 20 = 0"), v, 10, "id", "id", threshold=0.1)
    return found.select("query_id", C("item_id").alias("uuid"), "rank")


for _name, _k, _which in (("j3_search_communities", 20, 1), ("j4_search_hub_definitions", 10, 2), ("j5_search_nodes", 15, 3)):

    def _search(spark, sf, k=_k, which=_which):
        """Every twentieth vector as a query, each within the book that lies `which` after its own."""
        v = _vectors(spark, sf).withColumn("source", C("label").cast("string"))
        queries = v.where("id % 20 = 0").withColumn("source", ((C("label") + which) % 10).cast("string"))
        return search.knn_join(queries, v, k, "id", "id", within="source").select("query_id", C("item_id").alias("uuid"), "rank")

    query(_name, _asked("-2", _k, f"b.label = (a.label + {_which}) % 10"))(_search)


@query("j6_rerank", f"WITH {KNN} SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY (item_id % 10)::DOUBLE DESC, rank) AS rank FROM knn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (item_id % 10)::DOUBLE DESC, rank) <= 3")
def j6(spark, sf):
    k = _knn(spark, sf)
    return search.rerank(k, k.select("query_id", "item_id", (C("item_id") % 10).cast("double").alias("relevance")), 3).select("query_id", "item_id", "rank")


@query("j7_judge", f"WITH {KNN} SELECT query_id, item_id, rank, CASE WHEN rank <= 2 THEN rank = 1 END AS judge_relevant FROM knn")
def j7(spark, sf):
    k = _knn(spark, sf)
    v = k.where("rank <= 2").select("query_id", (C("rank") - 1).alias("position"), (C("rank") == 1).alias("relevant"))
    return search.judge(k, v).select("query_id", "item_id", "rank", "judge_relevant")


SHARE = "len(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' '))))::DOUBLE / greatest(len(list_distinct(string_split(a.text, ' '))), 1)"


@query("j8_search", f"""WITH v AS (SELECT vec_id, embedding, label, 'text ' || vec_id || ' of ' || label AS text FROM embeddings),
near AS (SELECT a.vec_id AS query_id, b.vec_id AS uuid, {SHARE} AS r, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 12) DESC, b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id % 20 = 0)
SELECT query_id, uuid, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, rank) AS rank FROM near WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC, rank) <= 5""")
def j8(spark, sf):
    text = F.concat(F.lit("text "), C("id").cast("string"), F.lit(" of "), C("label").cast("string"))
    v = _vectors(spark, sf).select(C("id").alias("uuid"), "embedding", text.alias("text"))
    return search.search({"node": v}, "node", v.where("uuid % 20 = 0").withColumnRenamed("uuid", "query_id")).select("query_id", C("item_id").alias("uuid"), "rank")


@query("j9_expand_communities", f"WITH {OT} SELECT source, 'c' || g AS component, {N_HUBS} AS n_hubs, count(DISTINCT k) AS n_triplets FROM ot GROUP BY source, g")
def j9(spark, sf):
    t = _order_triplets(spark, sf)
    m = communities.community_of_hubs(t)
    return search.expand_communities(m.select("source", "component").distinct(), m, t).select("source", "component", "n_hubs", "n_triplets")


@query("j10_expand_entity_hubs", f"WITH {HUBT} SELECT subj_hub AS hub, triplet_uuid FROM ht WHERE subj_hub LIKE '%1' UNION SELECT obj_hub, triplet_uuid FROM ht WHERE obj_hub LIKE '%1'")
def j10(spark, sf):
    g = _graph(spark, sf)
    return search.expand_entity_hubs(g[3].where("uuid like '%1'").select(C("uuid").alias("hub")), communities.canonical_hub_triplets(*g))


@query("j11_expand_predicate_hubs", f"WITH {HUBT} SELECT pred_hub AS hub, triplet_uuid FROM ht WHERE pred_hub = 'pA'")
def j11(spark, sf):
    g = _graph(spark, sf)
    return search.expand_predicate_hubs(g[3].where("uuid = 'pA'").select(C("uuid").alias("hub")), communities.canonical_hub_triplets(*g))


@query("j12_hubs_in_community", f"WITH {OT} SELECT DISTINCT source, 'c' || g AS component, 'c' || g AS hub, name, NULL AS definition FROM ot UNION ALL SELECT DISTINCT source, 'c' || g, 'p' || g || st, st, NULL FROM ot UNION ALL SELECT DISTINCT source, 'c' || g, 'o' || k, 'order ' || k, pr FROM ot")
def j12(spark, sf):
    t = _order_triplets(spark, sf)
    hubs = F.array(*(F.struct(C(f"{s}_hub").alias("uuid"), F.lit(r).alias("label"), C(f"{s}_name").alias("name")) for r, s in communities.ROLES))
    named = t.select(F.explode(hubs).alias("h")).select("h.*").distinct()
    defs = t.select(C("obj_hub").alias("hub"), C("obj_def").alias("text")).distinct()
    return search.hubs_in_community(communities.community_of_hubs(t), named, defs).select("source", "component", "hub", "name", "definition")


@query("j13_relation_types", "SELECT unnest(['CANONICAL', 'HAS_OBJECT', 'HAS_SUBJECT']) AS type")
def j13(spark, sf):
    _, ends, canon, _, _ = _graph(spark, sf)
    return search.relation_types({"HAS_SUBJECT": ends["subject"], "HAS_OBJECT": ends["object"], "CANONICAL": canon, "NEXT": canon.limit(0)})


@query("k1_label_counts", f"WITH {NODES} SELECT 'Node' AS label, count(*) AS n FROM nodes UNION ALL SELECT 'Source', count(DISTINCT source) FROM documents UNION ALL SELECT 'HEAD', count(DISTINCT source) FROM nodes UNION ALL SELECT 'NEXT', count(*) - count(DISTINCT source) FROM nodes")
def k1(spark, sf):
    n = materialize(nodes(spark, sf), "nodes")
    vertices = graph.nodes(n)
    books = graph.sources(table(spark, sf, "documents").select("source").distinct())
    return checks.table_counts({"Node": vertices, "Source": books, "HEAD": graph.head_edges(vertices), "NEXT": graph.next_edges(n)})


@query("k2_resolved_triplets", f"WITH {STAR} SELECT source || '#' || fact_index AS uuid, CASE WHEN fact_index % 8 <> 1 THEN subject END AS subject, predicate, object FROM star")
def k2(spark, sf):
    t = _graph(spark, sf)[0]
    ends = {r: t.select(C("uuid").alias("triplet_uuid"), C(r).alias("name")) for r, _ in communities.ROLES}
    ends["subject"] = t.where("fact_index % 8 <> 1").select(C("uuid").alias("triplet_uuid"), C("subject").alias("name"))
    return checks.resolved_triplets(t, ends)


@query("k3_resolved_assertions", f"WITH {HUBT} SELECT DISTINCT subj_name, pred_name, obj_name, source FROM ht")
def k3(spark, sf):
    g = _graph(spark, sf)
    a = materialize(communities.triplet_hubs(communities.canonical_hub_triplets(*g)), "assertions")
    return checks.resolved_assertions(a, g[3]).join(a.select("uuid", "source"), "uuid").select("subj_name", "pred_name", "obj_name", "source")


@query("k4_longest_chain", f"WITH {NODES} SELECT source, count(*) - 1 AS length FROM nodes GROUP BY source")
def k4(spark, sf):
    n = nodes(spark, sf)
    return checks.longest_chain(graph.next_edges(n), graph.nodes(n))


@query("k5_walk_stream", f"WITH {NODES} SELECT source, id AS position, content FROM nodes")
def k5(spark, sf):
    """All books, from HEAD and NEXT edges; the nodes' own index is dropped."""
    n = materialize(nodes(spark, sf), "nodes")
    vertices = graph.nodes(n)
    return checks.walk_stream(vertices.drop("index"), graph.head_edges(vertices), graph.next_edges(n)).select("source", "position", "content")


@query("k6_community_overview", f"WITH {COMMUNITY} SELECT source, 'c' || g AS component, summary_text[1:120] AS summary, 64 AS vector_size FROM cm")
def k6(spark, sf):
    c = semantics.attach_embeddings(communities.build_communities(_order_triplets(spark, sf)), "summary_text").withColumnRenamed("embedding", "summary_embedding")
    return checks.community_overview(c)


@query("k7_type_histogram", "SELECT CASE WHEN doc_id % 9 = 0 OR doc_id % 7 = 0 THEN '?' ELSE lang END AS type, count(*) AS n FROM documents GROUP BY 1")
def k7(spark, sf):
    return checks.type_histogram(table(spark, sf, "documents").select(F.when(C("doc_id") % 7 == 0, "").when(C("doc_id") % 9 != 0, C("lang")).alias("type")))


@query("k8_snippet", r"WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN t[1:80] || '…' ELSE t END AS snippet FROM f")
def k8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", checks.snippet(C("text")).alias("snippet"))


@query("k9_stage_metrics", "SELECT lang, count(*) AS n, (SELECT count(*) FROM documents) AS rows_seen FROM documents GROUP BY lang")
def k9(spark, sf):
    out, seen = checks.stage_metrics(table(spark, sf, "documents"), "k9")
    counts = materialize(out.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    return counts.withColumn("rows_seen", F.lit(seen.get["rows"]).cast("long"))


def _records(spark, sf):
    edit = F.array(F.struct(F.lit("order").alias("class"), F.lit("a").alias("before"), F.lit("b").alias("after")))
    return table(spark, sf, "documents").select(
        C("doc_id").alias("id"), C("lang").alias("transcription"), F.when(C("doc_id") % 2 == 0, F.replace("lang", F.lit("a"), F.lit("b"))).otherwise("x").alias("corrected"), edit.alias("edits"), F.array(F.lit("substitution")).alias("edit_classes"),
        F.when(C("doc_id") % 4 == 0, "dev").otherwise("train").alias("split"), F.when(C("doc_id") % 3 == 0, C("doc_id") + 1).alias("derived_from"), "source",
    )


@query("k10_gold_edit_check", "SELECT doc_id AS id FROM documents WHERE doc_id % 2 <> 0")
def k10(spark, sf):
    return checks.gold_edit_check(_records(spark, sf)).select("id")


@query("k11_split_leakage", "SELECT a.doc_id AS id, b.doc_id AS derived_from FROM documents a JOIN documents b ON a.doc_id % 3 = 0 AND b.doc_id = a.doc_id + 1 WHERE a.lang <> b.lang OR (a.doc_id % 4 = 0) <> (b.doc_id % 4 = 0)")
def k11(spark, sf):
    return checks.split_leakage(_records(spark, sf))


@query("k12_split_coverage", "WITH c AS (SELECT c_custkey // 5 AS grp, c_mktsegment AS split FROM customer) SELECT g.grp, s.split FROM (SELECT DISTINCT grp FROM c) g CROSS JOIN (SELECT DISTINCT split FROM c) s EXCEPT SELECT grp, split FROM c")
def k12(spark, sf):
    return checks.split_coverage(table(spark, sf, "customer").select(F.floor(C("c_custkey") / 5).alias("grp"), C("c_mktsegment").alias("split")), "grp")


@query("k13_edit_class_counts", "SELECT class, count(*) AS n FROM (SELECT unnest(string_split(props, ',')) AS class FROM events) GROUP BY class")
def k13(spark, sf):
    edits = F.transform(F.split("props", ","), lambda p: F.struct(p.alias("class"), F.lit("a").alias("before"), F.lit("b").alias("after")))
    return checks.edit_class_counts(table(spark, sf, "events").select(edits.alias("edits")))


@query("k14_discard_keep_eval", "SELECT avg((NOT contains(text, 'the'))::INT::DOUBLE) AS discard_gone, avg(contains(text, 'de')::INT::DOUBLE) AS keep_there FROM documents")
def k14(spark, sf):
    d = table(spark, sf, "documents")
    spans = d.select(C("doc_id").alias("page"), F.explode(F.array(F.struct(F.lit("the").alias("span"), F.lit(False).alias("keep")), F.struct(F.lit("de").alias("span"), F.lit(True).alias("keep")))).alias("s")).select("page", "s.*")
    return checks.discard_keep_eval(spans, d.select(C("doc_id").alias("page"), C("text").alias("content")))


@query("l1_decisions_from_table", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def l1(spark, sf):
    return providers.decisions_from_table(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


def _length(pdf):
    return pdf[["doc_id"]].assign(n=pdf.text.str.len())


@query("l2_decisions_from_function", "SELECT doc_id, length(text) AS n FROM documents")
def l2(spark, sf):
    return providers.decisions_from_function(table(spark, sf, "documents").select("doc_id", "text"), _length, "doc_id long, n long", 4)


def _add(state, row):
    total = state + len(row.content)
    return total, [(row.source, row.id, total)]


@query("l3_fold_per_stream", f"WITH {NODES} SELECT source, id, sum(length(content)) OVER (PARTITION BY source ORDER BY id) AS total FROM nodes")
def l3(spark, sf):
    return providers.fold_per_stream(nodes(spark, sf), _add, int, "source string, id long, total long")


@query("l4_vector_kernels", f"SELECT a.vec_id AS query_id, count(*) AS near, round(max({COS}), 9) AS best FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND {COS} >= 0.05 GROUP BY a.vec_id")
def l4(spark, sf):
    v = _vectors(spark, sf)
    scores = search.block_scores(v.where("id % 20 = 0"), v, 0.05, "id", "id").where("query_id <> item_id")
    return scores.groupBy("query_id").agg(F.count("*").alias("near"), F.round(F.max("score"), 9).alias("best"))


@query("m2_incremental_canonicalize")
def m2(spark, sf):
    return incremental.incremental_canonicalize(_spokes(spark, sf), _hub_vectors(spark, sf), T, 0.9)[1].select("hub_uuid")


@query("m3_append_results", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def m3(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return incremental.append_results(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"))



def _clusters(spark, sf):
    """Spokes by name: each supplier of the star is a component of its own."""
    t = materialize(star_triplets(spark, sf), "star")
    return t.select("source", C("subject").alias("component"), F.concat("source", F.lit("#"), C("fact_index").cast("string")).alias("uuid"), C("subject").alias("name"))


def _names(role: str) -> str:
    return f"(WITH {STAR} SELECT source, {role} AS name, count(*) AS n, string_agg(source || '#' || fact_index, '#' ORDER BY source || '#' || fact_index) AS spokes FROM star GROUP BY ALL)"


def _hub_sql(kind: str) -> str:
    return uuid5_sql(f"source || '#{kind}_hub#' || spokes")


@query("g18_entity_hubs", f"SELECT {_hub_sql('entity')} AS uuid, source, name, 0 AS n_aliases, n AS n_spokes FROM {_names('subject')}")
def g18(spark, sf):
    return graph.hubs(_clusters(spark, sf), "entity").select("uuid", "source", "name", F.size("aliases").alias("n_aliases"), "n_spokes")


@query("g18_canonical_entities", f"WITH {STAR}, h AS (SELECT *, {_hub_sql('entity')} AS dst FROM {_names('subject')}) SELECT s.source || '#' || fact_index AS src, dst FROM star s JOIN h ON h.source = s.source AND h.name = s.subject")
def g18b(spark, sf):
    c = _clusters(spark, sf)
    return graph.canonical_edges(c, graph.hubs(c, "entity"))


def _predicate_clusters(spark, sf):
    t = materialize(star_triplets(spark, sf), "star")
    return t.select("source", C("predicate").alias("component"), F.concat("source", F.lit("#"), C("fact_index").cast("string")).alias("uuid"), C("predicate").alias("name"))


@query("g19_predicate_hubs", f"SELECT {_hub_sql('predicate')} AS uuid, source, name FROM {_names('predicate')}")
def g19(spark, sf):
    return graph.hubs(_predicate_clusters(spark, sf), "predicate").select("uuid", "source", "name")


@query("g19_canonical_predicates", f"WITH {STAR}, h AS (SELECT *, {_hub_sql('predicate')} AS dst FROM {_names('predicate')}) SELECT s.source || '#' || fact_index AS src, dst FROM star s JOIN h ON h.source = s.source AND h.name = s.predicate")
def g19b(spark, sf):
    c = _predicate_clusters(spark, sf)
    return graph.canonical_edges(c, graph.hubs(c, "predicate"))


def _hub_rows(spark, sf):
    return _graph(spark, sf)[3]


_DEF = "SELECT DISTINCT 's' || s_name AS hub, 'def ' || s_name AS text FROM supplier JOIN lineitem ON l_suppkey = s_suppkey"


@query("g20_definitions", _DEF)
def g20(spark, sf):
    hubs = _hub_rows(spark, sf).where("uuid like 's%'")
    return graph.definitions(hubs, F.concat(F.lit("def "), "name")).select("hub", "text")


@query("g20_definition_edges", f"SELECT hub AS src, {uuid5_sql('hub || chr(35) || ' + chr(39) + 'definition' + chr(39))} AS dst FROM ({_DEF})")
def g20b(spark, sf):
    return graph.definition_edges(graph.definitions(_hub_rows(spark, sf).where("uuid like 's%'"), C("name")))


def _communities(spark, sf):
    """(triplets, hubs of communities, community table)."""
    t = materialize(_order_triplets(spark, sf), "order-triplets")
    m = materialize(communities.community_of_hubs(t), "community-hubs")
    return t, m, graph.communities(m)


_MEMBERS = f"{OT}, mb AS (SELECT source, g, list_sort(list(DISTINCT hub)) AS members FROM (SELECT source, g, unnest(['c' || g, 'p' || g || st, 'o' || k]) AS hub FROM ot) GROUP BY source, g), named AS (SELECT *, {uuid5_sql(chr(115) + 'ource || ' + chr(39) + '#community#' + chr(39) + ' || array_to_string(members, ' + chr(39) + '#' + chr(39) + ')')} AS uuid FROM mb)"


@query("g21_communities", f"WITH {_MEMBERS} SELECT uuid, source, len(members)::BIGINT AS n_members FROM named")
def g21(spark, sf):
    return _communities(spark, sf)[2].select("uuid", "source", "n_members")


@query("g21_community_members", f"WITH {_MEMBERS} SELECT uuid AS src, unnest(members) AS dst FROM named")
def g21b(spark, sf):
    _, m, c = _communities(spark, sf)
    return graph.community_members(m, c)


@query("g21_community_evidence", f"WITH {_MEMBERS} SELECT DISTINCT uuid AS src, k::VARCHAR AS dst FROM named JOIN ot ON ot.source = named.source AND ot.g = named.g")
def g21c(spark, sf):
    t, m, c = _communities(spark, sf)
    return graph.community_evidence(communities.community_triplets(t, m), c)


@query("g22_triplet_hub_edges", f"WITH {HUBT}, a AS (SELECT DISTINCT source, subj_hub, pred_hub, obj_hub FROM ht), k AS (SELECT *, {THUB} AS dst FROM a) SELECT 'CANONICAL_SUBJECT' AS type, subj_hub AS src, dst FROM k UNION ALL SELECT 'CANONICAL_PREDICATE', pred_hub, dst FROM k UNION ALL SELECT 'CANONICAL_OBJECT', obj_hub, dst FROM k")
def g22(spark, sf):
    out = None
    assertions = materialize(communities.triplet_hubs(_hub_triplets(spark, sf)), "assertions")
    for name, edges in graph.triplet_hub_edges(assertions).items():
        one = edges.select(F.lit(name).alias("type"), "src", "dst")
        out = one if out is None else out.unionByName(one)
    return out


@query("g23_has_fact", f"WITH {HUBT}, a AS (SELECT DISTINCT source, subj_hub, pred_hub, obj_hub FROM ht), k AS (SELECT {THUB} AS src FROM a) SELECT src, {uuid5_sql('src || chr(35) || ' + chr(39) + 'fact_hub' + chr(39))} AS dst FROM k")
def g23b(spark, sf):
    return graph.fact_hub_edges(graph.fact_hubs(communities.triplet_hubs(_hub_triplets(spark, sf))))


@query("g23_fact_hubs", f"WITH {HUBT} SELECT min(concat_ws(' ', subj_name, pred_name, obj_name)) AS text FROM ht GROUP BY source, subj_hub, pred_hub, obj_hub")
def g23(spark, sf):
    return graph.fact_hubs(communities.triplet_hubs(_hub_triplets(spark, sf))).select("text")


MOVED = f"""WITH {STAR}, e AS (SELECT source || '#' || fact_index AS src, 's' || subject AS old, 'r' || predicate AS hub, fact_index % 3 AS k FROM star)
SELECT src, CASE WHEN k = 0 THEN old WHEN k = 1 THEN hub ELSE old END AS dst, k = 1 AS created, k <> 0 AS touched FROM e"""


@query("h14_merge_into_hub", MOVED)
def h14(spark, sf):
    """Spokes by supplier; a third of them is merged into hubs by return flag, another third into the hub where it is."""
    t = materialize(star_triplets(spark, sf), "star").select(F.concat("source", F.lit("#"), C("fact_index").cast("string")).alias("src"), F.concat(F.lit("s"), "subject").alias("old"), F.concat(F.lit("r"), "predicate").alias("hub"), (C("fact_index") % 3).alias("k"))
    then, now = (F.to_timestamp(F.lit(f"{y}-01-01")) for y in (2019, 2020))
    edges = t.select("src", C("old").alias("dst"), then.alias("created_at"), then.alias("modified_at"))
    merged = t.where("k > 0").select(C("src").alias("uuid"), F.when(C("k") == 1, C("hub")).otherwise(C("old")).alias("hub"))
    return graph.move_spokes(edges, merged, now).select("src", "dst", (F.year("created_at") == 2020).alias("created"), (F.year("modified_at") == 2020).alias("touched"))


@query("i10_community_summary", f"WITH {COMMUNITY} SELECT source, 'c' || g AS component, summary_text FROM cm")
def i10(spark, sf):
    t = _order_triplets(spark, sf)
    m = communities.community_of_hubs(t)
    return communities.community_summary(communities.community_definitions(t, m), communities.community_triplet_strings(t, m))
