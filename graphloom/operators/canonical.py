"""Canonicalization: similar spokes, clusters, names and alignment with hubs (2.H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import keys, similarity
from graphloom.operators.components import connected_components
from graphloom.scratch import materialize

THRESHOLD, TOP_K, MIN_SCORE = 0.85, 5, 0.7


def uncanonicalized(spokes: DataFrame, canonical: DataFrame, source: str | None = None) -> DataFrame:
    """Embedded spokes without a CANONICAL edge."""
    rows = spokes.where("embedding is not null") if source is None else spokes.where((F.col("source") == source) & F.col("embedding").isNotNull())
    return rows.join(canonical.select(F.col("src").alias("uuid")), "uuid", "left_anti")


def require_embeddings(spokes: DataFrame) -> DataFrame:
    return spokes.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no vector: "), F.col("uuid").cast("string")))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot over norms in double precision; 0 for a zero vector; unequal lengths are an error."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double")).when(norms == 0, F.lit(0.0)).otherwise(_dot(a, b) / norms)


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, block: int = similarity.BLOCK, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, score): all pairs a < b with cosine at or above the threshold, by a pruned join of blocks of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    return similarity.self_pairs(rows, threshold, block=block).where("a is not null").select("a", "b", "score")


def clusters(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(vertex, component) of the similarity graph, singletons kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    return connected_components(similarity.self_links(rows, threshold), vectors.select(F.col(id_col).cast("long")))


def display_name(forms: DataFrame, group: str = "component") -> DataFrame:
    """The most frequent form of each group; ties go to the shorter, then to the first seen (by pos)."""
    counts = forms.groupBy(group, "name").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return counts.groupBy(group).agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), F.length("name").alias("l"), "pos")).alias("display_name"))


def centroid(vectors: DataFrame, group: str = "component", vector_col: str = "embedding") -> DataFrame:
    """The element-wise mean of each group's vectors."""
    each = vectors.select(group, F.posexplode(vector_col).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("centroid"))


def descriptions_of(spokes: DataFrame, group: str = "component") -> DataFrame:
    return spokes.groupBy(group).agg(F.array_sort(F.collect_set(F.when(F.trim("description") != "", F.col("description")))).alias("descriptions"))


def candidate_hubs(cluster_vectors: DataFrame, definitions: DataFrame, top_k: int = TOP_K, min_score: float = MIN_SCORE, score_scale: str = "cosine") -> DataFrame:
    """(cluster_id, hub_uuid, score, rank): the nearest definitions of each cluster (cluster_id, centroid), ties by hub key.

    A join at `min_score` that is pruned by pivots; each block passes on a cluster's best `top_k`.
    """
    least = min_score if score_scale == "cosine" else 2 * min_score - 1
    left = cluster_vectors.select(F.col("cluster_id").cast("string").alias("id"), F.col("centroid").cast("array<double>").alias("embedding"))
    right = definitions.select(F.col("hub_uuid").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = similarity.pairs_above(left, right, least, "id", "id", k=top_k).where("a is not null")
    score = F.col("score") if score_scale == "cosine" else (1 + F.col("score")) / 2
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.round("score", 12)), "hub_uuid"))
    kind = dict(cluster_vectors.dtypes)["cluster_id"]
    return found.select(F.col("a").cast(kind).alias("cluster_id"), F.col("b").alias("hub_uuid"), score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= top_k)


def alignment_rule(candidates: DataFrame, cut: float = THRESHOLD) -> DataFrame:
    """Default decision: Merge at or over the cut, Review in the upper half below it, New otherwise."""
    score = F.col("score")
    return candidates.select("cluster_id", "hub_uuid", F.when(score >= cut, "Merge").when(score >= (cut + MIN_SCORE) / 2, "Review").otherwise("New").alias("decision"))


def align_clusters(cluster_ids: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(cluster_id, hub_uuid, review): the first Merge in score order; no Merge means a new hub (null)."""
    judged = candidates.join(decisions, ["cluster_id", "hub_uuid"])
    merged = judged.groupBy("cluster_id").agg(F.min_by("hub_uuid", F.when(F.col("decision") == "Merge", F.col("rank"))).alias("hub_uuid"), F.count_if(F.col("decision") == "Merge").alias("_m"), F.count_if(F.col("decision") == "Review").alias("review"))
    return cluster_ids.join(merged, "cluster_id", "left").select("cluster_id", F.when(F.col("_m") > 0, F.col("hub_uuid")).alias("hub_uuid"), F.coalesce("review", F.lit(0)).alias("review"))


def new_definition(descriptions: Column, name: Column) -> Column:
    """Several descriptions are joined in order, one is taken, none gives the name."""
    return F.when(F.size(descriptions) > 1, F.array_join(F.array_sort(descriptions), " ")).when(F.size(descriptions) == 1, F.element_at(descriptions, 1)).otherwise(name)


def update_definition(old: Column, descriptions: Column) -> Column:
    fresh = F.filter(descriptions, lambda d: ~F.contains(old, d))
    return F.when(F.size(fresh) > 0, F.concat(old, F.lit(" "), F.array_join(F.array_sort(fresh), " "))).otherwise(old)


def canonicalize_report(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.count_if(F.col("hub_uuid").isNotNull()).alias("merged"), F.count_if(F.col("hub_uuid").isNull()).alias("new"), F.count_if(F.col("review") > 0).alias("review"), F.count("*").alias("total"))


def canonicalize(spokes: DataFrame, hub_definitions: DataFrame, threshold: float = THRESHOLD, cut: float = THRESHOLD) -> DataFrame:
    """Spokes (id, name, description, embedding, pos) in clusters, aligned with hubs: (cluster_id, display_name, definition, hub_uuid, review, centroid)."""
    placed = materialize(spokes.join(clusters(spokes, threshold).select(F.col("vertex").alias("id"), F.col("component").alias("cluster_id")), "id"), "spokes")
    centres = materialize(centroid(placed, "cluster_id"), "centres")
    found = candidate_hubs(centres, hub_definitions)
    aligned = align_clusters(centres.select("cluster_id"), found, alignment_rule(found, cut))
    text = display_name(placed, "cluster_id").join(descriptions_of(placed, "cluster_id"), "cluster_id")
    return aligned.join(text, "cluster_id").join(centres, "cluster_id").select("cluster_id", "display_name", new_definition(F.col("descriptions"), F.col("display_name")).alias("definition"), "hub_uuid", "review", "centroid")


KINDS = ("entity", "predicate")


def canonicalize_spokes(
    spokes: DataFrame, hubs: DataFrame, threshold: float = THRESHOLD, cut: float = THRESHOLD, top_k: int = TOP_K, min_score: float = MIN_SCORE, source: str | None = None, cross_source: bool = False, kinds: tuple = KINDS,
) -> dict[str, DataFrame]:
    """A run over uncanonicalized spokes (uuid, source, kind, name, description, embedding), of all books or one, of some kinds.

    Spokes of a book and kind are clustered at `threshold`. A cluster is aligned
    with existing hubs (hub_uuid, source, kind, text, embedding) of its kind, of its
    own book or with `cross_source` of any. Aligned clusters join their hub, whose
    definition takes in their descriptions; the others become new hubs, with the
    key of their spokes. Returns `clusters` (source, kind, component, n_spokes,
    hub_uuid, merged), `edges` (src, dst: CANONICAL), `definitions` (hub_uuid, text,
    merged) and `report` (kind, merged, new_hubs, review_flagged, total_spokes).
    """
    rows = spokes.where(F.col("kind").isin(*kinds) & F.col("embedding").isNotNull())
    rows = rows if source is None else rows.where(F.col("source") == source)
    group = F.concat("kind", F.lit("#"), "source")
    rows = materialize(rows.select("uuid", "source", "kind", "name", "description", F.col("embedding").cast("array<double>").alias("embedding"), group.alias("scope"), F.monotonically_increasing_id().alias("id")), "run-spokes")
    found = connected_components(similarity.self_links(rows, threshold, within="scope"), rows.select("id"))
    placed = materialize(rows.join(found.select(F.col("vertex").alias("id"), "component"), "id"), "run-placed")
    known = materialize(placed.groupBy("component", "source", "kind").agg(F.count("*").alias("n_spokes")), "run-clusters")

    reach = F.col("kind") if cross_source else group
    centres = centroid(placed, "component").join(known, "component").select(F.col("component").alias("id"), F.col("centroid").alias("embedding"), reach.alias("scope"))
    targets = hubs.where(F.col("kind").isin(*kinds)).select(F.col("hub_uuid").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), reach.alias("scope"))
    met = similarity.pairs_above(centres, targets, min_score, "id", "id", k=top_k, within="scope").where("a is not null").select(F.col("a").alias("cluster_id"), F.col("b").alias("hub_uuid"), "score")
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("score", 12)), "hub_uuid")
    candidates = materialize(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k), "run-candidates")
    aligned = align_clusters(known.select(F.col("component").alias("cluster_id")), candidates, alignment_rule(candidates, cut)).withColumnRenamed("cluster_id", "component").withColumnRenamed("hub_uuid", "into")

    fresh = None
    for kind in kinds:
        own = placed.where(F.col("kind") == kind).select("source", "component", F.col("uuid").alias("member"))
        one = keys.member_keys(own, f"#{kind}_hub#").select("component", F.col("uuid").alias("made"))
        fresh = one if fresh is None else fresh.unionByName(one)
    clusters_ = known.join(aligned, "component").join(fresh, "component")
    clusters_ = materialize(clusters_.select("source", "kind", "component", "n_spokes", F.coalesce("into", "made").alias("hub_uuid"), F.col("into").isNotNull().alias("merged"), "review"), "run-aligned")

    text = display_name(placed.withColumn("pos", F.col("id")), "component").join(placed.groupBy("component").agg(F.collect_set(F.when(F.trim("description") != "", F.col("description"))).alias("descriptions")), "component")
    said = clusters_.join(text, "component").groupBy("hub_uuid", "merged").agg(F.array_distinct(F.flatten(F.collect_list("descriptions"))).alias("descriptions"), F.min("display_name").alias("display_name"))
    old = said.join(hubs.select(F.col("hub_uuid").cast("string").alias("hub_uuid"), F.col("text").alias("old")), "hub_uuid", "left")
    definition = F.when(F.col("merged"), update_definition(F.coalesce("old", "display_name"), F.col("descriptions"))).otherwise(new_definition(F.col("descriptions"), F.col("display_name")))
    report = clusters_.groupBy("kind").agg(F.count_if("merged").alias("merged"), F.count_if(~F.col("merged")).alias("new_hubs"), F.count_if(F.col("review") > 0).alias("review_flagged"), F.sum("n_spokes").alias("total_spokes"))
    return {
        "clusters": clusters_.drop("review"), "edges": placed.join(clusters_.select("component", "hub_uuid"), "component").select(F.col("uuid").alias("src"), F.col("hub_uuid").alias("dst")),
        "definitions": old.select("hub_uuid", definition.alias("text"), "merged"), "report": report,
    }
