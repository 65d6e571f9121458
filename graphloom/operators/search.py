"""Retrieval over the graph (2.J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import similarity
from graphloom.scratch import materialize

#: Found rows up to this number are broadcast to the items that they name; beyond it both are shuffled.
BROADCAST_ROWS = 500_000
TOP_K, TOP_N = 20, 5
TARGETS = ("community", "entity_hub", "predicate_hub", "node", "fact")


def block_scores(queries: DataFrame, items: DataFrame, threshold: float, query_id: str = "query_id", item_id: str = "item_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, item_id, score) of all pairs of at least this cosine."""
    met = similarity.pairs_above(queries, items, threshold, query_id, item_id, vector_col)
    return met.where("a is not null").select(F.col("a").alias("query_id"), F.col("b").alias("item_id"), "score")


def knn_join(queries: DataFrame, items: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", vector_col: str = "embedding", round_to: int = 12, within: str | None = None, threshold: float | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the k nearest items of each query, in blocks of queries and items, ties by smaller item.

    With `within`, only items that have the query's value of this column; with
    `threshold`, only items of at least this cosine. With `vectors` (vector_id,
    `vector_col`) items have a vector_id and may share vectors: each vector meets the
    queries once in a scope, as the smallest item that has it, and the items of the
    vectors found are ranked. As many vectors as are asked for are enough: their
    smallest items come before all items of the vectors left out.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", round_to)), "item_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    if vectors is not None:
        by = ["vector_id"] if within is None else [within, "vector_id"]
        shared = materialize(items.groupBy(*by).agg(F.min(item_id).alias(item_id)), "shared-vectors")
        met = similarity.nearest(queries, shared.join(vectors, "vector_id"), k, query_id, item_id, vector_col, round_to, within).where("a is not null")
        first = materialize(best(met.select(F.col("a").alias("query_id"), F.col("b").alias("item_id"), "score")).drop("rank"), "near")
        named = materialize(attach(first, shared.withColumnRenamed(item_id, "item_id")).drop("item_id"), "near")
        found = attach(named, items.select(*by, F.col(item_id).alias("item_id")), by).select("query_id", "item_id", "score")
    else:
        met = similarity.nearest(queries, items, k, query_id, item_id, vector_col, round_to, within).where("a is not null")
        found = met.select(F.col("a").alias("query_id"), F.col("b").alias("item_id"), "score")
    out = best(found)
    return out if threshold is None else out.where(F.col("score") >= threshold)


def attach(found: DataFrame, items: DataFrame, on: list[str] | str = "item_id") -> DataFrame:
    """Found rows (a written table) with the columns of their items, which are not shuffled when few rows are found."""
    return (F.broadcast(found) if found.count() <= BROADCAST_ROWS else found).join(items, on)


def token_overlap(query: Column, text: Column) -> Column:
    """Default relevance: the share of the query's tokens that the text has."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda t: t != ""))
    return F.size(F.array_intersect(tokens(query), tokens(text))) / F.greatest(F.size(tokens(query)), F.lit(1))


def rerank(candidates: DataFrame, relevance: DataFrame | None = None, top_n: int = TOP_N, group: str = "query_id") -> DataFrame:
    """The first n by relevance (query_id, item_id, relevance); without one, by the order they have. Vector scores stay, relevance is not attached."""
    if relevance is None:
        return candidates.where(F.col("rank") <= top_n)
    joined = candidates.join(relevance, [group, "item_id"], "left")
    w = Window.partitionBy(group).orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), "rank")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).drop("relevance")


def judge(candidates: DataFrame, verdicts: DataFrame, keep_relevant_only: bool = False) -> DataFrame:
    """Adds judge_relevant by (query_id, position); positions past the end are ignored, rows without a verdict stay unmarked."""
    out = candidates.join(verdicts.select("query_id", (F.col("position") + 1).alias("rank"), F.col("relevant").alias("judge_relevant")), ["query_id", "rank"], "left")
    return out.where("judge_relevant") if keep_relevant_only else out


def search(tables: dict[str, DataFrame], target: str, queries: DataFrame, k: int = TOP_K, n: int = TOP_N, within_source: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the nearest k rows of the target's table (uuid, source, text, embedding), reranked by token overlap to n.

    `queries`: (query_id, embedding, text), with `within_source` also source: each
    query then meets the rows of its book only. `vectors` as in `knn_join`.
    """
    if target not in TARGETS:
        raise ValueError(f"unknown target: {target}")
    found = materialize(knn_join(queries, tables[target], k, "query_id", "uuid", within="source" if within_source else None, vectors=vectors), "found")
    texts = attach(found, tables[target].select(F.col("uuid").alias("item_id"), F.col("text").alias("_t"))).join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    return rerank(found, texts.select("query_id", "item_id", token_overlap(F.col("_q"), F.col("_t")).alias("relevance")), n)


def expand_communities(found: DataFrame, members: DataFrame, hub_triplets: DataFrame) -> DataFrame:
    """(component, hubs, triplets) of found communities: member hubs, and triplets whose three hubs are members."""
    inside = members.join(found.select("source", "component"), ["source", "component"], "left_semi")
    rows = hub_triplets
    for c in ("subj_hub", "pred_hub", "obj_hub"):
        rows = rows.join(inside.select("source", F.col("hub").alias(c), F.col("component").alias(f"_{c}")), ["source", c])
    t = rows.where("_subj_hub = _pred_hub and _subj_hub = _obj_hub").groupBy("source", F.col("_subj_hub").alias("component")).agg(F.count_distinct("triplet_uuid").alias("n_triplets"))
    h = inside.groupBy("source", "component").agg(F.count("*").alias("n_hubs"))
    return h.join(t, ["source", "component"], "left")


def expand_entity_hubs(found: DataFrame, hub_triplets: DataFrame) -> DataFrame:
    """(hub, triplet_uuid) where the hub is subject or object."""
    sides = [hub_triplets.select(F.col(c).alias("hub"), "triplet_uuid") for c in ("subj_hub", "obj_hub")]
    return sides[0].unionByName(sides[1]).join(found.select("hub"), "hub", "left_semi").distinct()


def expand_predicate_hubs(found: DataFrame, hub_triplets: DataFrame) -> DataFrame:
    return hub_triplets.select(F.col("pred_hub").alias("hub"), "triplet_uuid").join(found.select("hub"), "hub", "left_semi").distinct()


def hubs_in_community(members: DataFrame, hubs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(source, component, hub, label, name, definition or null)."""
    named = hubs.select(F.col("uuid").alias("hub"), "label", "name")
    return members.join(named, "hub").join(definitions.select("hub", F.col("text").alias("definition")), "hub", "left")


def relation_types(edges: dict[str, DataFrame], starts: DataFrame | None = None) -> DataFrame:
    """Distinct edge types, sorted; with `starts` (uuid) only those that leave one of these vertices."""
    out = None
    for name, table in edges.items():
        rows = table if starts is None else table.join(starts.select(F.col("uuid").alias("src")), "src", "left_semi")
        one = rows.limit(1).select(F.lit(name).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out.distinct().orderBy("type")
