"""Canonical assertions and communities (2.I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import keys
from graphloom.operators.components import connected_components
from graphloom.operators.semantics import attach_embeddings
from graphloom.scratch import discard, materialize

ROLES = (("subject", "subj"), ("predicate", "pred"), ("object", "obj"))


def canonical_hub_triplets(triplets: DataFrame, ends: dict[str, DataFrame], canonical: DataFrame, hubs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Ten columns, written: each triplet with its three hubs, their names and, where there are any, definitions.

    `ends`: for each role the edges triplet to component; `canonical`: component to hub.
    """
    named = hubs.select(F.col("uuid").alias("hub"), "name").join(definitions.select("hub", F.col("text").alias("def")), "hub", "left")
    edges = None
    for role, _ in ROLES:
        one = ends[role].select(F.col("src").alias("triplet_uuid"), F.col("dst").alias("part"), F.lit(role).alias("role"))
        edges = one if edges is None else edges.unionByName(one)
    spokes = edges.join(canonical.select(F.col("src").alias("part"), F.col("dst").alias("hub")), "part").join(named, "hub")
    spokes = materialize(spokes.select("triplet_uuid", "role", "hub", "name", "def"), "triplet-spokes")  # written once, read for each role
    out = triplets.select("source", F.col("uuid").alias("triplet_uuid"))
    for role, short in ROLES:
        step = spokes.where(F.col("role") == role)
        out = out.join(step.select("triplet_uuid", F.col("hub").alias(f"{short}_hub"), F.col("name").alias(f"{short}_name"), F.col("def").alias(f"{short}_def")), "triplet_uuid")
    found = materialize(out, "hub-triplets")
    discard(spokes)
    return found


def triplet_hubs(hub_triplets: DataFrame) -> DataFrame:
    """One assertion for each (subject, predicate, object) hubs: support and text.

    Its triplets are `supported_by`, a table, as an assertion may have a third of all
    triplets; its vector is that of the text (`attach_embeddings`).
    """
    hubs = ["subj_hub", "pred_hub", "obj_hub"]
    text = F.concat_ws(" ", "subj_name", "pred_name", "obj_name")
    grouped = hub_triplets.groupBy("source", *hubs).agg(F.count_distinct("triplet_uuid").alias("support"), F.min(text).alias("fact_text"))
    return grouped.withColumn("uuid", keys.triplet_hub_key(F.col("source"), *(F.col(h) for h in hubs)))


def with_vectors(assertions: DataFrame, provider=None) -> DataFrame:
    """Assertions with the vector of their text (`embedding`); equal texts are embedded once."""
    return attach_embeddings(assertions, "fact_text", provider)


def supported_by(hub_triplets: DataFrame) -> DataFrame:
    key = keys.triplet_hub_key(F.col("source"), F.col("subj_hub"), F.col("pred_hub"), F.col("obj_hub"))
    return hub_triplets.select(key.alias("src"), F.col("triplet_uuid").alias("dst")).distinct()


def support_count(hub_triplets: DataFrame) -> DataFrame:
    return hub_triplets.agg(F.count_distinct("source", "subj_hub", "pred_hub", "obj_hub").alias("assertions"), F.count_distinct("triplet_uuid").alias("triplets"))


def hub_adjacency(hub_triplets: DataFrame) -> DataFrame:
    """(source, a, b): undirected edges between the three hubs, in both directions."""
    pairs = [("subj_hub", "obj_hub"), ("subj_hub", "pred_hub"), ("obj_hub", "pred_hub")]
    both = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for p in pairs for x, y in (p, p[::-1])))
    return hub_triplets.select("source", *[c for p in ("subj_hub", "pred_hub", "obj_hub") for c in (p,)]).distinct().select("source", F.explode(both).alias("e")).select("source", "e.a", "e.b").distinct()


def community_of_hubs(hub_triplets: DataFrame) -> DataFrame:
    """(source, hub, component).

    A triplet's hubs are one by two of its three edges; loops and repeats of edges do no harm.
    """
    glue = lambda c: F.concat_ws("\u0001", "source", c)
    ends = F.array(*(F.struct(glue("subj_hub").alias("a"), glue(c).alias("b")) for c in ("obj_hub", "pred_hub")))
    found = connected_components(hub_triplets.select(F.explode(ends).alias("e")).select("e.a", "e.b"))
    part = lambda c, k: F.element_at(F.split(c, "\u0001"), k)
    return found.select(part("vertex", 1).alias("source"), part("vertex", 2).alias("hub"), part("component", 2).alias("component"))


def community_triplets(hub_triplets: DataFrame, members: DataFrame) -> DataFrame:
    """(source, component, triplet_uuid): the subject's component holds the other two hubs as well."""
    return hub_triplets.join(members.withColumnRenamed("hub", "subj_hub"), ["source", "subj_hub"]).select("source", "component", "triplet_uuid").distinct()


def community_definitions(hub_triplets: DataFrame, members: DataFrame) -> DataFrame:
    """(source, component, definition): distinct definitions of a community's hubs."""
    stacked = F.array(*(F.struct(F.col(f"{s}_hub").alias("hub"), F.col(f"{s}_def").alias("definition")) for _, s in ROLES))
    rows = hub_triplets.select("source", F.explode(stacked).alias("x")).select("source", "x.*").where("definition is not null").distinct()
    return rows.join(members, ["source", "hub"]).select("source", "component", "definition").distinct()


def community_triplet_strings(hub_triplets: DataFrame, members: DataFrame) -> DataFrame:
    """(source, component, line): distinct triplets of a community, written out."""
    rows = hub_triplets.join(members.withColumnRenamed("hub", "subj_hub"), ["source", "subj_hub"])
    line = F.concat(F.lit("("), "subj_name", F.lit(") --["), "pred_name", F.lit("]--> ("), "obj_name", F.lit(")"))
    return rows.select("source", "component", line.alias("line")).distinct()


def community_summary(definitions: DataFrame, strings: DataFrame, budget: int = 2000) -> DataFrame:
    """Default decision: sorted definitions, then sorted triplet strings, joined by line feeds and cut to a budget of characters.

    A line takes one character at least, so the first `budget` lines hold the
    summary: only these, each cut to the budget, are ranked and gathered, whatever
    the size of a community. Communities without triplet strings have no row.
    """
    rows = definitions.select("source", "component", F.lit(0).alias("part"), F.col("definition").alias("text")).unionByName(strings.select("source", "component", F.lit(1).alias("part"), F.col("line").alias("text")))
    rank = F.row_number().over(Window.partitionBy("source", "component").orderBy("part", "text"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= budget + 1)
    kept = first.select("source", "component", "rank", F.substring("text", 1, budget).alias("text"), (F.length("text") + 1).alias("chars"))
    running = F.sum("chars").over(Window.partitionBy("source", "component").orderBy("rank")) - F.col("chars")
    near = kept.withColumn("before", running).where(F.col("before") <= budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text), "\n")
    out = near.groupBy("source", "component").agg(F.substring(text, 1, budget).alias("summary_text"))
    return out.join(strings.select("source", "component").distinct(), ["source", "component"], "left_semi")


def build_communities(hub_triplets: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(source, component, n_hubs, n_triplets, summary_text); `members`: the written `community_of_hubs`, where it is there."""
    members = materialize(community_of_hubs(hub_triplets), "community-hubs") if members is None else members
    n = members.groupBy("source", "component").agg(F.count("*").alias("n_hubs"))
    t = community_triplets(hub_triplets, members).groupBy("source", "component").agg(F.count("*").alias("n_triplets"))
    strings = materialize(community_triplet_strings(hub_triplets, members), "community-lines")
    return n.join(t, ["source", "component"]).join(community_summary(community_definitions(hub_triplets, members), strings), ["source", "component"])
