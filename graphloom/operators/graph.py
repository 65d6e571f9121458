"""Vertex and edge tables and their idempotent upsert (2.G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import keys

ROLES = ("subject", "object")
#: Other forms of a name that a hub carries at most.
ALIASES = 1000


def upsert_vertices(current: DataFrame, rows: DataFrame, now: Column, key: str = "uuid", order: Column | None = None) -> DataFrame:
    """`current` with `rows` merged by key: supplied values win over old ones, nulls leave them; stamps as on insert or update.

    Rows that share a key apply one after another by `order` (as they are read, if
    there is none): each property takes its last value that is not null.
    """
    values = [c for c in rows.columns if c != key]
    known = [c for c in current.columns if c not in (key, "created_at", "modified_at")]
    ranked = rows.withColumn("_order", F.monotonically_increasing_id() if order is None else order)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(f"_{c}") for c in values]
    new = ranked.groupBy(key).agg(*last, F.lit(True).alias("_new"))
    joined = current.join(new, key, "full_outer")
    every = [*known, *(c for c in values if c not in known)]
    merged = [F.coalesce(*(x for x in (F.col(f"_{c}") if c in values else None, F.col(c) if c in known else None) if x is not None)).alias(c) for c in every]
    return joined.select(key, *merged, F.coalesce("created_at", now).alias("created_at"), F.when(F.col("_new"), now).otherwise(F.col("modified_at")).alias("modified_at"))


def upsert_edges(current: DataFrame, pairs: DataFrame, now: Column, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One edge for each (src, dst) whose ends exist as vertices."""
    new = pairs.select("src", "dst").distinct().join(sources.select(F.col("uuid").alias("src")), "src", "left_semi").join(targets.select(F.col("uuid").alias("dst")), "dst", "left_semi")
    joined = current.join(new.withColumn("_new", F.lit(True)), ["src", "dst"], "full_outer")
    return joined.select("src", "dst", F.coalesce("created_at", now).alias("created_at"), F.when(F.col("_new"), now).otherwise(F.col("modified_at")).alias("modified_at"))


def empty_like(rows: DataFrame) -> DataFrame:
    return rows.limit(0).withColumns({"created_at": F.lit(None).cast("timestamp"), "modified_at": F.lit(None).cast("timestamp")})


def node_label(kind: Column) -> Column:
    return F.initcap(kind)


def sources(books: DataFrame) -> DataFrame:
    """One row for each book; `uuid` and `key` win over metadata columns of these names."""
    return books.withColumns({"key": F.col("source"), "uuid": keys.source_key(F.col("source"))})


def nodes(stream: DataFrame) -> DataFrame:
    return stream.select(keys.node_key(F.col("source"), F.col("id")).alias("uuid"), "source", "type", "content", F.col("id").alias("index"), "segment_index")


def head_edges(node_table: DataFrame) -> DataFrame:
    return node_table.groupBy("source").agg(F.min_by("uuid", "index").alias("dst")).select(keys.source_key(F.col("source")).alias("src"), "dst")


def next_edges(stream: DataFrame) -> DataFrame:
    """Each node with the next id that is there; ids are dense but for removed ones, so spans of ids are linked apart and then joined."""
    span = 4096
    cut = stream.select("source", "id", F.floor(F.col("id") / span).alias("s"))
    inner = cut.withColumn("to", F.lead("id").over(Window.partitionBy("source", "s").orderBy("id")))
    firsts = cut.groupBy("source", "s").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    hops = firsts.select("source", F.col("last").alias("id"), F.lead("first").over(Window.partitionBy("source").orderBy("s")).alias("hop"))
    joined = inner.join(hops, ["source", "id"], "left").withColumn("to", F.coalesce("to", "hop")).where("to is not null")
    return joined.select(keys.node_key(F.col("source"), F.col("id")).alias("src"), keys.node_key(F.col("source"), F.col("to")).alias("dst"))


def statements(rows: DataFrame) -> DataFrame:
    return rows.select(keys.statement_key(F.col("source"), F.col("block")).alias("uuid"), "source", keys.block_key(F.col("block")).alias("block"))


def span_statements(members: DataFrame) -> DataFrame:
    """Statement vertices (uuid, source, span_id, n) of spans of any size, given as members (source, span_id, id); keys as of `statements`."""
    found = keys.member_keys(members.select("source", F.col("span_id").alias("component"), F.col("id").alias("member")), "#statement#", "member")
    return found.select("uuid", "source", F.col("component").alias("span_id"), "n")


def span_statement_members(members: DataFrame, statement_table: DataFrame) -> DataFrame:
    """MEMBER_OF: node to statement."""
    rows = members.join(statement_table.select("source", "span_id", "uuid"), ["source", "span_id"])
    return rows.select(keys.node_key(F.col("source"), F.col("id")).alias("src"), F.col("uuid").alias("dst"))


def statement_members(rows: DataFrame) -> DataFrame:
    m = rows.select("source", "block", F.explode("members").alias("m"))
    return m.select(keys.node_key(F.col("source"), F.col("m")).alias("src"), keys.statement_key(F.col("source"), F.col("block")).alias("dst")).distinct()


def procedures(rows: DataFrame) -> DataFrame:
    return rows.select(keys.procedure_key(F.col("source"), F.col("block"), F.col("index")).alias("uuid"), "source", keys.block_key(F.col("block")).alias("block"), "index")


def procedure_members(rows: DataFrame) -> DataFrame:
    m = rows.select("source", "block", "index", F.explode("members").alias("m"))
    return m.select(keys.node_key(F.col("source"), F.col("m")).alias("src"), keys.procedure_key(F.col("source"), F.col("block"), F.col("index")).alias("dst")).distinct()


def acts(steps: DataFrame) -> DataFrame:
    """Acts of supplied steps (source, statement, procedure, step); none are supplied by default."""
    return steps.select(keys.act_key(*(F.col(c) for c in ("source", "statement", "procedure", "step"))).alias("uuid"), "source", "procedure", "step")


def act_edges(act_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(FIRST: procedure to its first act, THEN: act to the next)."""
    w = Window.partitionBy("source", "procedure").orderBy("step")
    first = act_table.groupBy("source", "procedure").agg(F.min_by("uuid", "step").alias("dst")).select(F.col("procedure").alias("src"), "dst")
    return first, act_table.select(F.col("uuid").alias("src"), F.lead("uuid").over(w).alias("dst")).where("dst is not null")


def instructions(hubs: DataFrame) -> DataFrame:
    return hubs.select(keys.instruction_key(F.col("source"), F.col("node_id")).alias("uuid"), "source", "node_id", "text", "directive")


def governs(hubs: DataFrame) -> DataFrame:
    m = hubs.select("source", "node_id", F.explode("members").alias("m"))
    return m.select(keys.instruction_key(F.col("source"), F.col("node_id")).alias("src"), keys.node_key(F.col("source"), F.col("m")).alias("dst"))


def facts(rows: DataFrame) -> DataFrame:
    return rows.select(keys.fact_key(F.col("source"), F.col("node_ids"), F.col("index")).alias("uuid"), "source", "index", "text")


def evidence(rows: DataFrame) -> DataFrame:
    m = rows.select("source", "index", "node_ids", F.explode("node_ids").alias("m"))
    return m.select(keys.node_key(F.col("source"), F.col("m")).alias("src"), keys.fact_key(F.col("source"), F.col("node_ids"), F.col("index")).alias("dst"))


def placed_triplets(triplets: DataFrame, fact_rows: DataFrame) -> DataFrame:
    """One row for each (node, triplet) with the keys of node, fact and triplet."""
    f = fact_rows.select("source", F.col("index").alias("fact_index"), F.col("node_ids"), keys.fact_key(F.col("source"), F.col("node_ids"), F.col("index")).alias("fact_uuid"))
    rows = triplets.join(f, ["source", "fact_index"]).withColumn("node_id", F.explode("node_ids")).drop("node_ids")
    node = keys.node_key(F.col("source"), F.col("node_id"))
    s, p, o = (F.col(c) for c in ("subject", "predicate", "object"))
    return rows.withColumn("node_uuid", node).withColumn("uuid", keys.triplet_key(F.col("source"), F.col("node_uuid"), F.col("fact_uuid"), s, p, o))


def triplets(placed: DataFrame) -> DataFrame:
    return placed.select("uuid", "source", "subject", "predicate", "object").dropDuplicates(["uuid"])


def yields(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("fact_uuid").alias("src"), F.col("uuid").alias("dst")).distinct()


def entities(placed: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """One vertex for each (node, triplet, role); description and vector of the name at the node when known."""
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("name")) for r in ROLES))
    rows = placed.select("source", "node_id", F.col("uuid").alias("triplet_uuid"), "node_uuid", F.explode(roles).alias("r")).select("*", "r.role", "r.name").drop("r")
    out = rows.withColumn("uuid", keys.entity_key(F.col("source"), F.col("node_uuid"), F.col("triplet_uuid"), F.col("role"))).drop("node_uuid")
    return out if descriptions is None else out.join(descriptions, ["source", "node_id", "name"], "left")


def role_edges(entity_table: DataFrame, role: str) -> DataFrame:
    """HAS_SUBJECT or HAS_OBJECT."""
    return entity_table.where(F.col("role") == role).select(F.col("triplet_uuid").alias("src"), F.col("uuid").alias("dst"))


def predicates(placed: DataFrame) -> DataFrame:
    s, p, o = (F.col(c) for c in ("subject", "predicate", "object"))
    key = keys.predicate_key(F.col("source"), F.col("node_uuid"), F.col("fact_uuid"), s, p, o)
    return placed.select(key.alias("uuid"), "source", F.col("predicate").alias("name"), F.col("uuid").alias("triplet_uuid"))


def predicate_edges(predicate_table: DataFrame) -> DataFrame:
    return predicate_table.select(F.col("triplet_uuid").alias("src"), F.col("uuid").alias("dst"))


def hubs(clusters: DataFrame, kind: str) -> DataFrame:
    """(uuid, source, component, name, aliases, n_spokes) of clusters (source, component, uuid of a spoke, name): named by the most frequent form.

    The key is that of the source and all spokes, sorted; they are digested in order
    and never gathered in a row. Aliases are the other forms, up to ALIASES of them
    (the most frequent), as a hub may have a form for each of its spokes; the whole
    list is in the spokes' table.
    """
    forms = clusters.groupBy("source", "component", "name").agg(F.count("*").alias("n"))
    best = Window.partitionBy("source", "component").orderBy(F.desc("n"), F.length("name"), "name")
    first = forms.withColumn("k", F.row_number().over(best)).where(F.col("k") <= ALIASES + 1)
    named = first.groupBy("source", "component").agg(F.min_by("name", "k").alias("name"), F.array_sort(F.collect_list(F.when(F.col("k") > 1, F.col("name")))).alias("aliases"))
    known = keys.member_keys(clusters.select("source", "component", F.col("uuid").alias("member")), f"#{kind}_hub#")
    return known.join(named, ["source", "component"]).select("uuid", "source", "component", "name", "aliases", F.col("n").alias("n_spokes"))


def canonical_edges(clusters: DataFrame, hub_table: DataFrame) -> DataFrame:
    return clusters.join(hub_table.select("source", "component", F.col("uuid").alias("dst")), ["source", "component"]).select(F.col("uuid").alias("src"), "dst")


def definitions(hub_table: DataFrame, text: Column) -> DataFrame:
    return hub_table.select(keys.definition_key(F.col("uuid")).alias("uuid"), F.col("uuid").alias("hub"), text.alias("text"))


def definition_edges(definition_table: DataFrame) -> DataFrame:
    return definition_table.select(F.col("hub").alias("src"), F.col("uuid").alias("dst"))


def communities(members: DataFrame) -> DataFrame:
    """(uuid, source, component, n_members) of members (source, component, hub); the key is that of the source and all hubs, sorted."""
    found = keys.member_keys(members.select("source", "component", F.col("hub").alias("member")), "#community#")
    return found.select("uuid", "source", "component", F.col("n").alias("n_members"))


def community_members(members: DataFrame, community_table: DataFrame) -> DataFrame:
    """HAS_MEMBER: community to hub."""
    return members.join(community_table.select("source", "component", "uuid"), ["source", "component"]).select(F.col("uuid").alias("src"), F.col("hub").alias("dst"))


def community_evidence(triplets: DataFrame, community_table: DataFrame) -> DataFrame:
    """COMMUNITY_EVIDENCE: community to the triplets (source, component, triplet_uuid) between its hubs."""
    return triplets.join(community_table.select("source", "component", "uuid"), ["source", "component"]).select(F.col("uuid").alias("src"), F.col("triplet_uuid").alias("dst")).distinct()


def move_spokes(canonical: DataFrame, spokes: DataFrame, now: Column) -> DataFrame:
    """CANONICAL edges (src, dst, stamps) after spokes (uuid, hub) are merged into existing hubs: each spoke's edge leads to its hub.

    An edge that leads there already keeps its creation stamp and gets a new
    modification stamp; one that leads elsewhere goes, and a new one is made. Edges
    of other spokes stay as they are.
    """
    wanted = spokes.groupBy(F.col("uuid").alias("src")).agg(F.min("hub").alias("hub"))
    joined = canonical.join(wanted, "src", "full_outer").withColumn("same", F.col("dst").eqNullSafe(F.col("hub")))
    stays = F.col("hub").isNull()
    edges = joined.select(
        "src", F.when(stays, F.col("dst")).otherwise(F.col("hub")).alias("dst"), F.when(stays | F.col("same"), F.coalesce("created_at", now)).otherwise(now).alias("created_at"), F.when(stays, F.col("modified_at")).otherwise(now).alias("modified_at"),
    )
    return edges.groupBy("src", "dst").agg(F.min("created_at").alias("created_at"), F.max("modified_at").alias("modified_at"))


def triplet_hub_edges(assertions: DataFrame) -> dict[str, DataFrame]:
    """CANONICAL_SUBJECT, _PREDICATE and _OBJECT: hub to assertion."""
    cols = {"CANONICAL_SUBJECT": "subj_hub", "CANONICAL_PREDICATE": "pred_hub", "CANONICAL_OBJECT": "obj_hub"}
    return {name: assertions.select(F.col(c).alias("src"), F.col("uuid").alias("dst")) for name, c in cols.items()}


def fact_hubs(assertions: DataFrame) -> DataFrame:
    return assertions.select(keys.fact_hub_key(F.col("uuid")).alias("uuid"), F.col("uuid").alias("triplet_hub"), F.col("fact_text").alias("text"))


def fact_hub_edges(fact_hub_table: DataFrame) -> DataFrame:
    """HAS_FACT: assertion to its fact."""
    return fact_hub_table.select(F.col("triplet_hub").alias("src"), F.col("uuid").alias("dst"))
