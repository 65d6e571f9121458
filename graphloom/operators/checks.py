"""Graph checks, report helpers and evaluation (2.K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.operators.text import apply_edits, strip
from graphloom.scratch import discard, materialize


def table_counts(tables: dict[str, DataFrame], name: str = "label") -> DataFrame:
    """Rows of each vertex or edge table."""
    out = None
    for label, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(label).alias(name), "n")
        out = one if out is None else out.unionByName(one)
    return out


def resolved_triplets(triplets: DataFrame, ends: dict[str, DataFrame]) -> DataFrame:
    """Each triplet with the text of its subject, predicate and object vertex where there is one. `ends`: (triplet_uuid, name)."""
    out = triplets.select("uuid")
    for role, table in ends.items():
        out = out.join(table.select(F.col("triplet_uuid").alias("uuid"), F.col("name").alias(role)), "uuid", "left")
    return out


def resolved_assertions(assertions: DataFrame, hubs: DataFrame) -> DataFrame:
    out = assertions.select("uuid", "subj_hub", "pred_hub", "obj_hub", "fact_text")
    for short in ("subj", "pred", "obj"):
        out = out.join(hubs.select(F.col("uuid").alias(f"{short}_hub"), F.col("name").alias(f"{short}_name")), f"{short}_hub")
    return out.select("uuid", "subj_name", "pred_name", "obj_name", "fact_text")


def longest_chain(next_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, length): edges of the longest NEXT path of each book, 0 without edges.

    Components are found first. One without branches and with a vertex more than
    edges is a path; a book in which NEXT branches or runs in a circle has no
    length (null).
    """
    edges = materialize(next_edges.select("src", "dst").distinct(), "next-edges")
    parts = connected_components(edges, nodes.select("uuid"))
    degree = edges.select(F.col("src").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("vertex"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degree = degree.groupBy("vertex").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    known = parts.join(degree, "vertex", "left").join(nodes.select(F.col("uuid").alias("vertex"), "source"), "vertex")
    each = known.groupBy("source", "component").agg(F.count("*").alias("n"), F.coalesce(F.sum("o"), F.lit(0)).alias("e"), F.max(F.greatest("o", "i")).alias("most"))
    fine = (F.coalesce("most", F.lit(0)) <= 1) & (F.col("e") == F.col("n") - 1)
    return each.groupBy("source").agg(F.when(F.bool_and(fine), F.max("e")).alias("length"))


def stream_positions(heads: DataFrame, next_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uuid, head, position): how far each node lies behind its book's head, from HEAD (src, dst) and NEXT (src, dst) edges alone.

    List ranking by pointer doubling: each round, a node's pointer and distance are
    extended by those of the node that it points at, so a chain of n nodes takes
    log2(n) rounds of one join; nodes that have come to their head drop out. A node
    that no head leads to, that lies in or behind a circle, or in or behind a node
    with two predecessors, has neither head nor position.
    """
    before = next_edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("uuid")).agg(F.min("src").alias("to"), F.count("*").alias("n"))
    first = heads.select(F.col("dst").alias("uuid"), F.lit(True).alias("is_head")).distinct()
    state = nodes.select("uuid").distinct().join(before, "uuid", "left").join(first, "uuid", "left")
    # a head points at nothing, whatever leads to it; so does what has no or no single predecessor, and that has no head
    ends = F.coalesce("is_head", F.lit(False)) | F.col("to").isNull() | (F.col("n") > 1)
    state = state.select("uuid", F.when(~ends, F.col("to")).alias("to"), (~ends).cast("long").alias("distance"), F.when(F.col("is_head"), F.col("uuid")).alias("head"))
    state = materialize(state, "positions")
    open_ = state.where("to is not null").count()
    rounds = max(1, open_).bit_length() + 1
    for _ in range(rounds):
        if not open_:
            break
        ahead = state.select(F.col("uuid").alias("to"), F.col("to").alias("to2"), F.col("distance").alias("more"), F.col("head").alias("head2"))
        moved = state.where("to is not null").join(ahead, "to", "left").select("uuid", F.col("to2").alias("to"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"), F.col("head2").alias("head"))
        following = materialize(state.where("to is null").unionByName(moved), "positions")
        discard(state)
        state, open_ = following, following.where("to is not null").count()
    known = F.col("to").isNull() & F.col("head").isNotNull()
    return state.select("uuid", F.when(known, F.col("head")).alias("head"), F.when(known, F.col("distance")).alias("position"))


def walk_stream(nodes: DataFrame, heads: DataFrame, next_edges: DataFrame, source: str | None = None) -> DataFrame:
    """Nodes with their position behind the head of their book, in all books or one; those that the walk does not reach are left out."""
    rows = nodes if source is None else nodes.where(F.col("source") == source)
    return rows.join(stream_positions(heads, next_edges, rows).where("position is not null"), "uuid")


def community_overview(communities: DataFrame) -> DataFrame:
    return communities.select("source", "component", F.substring("summary_text", 1, 120).alias("summary"), F.size("summary_embedding").alias("vector_size"))


def type_histogram(rows: DataFrame, kind: str = "type") -> DataFrame:
    """(type, n), most common first; null and the empty string count as `?`."""
    known = F.when(F.col(kind) != "", F.col(kind))
    return rows.groupBy(F.coalesce(known, F.lit("?")).alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def histogram_line(rows: DataFrame, kind: str = "type") -> DataFrame:
    """One row: `a=2 b=1`, most common first; `none` without rows."""
    h = type_histogram(rows, kind)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "type"))), lambda x: F.concat(x.type, F.lit("="), (-x.k).cast("string"))), " ")
    return h.agg(F.when(F.count("*") == 0, F.lit("none")).otherwise(line).alias("line"))


def snippet(text: Column, limit: int = 80) -> Column:
    """White space collapsed; beyond the limit so many characters and an ellipsis."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def stage_metrics(df: DataFrame, name: str):
    """The rows that pass, observed while they do: (DataFrame, Observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def gold_edit_check(records: DataFrame) -> DataFrame:
    """Records (id, transcription, corrected, edits, edit_classes) whose edits do not give the corrected text.

    Edits of order only may permute lines.
    """
    edited = apply_edits(F.col("transcription"), F.col("edits"))
    lines = lambda c: F.array_sort(F.split(c, "\n"))
    order = F.array_distinct("edit_classes") == F.array(F.lit("order"))
    fine = F.when(order, lines("transcription") == lines("corrected")).otherwise(edited == F.col("corrected"))
    return records.where(~fine)


def split_leakage(records: DataFrame) -> DataFrame:
    """Derived records whose text or split differs from their base's: (id, derived_from)."""
    base = records.select(F.col("id").alias("derived_from"), F.col("transcription").alias("_t"), F.col("split").alias("_s"))
    return records.join(base, "derived_from").where("not (transcription <=> _t) or not (split <=> _s)").select("id", "derived_from")


def split_coverage(records: DataFrame, group: str, split: str = "split") -> DataFrame:
    """(group, split) pairs that do not occur; each group meets the few splits by an array, not a join."""
    splits = records.agg(F.array_sort(F.collect_set(split)).alias("splits"))
    have = records.groupBy(group).agg(F.collect_set(split).alias("have")).join(F.broadcast(splits))
    return have.select(group, F.explode(F.array_except("splits", "have")).alias(split))


def edit_class_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("edits.class").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def discard_keep_eval(spans: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of discard spans that are gone and of keep spans that are there. spans: (page, span, keep); kept: (page, content)."""
    text = kept.groupBy("page").agg(F.concat_ws("\n", F.array_sort(F.collect_list("content"))).alias("text"))
    found = F.contains(F.coalesce("text", F.lit("")), "span")
    return spans.join(text, "page", "left").agg(F.avg(F.when(~F.col("keep"), (~found).cast("double"))).alias("discard_gone"), F.avg(F.when(F.col("keep"), found.cast("double"))).alias("keep_there"))
