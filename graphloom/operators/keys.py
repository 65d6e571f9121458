"""Deterministic keys (2.F): name-based UUIDs as 32 hex digits, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.digests import ordered_digest

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(text: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of a text in a namespace; null for null."""
    return of_sha1(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "UTF-8"))))


def of_sha1(h: Column) -> Column:
    """The version 5 UUID of a SHA-1 (hex) over namespace and text."""
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3) + 1), F.lit(1))
    return F.concat(F.substr(h, F.lit(1), F.lit(12)), F.lit("5"), F.substr(h, F.lit(14), F.lit(3)), variant, F.substr(h, F.lit(18), F.lit(15)))


def dashed(key: Column) -> Column:
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substr(key, F.lit(a), F.lit(n)) for a, n in parts))


def _key(*parts) -> Column:
    return uuid5(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def source_key(source: Column) -> Column:
    return uuid5(source)


def node_key(source: Column, index: Column) -> Column:
    return _key(source, "#", index)


def block_key(block: Column) -> Column:
    """Ids joined by `#`."""
    return F.concat_ws("#", F.transform(block, lambda x: x.cast("string")))


def statement_key(source: Column, block: Column) -> Column:
    return _key(source, "#statement#", block_key(block))


def procedure_key(source: Column, block: Column, index: Column) -> Column:
    return _key(source, "#procedure#", block_key(block), "#", index)


def act_key(source: Column, statement: Column, procedure: Column, step: Column) -> Column:
    return _key(source, "#act#", statement, "#", procedure, "#", step)


def instruction_key(source: Column, node_id: Column) -> Column:
    return _key(source, "#instruction#", node_id)


def fact_key(source: Column, node_ids: Column, index: Column) -> Column:
    return _key(source, "#fact#", block_key(node_ids), "#", index)


def triplet_key(source: Column, node: Column, fact: Column, s: Column, p: Column, o: Column) -> Column:
    return _key(source, "#triplet#", node, "#", fact, "#", s, "#", p, "#", o)


def entity_key(source: Column, node: Column, triplet: Column, role: Column) -> Column:
    return _key(source, "#entity#", node, "#", triplet, "#", role)


def predicate_key(source: Column, node: Column, fact: Column, s: Column, p: Column, o: Column) -> Column:
    return _key(source, "#predicate#", node, "#", fact, "#", s, "#", p, "#", o)


def hub_key(source: Column, kind: str, spokes: Column) -> Column:
    """Entity or predicate hub of a set of spokes; their order does not matter."""
    return _key(source, f"#{kind}_hub#", F.concat_ws("#", F.array_sort(spokes)))


def member_keys(members: DataFrame, between: str, order: str | None = None) -> DataFrame:
    """(source, component, uuid, n) of groups (source, component, member): the key of the source, `between` and the members joined by `#` and sorted as texts, or by `order`.

    The same as `hub_key`, `community_key` or `statement_key` of all members in one array, without
    such an array: members are digested in order, so a group may have any size. A
    group's members are distinct.
    """
    group = F.concat(F.length("source").cast("string"), F.lit(":"), "source", F.col("component").cast("string"))
    rows = members.select(group.alias("key"), "source", F.col("member").cast("string").alias("member"), (F.col("member").cast("string") if order is None else F.col(order)).alias("by"))
    head = F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat("source", F.lit(between)), "UTF-8"))
    digests = ordered_digest(rows, "key", ["by"], F.col("member"), "sha1", "#", head)
    groups = members.select("source", "component").distinct().withColumn("key", group)
    return groups.join(digests, "key").select("source", "component", of_sha1(F.col("digest")).alias("uuid"), "n")


def definition_key(hub: Column) -> Column:
    return _key(hub, "#definition")


def triplet_hub_key(source: Column, s: Column, p: Column, o: Column) -> Column:
    return _key(source, "#triplet_hub#", s, "#", p, "#", o)


def fact_hub_key(triplet_hub: Column) -> Column:
    return _key(triplet_hub, "#fact_hub")


def community_key(source: Column, hubs: Column) -> Column:
    return _key(source, "#community#", F.concat_ws("#", F.array_sort(hubs)))


def run_key(text: Column, namespace: str) -> Column:
    """A run id: dashed, in a namespace of its own."""
    return dashed(uuid5(text, namespace))


def check_unique(table: DataFrame, key: str = "uuid") -> DataFrame:
    """Keys that more than one row has, with their count. An empty result means unique."""
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
