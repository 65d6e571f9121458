"""Inputs shared by the registered queries, as DataFrames and as oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, stream, text
from graphloom.operators.text import TYPE_RULES
from graphloom.sources import io
from graphloom.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its oracle where SQL can express it."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return io.read_text_documents(table(spark, sf, "documents"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = text.segment_blocks(pages(spark, sf))
    return b.withColumn("type", text.block_type(F.col("content")))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(source, id, segment_index, pos, type, content): lines of documents as the block stream of their book."""
    return stream.flatten_stream(blocks(spark, sf))


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches({strip_sql('content')}, '{p}') THEN '{t}'" for t, p in TYPE_RULES) + " ELSE 'paragraph' END"
BLOCKS = rf"""
lines AS (
  SELECT source, doc_id AS segment_index, unnest(string_split(text, chr(10))) AS content,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), kept_lines AS (SELECT *, regexp_matches(content, '^\s*[0-9]+[.)] ') AS num FROM lines WHERE {strip_sql('content')} <> ''),
marked AS (
  SELECT *, CASE WHEN num AND coalesce(lag(num) OVER (PARTITION BY source, segment_index ORDER BY line), false) THEN 0 ELSE 1 END AS fresh FROM kept_lines
), placed AS (SELECT *, sum(fresh) OVER (PARTITION BY source, segment_index ORDER BY line) - 1 AS pos FROM marked),
raw_blocks AS (SELECT source, segment_index, pos::INT AS pos, string_agg(content, chr(10) ORDER BY line) AS content FROM placed GROUP BY ALL),
blocks AS (SELECT *, {TYPE_SQL} AS type FROM raw_blocks)
"""
NODES = BLOCKS + ", nodes AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY segment_index, pos) - 1 AS id FROM blocks)"
WEIGHED = NODES + """, weighed AS (SELECT *, length(coalesce(content, '')) // 4 + 1 AS tokens FROM nodes),
sums AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY id) AS i,
    sum(tokens) OVER (PARTITION BY source ORDER BY id) - tokens AS e FROM weighed
)"""


def uuid5_sql(x: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({x}))"
    return f"list_transform([{h}], lambda h: h[1:12] || '5' || h[14:16] || substr('89ab', 1 + (('0x' || h[17:17])::INT & 3), 1) || h[18:32])[1]"


def star_triplets(spark: SparkSession, sf: str) -> DataFrame:
    """(source, fact_index, subject, predicate, object): who supplied what, by return flag."""
    li, s, p = (table(spark, sf, n) for n in ("lineitem", "supplier", "part"))
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    parts = F.struct(F.col("s_name").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("p_name").alias("object"))
    # an order may have a line number twice: the smallest triplet stays
    once = joined.groupBy(F.col("l_linestatus").alias("source"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact_index")).agg(F.min(parts).alias("t"))
    return once.select("source", "fact_index", "t.subject", "t.predicate", "t.object")


def star_facts(spark: SparkSession, sf: str) -> DataFrame:
    t = star_triplets(spark, sf)
    return t.select("source", F.col("fact_index").alias("index"), F.concat_ws(" ", "subject", "predicate", "object").alias("text"), F.array(F.floor(F.col("fact_index") / 8)).alias("node_ids"))


STAR = """
star AS (
  SELECT source, fact_index, t.subject AS subject, t.predicate AS predicate, t.object AS object, node_id FROM (
    SELECT l_linestatus AS source, l_orderkey * 8 + l_linenumber AS fact_index, l_orderkey AS node_id, min({'subject': s_name, 'predicate': l_returnflag, 'object': p_name}) AS t
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
)"""
PLACED = STAR + f""", placed_t AS (
  SELECT *, {uuid5_sql("source || '#' || node_id")} AS node_uuid, {uuid5_sql("source || '#fact#' || node_id || '#' || fact_index")} AS fact_uuid FROM star
), placed AS (
  SELECT *, {uuid5_sql("source || '#triplet#' || node_uuid || '#' || fact_uuid || '#' || subject || '#' || predicate || '#' || object")} AS uuid FROM placed_t
)"""


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.placed_triplets(star_triplets(spark, sf), star_facts(spark, sf))
