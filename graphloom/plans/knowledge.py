"""Queries over facts, triplets, keys and graph tables (2.E to 2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph, keys, semantics
from graphloom.plans.base import NODES, PLACED, STAR, nodes, placed, query, star_facts, star_triplets, strip_sql, uuid5_sql
from graphloom.tables import table

FACTS = NODES + rf""", said AS (SELECT source, id, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM nodes WHERE type NOT IN ('header', 'bibliographic', 'caption')),
sentences AS (SELECT source, id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS raw FROM said),
facts AS (SELECT source, id, pos, {strip_sql('raw')} AS text, row_number() OVER (PARTITION BY source ORDER BY id, pos) - 1 AS index FROM sentences WHERE {strip_sql('raw')} <> '')"""
def _facts(spark, sf):
    return semantics.index_facts(semantics.extract_facts(nodes(spark, sf)))


@query("e1_extract_facts", f"WITH {FACTS} SELECT source, id, pos, text FROM facts")
def e1(spark, sf):
    return semantics.extract_facts(nodes(spark, sf)).select("source", "id", "pos", "text")


@query("e2_index_facts", f"WITH {FACTS} SELECT source, id, index, text FROM facts")
def e2(spark, sf):
    return _facts(spark, sf).select("source", "id", "index", "text")


@query("e3_dedup_facts", f"WITH {STAR} SELECT source, fact_index // 80 AS window_id, concat_ws(' ', subject, predicate) AS text, min(fact_index) AS \"index\" FROM star GROUP BY ALL")
def e3(spark, sf):
    t = star_triplets(spark, sf).select("source", F.col("fact_index").alias("index"), F.floor(F.col("fact_index") / 80).alias("window_id"), F.concat_ws(" ", "subject", "predicate").alias("text"))
    return semantics.dedup_facts(t)


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: The clause rule of `fact_triplets`, step by step over the facts.
TRIPLETS = FACTS + f""", bare AS (SELECT source, index AS fact_index, text, regexp_replace(regexp_replace(text, '[.!?]+$', ''), {_re(semantics.FRAME)}, '') AS t FROM facts),
told AS (SELECT source, fact_index, text, regexp_replace(regexp_replace(t, {_re(semantics.SO)}, ''), ',? (?:{semantics.REASONS}) .*$', '') AS t FROM bare),
open_facts AS (SELECT *, ends_with(text, '?') AND regexp_matches(t, {_re(semantics.ASKED)}) AS asked FROM told WHERE NOT regexp_matches(t, {_re(semantics.REQUEST)}) AND NOT contains(t, 'property that')),
conditions AS (SELECT source, fact_index, unnest(string_split(regexp_replace(t, ',? (?:{semantics.IFS}) ', chr(1), 'g'), chr(1))) AS part FROM open_facts WHERE NOT asked),
subjects AS (SELECT *, regexp_extract(part, '^(.+?) (?:{semantics.VERB}) ', 1) AS subject, regexp_matches(part, {_re(semantics.EQUATION)}) AS equation FROM conditions),
phrases AS (SELECT source, fact_index, subject, unnest(string_split(regexp_replace(substr(part, length(subject) + 2), ',? (?:{semantics.JOINS}) ({semantics.VERB}) ', chr(1) || '\\1 ', 'g'), chr(1))) AS phrase FROM subjects WHERE NOT equation AND subject <> ''),
related AS (SELECT source, fact_index, CASE WHEN regexp_extract(subject, {_re(semantics.SYMBOL)}, 1) <> '' THEN regexp_extract(subject, {_re(semantics.SYMBOL)}, 1) ELSE subject END AS s,
  CASE WHEN regexp_matches(phrase, {_re(semantics.MEASURE)}) THEN regexp_extract(phrase, {_re(semantics.MEASURE)}, 1) ELSE regexp_extract(phrase, {_re(semantics.PHRASE)}, 1) END AS predicate,
  CASE WHEN regexp_matches(phrase, {_re(semantics.MEASURE)}) THEN regexp_extract(phrase, {_re(semantics.MEASURE)}, 2) ELSE regexp_extract(phrase, {_re(semantics.PHRASE)}, 2) END AS o FROM phrases),
every AS (
  SELECT source, fact_index, regexp_replace(s, '^[ ,;:]+|[ ,;:]+$', '', 'g') AS subject, predicate, regexp_replace(o, '^[ ,;:]+|[ ,;:]+$', '', 'g') AS object FROM related
  UNION ALL SELECT source, fact_index, regexp_extract(part, {_re(semantics.EQUATION)}, 1), 'equals', regexp_extract(part, {_re(semantics.EQUATION)}, 2) FROM subjects WHERE equation
  UNION ALL SELECT source, fact_index, regexp_extract(t, {_re(semantics.ASKED)}, 2), lower(regexp_extract(t, {_re(semantics.ASKED)}, 1)), regexp_extract(t, {_re(semantics.ASKED)}, 3) FROM open_facts WHERE asked
), fact_triplets AS (SELECT DISTINCT * FROM every WHERE subject <> '' AND predicate <> '' AND object <> '' AND NOT regexp_matches(subject, {_re(semantics.EMPTY)}))"""


@query("e4_extract_triplets", f"WITH {TRIPLETS} SELECT * FROM fact_triplets")
def e4(spark, sf):
    return semantics.extract_triplets(_facts(spark, sf))


@query("e5_check_verbatim", f"WITH {STAR} SELECT source, fact_index, CASE WHEN fact_index % 50 = 0 THEN 'nobody' ELSE subject END AS subject, predicate, object FROM star WHERE fact_index % 50 = 0")
def e5(spark, sf):
    t = star_triplets(spark, sf).withColumn("subject", F.when(F.col("fact_index") % 50 == 0, "nobody").otherwise(F.col("subject")))
    return semantics.not_verbatim(t, star_facts(spark, sf)).select("source", "fact_index", "subject", "predicate", "object")


@query("e6_dedup_triplets", f"WITH {STAR} SELECT DISTINCT source, fact_index, subject, predicate, object FROM star")
def e6(spark, sf):
    t = star_triplets(spark, sf)
    return semantics.dedup_triplets(t.unionByName(t))


@query("e7_node_fact_index", f"WITH {STAR} SELECT source, node_id, fact_index FROM star")
def e7(spark, sf):
    return semantics.node_fact_index(star_facts(spark, sf))


@query("e8_node_triplets", f"WITH {STAR} SELECT source, fact_index, node_id, subject, predicate, object FROM star")
def e8(spark, sf):
    return semantics.node_triplets(star_triplets(spark, sf), star_facts(spark, sf))


LINES = f"WITH {STAR}, x AS (SELECT *, concat_ws(' | ', subject, predicate, object) AS line FROM star)"


@query("e9_local_entities", f"{LINES} SELECT source, node_id, name, list_sort(list(DISTINCT line)) AS triplets FROM (SELECT source, node_id, unnest([subject, object]) AS name, line FROM x) GROUP BY ALL")
def e9(spark, sf):
    return semantics.local_entities(semantics.node_triplets(star_triplets(spark, sf), star_facts(spark, sf)))


@query("e10_local_relations", f"{LINES} SELECT source, node_id, predicate, list_sort(list(DISTINCT line)) AS triplets FROM x GROUP BY source, node_id, predicate")
def e10(spark, sf):
    return semantics.local_relations(semantics.node_triplets(star_triplets(spark, sf), star_facts(spark, sf)))


def _descriptions(spark, sf):
    rel = semantics.local_relations(semantics.node_triplets(star_triplets(spark, sf), star_facts(spark, sf))).withColumnRenamed("predicate", "name")
    told = rel.select("source", F.col("node_id").alias("id")).distinct().withColumn("content", F.when(F.col("id") % 4 == 0, " ").otherwise("text"))
    return semantics.describe(rel, told)


DESCRIBED = f"{LINES}, d AS (SELECT source, node_id, predicate AS name, array_to_string(list_sort(list(DISTINCT line)), '; ') AS description FROM x WHERE node_id % 4 <> 0 GROUP BY ALL)"


@query("e11_describe", f"{DESCRIBED} SELECT * FROM d")
def e11(spark, sf):
    return _descriptions(spark, sf).select("source", "node_id", "name", "description")


@query("e12_description_at", f"{DESCRIBED} SELECT x.source, x.fact_index, x.node_id, predicate AS name, description FROM x LEFT JOIN d ON d.source = x.source AND d.node_id = x.node_id AND d.name = x.predicate")
def e12(spark, sf):
    wanted = semantics.node_triplets(star_triplets(spark, sf), star_facts(spark, sf)).select("source", "fact_index", "node_id", F.col("predicate").alias("name"))
    d = _descriptions(spark, sf).select("source", "node_id", "name", "description", F.lit(0).alias("pos"))
    return semantics.description_at(wanted, d).select("source", "fact_index", "node_id", "name", "description")


@query("e13_embed_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE source || ': ' || lang END AS text FROM documents")
def e13(spark, sf):
    d = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", semantics.embed_text(F.col("source"), d).alias("text"))


@query("e14_attach_embeddings")
def e14(spark, sf):
    return semantics.attach_embeddings(table(spark, sf, "benchmark").select("item_id", "text")).select("item_id", "embedding")


@query("e15_embedding_coverage", "SELECT 'even' AS label, count(*) FILTER (vec_id % 2 = 0) AS with_vector, count(*) FILTER (vec_id % 2 <> 0) AS without_vector FROM embeddings UNION ALL SELECT 'all', count(embedding), 0 FROM embeddings")
def e15(spark, sf):
    e = table(spark, sf, "embeddings")
    return semantics.embedding_coverage({"even": e.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))), "all": e})


C = F.col
B, BS = "array(doc_id, n_chars)", "doc_id || '#' || n_chars"
KEYS = {
    "f1_uuid5": (lambda: keys.uuid5(C("text")), "text"),
    "f2_source": (lambda: keys.source_key(C("source")), "source"),
    "f3_node": (lambda: keys.node_key(C("source"), C("doc_id")), "source || '#' || doc_id"),
    "f5_statement": (lambda: keys.statement_key(C("source"), F.expr(B)), f"source || '#statement#' || {BS}"),
    "f6_procedure": (lambda: keys.procedure_key(C("source"), F.expr(B), C("n_chars")), f"source || '#procedure#' || {BS} || '#' || n_chars"),
    "f7_act": (lambda: keys.act_key(C("source"), C("lang"), C("lang"), C("doc_id")), "source || '#act#' || lang || '#' || lang || '#' || doc_id"),
    "f8_instruction": (lambda: keys.instruction_key(C("source"), C("doc_id")), "source || '#instruction#' || doc_id"),
    "f9_fact": (lambda: keys.fact_key(C("source"), F.expr(B), C("doc_id")), f"source || '#fact#' || {BS} || '#' || doc_id"),
    "f10_triplet": (lambda: keys.triplet_key(C("source"), C("doc_id"), C("n_chars"), C("lang"), C("lang"), C("source")), "source || '#triplet#' || doc_id || '#' || n_chars || '#' || lang || '#' || lang || '#' || source"),
    "f11_entity": (lambda: keys.entity_key(C("source"), C("doc_id"), C("lang"), F.lit("subject")), "source || '#entity#' || doc_id || '#' || lang || '#subject'"),
    "f12_predicate": (lambda: keys.predicate_key(C("source"), C("doc_id"), C("n_chars"), C("lang"), C("lang"), C("source")), "source || '#predicate#' || doc_id || '#' || n_chars || '#' || lang || '#' || lang || '#' || source"),
    "f13_hub": (lambda: keys.hub_key(C("source"), "entity", F.array("source", "lang")), "source || '#entity_hub#' || array_to_string(list_sort([source, lang]), '#')"),
    "f14_definition": (lambda: keys.definition_key(C("source")), "source || '#definition'"),
    "f15_triplet_hub": (lambda: keys.triplet_hub_key(C("source"), C("lang"), C("doc_id"), C("lang")), "source || '#triplet_hub#' || lang || '#' || doc_id || '#' || lang"),
    "f16_fact_hub": (lambda: keys.fact_hub_key(C("source")), "source || '#fact_hub'"),
    "f17_community": (lambda: keys.community_key(C("source"), F.array("source", "lang")), "source || '#community#' || array_to_string(list_sort([source, lang]), '#')"),
}
for _name, (_make, _text) in KEYS.items():
    query(_name, f"SELECT doc_id, {uuid5_sql(_text)} AS uuid FROM documents")(lambda spark, sf, make=_make: table(spark, sf, "documents").select("doc_id", make().alias("uuid")))


@query("f4_block_key", f"SELECT doc_id, {BS} AS key FROM documents")
def f4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", keys.block_key(F.expr(B)).alias("key"))


_U = uuid5_sql("source || doc_id")


@query("f18_run_id", f"SELECT doc_id, u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32] AS run_id FROM (SELECT doc_id, {_U} AS u FROM documents)")
def f18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", keys.run_key(F.concat("source", C("doc_id").cast("string")), keys.URL_NAMESPACE).alias("run_id"))


@query("f19_check_unique", "SELECT source || lang AS uuid, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def f19(spark, sf):
    return keys.check_unique(table(spark, sf, "documents").select(F.concat("source", "lang").alias("uuid")))


def _stamped(df):
    return df.withColumns({"created_at": F.to_timestamp(F.lit("2019-01-01")), "modified_at": F.to_timestamp(F.lit("2019-01-01"))})


@query("g1_upsert_vertices", "SELECT s_suppkey AS uuid, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS name, s_acctbal AS bal, s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0 OR s_suppkey % 2 <> 0 AS inserted, s_suppkey % 3 = 0 OR s_suppkey % 2 <> 0 AS touched FROM supplier")
def g1(spark, sf):
    s = table(spark, sf, "supplier").select(C("s_suppkey").alias("uuid"), C("s_name").alias("name"), C("s_acctbal").alias("bal"))
    old = _stamped(s.where("uuid % 2 = 0"))
    update = s.where("uuid % 3 = 0 and uuid % 2 = 0").select("uuid", F.upper("name").alias("name"), F.lit(None).cast("double").alias("bal"))
    new = s.where("uuid % 2 <> 0")
    out = graph.upsert_vertices(old, update.unionByName(new), F.to_timestamp(F.lit("2020-01-01")))
    return out.select("uuid", "name", "bal", (F.year("created_at") == 2020).alias("inserted"), (F.year("modified_at") == 2020).alias("touched"))


@query("g2_upsert_edges", "SELECT o_orderkey AS src, o_custkey AS dst, o_orderkey % 2 = 0 AS old, o_orderkey % 3 = 0 AND o_custkey % 4 <> 0 AS touched FROM orders WHERE o_orderkey % 2 = 0 OR (o_orderkey % 3 = 0 AND o_custkey % 4 <> 0)")
def g2(spark, sf):
    """Orders of customers: half of the edges are there; a third is written, twice, of which those to a quarter of the customers have no vertex."""
    o = table(spark, sf, "orders").select(C("o_orderkey").alias("src"), C("o_custkey").alias("dst"))
    customers = table(spark, sf, "customer").select(C("c_custkey").alias("uuid")).where("uuid % 4 <> 0")
    new = o.where("src % 3 = 0")
    out = graph.upsert_edges(_stamped(o.where("src % 2 = 0")), new.unionByName(new), F.to_timestamp(F.lit("2020-01-01")), o.select(C("src").alias("uuid")), customers)
    return out.select("src", "dst", (F.year("created_at") == 2019).alias("old"), (F.year("modified_at") == 2020).alias("touched"))


@query("g3_node_label", "SELECT doc_id, upper(lang[1:1]) || lang[2:] AS label FROM documents")
def g3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", graph.node_label(C("lang")).alias("label"))


@query("g4_sources", f"SELECT DISTINCT source, source AS key, {uuid5_sql('source')} AS uuid FROM documents")
def g4(spark, sf):
    return graph.sources(table(spark, sf, "documents").select("source").distinct())


_NODE = uuid5_sql("source || '#' || id")


@query("g5_nodes", f"WITH {NODES} SELECT {_NODE} AS uuid, source, type, content, id AS \"index\", segment_index FROM nodes")
def g5(spark, sf):
    return graph.nodes(nodes(spark, sf))


@query("g6_head", f"WITH {NODES} SELECT {uuid5_sql('source')} AS src, {_NODE} AS dst FROM nodes WHERE id = 0")
def g6(spark, sf):
    return graph.head_edges(graph.nodes(nodes(spark, sf)))


@query("g7_next", f"WITH {NODES}, x AS (SELECT source, id, lead(id) OVER (PARTITION BY source ORDER BY id) AS n FROM nodes WHERE id % 7 <> 3) SELECT {_NODE} AS src, {uuid5_sql(chr(115) + 'ource || ' + chr(39) + '#' + chr(39) + ' || n')} AS dst FROM x WHERE n IS NOT NULL")
def g7(spark, sf):
    return graph.next_edges(nodes(spark, sf).where("id % 7 <> 3"))


def _spans(spark, sf):
    d = table(spark, sf, "documents").select("source", F.array("doc_id", C("doc_id") + 1).alias("block"))
    return d.withColumns({"members": C("block"), "index": F.lit(0)})


_BLK = "doc_id || '#' || (doc_id + 1)"
_ST = uuid5_sql(f"source || '#statement#' || {_BLK}")
_PR = uuid5_sql(f"source || '#procedure#' || {_BLK} || '#0'")


@query("g8_statements", f"SELECT {_ST} AS uuid, source, {_BLK} AS block FROM documents")
def g8(spark, sf):
    return graph.statements(_spans(spark, sf))


@query("g8_statement_members", f"SELECT {uuid5_sql(chr(115) + 'ource || ' + chr(39) + '#' + chr(39) + ' || m')} AS src, st AS dst FROM (SELECT source, unnest([doc_id, doc_id + 1]) AS m, {_ST} AS st FROM documents)")
def g8b(spark, sf):
    return graph.statement_members(_spans(spark, sf))


@query("g9_procedures", f"SELECT {_PR} AS uuid, source, {_BLK} AS block, 0 AS \"index\" FROM documents")
def g9(spark, sf):
    return graph.procedures(_spans(spark, sf))


@query("g9_procedure_members", f"SELECT {uuid5_sql(chr(115) + 'ource || ' + chr(39) + '#' + chr(39) + ' || m')} AS src, pr AS dst FROM (SELECT source, unnest([doc_id, doc_id + 1]) AS m, {_PR} AS pr FROM documents)")
def g9b(spark, sf):
    return graph.procedure_members(_spans(spark, sf))


def _acts(spark, sf):
    steps = _spans(spark, sf).select("source", keys.statement_key(C("source"), C("block")).alias("statement"), keys.procedure_key(C("source"), C("block"), C("index")).alias("procedure"), F.explode("members").alias("step"))
    return graph.acts(steps)


_act = lambda step: uuid5_sql(f"source || '#act#' || {_ST} || '#' || {_PR} || '#' || ({step})")


@query("g10_acts", f"SELECT {_act('m')} AS uuid, source, {_PR} AS procedure, m AS step FROM (SELECT source, doc_id, unnest([doc_id, doc_id + 1]) AS m FROM documents)")
def g10(spark, sf):
    return _acts(spark, sf)


@query("g10_first", f"SELECT {_PR} AS src, {_act('doc_id')} AS dst FROM documents")
def g10_first(spark, sf):
    return graph.act_edges(_acts(spark, sf))[0]


@query("g10_then", f"SELECT {_act('doc_id')} AS src, {_act('doc_id + 1')} AS dst FROM documents")
def g10_then(spark, sf):
    return graph.act_edges(_acts(spark, sf))[1]


@query("g11_governs", f"SELECT {uuid5_sql(chr(115) + 'ource || ' + chr(39) + '#instruction#' + chr(39) + ' || doc_id')} AS src, {uuid5_sql(chr(115) + 'ource || ' + chr(39) + '#' + chr(39) + ' || m')} AS dst FROM (SELECT source, doc_id, unnest([doc_id, doc_id + 1]) AS m FROM documents)")
def g11(spark, sf):
    return graph.governs(_spans(spark, sf).withColumn("node_id", F.element_at("block", 1)))


@query("g11_instructions", f"SELECT {uuid5_sql(chr(115) + 'ource || ' + chr(39) + '#instruction#' + chr(39) + ' || doc_id')} AS uuid, source, doc_id AS node_id, text, lang AS directive FROM documents")
def g11b(spark, sf):
    return graph.instructions(table(spark, sf, "documents").select("source", C("doc_id").alias("node_id"), "text", C("lang").alias("directive")))


@query("g12_facts", f"WITH {PLACED} SELECT fact_uuid AS uuid, source, fact_index AS \"index\", concat_ws(' ', subject, predicate, object) AS text FROM placed")
def g12(spark, sf):
    return graph.facts(star_facts(spark, sf))


@query("g12_evidence", f"WITH {PLACED} SELECT node_uuid AS src, fact_uuid AS dst FROM placed")
def g12b(spark, sf):
    return graph.evidence(star_facts(spark, sf))


@query("g13_triplets", f"WITH {PLACED} SELECT uuid, source, subject, predicate, object FROM placed")
def g13(spark, sf):
    return graph.triplets(placed(spark, sf))


@query("g14_yields", f"WITH {PLACED} SELECT fact_uuid AS src, uuid AS dst FROM placed")
def g14(spark, sf):
    return graph.yields(placed(spark, sf))


_EN = uuid5_sql("source || '#entity#' || node_uuid || '#' || uuid || '#' || role")
ENTS = PLACED + ", roles AS (SELECT *, unnest(['subject', 'object']) AS role FROM placed)"


@query("g15_entities", f"WITH {ENTS} SELECT source, node_id, uuid AS triplet_uuid, role, CASE role WHEN 'subject' THEN subject ELSE object END AS name, {_EN} AS uuid FROM roles")
def g15(spark, sf):
    return graph.entities(placed(spark, sf))


@query("g16_has_subject", f"WITH {ENTS} SELECT uuid AS src, {_EN} AS dst FROM roles WHERE role = 'subject'")
def g16(spark, sf):
    return graph.role_edges(graph.entities(placed(spark, sf)), "subject")


@query("g16_has_object", f"WITH {ENTS} SELECT uuid AS src, {_EN} AS dst FROM roles WHERE role = 'object'")
def g16b(spark, sf):
    return graph.role_edges(graph.entities(placed(spark, sf)), "object")


_PK = uuid5_sql("source || '#predicate#' || node_uuid || '#' || fact_uuid || '#' || subject || '#' || predicate || '#' || object")


@query("g17_predicates", f"WITH {PLACED} SELECT {_PK} AS uuid, source, predicate AS name, uuid AS triplet_uuid FROM placed")
def g17(spark, sf):
    return graph.predicates(placed(spark, sf))



@query("g17_has_predicate", f"WITH {PLACED} SELECT uuid AS src, {_PK} AS dst FROM placed")
def g17_edges(spark, sf):
    return graph.predicate_edges(graph.predicates(placed(spark, sf)))
