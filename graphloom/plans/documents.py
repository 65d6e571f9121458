"""Queries over the block stream: sources, text rules, stream, windows (2.A to 2.D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph, stream, text, windows
from graphloom.plans.base import BLOCKS, NODES, WEIGHED, blocks, nodes, pages, query, strip_sql, uuid5_sql
from graphloom.scratch import materialize
from graphloom.sources import io
from graphloom.tables import table

HTML = "regexp_replace(html, '<[^>]*>', ' ', 'g')"


def _responses(spark, sf):
    """Page tables as nested responses: a book for each ten pages."""
    p = table(spark, sf, "pages")
    page = F.struct(F.col("html").alias("markdown"), F.col("url").alias("footer"), F.array(F.struct(F.concat(F.lit("img-"), F.col("page_id").cast("string")).alias("id"), F.lit("").alias("image_base64"))).alias("images"))
    grouped = p.groupBy(F.floor(F.col("page_id") / 10).cast("string").alias("source")).agg(F.array_sort(F.collect_list(F.struct("page_id", page.alias("p")))).alias("x"))
    return grouped.select("source", F.transform("x", lambda r: r.p).alias("pages"))


@query("a1_read_ocr_pages", "SELECT (page_id // 10)::VARCHAR AS source, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS segment_index, html AS markdown, url AS footer FROM pages")
def a1(spark, sf):
    return io.read_ocr_pages(_responses(spark, sf)).select("source", "segment_index", "markdown", "footer")


@query("a2_rewrite_figure_refs", "SELECT page_id, html || ' ![1]() and ![2]() and ![1]() and ![x](other)' AS markdown FROM pages")
def a2(spark, sf):
    p = table(spark, sf, "pages")
    fig = lambda k: F.concat(F.lit("![f](img-"), (F.col("page_id") + k).cast("string"), F.lit(")"))
    md = F.concat("html", F.lit(" "), fig(1), F.lit(" and "), fig(0), F.lit(" and "), fig(1), F.lit(" and ![x](other)"))
    known = F.array(*(F.concat(F.lit("img-"), (F.col("page_id") + k).cast("string")) for k in (0, 1, 2)))
    return p.select("page_id", io.rewrite_figure_refs(md, known).alias("markdown"))


@query("a3_append_footer", rf"SELECT page_id, CASE WHEN {strip_sql('f')} = '' THEN html ELSE regexp_replace(html, '\s+$', '') || chr(10) || chr(10) || {strip_sql('f')} END AS markdown FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN '  ' ELSE ' ' || url || ' ' END AS f FROM pages)")
def a3(spark, sf):
    footer = F.when(F.col("page_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    return table(spark, sf, "pages").select("page_id", io.append_footer(F.col("html"), footer).alias("markdown"))


@query("a4_select_pages", "WITH s AS (SELECT (page_id // 10)::VARCHAR AS source, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS k, url FROM pages) SELECT source, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS segment_index, url AS footer FROM s WHERE k IN (1, 4, 7)")
def a4(spark, sf):
    return io.select_pages(io.read_ocr_pages(_responses(spark, sf)), [1, 4, 7]).select("source", "segment_index", "footer")


@query("a5_pictures", "SELECT (page_id // 10)::VARCHAR AS source, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS segment_index, 1 AS index, 'img-' || page_id AS image_id FROM pages")
def a5(spark, sf):
    return io.pictures(io.read_ocr_pages(_responses(spark, sf)))


@query("a6_read_text_documents", "SELECT source, doc_id AS segment_index, text AS content FROM documents")
def a6(spark, sf):
    return pages(spark, sf).select("source", "segment_index", "content")


@query("a7_source_table", f"SELECT source, any_value(lang_min) AS lang, {uuid5_sql('source')} AS uuid, source AS key FROM (SELECT source, min(lang) AS lang_min FROM documents GROUP BY source) GROUP BY source")
def a7(spark, sf):
    books = table(spark, sf, "documents").groupBy("source").agg(F.min("lang").alias("lang"), F.lit("mine").alias("key"))
    return io.source_table(books)


@query("b1_math_delimiters", rf"SELECT doc_id, replace(replace(replace(replace('\(' || text || '\) \[' || lang || '\]', '\(', '$'), '\)', '$'), '\[', '$$'), '\]', '$$') AS content FROM documents")
def b1(spark, sf):
    made = F.concat(F.lit("\\("), "text", F.lit("\\) \\["), "lang", F.lit("\\]"))
    return table(spark, sf, "documents").select("doc_id", text.math_delimiters(made).alias("content"))


@query("b2_join_display_math", "SELECT doc_id, text || '$$a_' || doc_id || chr(10) || '= b$$' || chr(10) || '$$c$$' AS content FROM documents")
def b2(spark, sf):
    made = F.concat("text", F.lit("$$a_"), F.col("doc_id").cast("string"), F.lit("$$\n$$= b$$\n$$c$$"))
    return table(spark, sf, "documents").select("doc_id", text.join_display_math(made).alias("content"))


@query("b3_escape_currency")
def b3(spark, sf):
    made = F.concat("text", F.lit(" costs $"), F.col("n_chars").cast("string"), F.lit(" or $x$, \\$5, $$y$$"))
    return table(spark, sf, "documents").select("doc_id", text.escape_currency(made).alias("content"))


@query("b4_unicode_math", rf"SELECT doc_id, replace(replace(replace(replace('α≤' || text || '²₃', 'α', '\alpha '), '≤', '\le '), '²', '^{{2}}'), '₃', '_{{3}}') AS content FROM documents")
def b4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.unicode_math_to_latex(F.concat(F.lit("α≤"), "text", F.lit("²₃"))).alias("content"))


@query("b5_part_markers", r"SELECT doc_id, regexp_replace('(a) ' || lang || chr(10) || text || chr(10) || 'b) ' || source || chr(10) || 'c. x. y', '(?m)^([a-z])[.)] ', '(\1) ', 'g') AS content FROM documents")
def b5(spark, sf):
    made = F.concat(F.lit("ⓐ "), "lang", F.lit("\n"), "text", F.lit("\nb) "), "source", F.lit("\nc. x. y"))
    return table(spark, sf, "documents").select("doc_id", text.part_markers(made).alias("content"))


@query("b6_markdown_markup", r"SELECT doc_id, '# ' || lang || chr(10) || '## ' || source || chr(10) || chr(10) || regexp_replace(regexp_replace('* item' || chr(10) || text, '(?m)^[*+•] ', '- ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS content FROM documents")
def b6(spark, sf):
    made = F.concat("lang", F.lit("\n====\n"), "source", F.lit("\n----\n\n\n\n* item\n"), "text")
    return table(spark, sf, "documents").select("doc_id", text.markdown_markup(made).alias("content"))


@query("b7_segment_blocks", f"WITH {BLOCKS} SELECT source, segment_index, pos, content FROM blocks")
def b7(spark, sf):
    return text.segment_blocks(pages(spark, sf))


@query("b8_type_blocks", f"WITH {BLOCKS} SELECT source, segment_index, pos, type FROM blocks")
def b8(spark, sf):
    return blocks(spark, sf).select("source", "segment_index", "pos", "type")


_ODD = "CASE WHEN (segment_index + pos) % 7 = 0 THEN ' Furniture ' ELSE type END"


def _odd(spark, sf):
    return blocks(spark, sf).withColumn("type", F.when((F.col("segment_index") + F.col("pos")) % 7 == 0, " Furniture ").otherwise(F.col("type")))


@query("b9_partition_furniture", f"WITH {BLOCKS} SELECT source, segment_index, pos, trim(lower({_ODD})) <> 'furniture' AS kept FROM blocks")
def b9(spark, sf):
    kept, gone = text.partition_furniture(_odd(spark, sf))
    return kept.select("source", "segment_index", "pos", F.lit(True).alias("kept")).unionByName(gone.select("source", "segment_index", "pos", F.lit(False).alias("kept")))


@query("b10_validate_types", "SELECT doc_id, 'Poem' AS type FROM documents WHERE doc_id % 10 = 0")
def b10(spark, sf):
    return text.invalid_types(table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "Poem").otherwise(" Table ").alias("type")))


@query("b11_repeated_furniture", f"""WITH {BLOCKS}, edges AS (
  SELECT source, segment_index, unnest(list_distinct([{strip_sql('arg_min(content, pos)')}, {strip_sql('arg_max(content, pos)')}])) AS content FROM blocks GROUP BY source, segment_index
), total AS (SELECT source, count(DISTINCT segment_index) AS total FROM blocks GROUP BY source)
SELECT source, content, count(*) AS pages FROM edges JOIN total USING (source) GROUP BY source, content, total HAVING count(*) > 1 AND count(*) >= total * 0.05""")
def b11(spark, sf):
    return text.repeated_furniture(blocks(spark, sf))


@query("b12_discard_audit", f"WITH {BLOCKS} SELECT source, segment_index, count(*) AS n FROM blocks WHERE trim(lower({_ODD})) = 'furniture' GROUP BY ALL")
def b12(spark, sf):
    return text.discard_audit(text.partition_furniture(_odd(spark, sf))[1]).select("source", "segment_index", "n")


@query("b13_split_references", r"SELECT source, doc_id AS id, unnest([0, 1, 2]) AS pos, unnest([text, '[1] ' || lang || ', 1999.', '[2] ' || source]) AS work FROM (SELECT source, doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents)")
def b13(spark, sf):
    made = F.concat(F.col("text"), F.lit("\n[1] "), F.col("lang"), F.lit(", 1999. [2] "), F.col("source"))
    return text.split_references(table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), made.alias("content")))


@query("b14_apply_edits", "SELECT doc_id, md5(replace(replace(text, 'the', 'THE'), 'THE ', 'an ')) AS edited FROM documents")
def b14(spark, sf):
    edits = F.array(F.struct(F.lit("the").alias("before"), F.lit("THE").alias("after")), F.struct(F.lit("THE ").alias("before"), F.lit("an ").alias("after")))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.apply_edits(F.col("text"), edits)).alias("edited"))


@query("b15_drain_results", "SELECT doc_id AS segment_index, source, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE text END AS content FROM documents")
def b15(spark, sf):
    p = pages(spark, sf)
    d = table(spark, sf, "documents").where("doc_id % 3 = 0")
    one = d.select("source", F.col("doc_id").alias("segment_index"), F.col("lang").alias("content"), F.lit(0).alias("seq"))
    two = d.select("source", F.col("doc_id").alias("segment_index"), F.upper("lang").alias("content"), F.lit(1).alias("seq"))
    return text.drain_results(p, one.unionByName(two)).select("segment_index", "source", "content")


@query("b16_eligible_pages", f"SELECT doc_id AS segment_index FROM documents WHERE {strip_sql('text')} <> ''")
def b16(spark, sf):
    return text.eligible_pages(pages(spark, sf)).select("segment_index")


@query("c1_mergeable_blocks", f"WITH {BLOCKS} SELECT source, segment_index, pos FROM blocks WHERE type NOT IN ('bibliographic', 'note')")
def c1(spark, sf):
    return stream.mergeable_blocks(blocks(spark, sf)).select("source", "segment_index", "pos")


SEAMS = BLOCKS + """, pg AS (SELECT source, segment_index AS t, lead(segment_index) OVER (PARTITION BY source ORDER BY segment_index) AS b FROM (SELECT DISTINCT source, segment_index FROM blocks)),
m AS (SELECT *, row_number() OVER (PARTITION BY source, segment_index ORDER BY pos) AS up, row_number() OVER (PARTITION BY source, segment_index ORDER BY pos DESC) AS down FROM blocks WHERE type NOT IN ('bibliographic', 'note')),
pairs AS (SELECT source, t AS top_index, b AS bottom_index FROM pg WHERE t % 2 = 0 AND b IS NOT NULL AND (source, t) IN (SELECT (source, segment_index) FROM m) AND (source, b) IN (SELECT (source, segment_index) FROM m)),
edges AS (
  SELECT p.*, a.pos AS tail_pos, a.content AS tail, h.pos AS head_pos, h.content AS head, a2.content AS context_before, h2.content AS context_after
  FROM pairs p JOIN m a ON a.source = p.source AND a.segment_index = top_index AND a.down = 1 JOIN m h ON h.source = p.source AND h.segment_index = bottom_index AND h.up = 1
  LEFT JOIN m a2 ON a2.source = p.source AND a2.segment_index = top_index AND a2.down = 2 LEFT JOIN m h2 ON h2.source = p.source AND h2.segment_index = bottom_index AND h2.up = 2
)"""


@query("c2_seam_pairs", f"WITH {SEAMS} SELECT * FROM pairs")
def c2(spark, sf):
    b = blocks(spark, sf)
    return stream.seam_pairs(b.select("source", "segment_index").distinct(), b, 0)


def _edges(spark, sf):
    b = blocks(spark, sf)
    return stream.seam_edges(stream.seam_pairs(b.select("source", "segment_index").distinct(), b, 0), b)


@query("c3_seam_edges", f"WITH {SEAMS} SELECT * FROM edges")
def c3(spark, sf):
    return _edges(spark, sf)


JUDGE = rf"NOT regexp_matches({strip_sql('tail')}, '[.!?:;]$') AND regexp_matches({strip_sql('head')}, '^\p{{Ll}}')"


@query("c4_judge_seam", f"WITH {SEAMS} SELECT source, top_index, {JUDGE} AS is_split FROM edges")
def c4(spark, sf):
    return _edges(spark, sf).select("source", "top_index", stream.judge_seam(F.col("tail"), F.col("head")).alias("is_split"))


@query("c5_join_halves", rf"""WITH {SEAMS}, h AS (SELECT source, top_index, regexp_replace(CASE WHEN top_index % 4 = 0 THEN tail || 'ab-' ELSE tail END, '\s+$', '') AS a, regexp_replace(head, '^\s+', '') AS b FROM edges)
SELECT source, top_index, CASE WHEN regexp_matches(a, '\p{{L}}-$') THEN regexp_replace(a, '-$', '') || b ELSE a || ' ' || b END AS merged FROM h""")
def c5(spark, sf):
    tail = F.when(F.col("top_index") % 4 == 0, F.concat("tail", F.lit("ab-"))).otherwise(F.col("tail"))
    return _edges(spark, sf).select("source", "top_index", stream.join_halves(tail, F.col("head")).alias("merged"))


def _pass(blocks: str, parity: int, n: int) -> str:
    """A pass over seams of one parity as common table expressions: healed{n} of {blocks}."""
    join = r"""CASE WHEN regexp_matches(a, '\p{L}-$') THEN regexp_replace(a, '-$', '') || b WHEN regexp_matches(a, '\$\$$') AND regexp_matches(b, '^\$\$') THEN a[:-3] || ' ' || b[3:]
      WHEN regexp_matches(a, '\$$') AND regexp_matches(b, '^\$') THEN a[:-2] || ' ' || b[2:] WHEN regexp_matches(a, '```$') AND regexp_matches(b, '^```') THEN a[:-4] || ' ' || b[4:] ELSE a || ' ' || b END"""
    return f"""pg{n} AS (SELECT source, segment_index AS t, lead(segment_index) OVER (PARTITION BY source ORDER BY segment_index) AS b FROM (SELECT DISTINCT source, segment_index FROM blocks)),
m{n} AS (SELECT *, row_number() OVER (PARTITION BY source, segment_index ORDER BY pos) AS up, row_number() OVER (PARTITION BY source, segment_index ORDER BY pos DESC) AS down FROM {blocks} WHERE type NOT IN ('bibliographic', 'note')),
e{n} AS (SELECT p.source, p.t, p.b AS next, x.pos AS tail_pos, y.pos AS head_pos, x.content AS tail, y.content AS head, regexp_replace(x.content, '\\s+$', '') AS a, regexp_replace(y.content, '^\\s+', '') AS b
  FROM pg{n} p JOIN m{n} x ON x.source = p.source AND x.segment_index = p.t AND x.down = 1 JOIN m{n} y ON y.source = p.source AND y.segment_index = p.b AND y.up = 1 WHERE p.t % 2 = {parity}),
agreed{n} AS (SELECT *, {join} AS merged FROM e{n} WHERE {JUDGE}),
healed{n} AS (SELECT k.* REPLACE (coalesce(merged, content) AS content) FROM {blocks} k LEFT JOIN agreed{n} g ON g.source = k.source AND g.t = k.segment_index AND g.tail_pos = k.pos
  WHERE NOT EXISTS (SELECT 1 FROM agreed{n} h WHERE h.source = k.source AND h.next = k.segment_index AND h.head_pos = k.pos))"""


HEALED_BLOCKS = f"{BLOCKS}, {_pass('blocks', 0, 0)}, {_pass('healed0', 1, 1)}"
HEALED = f"WITH {BLOCKS}, {_pass('blocks', 0, 0)}, {_pass('healed0', 1, 1)} SELECT source, segment_index, pos, content FROM healed1"


@query("c6_heal_seams", HEALED)
def c6(spark, sf):
    return stream.heal_seams(blocks(spark, sf)).select("source", "segment_index", "pos", "content")


@query("c7_flatten_stream", f"WITH {NODES} SELECT source, segment_index, pos, id FROM nodes")
def c7(spark, sf):
    return nodes(spark, sf).select("source", "segment_index", "pos", "id")


#: What stands for numbers, lead-ins, labels and roles in the given texts, which have none of the default forms: short first words.
ITEM, LEADS = "[A-Z][a-z]{0,2}", r"^(?:To|For|From|Dans|Pour|Para|Von)[ ,.]"
LABELS, STATED, WORKED = r"^(?:The|That|Les|Die|Los)[ ,.]", "(?:^| )(?:the|les|die|los)[ ,.]", "(?:^| )(?:from|est|der|para)[ ,.]"
NUMBERED = stream.numbered(ITEM)


def _texts(spark, sf):
    """Whole texts as blocks of many lines."""
    return table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), F.col("doc_id").alias("segment_index"), F.col("text").alias("content"))


PACKED = rf"""cut AS (SELECT source, doc_id AS id, doc_id AS segment_index, string_split(regexp_replace(text, '\n(\s*(?:{ITEM})[.)]? )', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents),
pieces AS (SELECT source, id, segment_index, list_filter(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS parts FROM cut),
several AS (SELECT *, len(list_filter(parts, lambda x: regexp_matches(x, '{NUMBERED}'))) >= 2 AS many FROM pieces)"""


@query("c8_split_packed", f"""WITH {PACKED}, each AS (SELECT source, id, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS piece FROM several WHERE many)
SELECT source, id, piece, nullif(regexp_extract(t, '^\\s*({ITEM})[.)]? ', 1), '') AS number, {strip_sql(f"regexp_replace(t, '{NUMBERED}', '')")} AS body FROM each""")
def c8(spark, sf):
    return stream.packed_pieces(_texts(spark, sf), ITEM)


@query("c9_rebuild_stream", f"""WITH {PACKED}, e AS (SELECT source, id, segment_index, unnest(range(CASE WHEN many THEN len(parts) ELSE 1 END)) AS piece FROM several)
SELECT source, segment_index, row_number() OVER (PARTITION BY source ORDER BY e.id, piece) - 1 AS id FROM e""")
def c9(spark, sf):
    n = _texts(spark, sf)
    return stream.rebuild_stream(n, stream.packed_pieces(n, ITEM)).select("source", "segment_index", "id")


def _led(spark, sf):
    return stream.tag_lead_ins(nodes(spark, sf), LEADS, ITEM)


LED = NODES + f""", led AS (SELECT *, regexp_matches(content, '{LEADS}') AND NOT regexp_matches(content, '{NUMBERED}') AS lead FROM nodes),
grouped AS (SELECT *, sum(lead::INT) OVER (PARTITION BY source ORDER BY id) AS g FROM led),
cand AS (SELECT r.source, l.id AS lead_in_id, r.id, (r.id - l.id - 1)::INT AS position, r.content FROM grouped r JOIN grouped l ON l.source = r.source AND l.g = r.g AND l.lead WHERE NOT r.lead),
governed AS (SELECT source, lead_in_id, coalesce(min(position) FILTER (NOT regexp_matches(content, '{NUMBERED}')), max(position) + 1) AS n FROM cand GROUP BY ALL),
hubs AS (SELECT c.source, c.lead_in_id AS node_id, list(c.id ORDER BY c.id) AS members FROM cand c JOIN governed v ON v.source = c.source AND v.lead_in_id = c.lead_in_id AND c.position < v.n GROUP BY ALL)"""


@query("c10_tag_lead_ins", f"WITH {LED} SELECT source, id FROM led WHERE lead")
def c10(spark, sf):
    return _led(spark, sf).where("type = 'instruction'").select("source", "id")


@query("c11_lead_in_candidates", f"WITH {LED} SELECT source, lead_in_id, id, position FROM cand")
def c11(spark, sf):
    return stream.lead_in_candidates(_led(spark, sf)).select("source", "lead_in_id", "id", "position")


def _hubs(spark, sf):
    led = materialize(_led(spark, sf), "led")
    cand = materialize(stream.lead_in_candidates(led), "lead-in-candidates")
    return stream.instruction_hubs(led, cand, stream.governed_run(cand, ITEM))


@query("c12_governed_run", f"WITH {LED} SELECT source, node_id, members FROM hubs")
def c12(spark, sf):
    return _hubs(spark, sf).select("source", "node_id", "members")


@query("c13_instruction_hubs", rf"""WITH {LED}, said AS (SELECT h.source, node_id, content AS text, {strip_sql("regexp_replace(content, '(?i)^(?:in|for) (?:exercises?|problems?)[^,:]*[,:]', '')")} AS d, members FROM hubs h JOIN nodes n ON n.source = h.source AND n.id = h.node_id)
SELECT source, node_id, text, nullif(d, '') AS directive, members FROM said""")
def c13(spark, sf):
    return _hubs(spark, sf)


@query("c14_drop_lead_ins", f"WITH {LED} SELECT source, id FROM led WHERE NOT lead")
def c14(spark, sf):
    return stream.drop_lead_ins(_led(spark, sf)).select("source", "id")


@query("c15_normalize_spans", 'SELECT doc_id, least(greatest(doc_id % 30 - 10, 0), 11) AS start, greatest(least(greatest(doc_id % 17 - 2, 0), 11), least(greatest(doc_id % 30 - 10, 0), 11)) AS "end" FROM documents')
def c15(spark, sf):
    spans = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 30 - 10).alias("start"), (F.col("doc_id") % 17 - 2).alias("end"), F.lit(12).alias("size"))
    return stream.normalize_spans(spans).select("doc_id", "start", "end")


UNITS = NODES + f""", cut AS (SELECT *, regexp_matches(content, '{LABELS}') AS lab, sum((regexp_matches(content, '{LABELS}') OR type = 'header')::INT) OVER (PARTITION BY source ORDER BY id) AS u FROM nodes),
units AS (SELECT source, min(id) AS s, max(id) AS e, count(*) AS n, u FROM cut GROUP BY source, u HAVING arg_min(lab, id)),
parts AS (SELECT c.source, s AS span_id, id, content, row_number() OVER (PARTITION BY c.source, s ORDER BY id) - 1 AS pos FROM cut c JOIN units x ON x.source = c.source AND x.u = c.u),
roles AS (SELECT source, span_id, bool_or(regexp_matches(content, '{STATED}')) AS has_statement, bool_or(regexp_matches(content, '{WORKED}')) AS has_procedure FROM parts WHERE {strip_sql('content')} <> '' GROUP BY ALL)"""


def _units(spark, sf):
    """(nodes, spans, their members)."""
    n = materialize(nodes(spark, sf), "nodes")
    spans = materialize(stream.find_units(n, LABELS), "units")
    return n, spans, materialize(stream.span_members(spans, n), "unit-members")


#: The same rule on a stream where every ninth node opens a unit and every twentieth is a heading, whatever the texts are.
PLANTED = f"""planted AS (SELECT source, id, CASE WHEN id % 9 = 0 THEN 'Example ' || id ELSE content END AS content, id % 20 = 5 AND id % 9 <> 0 AS heads FROM nodes),
planted_cut AS (SELECT *, regexp_matches(content, '{stream.LABEL}') AS lab, sum((regexp_matches(content, '{stream.LABEL}') OR heads)::INT) OVER (PARTITION BY source ORDER BY id) AS u FROM planted),
planted_units AS (SELECT source, min(id) AS s, max(id) AS e, count(*) AS n, u FROM planted_cut GROUP BY source, u HAVING arg_min(lab, id))"""


def _planted(n):
    made = F.when(F.col("id") % 9 == 0, F.concat(F.lit("Example "), F.col("id").cast("string"))).otherwise(F.col("content"))
    return n.withColumn("content", made).withColumn("type", F.when((F.col("id") % 20 == 5) & (F.col("id") % 9 != 0), "header").otherwise("paragraph"))


@query("c16_find_units", f"""WITH {UNITS}, {PLANTED}
SELECT 'given' AS labels, c.source, s AS span_id, s AS start, e AS "end", n, id FROM cut c JOIN units x ON x.source = c.source AND x.u = c.u
UNION ALL SELECT 'planted', c.source, s, s, e, n, id FROM planted_cut c JOIN planted_units x ON x.source = c.source AND x.u = c.u""")
def c16(spark, sf):
    """A row for each member of each unit, as a unit has any size: by first words of the given texts, and by planted labels."""
    n = materialize(nodes(spark, sf), "nodes")
    out = []
    for labels, spans in (("given", stream.find_units(n, LABELS)), ("planted", stream.find_units(_planted(n)))):
        spans = materialize(spans, "units")
        members = stream.span_members(spans, n).join(spans, ["source", "span_id"])
        out.append(members.select(F.lit(labels).alias("labels"), "source", "span_id", "start", "end", "n", "id"))
    return out[0].unionByName(out[1])


@query("c17_bank_spans")
def c17(spark, sf):
    from graphloom.functions.providers import bank_spans

    def find(held):
        at = [k for k, (i, _) in enumerate(held) if i % 9 == 0]
        return [(a, (at[n + 1] if n + 1 < len(at) else len(held)) - 1) for n, a in enumerate(at)]

    return bank_spans(nodes(spark, sf), find)


@query("c18_span_members", f"WITH {UNITS} SELECT source, span_id, id FROM parts")
def c18(spark, sf):
    return _units(spark, sf)[2]


@query("c19_span_contents", f"WITH {UNITS} SELECT source, span_id, id, content FROM parts WHERE {strip_sql('content')} <> ''")
def c19(spark, sf):
    n, _, m = _units(spark, sf)
    return stream.span_contents(m, n)


def _roles(spark, sf):
    n, s, m = _units(spark, sf)
    return n, s, stream.type_roles(stream.span_contents(m, n), STATED, WORKED)


@query("c20_type_roles", f"WITH {UNITS} SELECT * FROM roles")
def c20(spark, sf):
    return _roles(spark, sf)[2]


@query("c21_check_roles", f"WITH {UNITS} SELECT source, span_id FROM roles WHERE NOT has_statement AND NOT has_procedure")
def c21(spark, sf):
    return stream.roleless(_roles(spark, sf)[2]).select("source", "span_id")


_HUBS = "SELECT r.source, r.span_id, '{0}' AS kind, s AS start, e AS \"end\" FROM roles r JOIN units u ON u.source = r.source AND u.s = r.span_id WHERE has_{0}"


@query("c22_build_hubs", f"WITH {UNITS} {_HUBS.format('statement')} UNION ALL {_HUBS.format('procedure')}")
def c22(spark, sf):
    n, s, r = _roles(spark, sf)
    st, pr = stream.build_hubs(s, materialize(r, "roles"), n)
    columns = ["source", "span_id", "start", "end"]
    return st.select(*columns, F.lit("statement").alias("kind")).unionByName(pr.select(*columns, F.lit("procedure").alias("kind")))


@query("c23_partition_members", f"WITH {UNITS} SELECT p.source, p.span_id, id FROM parts p JOIN units u ON u.source = p.source AND u.s = p.span_id WHERE pos IN (1, 3) OR n < 2")
def c23(spark, sf):
    """The second and fourth member of each unit, and one that no unit has; units of one member keep it."""
    _, s, m = _units(spark, sf)
    positions = s.select("source", "span_id", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 3, 1 << 40)))).alias("position"))
    return stream.select_members(m, positions)


@query("c24_both_blocks", f'WITH {UNITS} SELECT r.source, s AS start, e AS "end" FROM roles r JOIN units u ON u.source = r.source AND u.s = r.span_id WHERE has_statement AND has_procedure')
def c24(spark, sf):
    n, s, r = _roles(spark, sf)
    return stream.both_blocks(*stream.build_hubs(s, materialize(r, "roles"), n))


_UNIT_KEYS = f"""{UNITS}, named AS (SELECT source, span_id, n, {uuid5_sql("source || '#statement#' || block")} AS uuid FROM (SELECT source, span_id, count(*) AS n, string_agg(id::VARCHAR, '#' ORDER BY id) AS block FROM parts GROUP BY ALL))"""


@query("g8_unit_statements", f"WITH {_UNIT_KEYS} SELECT uuid, source, span_id, n FROM named")
def g8_units(spark, sf):
    return graph.span_statements(_units(spark, sf)[2])


@query("g8_unit_members", f"WITH {_UNIT_KEYS} SELECT {uuid5_sql("p.source || '#' || p.id")} AS src, uuid AS dst FROM parts p JOIN named k ON k.source = p.source AND k.span_id = p.span_id")
def g8_unit_members(spark, sf):
    m = _units(spark, sf)[2]
    return graph.span_statement_members(m, graph.span_statements(m))


@query("d1_estimate_tokens", "SELECT doc_id, length(coalesce(text, '')) // 4 + 1 AS tokens FROM documents")
def d1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", windows.estimate_tokens(F.col("text")).alias("tokens"))


@query("d2_lookahead_window", f"WITH {WEIGHED}, c AS (SELECT source, id AS cursor, e AS origin FROM sums WHERE id % 10 = 0) SELECT c.source, cursor, s.id FROM c JOIN sums s ON s.source = c.source AND s.id >= cursor WHERE s.id = cursor OR s.i - origin <= 2000")
def d2(spark, sf):
    n = nodes(spark, sf)
    return windows.lookahead_window(n, n.where("id % 10 = 0").select("source", F.col("id").alias("cursor")))


def _greedy(where: str, budget: int) -> str:
    return f"""WITH RECURSIVE {WEIGHED}, el AS (SELECT source, id, tokens, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM weighed WHERE {where}),
walk AS (
  SELECT source, id, k, tokens AS filled, 0 AS window_id FROM el WHERE k = 1 UNION ALL
  SELECT e.source, e.id, e.k, CASE WHEN filled + e.tokens > {budget} THEN e.tokens ELSE filled + e.tokens END, CASE WHEN filled + e.tokens > {budget} THEN window_id + 1 ELSE window_id END
  FROM walk w JOIN el e ON e.source = w.source AND e.k = w.k + 1
)"""


FIXED = _greedy(f"{strip_sql('content')} <> '' AND type <> 'image'", 600)


@query("d3_fixed_windows", FIXED + " SELECT source, id, window_id FROM walk")
def d3(spark, sf):
    return windows.fixed_windows(nodes(spark, sf))


CONTEXT_B = "SELECT a.source, a.id, string_agg(b.content, chr(10) || chr(10) ORDER BY b.id) AS context FROM sums a JOIN sums b ON a.source = b.source AND b.id < a.id AND a.e - b.e <= 400 GROUP BY ALL"
CONTEXT_A = "SELECT a.source, a.id, string_agg(b.content, chr(10) || chr(10) ORDER BY b.id) AS context FROM sums a JOIN sums b ON a.source = b.source AND b.id > a.id AND b.i - a.i <= 400 GROUP BY ALL"


@query("d4_context_before", f"WITH {WEIGHED} {CONTEXT_B}")
def d4(spark, sf):
    return windows.context_before(nodes(spark, sf))


@query("d5_context_after", f"WITH {WEIGHED} {CONTEXT_A}")
def d5(spark, sf):
    return windows.context_after(nodes(spark, sf))


D6 = FIXED + f""", edges AS (SELECT source, window_id, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM walk GROUP BY ALL), cb AS ({CONTEXT_B}), ca AS ({CONTEXT_A})
SELECT e.*, cb.context AS before, ca.context AS after FROM edges e LEFT JOIN cb ON cb.source = e.source AND cb.id = first_id LEFT JOIN ca ON ca.source = e.source AND ca.id = last_id"""


@query("d6_windows_with_context", D6)
def d6(spark, sf):
    return windows.windows_with_context(nodes(spark, sf))


@query("d7_tiled_windows", _greedy("true", 2000) + " SELECT source, id, window_id FROM walk")
def d7(spark, sf):
    return windows.tiled_windows(nodes(spark, sf))


@query("d8_context_around", f"WITH {WEIGHED}, f AS (SELECT source, count(*) AS fits FROM sums WHERE i <= 500 GROUP BY source), a AS (SELECT a.source, a.id, count(*) AS n_after FROM sums a JOIN sums b ON a.source = b.source AND b.id > a.id AND b.i - a.i <= 400 GROUP BY ALL) SELECT s.source, s.id, least(s.id, coalesce(fits, 0)) AS n_before, coalesce(n_after, 0) AS n_after FROM sums s LEFT JOIN f USING (source) LEFT JOIN a USING (source, id)")
def d8(spark, sf):
    return windows.context_around(nodes(spark, sf), 500, 400)


@query("d9_window_view", FIXED + " SELECT w.source, window_id, row_number() OVER (PARTITION BY w.source, window_id ORDER BY w.id) - 1 AS position, w.id AS node_id, type, content FROM walk w JOIN nodes n ON n.source = w.source AND n.id = w.id")
def d9(spark, sf):
    n = nodes(spark, sf)
    return windows.window_view(windows.fixed_windows(n), n)

