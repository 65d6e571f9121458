"""Queries that write tables to the shared folder and read them again (2.A, 2.G, 2.M)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.plans import canon
from graphloom.plans.base import BLOCKS, NODES, nodes, pages, query, uuid5_sql
from graphloom.plans.documents import _responses
from graphloom.scratch import scratch_root
from graphloom.sources import io
from graphloom.streaming import incremental, stores
from graphloom.tables import table


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


NODE_KEY = uuid5_sql("source || '#' || id")


def _recorded(spark, sf) -> str:
    """Two runs of examples of each document's language; the second has its upper case."""
    path = _folder(spark, "examples")
    d = table(spark, sf, "documents")
    for run, lang in (("r1", F.col("lang")), ("r2", F.upper("lang"))):
        io.write_examples(d.select("doc_id", "text", lang.alias("lang")), path, "language", run, ["doc_id", "text"], ["lang"])
    return path


EXAMPLE = "inputs struct<doc_id: long, text: string>, outputs struct<lang: string>"


@query("a8_write_examples", "SELECT 'r1' AS run_id, doc_id, md5(text) AS text, lang FROM documents UNION ALL SELECT 'r2', doc_id, md5(text), upper(lang) FROM documents")
def a8(spark, sf):
    path, out = _recorded(spark, sf), None
    for run in ("r1", "r2"):
        one = io.read_examples(spark, path, "language", EXAMPLE, run).select("run_id", "inputs.doc_id", F.md5("inputs.text").alias("text"), "outputs.lang")
        out = one if out is None else out.unionByName(one)
    return out


@query("a9_read_examples", "SELECT 'r2' AS run_id, doc_id, upper(lang) AS lang FROM documents")
def a9(spark, sf):
    return io.read_examples(spark, _recorded(spark, sf), "language", EXAMPLE).select("run_id", "inputs.doc_id", "outputs.lang")


@query("a11_graph_tables", f"WITH {NODES} SELECT {NODE_KEY} AS uuid, source, type, id AS index FROM nodes")
def a11(spark, sf):
    root = _folder(spark, "graph")
    io.graph_write(graph.nodes(nodes(spark, sf)), root, "Node")
    return io.graph_read(spark, root, "Node").select("uuid", "source", "type", "index")


@query("a11_graph_by_book", f"WITH {NODES} SELECT source, count(*) AS n, min(content) AS first FROM nodes GROUP BY source")
def a11_books(spark, sf):
    """The node table, in folders by book; each book is read on its own."""
    root = _folder(spark, "graph")
    io.graph_write(graph.nodes(nodes(spark, sf)), root, "Node", parts=16)
    out = None
    for book in sorted(r.source for r in table(spark, sf, "documents").select("source").distinct().collect()):
        one = io.graph_read(spark, root, "Node", parts=16, source=book).groupBy("source").agg(F.count("*").alias("n"), F.min("content").alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a1_read_ocr_json", "SELECT (page_id // 10)::VARCHAR AS source, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS segment_index, html AS markdown, url AS footer, 'img-' || page_id AS image FROM pages")
def a1_json(spark, sf):
    """Responses written as JSON lines, image bytes and all, and read without these."""
    path = _folder(spark, "responses")
    filled = lambda p: p.withField("images", F.transform(p.images, lambda i: i.withField("image_base64", F.base64(F.encode(p.markdown, "UTF-8")))))
    _responses(spark, sf).withColumn("pages", F.transform("pages", filled)).write.json(path)
    return io.read_ocr_json(spark, path).select("source", "segment_index", "markdown", "footer", F.col("images")[0].id.alias("image"))


@query("g24_persist_all", f"WITH {NODES} SELECT 'Node' AS name, {NODE_KEY} AS src, NULL AS dst FROM nodes UNION ALL SELECT 'HEAD', {uuid5_sql('source')}, {NODE_KEY} FROM nodes WHERE id = 0 UNION ALL SELECT 'NEXT', {NODE_KEY}, {uuid5_sql("source || '#' || (id + 1)")} FROM nodes n WHERE EXISTS (SELECT 1 FROM nodes m WHERE m.source = n.source AND m.id = n.id + 1)")
def g24(spark, sf):
    """All tables of the stream, written twice and read again."""
    root, n = _folder(spark, "graph"), nodes(spark, sf)
    vertices = graph.nodes(n)
    tables = {"NEXT": graph.next_edges(n), "HEAD": graph.head_edges(vertices), "Node": vertices}
    for _ in range(2):
        incremental.persist_all(tables, root)
    read = {name: io.graph_read(spark, root, name) for name in tables}
    read["Node"] = read["Node"].select(F.col("uuid").alias("src"), F.lit(None).cast("string").alias("dst"))
    out = None
    for name, t in read.items():
        one = t.select(F.lit(name).alias("name"), "src", "dst")
        out = one if out is None else out.unionByName(one)
    return out


@query("m1_ingest_stream", f"WITH {BLOCKS} SELECT {uuid5_sql("source || '#' || segment_index || '#' || pos")} AS uuid, source, segment_index, pos, type, content FROM blocks")
def m1(spark, sf):
    """Pages arrive in two files and are then all replayed."""
    root = _folder(spark, "ingest")
    p = pages(spark, sf).select("source", F.col("segment_index").cast("long").alias("segment_index"), "content")
    p.repartition(2, "segment_index").write.parquet(f"{root}/pages")
    store = incremental.NodeStore(spark, f"{root}/graph")
    for run in range(2):
        incremental.ingest_stream(spark, f"{root}/pages", store, f"{root}/checkpoint{run}").awaitTermination()
    return store.read().select("uuid", "source", "segment_index", "pos", "type", "content")


@query("m2_incremental_clusters", f"WITH {canon.COMPONENTS} SELECT * FROM comp")
def m2_clusters(spark, sf):
    """Vectors arrive in three files, one a batch."""
    root = _folder(spark, "clusters")
    table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).repartition(3, "id").write.parquet(f"{root}/arriving")
    store = stores.ClusterStore(spark, f"{root}/store", canon.T, buckets=8)
    stores.cluster_stream(spark, f"{root}/arriving", store, f"{root}/checkpoint").awaitTermination()
    return store.labels()
