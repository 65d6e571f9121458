"""Incremental runs (2.M): new pages arrive, tables are upserted, replays change stamps only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import canonical, graph, stream, text
from graphloom.scratch import materialize
from graphloom.sources import io
from graphloom.streaming.stores import BucketStore

PAGE_SCHEMA = "source string, segment_index long, content string"


def append_results(*parts: DataFrame) -> DataFrame:
    """Results of concurrent workers put together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class NodeStore(BucketStore):
    """The vertex table, in buckets of stretches of pages: a batch rewrites the buckets of its pages."""

    def __init__(self, spark: SparkSession, root: str, name: str = "Node", buckets: int = 64, stretch: int = 256):
        super().__init__(spark, root, name, F.pmod(F.xxhash64("source", F.floor(F.col("segment_index") / stretch)), F.lit(buckets)))

    def upsert(self, rows: DataFrame) -> list[int]:
        """Vertices (uuid, source, segment_index, ...) inserted or updated by uuid; the buckets that were written."""
        return self.merge(rows, lambda current, new: graph.upsert_vertices(graph.empty_like(new) if current is None else current, new, F.current_timestamp()))


def page_nodes(pages: DataFrame) -> DataFrame:
    """Vertices of arriving pages, keyed by page and place so that a page replaces itself."""
    blocks = text.segment_blocks(pages).withColumn("type", text.block_type(F.col("content")))
    key = F.concat(F.col("source"), F.lit("#"), F.col("segment_index").cast("string"), F.lit("#"), F.col("pos").cast("string"))
    return blocks.select(graph.keys.uuid5(key).alias("uuid"), "source", "segment_index", "pos", "type", "content")


def ingest_stream(spark: SparkSession, folder: str, store: NodeStore, checkpoint: str):
    """Starts a query that upserts each batch of page files (Parquet) into the store; replays are idempotent by key."""
    pages = spark.readStream.schema(PAGE_SCHEMA).parquet(folder)
    return pages.writeStream.foreachBatch(lambda df, _: store.upsert(page_nodes(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_canonicalize(batch: DataFrame, hubs: DataFrame, threshold: float = canonical.THRESHOLD, cut: float = canonical.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(clusters of the batch's spokes, hubs with those added that aligned with none)."""
    found = materialize(canonical.canonicalize(batch, hubs, threshold, cut), "canonical")
    fresh = found.where("hub_uuid is null").select(graph.keys.uuid5(F.concat(F.lit("hub#"), F.col("cluster_id").cast("string"))).alias("hub_uuid"), F.col("centroid").alias("embedding"))
    return found, append_results(hubs.select("hub_uuid", F.col("embedding").cast("array<double>").alias("embedding")), fresh)


def persist_all(tables: dict[str, DataFrame], root: str, version: int = 0) -> None:
    """Writes all tables, vertices before edges; running again gives the same tables."""
    for name in sorted(tables, key=lambda n: (n.isupper(), n)):
        io.graph_write(tables[name], root, name, version)


__all__ = ["NodeStore", "append_results", "incremental_canonicalize", "ingest_stream", "page_nodes", "persist_all", "stream"]
