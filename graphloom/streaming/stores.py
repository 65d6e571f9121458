"""Tables that batches change in place of rewriting them: buckets, versions and a manifest.

A table lies in buckets of its key. A merge reads the buckets that its rows fall
into, writes these as a new version and then publishes a manifest that names the
version of each bucket. Readers use the last manifest, so they see whole merges
only; a merge that fails before it publishes leaves nothing that is read. The
versions that the last two manifests do not name are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import similarity
from graphloom.operators.components import connected_components
from graphloom.scratch import discard, materialize

BUCKETS = 64


class BucketStore:
    """One table. `bucket` gives a row's bucket number, which must depend on its key alone; there is one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, name: str, bucket: Column):
        self.spark, self.root, self.bucket = spark, f"{root}/{name}", bucket

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._fs(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict[int, int]:
        """Bucket to version, of the last manifest or of the one with this number."""
        known = self._manifests()
        if not known:
            return {}
        text = self.spark.read.text(f"{self.root}/manifests/{known[-1] if number is None else number}.json", wholetext=True).first().value
        return {int(b): v for b, v in json.loads(text).items()}

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or only some of its buckets; None if there is nothing."""
        found = {b: v for b, v in self.manifest().items() if buckets is None or b in buckets}
        if not found:
            return None
        paths = [f"{self.root}/data/_store_version={v}/_store_bucket={b}" for b, v in found.items()]
        return self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", "true").parquet(*paths).drop("_store_version", "_store_bucket")

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets of `rows` by combine(their present rows or None, rows); the buckets that were written."""
        rows = materialize(rows, "batch")
        touched = sorted(r.b for r in rows.select(self.bucket.cast("int").alias("b")).distinct().collect())
        if not touched:
            return []
        known, old = self._manifests(), self.manifest()
        number = (known[-1] if known else -1) + 1
        combine(self.read(touched), rows).withColumn("_store_bucket", self.bucket.cast("int")).repartition("_store_bucket").write.partitionBy("_store_bucket").mode("overwrite").parquet(f"{self.root}/data/_store_version={number}")
        self._publish(number, old | dict.fromkeys(touched, number))
        discard(rows)
        return touched

    def _publish(self, number: int, named: dict[int, int]) -> None:
        draft, fs = self._fs(f"{self.root}/manifests/{number}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({str(b): v for b, v in named.items()}).encode()))
        out.close()
        fs.rename(draft, self._fs(f"{self.root}/manifests/{number}.json")[0])
        last = self._manifests()[-2:]
        used = {(v, b) for n in last for b, v in self.manifest(n).items()}
        for n in self._manifests()[:-2]:
            fs.delete(self._fs(f"{self.root}/manifests/{n}.json")[0], False)
        for version in self._names("data"):
            v = int(version.partition("=")[2])
            for b in (int(n.partition("=")[2]) for n in self._names(f"data/{version}") if n.startswith("_store_bucket=")):
                if (v, b) not in used and v <= number:
                    fs.delete(self._fs(f"{self.root}/data/{version}/_store_bucket={b}")[0], True)


def _by(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def replace_rows(key: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """New rows instead of present ones with their keys."""

    def combine(current: DataFrame | None, rows: DataFrame) -> DataFrame:
        return rows if current is None else current.join(rows.select(key), key, "left_anti").unionByName(rows)

    return combine


class ComponentStore:
    """Connected components under insertion of edges and vertices.

    A vertex keeps the root that it was added with, for good; roots carry the
    component that they are now in. A batch looks up the vertices of its edges,
    joins the few components that meet, and rewrites the roots of those only.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.vertices = BucketStore(spark, root, "vertices", _by("vertex", buckets))
        self.roots = BucketStore(spark, root, "roots", _by("root", buckets))

    def labels(self) -> DataFrame | None:
        """(vertex, component): component is the smallest vertex that can be reached."""
        vertices = self.vertices.read()
        return None if vertices is None else vertices.join(self.roots.read(), "root").select("vertex", "component")

    def add(self, edges: DataFrame, vertices: DataFrame) -> None:
        """Adds edges (two columns) and vertices (one); those that are there already change nothing."""
        a, b = edges.columns[:2]
        pairs = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct(), "new-edges")  # a loop brings its vertex
        ends = pairs.select(F.col("a").alias("vertex")).unionByName(pairs.select(F.col("b").alias("vertex"))).unionByName(vertices.select(F.col(vertices.columns[0]).alias("vertex")).where("vertex is not null")).distinct()
        touched = [r.b for r in ends.select(self.vertices.bucket.cast("int").alias("b")).distinct().collect()]
        known = self.vertices.read(touched)
        if known is None:
            met = ends.withColumn("label", F.col("vertex")).withColumn("fresh", F.lit(True))
        else:
            old = ends.join(known, "vertex", "left").join(self.roots.read(), "root", "left")
            met = old.select("vertex", F.coalesce("component", "vertex").alias("label"), F.col("root").isNull().alias("fresh"))
        met = materialize(met, "met-vertices")
        side = lambda c: met.select(F.col("vertex").alias(c), F.col("label").alias(f"l{c}"))
        links = pairs.join(side("a"), "a").join(side("b"), "b").where("la <> lb").select("la", "lb")
        joined = materialize(connected_components(links).select(F.col("vertex").alias("label"), "component").where("label <> component"), "joined-labels")
        fresh = met.where("fresh").select("vertex", F.col("vertex").alias("root"))
        self.vertices.merge(fresh, replace_rows("vertex"))
        changed = fresh.select("root", F.col("root").alias("component")).join(joined.select(F.col("label").alias("component"), F.col("component").alias("to")), "component", "left").select("root", F.coalesce("to", "component").alias("component"))
        present = self.roots.read()
        if present is not None:
            moved = present.join(joined.select(F.col("label").alias("component"), F.col("component").alias("to")), "component").select("root", F.col("to").alias("component"))
            changed = moved.unionByName(changed.join(present, "root", "left_anti"))
        self.roots.merge(changed, replace_rows("root"))
        discard(pairs, met, joined)


class ClusterStore:
    """Clusters of vectors that arrive in batches: components of the graph of similar pairs.

    A batch's vectors are compared with each other and with those that are there,
    never the latter among themselves.
    """

    def __init__(self, spark: SparkSession, root: str, threshold: float, buckets: int = BUCKETS):
        self.threshold = threshold
        self.vectors = BucketStore(spark, root, "vectors", _by("id", buckets))
        self.components = ComponentStore(spark, root, buckets)

    def add(self, batch: DataFrame) -> None:
        """Adds rows (id long, embedding); an id that is there already keeps its old links as well."""
        batch = materialize(batch.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
        pairs = similarity.self_pairs(batch, self.threshold).where("a is not null").select("a", "b")
        present = self.vectors.read()
        if present is not None:
            pairs = pairs.unionByName(similarity.pairs_above(batch, present, self.threshold, "id", "id").where("a is not null").select("a", "b"))
        self.components.add(pairs, batch.select("id"))
        self.vectors.merge(batch, replace_rows("id"))
        discard(batch)

    def labels(self) -> DataFrame | None:
        return self.components.labels()


def cluster_stream(spark: SparkSession, folder: str, store: ClusterStore, checkpoint: str, files: int = 1):
    """Starts a query that adds files of vectors (Parquet: id long, embedding), `files` of them a batch, to the store; replays change nothing."""
    rows = spark.readStream.schema("id long, embedding array<double>").option("maxFilesPerTrigger", files).parquet(folder)
    return rows.writeStream.foreachBatch(lambda df, _: store.add(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
