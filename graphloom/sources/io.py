"""Sources and sinks (2.A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import keys
from graphloom.operators.text import strip

PAGES = "pages ARRAY<STRUCT<markdown: STRING, footer: STRING, images: ARRAY<STRUCT<id: STRING, image_base64: STRING>>>>"
FIGURE = r"!\[[^\]]*\]\(([^)]*)\)"


def read_ocr_pages(responses: DataFrame) -> DataFrame:
    """Segments (source, segment_index, markdown, footer, images) of responses (source, pages); 0-based in order of the response."""
    return responses.select("source", F.posexplode("pages").alias("segment_index", "p")).select("source", "segment_index", "p.markdown", "p.footer", "p.images")


def read_ocr_json(spark: SparkSession, path: str, source: str | None = None, image_bytes: bool = False) -> DataFrame:
    """Segments of response files: one file a response (`source` given), or lines of responses that name their source.

    Images' encoded bytes, most of such files, are parsed only with `image_bytes`.
    """
    schema = PAGES if image_bytes else PAGES.replace(", image_base64: STRING", "")
    if source is not None:
        return read_ocr_pages(spark.read.schema(schema).json(path, multiLine=True).withColumn("source", F.lit(source)))
    return read_ocr_pages(spark.read.schema(f"source STRING, {schema}").json(path))


def figure_order(markdown: Column, known: Column) -> Column:
    """Known figure ids in the order in which the text first mentions them."""
    return F.array_distinct(F.filter(F.regexp_extract_all(markdown, F.lit(FIGURE), F.lit(1)), lambda i: F.array_contains(known, i)))


def rewrite_figure_refs(markdown: Column, known: Column) -> Column:
    """Each ![alt](id) of a known id becomes ![N](), N its 1-based place in order of first mention; other links stay."""
    order = figure_order(markdown, known)
    return F.aggregate(F.transform(order, lambda i, n: F.struct(i.alias("i"), (n + 1).alias("n"))), markdown, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"!\[[^\]]*\]\(\Q"), x.i, F.lit(r"\E\)")), F.concat(F.lit("!["), x.n.cast("string"), F.lit("]()"))))


def append_footer(markdown: Column, footer: Column) -> Column:
    """Body, blank line, stripped footer; a blank footer leaves the body."""
    stripped = strip(F.coalesce(footer, F.lit("")))
    return F.when(stripped == "", markdown).otherwise(F.concat(F.regexp_replace(markdown, r"\s+$", ""), F.lit("\n\n"), stripped))


def select_pages(segments: DataFrame, pages: list[int]) -> DataFrame:
    """Only the given 0-based pages, numbered densely again; the list bounds what the ranking sees."""
    chosen = segments.where(F.col("segment_index").isin(pages))
    return chosen.withColumn("segment_index", F.row_number().over(Window.partitionBy("source").orderBy("segment_index")) - 1)


def pictures(segments: DataFrame) -> DataFrame:
    """(source, segment_index, index from 1, image_id) of each figure; those not mentioned come after those that are."""
    order = figure_order(F.col("markdown"), F.col("images.id"))
    rows = segments.withColumn("order", order).select("source", "segment_index", "order", F.posexplode("images.id").alias("place", "image_id"))
    rank = F.array_position("order", F.col("image_id"))
    w = Window.partitionBy("source", "segment_index").orderBy(F.when(rank == 0, None).otherwise(rank).asc_nulls_last(), "place")
    return rows.select("source", "segment_index", F.row_number().over(w).alias("index"), "image_id")


def read_text_documents(documents: DataFrame, source: str = "source", index: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(F.col(source).alias("source"), F.col(index).alias("segment_index"), F.col(text).alias("content"), F.lit(None).cast("string").alias("image_path"))


def source_table(books: DataFrame) -> DataFrame:
    """One row for each book with its metadata; the computed uuid and key win over columns of these names."""
    return books.drop("uuid", "key").withColumns({"uuid": keys.source_key(F.col("source")), "key": F.col("source")})


def write_examples(decisions: DataFrame, path: str, module: str, run_id: str, inputs: list[str], outputs: list[str]) -> None:
    """Appends a JSON record for each decision under its module and run."""
    rows = decisions.select(F.lit(module).alias("module"), F.lit(run_id).alias("run_id"), F.struct(*inputs).alias("inputs"), F.struct(*outputs).alias("outputs"))
    rows.write.partitionBy("module", "run_id").mode("append").json(path)


def read_examples(spark: SparkSession, path: str, module: str, schema: str, run: str | None = None) -> DataFrame:
    """Records of a module: of the named run, else of the last run in sort order; none recorded gives none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], f"{schema}, module string, run_id string")
    rows = spark.read.schema(f"{schema}, module string, run_id string").json(path).where(F.col("module") == module)
    last = run if run is not None else rows.agg(F.max("run_id")).first()[0]
    return rows.where(F.col("run_id") == last)


def read_gold_set(spark: SparkSession, manifest: str, folder: str, schema: str) -> DataFrame:
    """Records of a manifest joined to the text files that they name (`transcription`, `corrected`: file names)."""
    records = spark.read.schema(f"records ARRAY<STRUCT<{schema}>>").json(manifest, multiLine=True).select(F.explode("records").alias("r")).select("r.*")
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value"))
    out = records
    for c in ("transcription", "corrected"):
        out = out.join(texts.select(F.col("file").alias(c), F.col("value").alias(f"{c}_text")), c, "left")
    return out


def _part(source, parts: int):
    return F.pmod(F.xxhash64(source), F.lit(parts)).cast("int")


def graph_write(table: DataFrame, root: str, name: str, version: int = 0, parts: int = 0) -> None:
    """Writes a vertex or edge table; with `parts` in so many folders by book (`source`), each book in one."""
    path = f"{root}/{name}/v{version}"
    if parts:
        table.withColumn("_part", _part(F.col("source"), parts)).repartition("_part", "source").write.mode("overwrite").partitionBy("_part").parquet(path)
    else:
        table.write.mode("overwrite").parquet(path)


def graph_read(spark: SparkSession, root: str, name: str, version: int = 0, parts: int = 0, source: str | None = None) -> DataFrame:
    """Reads a table; with the `parts` that it was written with, a `source` is read from its folder only."""
    rows = spark.read.parquet(f"{root}/{name}/v{version}")
    if source is not None:
        rows = rows.where(F.col("source") == source)
        if parts:
            at = spark.range(1).select(_part(F.lit(source), parts).alias("p")).first().p
            rows = rows.where(F.col("_part") == at)
    return rows.drop("_part") if parts else rows
