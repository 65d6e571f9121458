"""A corpus pipeline: language ID, line dedup, near-duplicate removal, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's `docs`. All but the last return the
columns of `docs`, with n_chars the length of the text that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.language_id import UNDETERMINED, identify, train
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.ngram_join import jaccard_groups
from graphloom.llm.packing import pack_documents
from graphloom.llm.substring_dedup import dedup_substrings
from graphloom.scratch import materialize, scratch_root
from graphloom.tables import table

#: Ids of dropped documents up to this number (16 bytes each, with the key of their text) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: The language stage rejects what it predicts with a smaller score.
LANGUAGE_SCORE = 0.5
#: Bytes of an Arrow batch at most.
BATCH_BYTES = 2 << 20


def _lean(spark: SparkSession) -> None:
    """Keeps executors small over many stages, for this and later queries of the session.

    Buffers of Arrow batches and of the default Parquet codec lie outside the heap and
    stay with the executor: batches are bounded in bytes, tables compressed by a
    codec that works in the heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")


def _with_text(columns: list[str], row: str, text) -> list:
    """The columns of a row struct, with another text and its length."""
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return [changed[c].alias(c) if c in changed else F.col(f"{row}.`{c}`").alias(c) for c in columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text is predicted to be in one of the learned languages with a score of LANGUAGE_SCORE or more.

    Rejected: rows with a null text or one without a letter, and texts that no
    language is more likely than not for (scraps of a word or two, numbers,
    addresses). A null lang only keeps a row from being learned from; without any
    labelled row nothing can be predicted and no row is kept. Rows without id go.
    Repeated ids and rows are judged one by one. Other columns, of any name, and
    texts pass as they are. An empty table gives an empty result.
    """
    _lean(spark)
    kept = identify(docs, train(docs)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand in ten documents or more; every row with an id stays, with the text that is left (possibly empty).

    A row that loses no line keeps its text as it is, null too. Rows that share an
    id count as one document for the ten, and each is returned. Other columns pass;
    n_chars becomes the length of the text that is left. An empty table gives an
    empty result.
    """
    _lean(spark)
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select(*_with_text(docs.columns, "row", F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(F.col("kept"))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links connect, the one with the smallest id stays (of rows that share it, the one whose text has the smallest xxhash64).

    A null text or one without words is linked with nothing and stays. Rows with
    equal id and text are one document and stay or go together; rows that share
    an id only are judged one by one. Rows without id stay. Other columns pass.
    An empty table gives an empty result.
    """
    _lean(spark)
    gone = materialize(jaccard_groups(docs).where("not first").select("doc_id", "text_key").distinct(), "gone")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, (docs.doc_id == few.doc_id) & (key == few.text_key), "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of fifty words or more that a document with a smaller id has, all of a text if need be.

    Every row with an id stays; one that loses no word keeps its text as it is, null
    too. Rows that share an id are one document for the comparison, and each is
    returned with its own text. Other columns pass; n_chars becomes the length of
    the text that is left. An empty table gives an empty result.
    """
    _lean(spark)
    return dedup_substrings(docs, as_it_was=True).select(*_with_text(docs.columns, "rest", F.col("kept")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths of the documents that are left.

    A null or empty text is the closing id alone; rows without id go; repeated rows
    are packed each. Other columns do not matter. An empty table gives no pieces.
    """
    import public_tokenizers

    _lean(spark)
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Language identification and tokenization are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_root(spark)}/graphloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
