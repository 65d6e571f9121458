"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary has a white-space marker after another character
(checked when the model is loaded), so merges never cross the border before a
run of markers. Each text is cut at those borders into marked words.

A first pass over all texts counts in how many stretches of text each distinct
marked word stands. Those of several stretches form the table: each is segmented
once, as a Spark job, and the table (its size is bounded) goes to all tasks. The
second pass joins ids and decoded text back by position. A word that only one
stretch has, one longer than LONG_WORD, and what a full table cannot hold is
segmented where it stands; a worker remembers such words, up to OWN_WORDS. The
result is the same whichever way a word goes.

No job moves a row for each word of the corpus: the first pass shuffles the
distinct words of each task, the second nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ragged, release, text_chunks
from graphloom.llm.packing import _Memo
from graphloom.scratch import discard, materialize

MARK = "▁"
MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct marked words of the table at most, and other ones that a worker remembers at most.
TABLE_WORDS, OWN_WORDS = 200_000, 400_000
#: Characters of a word in the table at most: with TABLE_WORDS, the bound of what is sent to every task.
LONG_WORD = 64
#: Bytes of text of a stretch.
STRETCH_BYTES = 4 << 20

TABLE = pa.schema([("word", pa.string()), ("ids", pa.binary()), ("decoded", pa.string())])
CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def marked_words(text: str) -> list[str]:
    return MARKED.findall(MARK + text.replace(" ", MARK)) if text else []


class ChunkCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
        probe = sp.encode("a  b ", out_type=str)
        self.whole |= "".join(probe) != f"{MARK}a{MARK}{MARK}b{MARK}"  # white space is kept, one marker is put before
        self.know(None, None)

    def know(self, name, table: pa.Table | None):
        """Takes the words, ids and decoded texts of a table (none: an empty one)."""
        words, ids, decoded = ([], [], []) if table is None else (table.column(c).to_pylist() for c in TABLE.names)
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        self.name = name
        self.known = dict(zip(words, range(len(words)), strict=True)), np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(ids), "<u4"), decoded
        self._reset()

    def _reset(self):
        """Forgets all words but the table's."""
        places, self.starts, self.lengths, self.pool, decoded = self.known
        self.memo, self.texts = _Memo(), list(decoded)
        self.memo.update(places)
        self.most = len(places) + OWN_WORDS

    def segment(self, words: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids of marked words, and what they decode to (each marker a space)."""
        ids = self.sp.encode([w[1:].replace(MARK, " ") for w in words], num_threads=1)
        alone = self.sp.piece_to_id(MARK)
        ids = [x or [alone] for x in ids]
        return ids, [" " + t for t in self.sp.decode(ids)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """(ids with begin and end, decoded text) of each text."""
        begin, end = self.sp.bos_id(), self.sp.eos_id()
        if self.whole:
            every = [[begin, *x, end] for x in self.sp.encode(texts, num_threads=1)]
            return [(np.array(x, np.uint32), t) for x, t in zip(every, self.sp.decode(every), strict=True)]
        if len(self.memo) > self.most:
            self._reset()
        places: list[int] = []
        ends = [0]
        for t in texts:
            places.extend(map(self.memo.__getitem__, marked_words(t)))
            ends.append(len(places))
        if self.memo.new:
            ids, decoded = self.segment(self.memo.new)
            lengths = np.array([len(x) for x in ids], np.int64)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, np.array([i for x in ids for i in x], np.uint32)])
            self.texts += decoded
            self.memo.new = []
        at = np.array(places, np.int64)
        lengths = self.lengths[at]
        flat = self.pool[ragged(self.starts[at], lengths)]
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            body = flat[cuts[a] : cuts[b]]
            ids = np.empty(len(body) + 2, np.uint32)
            ids[0], ids[-1], ids[1:-1] = begin, end, body
            out.append((ids, "".join(map(self.texts.__getitem__, places[a:b]))[1:]))
        return out


_codecs: dict[str, ChunkCodec] = {}


def codec(path: str, name: str | None = None, table: Broadcast | None = None) -> ChunkCodec:
    """The worker's codec for a model file, kept between tasks, with the table of that name."""
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    c = _codecs[path]
    if name != c.name:
        c.know(name, table.value if table is not None else None)
    return c


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def chunk_table(rows: DataFrame, model_path: str, stretch_bytes: int = STRETCH_BYTES, table_words: int = TABLE_WORDS) -> DataFrame:
    """(word, ids, decoded) of the marked words found in the most stretches of all texts, as a written table.

    `rows` holds an id and a text. A word is in the table if it has at most
    LONG_WORD characters and stands in at least two stretches, or as many more as
    leave table_words words. Which words these are depends on how the texts are
    dealt over tasks, what texts encode to does not.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = codec(model_path).whole
        for _, texts in text_chunks(batches, stretch_bytes):
            found = [] if whole else [w for w in set(chain.from_iterable(map(marked_words, texts))) if len(w) <= LONG_WORD]
            yield _batch(pa.schema([("word", pa.string())]), found)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids, decoded = c.segment(words)
            yield _batch(TABLE, words, [np.array(x, "<u4").tobytes() for x in ids], decoded)
        release()

    counts = materialize(rows.mapInArrow(find, "word string").groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "chunk-counts")
    bucket = F.floor(F.log2("n") * 16).alias("bucket")  # a thousand of them at most
    cut, words = None, 0
    for r in counts.groupBy(bucket).count().orderBy(F.desc("bucket")).collect():
        words += r["count"]
        if words > table_words:
            break
        cut = r.bucket
    often = counts.where(bucket >= cut if cut is not None else F.lit(False)).select("word")
    out = materialize(often.mapInArrow(segment, "word string, ids binary, decoded string"), "chunk-table")
    discard(counts)
    return out


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", stretch_bytes: int = STRETCH_BYTES, table_words: int = TABLE_WORDS
) -> DataFrame:
    """One row for each row of `docs`: doc_id, ids (little-endian uint32, with begin and end), decoded.

    A null text counts as empty and has begin and end only. A row without id
    takes no part; a repeated row is encoded again. Other columns are ignored. A
    long text is read whole in one task. An empty table gives an empty result.
    `docs` is read twice: for the table of distinct chunks, and to encode.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    known = chunk_table(rows, model_path, stretch_bytes, table_words)
    name, table = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(known.toArrow())
    discard(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, name, table)
        for ids, texts in text_chunks(batches, 2 << 20):
            coded = c.encode(texts)
            yield _batch(CODED, ids, [x.astype("<u4").tobytes() for x, _ in coded], [t for _, t in coded])

    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")
