"""What the operators of this subpackage share: bounded chunks, word hashing, blobs."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that a task works on at a time; one longer text makes a chunk alone.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch, and of a batch of the Parquet reader, at most, as texts are long.
BATCH_ROWS, SCAN_ROWS = 2000, 512
#: Bytes of an Arrow batch at most, where buffers are to be lean.
BATCH_BYTES = 2 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def bound_batches(df: DataFrame) -> None:
    """Lowers the session's rows of a batch to BATCH_ROWS and SCAN_ROWS, for this and later queries."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        if not 0 < int(conf.get(key)) <= most:
            conf.set(key, str(most))


def lean_buffers(df: DataFrame) -> None:
    """Bounds the session's Arrow batches in bytes and compresses tables in the heap, for this and later queries: buffers outside it stay with the executor."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    df.sparkSession.conf.set("spark.sql.parquet.compression.codec", "zstd")


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside the next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two hashes."""
    return mix(a * GOLDEN + mix(b + GOLDEN))


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes (SipHash) of byte strings."""
    if not words:
        return np.empty(0, np.uint64)
    arr = np.empty(len(words), dtype=object)
    arr[:] = words
    return pd.util.hash_array(arr, categorize=False)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    if len(x) < 2:
        return x.copy()
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values and how often each occurs."""
    if not len(x):
        return x, np.empty(0, np.int64)
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x)))


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts) of consecutive rows, about `limit` bytes at a time; a null text is empty.

    The first column holds the ids, the second the texts.
    """
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
    del ids, texts
    release()


def keyed_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list, list]]:
    """As `text_chunks` with the third column besides: (ids, texts, third)."""
    ids: list = []
    texts: list = []
    third: list = []
    size = 0
    for batch in batches:
        for i, t, x in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            third.append(x)
            size += len(t)
            if size >= limit:
                yield ids, texts, third
                ids, texts, third, size = [], [], [], 0
    if ids:
        yield ids, texts, third
    del ids, texts, third
    release()


def _texts(column: pa.Array) -> Iterator[str]:
    for start in range(0, len(column), 256):
        for x in column.slice(start, 256).to_pylist():
            yield x or ""


def doc_words(texts: list[str], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, one after another, and where each text's words start (one more entry: the end).

    Words are runs of bytes other than space and \\t to \\r; `lower` lower-cases A-Z only.
    """
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for k, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass")
        words += b.lower().split() if lower else b.split()
        starts[k + 1] = len(words)
    return words, starts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[k] .. starts[k]+lengths[k]-1 of all k, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def windows_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive entries of h (by doubling, exact on equality)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, done, out, at = h.astype(np.uint64), 1, None, 0
    while True:
        if width & done:
            part = power[at : at + n]
            out = part.copy() if out is None else combine(out, part)
            at += done
        if done * 2 > width:
            return mix(out + np.uint64(width))
        power = combine(power[:-done], power[done:])
        done *= 2
