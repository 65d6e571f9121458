"""Digests of the ordered rows of a group, without a row, task or group that holds them all.

Rows are range-sorted by (key, order), so a large group lies in several
partitions. A task digests the small groups that it holds whole. Groups larger
than a block, and the first and last of a partition, which may go on elsewhere,
leave as compressed blocks in order; one more pass feeds the blocks of a group to
the digest, a block at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import materialize, shuffle_width

#: Bytes of a group's text that a task holds at most before it leaves as a block.
BLOCK_BYTES = 1 << 18

PARTS = pa.schema([("key", pa.string()), ("shard", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("digest", pa.string()), ("head", pa.binary()), ("coded", pa.binary())])
PARTS_SQL = "key string, shard int, block int, n long, digest string, head binary, coded binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _fold(algorithm: str, separator: bytes, block_bytes: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, head, value) sorted by key and order in; each key's digest, or its blocks."""
        shard = TaskContext.get().partitionId()
        key, head, block, begun, first = None, b"", 0, False, True
        values: list[bytes] = []
        size = 0
        rows: list[tuple] = []

        def leave() -> None:
            nonlocal values, size, block
            rows.append((key, shard, block, len(values), None, head, zlib.compress(separator.join(values), 1)))
            values, size, block = [], 0, block + 1

        for batch in batches:
            for k, h, value in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if not begun or k != key:
                    if begun and not first and not block:
                        rows.append((key, shard, 0, len(values), hashlib.new(algorithm, head + separator.join(values), usedforsecurity=False).hexdigest(), None, None))
                        values, size = [], 0
                    elif begun and values:
                        leave()
                    first, begun, key, head, block = not begun, True, k, h, 0
                values.append(value)
                size += len(value)
                if size >= block_bytes:
                    leave()
            if rows:
                yield _batch(rows, PARTS)
                rows.clear()
        if values:
            leave()
        if rows:
            yield _batch(rows, PARTS)

    return fold


def _finish(algorithm: str, separator: bytes):
    schema = pa.schema([("key", pa.string()), ("digest", pa.string()), ("n", pa.int64())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks (key, n, head, coded) sorted by key, shard and block in."""
        key, state, n = None, None, 0
        done: list[tuple] = []
        for batch in batches:
            for r in range(batch.num_rows):
                k, count, head, coded = (batch.column(c)[r].as_py() for c in range(4))
                if state is None or k != key:
                    if state is not None:
                        done.append((key, state.hexdigest(), n))
                    key, state, n = k, hashlib.new(algorithm, head, usedforsecurity=False), 0
                else:
                    state.update(separator)
                state.update(zlib.decompress(coded))
                n += count
            if done:
                yield _batch(done, schema)
                done.clear()
        if state is not None:
            yield _batch([(key, state.hexdigest(), n)], schema)

    return finish


def ordered_digest(rows: DataFrame, key: str, order: list[str], value: Column, algorithm: str = "sha256", separator: str = "", head: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, digest, n): hex digest of each key's head (binary, depends on the key alone) followed by its values in order, joined by the separator.

    `key` is a string column; rows without one are left out, a null value is an
    empty one. Rows equal in key and order must have equal values, or their order
    is not defined. Such digests are sequential: one task computes that of a large
    group, reads the group's values as compressed blocks and holds one of them.
    """
    sep = separator.encode()
    columns = {f"_o{i}": F.col(c) for i, c in enumerate(order)}
    one = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), (F.lit(b"") if head is None else head).alias("head"), F.coalesce(F.encode(value.cast("string"), "UTF-8"), F.lit(b"")).alias("value"),
        *(c.alias(n) for n, c in columns.items()), F.monotonically_increasing_id().alias("_tie"),
    )
    by, width = ["key", *columns, "_tie"], shuffle_width(rows.sparkSession)
    folded = one.repartitionByRange(width, *by).sortWithinPartitions(*by).select("key", "head", "value").mapInArrow(_fold(algorithm, sep, block_bytes), PARTS_SQL)
    parts = materialize(folded, "digest-parts")
    blocks = parts.where("coded is not null").repartition(width, "key").sortWithinPartitions("key", "shard", "block").select("key", "n", "head", "coded")
    whole = parts.where("coded is null").select("key", "digest", "n")
    return whole.unionByName(blocks.mapInArrow(_finish(algorithm, sep), "key string, digest string, n long"))
