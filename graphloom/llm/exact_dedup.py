"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Senders. Each task hashes its texts to short fingerprints, sorts the distinct
   ones, cuts them into ranges by owner and codes each range as Golomb-Rice gaps
   (a few bytes a fingerprint). It writes one ledger row for each range: the
   coded fingerprints, and beside them the ids and digests of the rows.
2. Owners read only the coded column, find fingerprints that more than one
   sender has, and answer each range with a bitmap.
3. Rows whose bit is set, or that repeat within their sender, are suspects. Only
   their texts are shuffled, grouped by the bytes themselves.

A sender sends a fingerprint once however often it occurs, so an owner gets a
row from each sender at most for a text that holds a third of the corpus, and
the verification aggregates on the map side before it shuffles.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import discard, materialize, shuffle_width

#: Bits of a fingerprint. False hits only add suspects, whose bytes are compared.
FINGERPRINT_BITS = 40
#: Rows that a sender holds at a time, and fingerprints that an owner gets on average at most.
SENDER_ROWS, OWNER_ROWS = 200_000, 2_000_000
#: Suspects up to this number (16 bytes each) are broadcast to fetch their texts; beyond it the fetch is a shuffle join.
BROADCAST_SUSPECTS = 2_000_000

LEDGER = "sender string, owner int, n int, k int, coded binary, ids array<long>, slots array<int>, repeated array<boolean>, shas array<string>"


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct unsigned values as Rice-coded gaps: (k, unary part then k-bit remainders)."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69))))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    head = np.packbits(unary).tobytes()
    return k, len(head).to_bytes(4, "little") + head + np.packbits(bits.ravel()).tobytes()


def golomb_decode(n: int, k: int, coded: bytes) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    cut = 4 + int.from_bytes(coded[:4], "little")
    unary = np.unpackbits(np.frombuffer(coded[4:cut], np.uint8))
    ends = np.flatnonzero(unary == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(coded[cut:], np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
    gaps = (q.astype(np.uint64) << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= SENDER_ROWS:
                yield from _ledger(held, owners)
                held, rows = [], 0
        if rows:
            yield from _ledger(held, owners)

    return send


def _ledger(batches: list[pa.RecordBatch], owners: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(batches)
    ids = t.column(0).to_numpy()
    fp = t.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - FINGERPRINT_BITS)
    shas = t.column(2).combine_chunks()
    values, slot, count = np.unique(fp, return_inverse=True, return_counts=True)
    owner = ((values * np.uint64(owners)) >> np.uint64(FINGERPRINT_BITS)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    firsts = np.searchsorted(owner, np.arange(owners + 1))
    row_ends = np.concatenate([[0], np.cumsum(count)])
    sender = uuid.uuid4().hex
    out = []
    for o in np.unique(owner):
        a, b = firsts[o], firsts[o + 1]
        rows = order[row_ends[a] : row_ends[b]]
        k, coded = golomb_encode(values[a:b])
        out.append({"sender": sender, "owner": int(o), "n": int(b - a), "k": k, "coded": coded, "ids": ids[rows], "slots": (slot[rows] - a).astype(np.int32), "repeated": count[slot[rows]] > 1, "shas": shas.take(pa.array(rows)).to_pylist()})
    schema = pa.schema([("sender", pa.string()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("coded", pa.binary()), ("ids", pa.list_(pa.int64())), ("slots", pa.list_(pa.int32())), ("repeated", pa.list_(pa.bool_())), ("shas", pa.list_(pa.string()))])
    for start in range(0, len(out), 64):
        yield pa.RecordBatch.from_pylist(out[start : start + 64], schema=schema)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner: bitmaps of the fingerprints that more than one sender has."""
    lists = [golomb_decode(n, k, c) for n, k, c in zip(pdf.n, pdf.k, pdf.coded, strict=True)]
    values, count = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[count > 1]
    return pd.DataFrame({"sender": pdf.sender, "owner": pdf.owner, "bitmap": [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]})


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sender that has its bitmaps: each row with whether it is a suspect."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            ids, slots, repeated, shas, bitmap = (row.column(c).flatten() if c < 4 else row.column(c)[0].as_py() for c in range(5))
            bits = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)
            suspect = bits[slots.to_numpy()] | repeated.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([ids, shas, pa.array(suspect)], names=["id", "text_sha256", "suspect"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; of equal texts the largest id is kept.
    A null text counts as empty. A row without id takes no part and is not
    returned. Rows that repeat an id with the same text count in group_size,
    and each is returned with the same values. Texts of any length are hashed where
    they are read; only suspects' texts are moved, one row each. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    if owners is None:
        owners = max(shuffle_width(spark), -(-base.count() // OWNER_ROWS))
    ledger = materialize(
        base.select("id", F.xxhash64("text").alias("fp"), F.sha2("text", 256).alias("sha")).mapInArrow(_send(owners), LEDGER), "ledger"
    )
    bitmaps = ledger.select("sender", "owner", "n", "k", "coded").groupBy("owner").applyInPandas(_answer, "sender string, owner int, bitmap binary")
    marked = materialize(
        ledger.join(bitmaps, ["sender", "owner"]).select("ids", "slots", "repeated", "shas", "bitmap").mapInArrow(_mark, "id long, text_sha256 string, suspect boolean"), "marked"
    )
    discard(ledger)
    suspects = marked.where("suspect").select("id").distinct()
    if suspects.count() <= BROADCAST_SUSPECTS:
        suspects = F.broadcast(suspects)
    verified = (
        base.join(suspects, "id", "left_semi")
        .groupBy("text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", F.col("n").alias("group_size"))
    )
    return (
        marked.join(verified, "text_sha256", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("keep_id", "id").alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.coalesce("keep_id", "id") == F.col("id")).alias("kept"),
            "text_sha256",
        )
    )
