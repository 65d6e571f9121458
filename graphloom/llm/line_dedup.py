"""Line deduplication that can be reversed: cuckoo filters over exact reference counts.

The store has two parts. The reference table holds, for each line key, in how
many documents it stands; keys are 128-bit hashes of the normalised line. The
filters, one cuckoo filter for each shard of keys, hold the keys at or over the
threshold. Adding documents adds to counts, deleting documents subtracts; keys
that cross the threshold are inserted into or deleted from their shard's filter,
so that deletion brings back the state before.

To clean documents, line keys are probed against the filters where the rows are
read. Only what passes is looked up in the reference table, which decides. Each
document counts a key once, and counts are summed before they are shuffled, so
that a line found in a third of all documents costs one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, mix
from graphloom.scratch import discard, materialize, shuffle_width

#: Keys of a shard's filter on average at most.
SHARD_KEYS = 100_000
#: Filters of this size in all are sent to every task; beyond it keys are sent to their shard's filter, in so many parts a shard.
BROADCAST_FILTER_BYTES, SHARD_PARTS = 32 << 20, 16
#: (document, key) rows up to this number (about 40 bytes each) are broadcast to the documents; beyond it they are joined by a shuffle.
BROADCAST_HITS = 1_000_000

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; a key has two buckets, each found from the other and the fingerprint."""

    def __init__(self, keys: int = 0, slots: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / 4 / 0.85 + 1))))
        self.slots = np.zeros((buckets, 4), np.uint16) if slots is None else slots

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(slots=np.frombuffer(blob, np.uint16).reshape(-1, 4).copy())

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @staticmethod
    def places(h1: np.ndarray, h2: np.ndarray, mask: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys."""
        h = mix(h1.astype(np.int64).view(np.uint64) ^ mix(h2.astype(np.int64).view(np.uint64)))
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp = np.where(fp == 0, np.uint16(1), fp)
        mask = np.asarray(mask, np.uint64)
        first = h & mask
        return fp, first.astype(np.int64), ((first ^ mix(fp.astype(np.uint64))) & mask).astype(np.int64)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if there is no room; then the filter is to be rebuilt larger from the reference table."""
        mask = len(self.slots) - 1
        jump = lambda fp: int(mix(np.array([fp], np.uint64))[0]) & mask
        for fp, a, b in zip(*(x.tolist() for x in self.places(h1, h2, mask)), strict=True):
            for at in (a, b):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = fp
                    break
            else:
                at = b
                for kick in range(500):
                    out = int(self.slots[at, kick % 4])
                    self.slots[at, kick % 4] = fp
                    fp, at = out, at ^ jump(out)
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for fp, a, b in zip(*(x.tolist() for x in self.places(h1, h2, len(self.slots) - 1)), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.slots[at] == fp)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(h1, h2, len(self.slots) - 1)
        return (self.slots[a] == fp[:, None]).any(axis=1) | (self.slots[b] == fp[:, None]).any(axis=1)


@dataclass
class LineStore:
    refs: DataFrame  # h1, h2, n
    filters: DataFrame  # shard, slots
    shards: int
    min_docs: int
    min_chars: int


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """Adds the distinct line keys of each row's text."""
    lines = F.split("text", "\n")
    keys = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= max(1, min_chars))
    return rows.withColumn("keys", F.array_distinct(F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(42), k).alias("h2")))))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("row")).where("id is not null")


def _counts(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    keyed = _keys(_rows(docs, id_col, text_col).select("id", "text"), min_chars)
    return keyed.select(F.explode("keys").alias("k")).groupBy("k.h1", "k.h2").agg(F.count("*").alias("n"))


def _build_filters(hot: DataFrame, shards: int) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2, size = pdf.h1.to_numpy(), pdf.h2.to_numpy(), len(pdf)
        while not (f := CuckooFilter(size)).insert(h1, h2):
            size *= 2
        return pd.DataFrame({"shard": pdf.shard[:1], "slots": [f.to_bytes()]})

    return hot.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, slots binary")


def build_store(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
    """The store of documents: how many hold each line key, and a filter of the keys that `min_docs` or more hold for each shard.

    A document counts a key once; rows that repeat an id are documents each. Rows
    without id are left out; a null or empty text and lines under `min_chars` have no
    keys. A long text is split in its task. An empty table gives a store of nothing.
    """
    refs = materialize(_counts(docs, id_col, text_col, min_chars), "line-refs")
    hot = refs.where(F.col("n") >= min_docs).select("h1", "h2")
    shards = shards or max(1, -(-hot.count() // SHARD_KEYS))
    return LineStore(refs, materialize(_build_filters(hot, shards), "line-filters"), shards, min_docs, min_chars)


def update_store(store: LineStore, inserted: DataFrame | None = None, deleted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
    """The store after documents were added or deleted; the store given is left as it is.

    Deleting a document that was added gives the counts and filters' answers of
    before. One added twice counts twice and is to be deleted twice; one deleted
    that was never added takes its keys from other documents' counts, down to none.
    Null texts and rows without id change nothing.
    """
    parts = [store.refs.select("h1", "h2", F.col("n").alias("old"), F.lit(0).cast("long").alias("step"))]
    for docs, sign in ((inserted, 1), (deleted, -1)):
        if docs is not None:
            parts.append(_counts(docs, id_col, text_col, store.min_chars).select("h1", "h2", F.lit(0).cast("long").alias("old"), (F.col("n") * sign).alias("step")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    moved = materialize(every.groupBy("h1", "h2").agg(F.sum("old").alias("old"), (F.sum("old") + F.sum("step")).alias("n")), "line-moves")
    least = store.min_docs
    crossed = moved.where((F.col("old") >= least) != (F.col("n") >= least)).select(
        F.pmod("h1", F.lit(store.shards)).cast("int").alias("shard"), "h1", "h2", (F.col("n") >= least).alias("add")
    )

    def turn(key, old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.from_bytes(old.slots.iloc[0]) if len(old) else CuckooFilter(len(moves))
        out, new = moves[~moves["add"]], moves[moves["add"]]
        f.delete(out.h1.to_numpy(), out.h2.to_numpy())
        fits = f.insert(new.h1.to_numpy(), new.h2.to_numpy())
        return pd.DataFrame({"shard": [key[0]], "slots": [f.to_bytes() if fits else b""]})

    turned = materialize(store.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(turn, "shard int, slots binary"), "line-filters")
    refs = moved.where("n > 0").select("h1", "h2", "n")
    full = turned.where("octet_length(slots) = 0").select("shard")
    if not full.isEmpty():  # these shards have no room left: built again from the reference table
        hot = refs.where(F.col("n") >= least).withColumn("shard", F.pmod("h1", F.lit(store.shards)).cast("int")).join(full, "shard", "left_semi")
        turned = materialize(turned.where("octet_length(slots) > 0").unionByName(_build_filters(hot, store.shards)), "line-filters")
    return replace(store, refs=refs, filters=turned)


def _probe(filters: dict[int, bytes], shards: int):
    """Where tasks read rows: the keys that the filters may hold."""
    offsets, masks, flat, at = np.zeros(shards, np.int64), np.zeros(shards, np.uint64), [np.zeros((1, 4), np.uint16)], 1
    for shard, blob in filters.items():
        slots = np.frombuffer(blob, np.uint16).reshape(-1, 4)
        offsets[shard], masks[shard] = at, len(slots) - 1
        flat.append(slots)
        at += len(slots)
    slots = np.concatenate(flat)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten()
            h1, h2 = (keys.field(i).to_numpy() for i in (0, 1))
            shard = h1 % shards
            fp, a, b = CuckooFilter.places(h1, h2, masks[shard])
            a, b = a + offsets[shard], b + offsets[shard]
            hit = (slots[a] == fp[:, None]).any(axis=1) | (slots[b] == fp[:, None]).any(axis=1)
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(owner[hit]), pa.array(h1[hit]), pa.array(h2[hit])], names=["id", "h1", "h2"])

    return probe


def _probe_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, id, h1, h2, slots) sorted so that a shard's filter comes before the keys that it is asked for: the keys that it may hold."""
    at, held = None, None
    for batch in batches:
        shard, given = batch.column(0).to_numpy(), batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (given[1:] != given[:-1]), [True]])) if len(shard) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if shard[a] != at:
                at, held = shard[a], None
            if given[a]:
                held = CuckooFilter.from_bytes(batch.column(4)[int(a)].as_py())
            elif held is not None:  # a shard without hot keys has no filter
                part = [batch.column(c).slice(a, b - a) for c in (1, 2, 3)]
                hit = pa.array(held.contains(part[1].to_numpy(), part[2].to_numpy()))
                yield pa.RecordBatch.from_arrays([c.filter(hit) for c in part], names=["id", "h1", "h2"])


def _probe_shards(store: LineStore, keyed: DataFrame) -> DataFrame:
    """Keys (id, h1, h2) that the filters may hold, each probed where its shard's filter is; a shard is cut in parts by document, as one line may be in a third of them."""
    width = max(shuffle_width(keyed.sparkSession), store.shards)
    part = F.pmod(F.xxhash64("id"), F.lit(SHARD_PARTS)).cast("int")
    asked = keyed.select("id", F.explode("keys").alias("k")).select(F.pmod("k.h1", F.lit(store.shards)).cast("int").alias("shard"), part.alias("part"), "id", "k.h1", "k.h2", F.lit(None).cast("binary").alias("slots"))
    none = F.lit(None).cast("long")
    filters = store.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARD_PARTS - 1))).alias("part"), none.alias("id"), none.alias("h1"), none.alias("h2"), "slots")
    met = asked.unionByName(filters).repartition(width, "shard", "part").sortWithinPartitions("shard", "part", F.col("slots").isNull())
    return met.select((F.col("shard") * SHARD_PARTS + F.col("part")).alias("shard"), "id", "h1", "h2", "slots").mapInArrow(_probe_sorted, "id long, h1 long, h2 long")


def drop_lines(store: LineStore, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_lines, n_dropped, kept, row (all columns as they came).

    Lines whose key stands in at least `min_docs` documents of the store go; the
    others stay, joined by line feeds. A null or empty text is one empty line,
    which stays: keys under one code point are never counted. A row without id
    takes no part. Rows that repeat an id count as further documents and are
    cleaned alike. Extra columns may have any name. A long text is split in its task;
    an empty table gives an empty result.
    """
    rows = _rows(docs, id_col, text_col)
    keyed = _keys(rows.select("id", "text"), store.min_chars).select("id", "keys")
    size = store.filters.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    if size <= BROADCAST_FILTER_BYTES:
        filters = {r.shard: bytes(r.slots) for r in store.filters.collect()}
        probed = keyed.mapInArrow(_probe(filters, store.shards), "id long, h1 long, h2 long")
    else:
        probed = _probe_shards(store, keyed)
    hot = store.refs.where(F.col("n") >= store.min_docs).select("h1", "h2")
    hits = materialize(probed.join(hot, ["h1", "h2"], "left_semi").groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("hot")), "line-hits")
    n_hits = hits.agg(F.sum(F.size("hot"))).first()[0] or 0
    small = F.broadcast(hits) if n_hits <= BROADCAST_HITS else hits
    lines = F.split("text", "\n")

    def stays(line: Column) -> Column:
        k = line_key(line)
        return ~F.array_contains(F.col("hot"), F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(42), k).alias("h2")))

    # a key under min_chars is never in the table
    cleaned = rows.join(small, "id", "left").withColumn("lines", lines)
    kept = F.when(F.col("hot").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    return cleaned.withColumn("left", kept).select(
        F.col("id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.array_join("left", "\n").alias("kept"), "row",
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`drop_lines` of documents by a store built from the same documents."""
    bound_batches(docs)
    store = build_store(docs, min_docs, min_chars, id_col=id_col, text_col=text_col)
    return drop_lines(store, docs, id_col, text_col)
