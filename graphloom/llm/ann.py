"""Approximate nearest neighbours by cross-polytope hashing.

A vector is normalised, turned by pseudo-rotations (random signs and a fast
Hadamard transform, three times) and assigned to the nearest signed axis: of
2 * dim buckets, one for each table. A query probes the buckets of its largest
coordinates in each table. Buckets are cut into blocks, so that one that holds a
third of all rows is many tasks; each block ranks its rows exactly for the
queries that probe it and passes on the best k, never the candidates themselves.
The best are merged with one row for each candidate and query.

A query that finds fewer than k rows is searched again, against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.scratch import discard, materialize

TABLES, PROBES = 10, 16
#: Rows and queries that meet in one task at most, about.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (its length a power of two)."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotate(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The pseudo-rotation of a table, of rows padded to a power of two."""
    d = 1 << (unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), d))
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng((seed, table, d))
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), d))
    return x


def buckets(unit: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """The `probes` nearest signed axes of each row: 2 * axis, plus 1 on the negative side."""
    x = rotate(unit, table, seed)
    signed = np.stack([x, -x], axis=2).reshape(len(x), -1)
    probes = min(probes, signed.shape[1])
    if probes == 1:
        return signed.argmax(axis=1)[:, None]
    best = np.argpartition(-signed, probes - 1, axis=1)[:, :probes]
    return best


def _hash(tables: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                ids, lists = batch.column(0), batch.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                for dim in np.unique(lengths):
                    rows = np.flatnonzero(lengths == dim)
                    x = np.stack([flat[cuts[r] : cuts[r + 1]] for r in rows])
                    scale = np.abs(x).max(axis=1, keepdims=True)
                    unit = x / scale
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    blobs = pa.array([v.tobytes() for v in x], pa.binary())
                    own = ids.take(pa.array(rows))
                    for t in range(tables):
                        b = buckets(unit, t, seed, probes)
                        n = b.shape[1]
                        again = pa.array(np.repeat(np.arange(len(rows)), n))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows) * n, dim, np.int32)), pa.array(np.full(len(rows) * n, t, np.int32)), pa.array(b.ravel().astype(np.int32)), own.take(again), blobs.take(again)],
                            names=["dim", "tab", "bucket", "id", "vec"],
                        )

    return run


HASHED = "dim int, tab int, bucket int, id long, vec binary"
FOUND = "query_id long, vec_id long, score double"


def _rank(k: int):
    """The best k rows of a block for each of its queries, by exact distance, ties to the smaller id."""

    def rank(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(asked):
            x = np.frombuffer(b"".join(rows.vec), np.float64).reshape(len(rows), -1)
            ids = rows.id.to_numpy()
            square = (x * x).sum(axis=1)
            q = np.frombuffer(b"".join(asked.vec), np.float64).reshape(len(asked), -1)
            for at in range(0, len(q), 128):
                part = q[at : at + 128]
                own = (part * part).sum(axis=1)
                rough = square[None, :] + own[:, None] - 2 * part @ x.T
                for qv, qid, size, d2 in zip(part, asked.id.to_numpy()[at : at + 128], own, rough, strict=True):
                    d2 = np.where(ids == qid, np.inf, d2)
                    if len(d2) > k:  # with room for rounding, and for ties
                        d2_k = np.partition(d2, k - 1)[k - 1]
                        near = np.flatnonzero(d2 <= d2_k + 1e-9 * (size + d2_k + 1e-300) + 1e-12 * np.abs(square).max())
                    else:
                        near = np.arange(len(d2))
                    near = near[ids[near] != qid]
                    score = np.sqrt(((x[near] - qv) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], score))[:k]
                    out["query_id"] += [qid] * len(best)
                    out["vec_id"] += ids[near][best].tolist()
                    out["score"] += score[best].tolist()
        return pd.DataFrame(out)

    return rank


KEY = ["dim", "tab", "bucket"]


def _blocks(hashed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best rows of each block of each bucket for the queries that probe it."""
    n_rows = hashed.groupBy(*KEY).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    n_asked = asked.groupBy(*KEY).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    sizes = F.broadcast(n_rows.join(n_asked, KEY))  # one row a bucket: tables x 2 x dim at most
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = hashed.join(sizes, KEY).select(*KEY, own("blocks").alias("block"), every("parts").alias("part"), "id", "vec")
    queries = asked.join(sizes, KEY).select(*KEY, every("blocks").alias("block"), own("parts").alias("part"), "id", "vec")
    by = [*KEY, "block", "part"]
    return rows.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(_rank(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector that is not null, empty or zero and has finite components only."""
    vec = F.col("vec")
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
        .where("id is not null and vec is not null")
        .where(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0))
    )


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The true nearest rows of each query, in blocks: (query_id, rank, vec_id, score).

    Null and odd vectors, ids, ties, repeated rows, other columns and empty tables
    are treated as in `ann_search`.
    """
    one = lambda df: usable(df, id_col, vector_col).mapInArrow(_hash(1, 1, 0), HASHED).withColumn("bucket", F.lit(0))
    return _best(_blocks(one(vectors), one(queries), k), k)


def ann_search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest rows found for each query: (query_id, rank from 1, vec_id, score: Euclidean distance).

    Every row of `vectors` is indexed. A row is no neighbour of a query with its
    own id. Vectors that are null, empty or zero, or hold null or non-finite
    components, and rows without id take no part on either side. Vectors of
    different lengths are never compared. Ties go to the smaller id; a repeated
    id counts once, at its nearest. Other columns are ignored. A query gets all
    rows if there are no more than k; without rows or queries the result is empty.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    hashed = materialize(rows.mapInArrow(_hash(tables, 1, seed), HASHED), "ann-rows")
    probing = materialize(asked.mapInArrow(_hash(tables, probes, seed), HASHED), "ann-queries")
    found = materialize(_best(_blocks(hashed, probing, k), k), "ann-found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias(id_col))
    short = queries.join(full, id_col, "left_anti")
    if not usable(short, id_col, vector_col).isEmpty():
        rest = exact_search(vectors, short, k, id_col, vector_col)
        found = found.join(full.select(F.col(id_col).alias("query_id")), "query_id", "left_semi").unionByName(rest)
    discard(hashed, probing)
    return found
