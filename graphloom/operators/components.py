"""Connected components by random contraction.

First each task replaces its own edges by stars, one for each component of them,
so none leaves more edges than vertices. A graph of few edges is finished by one
task. In a larger one vertices are numbered; in each round every vertex moves to
the least of itself and its neighbours in an order that is random and new, which
leaves about half of a path's vertices and no more of any other graph, and edges
are drawn between what is left. Rounds shrink, so all of them cost about two of
the first, however long a chain is. Then the moves are read backwards. Tables are
written to the shared folder between rounds; no edge or label passes through the
driver, which sees only counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import discard, materialize

#: Edges that a task replaces by stars, about; a graph of no more is finished by one task.
TASK_EDGES = 500_000


#: The lower half of a long.
HALF = 0xFFFFFFFF


def _mixed(v: Column, seed: int) -> Column:
    """A random order of longs, other with each seed, as a permutation of them; `_restored` is its inverse."""
    low = v.bitwiseAND(F.lit(HALF)).bitwiseXOR(_half(F.shiftrightunsigned(v, 32), seed))
    high = F.shiftrightunsigned(v, 32).bitwiseXOR(_half(low, seed))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _restored(m: Column, seed: int) -> Column:
    low = m.bitwiseAND(F.lit(HALF))
    high = F.shiftrightunsigned(m, 32).bitwiseXOR(_half(low, seed))
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseXOR(_half(high, seed)))


def _half(v: Column, seed: int) -> Column:
    return F.xxhash64(v, F.lit(seed)).bitwiseAND(F.lit(HALF))


def _moves(edges: DataFrame, seed: int) -> DataFrame:
    """(u, r): each vertex with the least of itself and its neighbours in the seed's order."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(_mixed(F.col("v"), seed)).alias("m"))
    return least.select("u", _restored(F.least("m", _mixed(F.col("u"), seed)), seed).alias("r"))


def _moved(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges between the vertices that their ends moved to."""
    ends = [moves.select(F.col("u").alias(c), F.col("r").alias(f"_{c}")) for c in "uv"]
    out = edges.join(ends[0], "u").join(ends[1], "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    return out.where("u <> v")


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For vertices 0..n-1 and edges (u, v): the smallest vertex of each one's component."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the smallest vertex of each component, made anew whenever it holds TASK_EDGES; stars of more vertices than half of that leave as they are."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > TASK_EDGES:
            held = list(_starred(held))
            n = sum(b.num_rows for b in held)
            if n > TASK_EDGES // 2:
                yield from held
                held, n = [], 0
    yield from _starred(held)


def _starred(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    table = pa.Table.from_batches(held)
    ends = pa.chunked_array(table.column(0).chunks + table.column(1).chunks).combine_chunks()
    names = ends.unique()
    names = names.take(pa.compute.sort_indices(names))
    at = pa.compute.index_in(ends, value_set=names).to_numpy()
    label = forest(at[: table.num_rows].astype(np.int64), at[table.num_rows :].astype(np.int64), len(names))
    leaf = np.flatnonzero(label != np.arange(len(names)))
    for k in range(0, len(leaf), 10_000):
        some = leaf[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), names.take(pa.array(label[some]))], schema=held[0].schema)


def stars(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components, task by task: nothing is shuffled, and many edges between few vertices are never written."""
    return edges.mapInArrow(_stars, edges.schema)


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """(vertex, component): component is the smallest vertex that can be reached.

    `edges` has two columns of one orderable type, in any direction and number;
    rows with a null end are ignored, loops keep their vertex as a singleton.
    `vertices` (one column) adds singletons. Without rows the result is empty.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    alone = pairs.where("u = v").select("u")
    if vertices is not None:
        alone = alone.unionByName(vertices.select(F.col(vertices.columns[0]).alias("u")).where("u is not null"))
    held = materialize(pairs.where("u <> v"), "component-edges")
    n = held.count()
    if n <= TASK_EDGES:
        current = _reduced(held, n)
        labelled = current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("vertex"), F.col("v").alias("component")))
        return labelled.unionByName(alone.select(F.col("u").alias("vertex"), F.col("u").alias("component"))).groupBy("vertex").agg(F.min("component").alias("component"))
    current = _reduced(held, n)
    every = current.select("u").unionByName(current.select(F.col("v").alias("u"))).unionByName(alone).distinct()
    names = materialize(every.select(F.col("u").alias("name"), F.monotonically_increasing_id().alias("id")), "component-names")
    ends = [names.select(F.col("name").alias(c), F.col("id").alias(f"_{c}")) for c in "uv"]
    numbered = materialize(current.join(ends[0], "u").join(ends[1], "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")), "component-edges")
    discard(current)
    roots = _roots(numbered, max_rounds)
    rooted = names.join(roots.select(F.col("u").alias("id"), "r"), "id", "left").select("name", F.coalesce("r", "id").alias("root"))
    placed = materialize(rooted, "component-roots")
    discard(names, roots)
    least = placed.groupBy("root").agg(F.min("name").alias("component"))
    return placed.join(least, "root").select(F.col("name").alias("vertex"), "component")


def _reduced(edges: DataFrame, n: int) -> DataFrame:
    """The n edges as stars, in tasks of TASK_EDGES; `edges` is discarded."""
    out = materialize(edges.coalesce(max(1, -(-n // TASK_EDGES))).mapInArrow(_stars, edges.schema), "component-edges")
    discard(edges)
    return out


def _roots(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(u, r) of a graph of longs: each vertex that has edges with one vertex of its component, the same for all of it. `edges` are discarded."""
    rounds: list[DataFrame] = []
    while (n := edges.count()) > TASK_EDGES:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
        rounds.append(materialize(_moves(edges, len(rounds)), "component-moves"))
        moved = materialize(_moved(edges, rounds[-1]), "component-edges")
        discard(edges)
        edges = _reduced(moved, moved.count())
    stars = _reduced(edges, n)
    out = materialize(stars.select("u", F.col("v").alias("r")).unionByName(stars.select(F.col("v").alias("u"), F.col("v").alias("r")).distinct()), "component-roots")
    discard(stars)
    for moves in reversed(rounds):
        known = out.select(F.col("u").alias("r"), F.col("r").alias("root"))
        found = materialize(moves.join(known, "r", "left").select("u", F.coalesce("root", "r").alias("r")), "component-roots")
        discard(out, moves)
        out = found
    return out
