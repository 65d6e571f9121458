"""Token-budget windows over an ordered stream (2.D)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.stream import SPAN, blocked_running_sum
from graphloom.operators.text import strip
from graphloom.scratch import materialize

#: Budgets in tokens; fixed values.
LOOKAHEAD, LOOKAHEAD_CAP, FACT_WINDOW, BEFORE, AFTER, TILE = 2000, 8000, 600, 400, 400, 2000


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, plus one; null counts as empty."""
    return (F.floor(F.length(F.coalesce(text, F.lit(""))) / 4) + 1).cast("long")


def _weighed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("tokens", estimate_tokens(F.col("content")))


def lookahead_window(nodes: DataFrame, cursors: DataFrame, budget: int = LOOKAHEAD) -> DataFrame:
    """(source, cursor, id): whole nodes from each cursor (source, cursor) while the budget holds, at least one."""
    summed = blocked_running_sum(_weighed(nodes), "source", "id", "tokens", "before").select("source", "id", "before", "tokens")
    start = summed.select("source", F.col("id").alias("cursor"), F.col("before").alias("origin")).join(cursors, ["source", "cursor"])
    # nodes weigh one token at least, so a window ends within `budget` ids of the cursor when ids are dense
    near = (F.col("id") >= F.col("cursor")) & (F.col("id") < F.col("cursor") + budget)
    joined = summed.withColumn("cell", F.floor(F.col("id") / budget)).join(start.withColumn("cell", F.explode(F.array(F.floor(F.col("cursor") / budget), F.floor(F.col("cursor") / budget) + 1))), ["source", "cell"]).where(near)
    return joined.where((F.col("id") == F.col("cursor")) | (F.col("before") + F.col("tokens") - F.col("origin") <= budget)).select("source", "cursor", "id")


def _jumps(tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a span's nodes: prefix sums; the start of the window after one that starts at each node (or the span's end); the last start that follows; how many follow.

    The next start is found on the prefix sums; last starts and counts by pointer doubling.
    """
    n = len(tokens)
    sums = np.concatenate([[0], np.cumsum(tokens)])
    at = np.arange(n + 1)
    after = np.append(np.maximum(np.searchsorted(sums[1:], sums[:-1] + budget, side="right"), at[1:]), n)
    jump, follow = after, (after < n).astype(np.int64)
    last = np.where(after < n, after, at)
    while (jump < n).any():
        follow = follow + follow[jump]
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    return sums, after, last, follow


def _through(tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows filled so far by 0 (none begun) to `budget` tokens: how full the last one is after these nodes, and how many were closed."""
    sums, _, last, follow = _jumps(tokens, budget)
    n, filled = len(tokens), np.arange(budget + 1)
    first = np.searchsorted(sums[1:], budget - filled, side="right")
    first[0] = 0
    stays = first == n
    out = np.where(stays, filled + sums[n], sums[n] - sums[last[first]])
    closed = np.where(stays, 0, follow[first] + (filled > 0))
    return np.minimum(out, budget), closed  # a fuller window takes nothing more either


#: Spans, or groups of them, that are composed at a time.
FANOUT = 64
MAPS = "source string, span long, filled binary, closed binary"


def _fold(budget: int):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """What a span does to a window of any fill."""
        filled, closed = _through(pdf.sort_values("id").tokens.to_numpy(), budget)
        return pd.DataFrame({"source": pdf.source.iloc[:1], "span": pdf.span.iloc[:1], "filled": [filled.astype(np.int32).tobytes()], "closed": [closed.astype(np.int64).tobytes()]})

    return fold


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """What consecutive spans do together."""
    filled = closed = None
    for f, c in zip(*(pdf.sort_values("span")[x] for x in ("filled", "closed")), strict=True):
        f, c = np.frombuffer(f, np.int32), np.frombuffer(c, np.int64)
        filled, closed = (f, c) if filled is None else (f[filled], closed + c[filled])
    return pd.DataFrame({"source": pdf.source.iloc[:1], "span": pdf.up.iloc[:1], "filled": [filled.tobytes()], "closed": [closed.tobytes()]})


def _enter(maps: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """The fill and the number of the window with which each of a group's spans is entered."""
    maps = maps.sort_values("span")
    fill, window = (int(entry.fill.iloc[0]), int(entry["first"].iloc[0])) if len(entry) else (0, 0)
    out = []
    for f, c in zip(maps.filled, maps.closed, strict=True):
        out.append((fill, window))
        fill, window = int(np.frombuffer(f, np.int32)[fill]), window + int(np.frombuffer(c, np.int64)[fill])
    return pd.DataFrame({"source": maps.source, "span": maps.span, "fill": [x for x, _ in out], "first": [x for _, x in out]})


def _number(budget: int):
    def number(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        """The window of each node of a span."""
        rows = rows.sort_values("id")
        fill, window = (int(entry.fill.iloc[0]), int(entry["first"].iloc[0])) if len(entry) else (0, 0)
        tokens = rows.tokens.to_numpy()
        sums, after, _, _ = _jumps(tokens, budget)
        begins = np.zeros(len(tokens) + 1, np.int64)
        at = int(np.searchsorted(sums[1:], budget - fill, side="right")) if fill else int(after[0])
        while at < len(tokens):
            begins[at] = 1
            at = int(after[at])
        return pd.DataFrame({"source": rows.source, "id": rows.id, "window_id": (window + np.cumsum(begins[:-1])).astype(np.int32)})

    return number


def pack_windows(weighed: DataFrame, budget: int, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """(source, id, window_id): greedy windows; one closes before the node that would exceed the budget.

    A book's nodes are cut into spans of ids. Jump pointers give, for every fill
    with which a window may enter a span, the fill with which it is left and the
    windows closed. These maps are composed in groups of `fanout`, then groups of
    groups, so that no task needs all of a book; from the whole book back down, each
    span is told its fill, and spans are numbered apart.
    """
    rows = materialize(weighed.select("source", "id", "tokens", F.floor(F.col("id") / span).alias("span")), "weights")
    levels = [materialize(rows.groupBy("source", "span").applyInPandas(_fold(budget), MAPS), "span-maps")]
    most = levels[0].agg(F.max("span")).first()[0] or 0
    up = lambda maps: maps.withColumn("up", F.floor(F.col("span") / fanout))
    while most >= fanout:
        levels.append(materialize(up(levels[-1]).groupBy("source", "up").applyInPandas(_compose, MAPS), "span-maps"))
        most //= fanout
    entry = rows.select("source", F.lit(0).cast("long").alias("span"), F.lit(0).cast("long").alias("fill"), F.lit(0).cast("long").alias("first")).limit(0)
    for maps in reversed(levels):  # the topmost groups have no entry: a book is entered with no window begun
        held = entry.withColumnRenamed("span", "up")
        entry = materialize(up(maps).groupBy("source", "up").cogroup(held.groupBy("source", "up")).applyInPandas(_enter, "source string, span long, fill long, first long"), "entries")
    return rows.groupBy("source", "span").cogroup(entry.groupBy("source", "span")).applyInPandas(_number(budget), "source string, id long, window_id int")


def eligible(nodes: DataFrame) -> DataFrame:
    return nodes.where((strip(F.coalesce("content", F.lit(""))) != "") & (F.col("type") != "image"))


def fixed_windows(nodes: DataFrame, budget: int = FACT_WINDOW) -> DataFrame:
    """Adjacent windows over nodes that are neither blank nor images."""
    return pack_windows(_weighed(eligible(nodes)), budget)


def tiled_windows(nodes: DataFrame, budget: int = TILE) -> DataFrame:
    """Windows over all nodes, each starting where the one before ended."""
    return pack_windows(_weighed(nodes), budget)


def _context(nodes: DataFrame, budget: int, forward: bool, cursors: DataFrame | None = None) -> DataFrame:
    weight = F.when(strip(F.coalesce("content", F.lit(""))) == "", 0).otherwise(estimate_tokens(F.col("content")))
    summed = blocked_running_sum(nodes.withColumn("_w", weight.cast("long")), "source", "id", "_w", "_e").withColumn("_i", F.col("_e") + F.col("_w"))
    # sums are cut into cells of one budget: the context lies in the cursor's cell and the neighbour's
    far = F.col("_i") if forward else F.col("_e")
    one = summed.select("source", F.col("id").alias("cid"), "content", "_w", far.alias("sum"), F.floor(far / budget).alias("cell")).where("_w > 0")
    step = 1 if forward else -1
    asked = summed if cursors is None else summed.join(cursors, ["source", "id"], "left_semi")
    cursor = asked.select("source", "id", far.alias("at"), F.explode(F.array(F.floor(far / budget), F.floor(far / budget) + step)).alias("cell"))
    inside = (F.col("cid") > F.col("id")) & (F.col("sum") - F.col("at") <= budget) if forward else (F.col("cid") < F.col("id")) & (F.col("at") - F.col("sum") <= budget)
    met = cursor.join(one, ["source", "cell"]).where(inside)
    text = F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("cid", "content"))), lambda x: x.content))
    return met.groupBy("source", "id").agg(text.alias("context"))


def context_before(nodes: DataFrame, budget: int = BEFORE, cursors: DataFrame | None = None) -> DataFrame:
    """(source, id, context): the run of nodes before each node (of `cursors`: source, id) that fits the budget; nodes without one have no row."""
    return _context(nodes, budget, False, cursors)


def context_after(nodes: DataFrame, budget: int = AFTER, cursors: DataFrame | None = None) -> DataFrame:
    return _context(nodes, budget, True, cursors)


def windows_with_context(nodes: DataFrame, budget: int = FACT_WINDOW, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """(source, window_id, first_id, last_id, n, before, after)."""
    nodes = materialize(nodes, "nodes")
    edges = materialize(fixed_windows(nodes, budget).groupBy("source", "window_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")), "window-ends")
    b = context_before(nodes, before, edges.select("source", F.col("first_id").alias("id"))).select("source", F.col("id").alias("first_id"), F.col("context").alias("before"))
    a = context_after(nodes, after, edges.select("source", F.col("last_id").alias("id"))).select("source", F.col("id").alias("last_id"), F.col("context").alias("after"))
    return edges.join(b, ["source", "first_id"], "left").join(a, ["source", "last_id"], "left")


def context_around(items: DataFrame, back: int, forward: int) -> DataFrame:
    """(source, id, n_before, n_after): how many items fit on both sides; the backward budget counts from the start of the list."""
    summed = blocked_running_sum(_weighed(items), "source", "id", "tokens", "_e").withColumn("_i", F.col("_e") + F.col("tokens"))
    first = summed.where(F.col("_i") <= back).groupBy("source").agg(F.count("*").alias("fits"))
    cell = lambda c: F.floor(c / forward)
    ahead = summed.select("source", F.col("id").alias("cid"), F.col("_i").alias("sum"), cell(F.col("_i")).alias("cell"))
    cursor = summed.select("source", "id", F.col("_i").alias("at"), F.explode(F.array(cell(F.col("_i")), cell(F.col("_i")) + 1)).alias("cell"))
    after = cursor.join(ahead, ["source", "cell"]).where((F.col("cid") > F.col("id")) & (F.col("sum") - F.col("at") <= forward)).groupBy("source", "id").agg(F.count("*").alias("n_after"))
    out = items.select("source", "id").join(first, "source", "left").join(after, ["source", "id"], "left")
    return out.select("source", "id", F.least(F.col("id"), F.coalesce("fits", F.lit(0))).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def window_view(windows: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a pass over windows sees: (source, window_id, position, node_id, type, content)."""
    w = Window.partitionBy("source", "window_id").orderBy("id")
    rows = windows.join(nodes.select("source", "id", "type", "content"), ["source", "id"])
    return rows.select("source", "window_id", (F.row_number().over(w) - 1).alias("position"), F.col("id").alias("node_id"), "type", "content")
