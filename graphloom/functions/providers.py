"""User functions (2.L): where judgements enter a pipeline as decision tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import discard, materialize

#: Requests of a task of a round of calls, about.
TASK_REQUESTS = 20_000


def decisions_from_table(requests: DataFrame, recorded: DataFrame, on: list[str]) -> DataFrame:
    """Requests with the decision that was recorded for them; others have nulls."""
    return requests.join(recorded, on, "left")


def decisions_from_function(requests: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parallelism: int = 16, batch: int = 200, task_requests: int = TASK_REQUESTS) -> DataFrame:
    """A user's function over batches of requests, at most `parallelism` calls at a time.

    Requests are asked in rounds of `parallelism` tasks with about `task_requests`
    each; a round's decisions are written before the next begins, so that a lost
    executor costs the tasks in flight and no decision is asked for twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                yield function(b.iloc[at : at + batch])

    held = materialize(requests, "requests")
    rounds = max(1, -(-held.count() // (parallelism * task_requests)))
    out = None
    for k in range(rounds):
        turn = held if rounds == 1 else held.where(F.pmod(F.xxhash64(*held.columns), F.lit(rounds)) == k)
        one = materialize(turn.repartition(parallelism).mapInPandas(run, schema), "decisions")
        out = one if out is None else out.unionByName(one)
    discard(held)
    return out


def fold_per_stream(rows: DataFrame, step: Callable, initial: Callable, schema: str, key: str = "source", order: str = "id") -> DataFrame:
    """A user's fold over each ordered stream: step(state, row) -> (state, list of output tuples).

    Streams pass through a task in order, row by row; only the state is held.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if getattr(row, key) != current:
                    current, state = getattr(row, key), initial()
                state, made = step(state, row)
                out += made
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def bank_spans(nodes: DataFrame, find: Callable[[list], list[tuple[int, int]]], budget: int = 2000, cap: int = 8000) -> DataFrame:
    """Spans (source, start, end) by an external decider over look-ahead windows.

    A window holds whole nodes from the cursor while the budget holds, one at
    least. `find` gets [(id, content)] and returns (start, end) positions, which
    are clamped into the window and taken in order. Spans that a node of the
    window follows are kept, and the cursor moves behind the last of them; if
    there is none the window is read again at twice the size. At the cap and at
    the end of the stream all spans are kept and the cursor moves to the window's
    end; a window without spans is passed over. What `find` says decides where the
    next window starts, so a stream is read in order, a window at a time.
    """

    def advance(source, held, size, ended):
        """Spans found from the held nodes on; changes `held`, returns the size of the next window."""
        out = []
        while held:
            n, total = 0, 0
            while n < len(held) and (not n or total + held[n][2] <= size):
                total += held[n][2]
                n += 1
            if n == len(held) and not ended:
                break  # the window may hold more
            last = n - 1
            spans = [(max(0, min(s, last)), max(0, min(e, last))) for s, e in find([(i, c) for i, c, _ in held[:n]])]
            spans = [(s, max(s, e)) for s, e in spans]
            bounded = [x for x in spans if x[1] < last]
            if not spans or (ended and n == len(held)) or size >= cap:
                done, step = spans, n
            elif bounded:
                done, step = bounded, bounded[-1][1] + 1
            else:
                size *= 2
                continue
            out += [(source, held[s][0], held[e][0]) for s, e in done]
            del held[:step]
            size = budget
        return out, size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, size, weight = None, [], budget, 0
        names = ["source", "start", "end"]
        for b in batches:
            out = []
            for source, i, c in zip(b.source, b.id, b.content, strict=True):
                if source != current:
                    out += advance(current, held, size, True)[0]
                    current, held, size, weight = source, [], budget, 0
                held.append((i, c, len(c or "") // 4 + 1))
                weight += held[-1][2]
                if weight > size:
                    found, size = advance(source, held, size, False)
                    out += found
                    weight = sum(t for *_, t in held)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(advance(current, held, size, True)[0], columns=names)

    return nodes.select("source", "id", "content").repartition("source").sortWithinPartitions("source", "id").mapInPandas(run, "source string, start long, end long")
