"""Substring deduplication by recompression.

Words are named by 64-bit hashes. Then follow rounds: a round names each run of
equal symbols, then divides the symbols into left and right ones and names each
left-right pair. A name is a hash of what it stands for, so all tasks give the
same name to the same thing without talking to each other, and equal substrings
get equal symbols except near their ends, where a symbol may join an unknown
neighbour.

How far that reaches is computed for each window of 50 words from the window
alone: after each round the first and the last run go, then a right symbol at
the left end and a left symbol at the right end. What remains is the window's
interior at that level. Its anchor is the symbol of smallest hash in the
interior at the highest level that has one, so that equal windows have equal
anchors at equal places, in whatever documents they stand. Windows with the same
anchor occurrence travel as one row: anchor symbol, and a hash of all the words
that these windows cover (the context).

Equal symbol and context: all windows of the row are shared, and the smallest
doc_id is found by an aggregation. One symbol with several contexts: a shared
passage begins or ends there, and the windows of one document for each context
(the smallest) are compared one by one. Symbol and context or window hash make a
key of 128 bits. No pairs of documents are ever formed, so a passage that
stands in a third of all documents costs one row for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import bound_batches, combine, doc_words, hash_words, keyed_chunks, lean_buffers, mix, ragged
from graphloom.scratch import discard, materialize

WIDTH = 50
ROUNDS = 6
#: Rounds that name runs before they name pairs.
RUN_ROUNDS = (0, 2)
#: Documents with edges or removed ranges are broadcast up to so many ranges (about 40 bytes each); beyond that they are joined by a shuffle.
BROADCAST_RANGES = 1_000_000

BASE = np.uint64(0x9DDFEA08EB382D69)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
RUN = np.uint64(0xA24BAED4963EE407)


def _salt(k: int) -> np.uint64:
    return np.uint64((k + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))


class SpanHash:
    """Hashes of any spans of a sequence, the same wherever the span stands."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        power = np.ones(n + 1, np.uint64)
        power[1:] = BASE
        self.inverse = np.ones(n + 1, np.uint64)
        self.inverse[1:] = BASE_INVERSE
        np.cumprod(power, out=power)
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class _Anchors:
    """The anchor of each window of a chunk of documents."""

    def __init__(self, h: np.ndarray, starts: np.ndarray, width: int):
        self.h, self.n = h, len(h)
        lengths = np.diff(starts)
        long = lengths >= width
        self.windows = ragged(starts[:-1][long], lengths[long] - width + 1)
        self.first = np.zeros(self.n + 1, bool)
        self.first[starts[:-1][lengths > 0]] = True
        w = len(self.windows)
        self.start, self.level, self.key = np.zeros(w, np.int64), np.zeros(w, np.int8), np.zeros(w, np.uint64)

    def pick(self, who: np.ndarray, sym: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, level: int) -> None:
        """The symbol of smallest hash between left and right, the first of equals, for the windows `who`."""
        if not len(who):
            return
        n = len(sym)
        index = np.empty(self.n + 1, np.int64)
        index[pos] = np.arange(n)
        index[self.n] = n
        a, b = index[left], index[right]
        order = mix(sym ^ _salt(100 + level))
        best, at = np.arange(n), np.empty(len(a), np.int64)
        level_of = np.frexp(b - a)[1] - 1
        for k in range(int(level_of.max()) + 1):  # best: the least of 2**k symbols from each on
            if k:
                x, y = best[: n - (1 << k >> 1)], best[1 << k >> 1 :]
                best = np.concatenate([np.where(order[x] <= order[y], x, y), best[n - (1 << k >> 1) :]])
            some = np.flatnonzero(level_of == k)
            x, y = best[a[some]], best[b[some] - (1 << k)]
            at[some] = np.where(order[x] <= order[y], x, y)
        p = pos[at]
        name = mix(sym[at] ^ _salt(level))
        if level:  # the words on both sides lie within the window too
            ends = np.append(pos[1:], self.n)
            name = combine(combine(name, self.h[p - 1]), self.h[ends[at]])
        self.start[who], self.level[who], self.key[who] = p, level, name

    def run(self, width: int, rounds: int) -> None:
        n = self.n
        sym, pos = self.h, np.arange(n)
        who, left, right = np.arange(len(self.windows)), self.windows, self.windows + width
        step_l, step_r = np.arange(n + 1), np.arange(n + 1)
        for t in range(rounds):
            old, new_l, new_r = (sym, pos), left, right
            if t in RUN_ROUNDS:
                head = np.ones(len(sym), bool)
                head[1:] = (sym[1:] != sym[:-1]) | self.first[pos[1:]]
                runs = np.flatnonzero(head)
                of = np.cumsum(head) - 1
                begin = pos[runs]
                step_l[pos] = np.append(begin[1:], n)[of]
                step_r[np.append(pos[1:], n)] = begin[of]
                new_l, new_r = step_l[new_l], step_r[new_r]
                count = np.diff(np.append(runs, len(sym)))
                sym = np.where(count > 1, combine(sym[runs] ^ RUN, count.astype(np.uint64)), sym[runs])
                pos = begin
            end = np.append(pos[1:], n)
            is_left = (mix(sym ^ _salt(t)) & np.uint64(1)).astype(bool)
            step_l[pos] = np.where(is_left, pos, end)
            step_r[end] = np.where(is_left, pos, end)
            new_l, new_r = step_l[new_l], step_r[new_r]
            pair = np.zeros(len(sym), bool)
            pair[:-1] = is_left[:-1] & ~is_left[1:] & ~self.first[pos[1:]]
            stays = np.ones(len(sym), bool)
            stays[1:] = ~pair[:-1]
            joined = combine(sym, np.append(sym[1:], np.uint64(0)))
            sym, pos = np.where(pair, joined, sym)[stays], pos[stays]
            alive = new_l < new_r
            self.pick(who[~alive], *old, left[~alive], right[~alive], t)
            who, left, right = who[alive], new_l[alive], new_r[alive]
            if not len(who):
                return
        self.pick(who, sym, pos, left, right, rounds)


def occurrences(h: np.ndarray, starts: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Runs of windows with the same anchor: doc (its place in the chunk), first and last window, symbol and context."""
    found = _Anchors(h, starts, width)
    w = found.windows
    if not len(w):
        return {k: np.empty(0, np.int64) for k in ("doc", "a", "b", "sym", "ctx")}
    found.run(width, rounds)
    change = np.ones(len(w), bool)
    moved = (found.start[1:] != found.start[:-1]) & (found.level[1:] > 0)  # at level 0 the anchor walks along a run of one word
    change[1:] = moved | (found.key[1:] != found.key[:-1]) | (found.level[1:] != found.level[:-1]) | (w[1:] != w[:-1] + 1)
    heads = np.flatnonzero(change)
    a, b = w[heads], w[np.append(heads[1:], len(w)) - 1]
    ctx = combine(SpanHash(h).of(a, b + width), (found.start[heads] - a).astype(np.uint64))
    doc = np.searchsorted(starts, a, side="right") - 1
    return {"doc": doc, "a": a - starts[doc], "b": b - starts[doc], "sym": found.key[heads], "ctx": ctx}


def _scan(width: int, rounds: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, keys in keyed_chunks(batches):
            words, starts = doc_words(texts)
            o = occurrences(hash_words(words), starts, width, rounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(o["sym"].view(np.int64)), pa.array(o["ctx"].view(np.int64)), pa.array(np.array(ids, np.int64)[o["doc"]]), pa.array(np.array(keys, np.int64)[o["doc"]]), pa.array(o["a"].astype(np.int32)), pa.array(o["b"].astype(np.int32))],
                names=["sym", "ctx", "id", "tk", "a", "b"],
            )

    return scan


def _windows(width: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of the given ranges of each document."""
        for batch in batches:
            for k in range(batch.num_rows):
                i, t, tk, edges = (batch.column(c)[k] for c in range(4))
                h = hash_words(t.as_py().encode("utf-8", "surrogatepass").split())
                e = edges.values
                sym, a, b = (e.field(c).to_numpy() for c in range(3))
                at = ragged(a.astype(np.int64), (b - a + 1).astype(np.int64))
                name = np.repeat(sym, b - a + 1)
                win = SpanHash(h).of(at, at + width).view(np.int64)
                head = np.ones(len(at), bool)  # equal windows in a row, as in a run of one word, go as one
                head[1:] = (win[1:] != win[:-1]) | (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(head)
                last = np.append(first[1:], len(at)) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[first]), pa.array(win[first]), pa.array(np.full(len(first), i.as_py())), pa.array(np.full(len(first), tk.as_py())), pa.array(at[first].astype(np.int32)), pa.array(at[last].astype(np.int32))],
                    names=["sym", "win", "id", "tk", "a", "b"],
                )

    return windows


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges of a document that overlap or touch become one."""
    for batch in batches:
        starts, ends = [], []
        for k in range(batch.num_rows):
            v = batch.column(2)[k].values
            s, e = v.field(0).to_numpy(), v.field(1).to_numpy()
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            head = np.ones(len(s), bool)
            head[1:] = s[1:] > e[:-1]
            starts.append(s[head])
            ends.append(e[np.append(np.flatnonzero(head)[1:], len(s)) - 1])
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, kind), pa.array(ends, kind)], names=["id", "tk", "starts", "ends"])


def _cut(as_it_was: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words outside the ranges, joined by one space; if `as_it_was`, a text that loses none stays as it came."""
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                total, removed, kept = [], [], []
                for t, s, e in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    total.append(len(words))
                    if s:
                        left, done = [], 0
                        for x, y in zip(s, e, strict=True):
                            left += words[done:x]
                            done = y
                        words = left + words[done:]
                    removed.append(total[-1] - len(words))
                    kept.append(t if as_it_was and not removed[-1] else b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), batch.column(4)], names=["doc_id", "n_words", "n_removed", "kept", "rest"])

    return cut


def _small(df: DataFrame, count) -> DataFrame:
    n = df.agg(F.sum(count)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_RANGES else df


def repeated_ranges(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words to remove: (id, tk, starts, ends), merged and sorted; tk is xxhash64 of the text."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null").withColumn("tk", F.xxhash64("text"))
    occ = materialize(base.mapInArrow(_scan(width, rounds), "sym long, ctx long, id long, tk long, a int, b int"), "occurrences")
    classes = materialize(occ.groupBy("sym", "ctx").agg(F.min("id").alias("first"), F.max("id").alias("last")), "classes")
    several = classes.groupBy("sym").agg(F.count("*").alias("n"), F.min("first").alias("a"), F.max("last").alias("b")).where("n > 1 and a < b").select("sym", F.lit(True).alias("several"))
    wanted = classes.join(several, "sym", "left").where("several or first < last").select("sym", "ctx", "first", F.coalesce("several", F.lit(False)).alias("several"))
    met = materialize(occ.join(wanted, ["sym", "ctx"]).where("id > first or several").select("sym", "id", "tk", "a", "b", (F.col("id") > F.col("first")).alias("shared")), "met")
    discard(occ, classes)
    edges = materialize(met.where("not shared").groupBy("id", "tk").agg(F.collect_set(F.struct("sym", "a", "b")).alias("edges")), "edges")
    wins = materialize(
        base.join(_small(edges, F.size("edges")), ["id", "tk"]).select("id", "text", "tk", "edges")
        .mapInArrow(_windows(width), "sym long, win long, id long, tk long, a int, b int"), "windows"
    )
    discard(edges)
    firsts = wins.groupBy("sym", "win").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    single = wins.join(firsts, ["sym", "win"]).where("id > first").select("id", "tk", "a", "b")
    every = met.where("shared").select("id", "tk", "a", "b").unionByName(single)
    ranges = every.groupBy("id", "tk").agg(F.collect_set(F.struct("a", (F.col("b") + width).alias("e"))).alias("ranges"))
    out = materialize(ranges.mapInArrow(_merge, "id long, tk long, starts array<int>, ends array<int>"), "ranges")
    discard(met, wins)
    return out


def dedup_substrings(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", as_it_was: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept, rest (the other columns).

    A window is `width` consecutive words of one document; words are runs of
    characters other than space and \\t to \\r. Words covered by a window whose
    words also stand in a document with a smaller id are removed; `kept` joins
    the others by one space; with `as_it_was`, a text that loses no word stays as
    it came, null too. A null text has no words. A document shorter than a window
    loses nothing. A long text is read whole in one task; its arrays take about a
    hundred bytes a word. A row without id takes no part; rows that share an
    id are one document for the comparison, and each is returned with its own
    text. Extra columns may have any name. An empty table gives an empty result.
    """
    bound_batches(docs)
    lean_buffers(docs)
    ranges = repeated_ranges(docs, width, rounds, id_col, text_col)
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*(F.col(f"`{c}`") for c in others))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest.alias("rest")).where("id is not null").withColumn("tk", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(_small(ranges, F.size("starts")), ["id", "tk"], "left").select("id", "text", "starts", "ends", "rest")
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), joined.schema["rest"]])
    return joined.mapInArrow(_cut(as_it_was), kinds)
