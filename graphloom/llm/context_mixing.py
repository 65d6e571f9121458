"""Language-model scores by context mixing in reading order.

A text is its words and one end. Each is written as bits: frequent words, the end
and an escape for all others have a code by their counts, short for frequent ones.
Each bit is predicted from counts in contexts: none (exact counts), the word before
and the two words before (hashed tables of all training documents), and what the
text itself has shown so far. The predictions' logits are mixed by weights which a
gate selects from how much the contexts have seen. The weights start at START and
learn online: along a text, after each block of words, they are corrected by the
errors made in it. An adaptive map, also learned along the text, refines the mixed
probability. After an escape a word is known by its discounted count, or is new and
spelled by the mixed bit predictors of `lm_scoring`.

Texts are mixed side by side, block by block. Nothing depends on how documents lie
in partitions. The tables of contexts have at most 2^CONTEXT_BITS slots each, beyond
which contexts share slots and tell less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import GOLDEN, bound_batches, combine, hash_words, lean_buffers, mix, ragged, text_chunks
from graphloom.llm.language_id import LanguageModel
from graphloom.llm.lm_scoring import LN10, MULTIPLIER, PART_SCHEMA, fit, sum_tables, table_parts, word_counts
from graphloom.scratch import discard, materialize

#: Words that have a code of their own at most, and log2 of the slots of a context table at most.
HEAD_WORDS, CONTEXT_BITS = 1 << 18, 21
#: Words of a text after which its weights are corrected, and bytes of text that are mixed side by side.
BLOCK, MIX_BYTES = 64, 1 << 19
INPUTS, LEVELS = 5, 24
#: Steps of a logit in a context table.
STEPS = 512
PRIOR, RATE, MAP_PRIOR = 0.4, 0.15, 30.0
#: Weights of a text's first words: for each input (no context, one word, two words, the text itself, constant) by gate (how
#: much two words have seen, 0 to 3, by how much one word has).
START = np.array([
    [0.40, 0.40, 0.25, 0.20, 0.40, 0.35, 0.20, 0.05, 0.40, 0.35, 0.20, 0.05, 0.35, 0.30, 0.15, 0.00],
    [0.05, 0.20, 0.35, 0.45, 0.10, 0.25, 0.40, 0.50, 0.15, 0.35, 0.45, 0.50, 0.15, 0.60, 0.50, 0.20],
    [0.00, 0.05, 0.10, 0.05, 0.05, 0.08, 0.10, 0.10, 0.10, 0.25, 0.25, 0.20, 0.10, 0.35, 0.60, 0.65],
    [0.55, 0.50, 0.40, 0.25, 0.50, 0.50, 0.40, 0.30, 0.55, 0.50, 0.40, 0.30, 0.55, 0.40, 0.30, 0.25],
    [0.05] * 16,
], np.float32)


class WordCode:
    """Codes of words by their hashes, of the escape and of the end: Huffman's lengths, shorter codes before longer ones.

    The inner nodes of the tree are numbered by depth, then prefix. What tasks are sent is a
    hash and a length for each word and a logit for each node; the rest is derived from that.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, escapes: float, ends: float):
        self.hashes = hashes
        weight = np.concatenate([counts, [max(escapes, 0.5), max(ends, 0.5)]]).astype(np.float64)
        self.escape, self.end = len(counts), len(counts) + 1
        self.length = huffman_lengths(np.maximum(weight, weight.sum() / 2**30))  # bounded lengths
        order, code, depth, prefix = self._tree()
        most = int(self.length.max())
        first, sums = code[order] << (most - self.length[order]), np.concatenate([[0.0], np.cumsum(weight[order])])
        begin, span = prefix << (most - depth), np.int64(1) << (most - depth)
        low, middle, high = (sums[np.searchsorted(first, begin + part)] for part in (0, span // 2, span))
        self.base = np.log((high - middle + PRIOR) / (middle - low + PRIOR)).astype(np.float32)
        self._derived: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"length": self.length.astype(np.uint8), "_derived": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"length": state["length"].astype(np.int64)})

    def _tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols in the order of codes, their codes, and depth and prefix of each node."""
        order = np.argsort(self.length, kind="stable")
        code, depth, prefix, at, begin = np.empty(len(order), np.int64), [], [], 0, 0
        self._node = []  # for each depth what a prefix is off its node's number by
        numbered = 0
        for d, n in enumerate(np.bincount(self.length).tolist()):
            code[order[at : at + n]] = begin + np.arange(n)
            at, begin = at + n, begin + n
            inner = (1 << d) - begin
            self._node.append(numbered - begin)
            depth.append(np.full(inner, d, np.int64))
            prefix.append(begin + np.arange(inner, dtype=np.int64))
            numbered, begin = numbered + inner, begin * 2
        return order, code, np.concatenate(depth), np.concatenate(prefix)

    def derived(self) -> tuple[pd.Index, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the hashes; start of each symbol's bits; of each bit node * 2 + value; of each node its place in tables."""
        if self._derived is None:
            _, code, depth, prefix = self._tree()
            length = self.length
            size, bits = np.repeat(length, length), np.repeat(code, length)
            at = ragged(np.zeros(len(length), np.int64), length)
            path = (np.array(self._node)[at] + (bits >> (size - at))) * 2 + (bits >> (size - 1 - at) & 1)
            # three levels lie side by side, so that a context's slots share a cache line
            below = depth % 3
            top = (np.int64(1) << (depth - below)) | (prefix >> below)
            place = (mix(top.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) & ~7 | (1 << below) | (prefix & ((1 << below) - 1))
            self._derived = pd.Index(self.hashes), np.cumsum(length) - length, path.astype(np.int32), place.astype(np.uint32)
        return self._derived

    def symbols(self, h: np.ndarray) -> np.ndarray:
        at = self.derived()[0].get_indexer(h) if len(self.hashes) else np.full(len(h), -1)
        return np.where(at < 0, self.escape, at)


def huffman_lengths(weight: np.ndarray) -> np.ndarray:
    """Lengths of Huffman's codes for these weights (two at least), by two queues."""
    order = np.argsort(weight, kind="stable")
    n = len(order)
    leaves, inner = weight[order].tolist(), []
    parent = np.empty(2 * n - 1, np.int64)
    leaf = node = 0
    for new in range(n - 1):
        total = 0.0
        for _ in range(2):
            if node >= new or (leaf < n and leaves[leaf] <= inner[node]):
                total += leaves[leaf]
                parent[leaf] = n + new
                leaf += 1
            else:
                total += inner[node]
                parent[n + node] = n + new
                node += 1
        inner.append(total)
    depth = [0] * (2 * n - 1)
    up = parent.tolist()
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[up[k]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


class Places:
    """The bits of a set of texts, block after block: (word hashes of all texts, where each text's begin)."""

    def __init__(self, code: WordCode, h: np.ndarray, starts: np.ndarray, table_bits: int):
        n = len(starts) - 1
        size = np.diff(starts) + 1  # with the end
        self.rank = np.argsort(-size, kind="stable")  # long texts first: those that reach a block are the first ones
        size = size[self.rank]
        doc, place = np.repeat(np.arange(n), size), ragged(np.zeros(n, np.int64), size)
        ends = np.cumsum(size) - 1
        source = ragged(starts[:-1][self.rank], size)
        source[ends] = len(h)
        own, symbol = np.append(h.view(np.uint64), np.uint64(0))[source], np.append(code.symbols(h), code.end)[source]
        one, two = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
        one[1:] = own[:-1]  # an end is 0, as what is before a text
        two[2:] = own[:-2]
        two[ends - size + 1] = 0
        order = np.argsort(place // BLOCK, kind="stable")
        symbol, self._doc, one, two = symbol[order], doc[order], one[order], two[order]
        of_block = np.bincount(place // BLOCK)
        self.reach = np.searchsorted(-size, -BLOCK * np.arange(len(of_block)))
        self._length = code.length[symbol]
        begins = np.flatnonzero(np.diff(self._doc, prepend=-1) | (np.diff(place[order] // BLOCK, prepend=-1) != 0))
        self.segments = np.add.reduceat(self._length, begins)  # bits of each text in each block that it reaches
        self.cuts = np.concatenate([[0], np.cumsum(self._length)[np.cumsum(of_block) - 1]])
        _, start, path, node_place = code.derived()
        path = path[ragged(start[symbol], self._length)]
        self.value, self.node, self.docs = (path & 1).astype(np.uint8), path >> 1, n
        spread, most = node_place.take(self.node), np.uint32((1 << table_bits) - 1)
        self.slots = [(np.repeat((mix(c) >> np.uint64(32)).astype(np.uint32), self._length) ^ spread) & most for c in (one, combine(one, two))]

    def shown(self) -> np.ndarray:
        """The logit of what the text itself has shown at the same node before."""
        n = len(self.value)
        doc = mix(np.arange(1, self.docs + 1, dtype=np.uint64))[self._doc]
        width = int(n).bit_length() + 1
        x = np.repeat(doc, self._length)
        x ^= self.node.astype(np.uint64) * GOLDEN
        x *= MULTIPLIER
        x &= ~np.uint64((1 << width) - 1)
        x |= np.arange(n, dtype=np.uint64) << np.uint64(1)
        x |= self.value
        x.sort()
        v = (x & np.uint64(1)).astype(np.int32)
        at = ((x & np.uint64((1 << width) - 1)) >> np.uint64(1)).view(np.int64)
        x >>= np.uint64(width)
        begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        many = np.diff(np.append(begin, n))
        before = np.cumsum(v, dtype=np.int32)
        before -= v
        before -= np.repeat(before[begin], many)
        ones = before.astype(np.float32)
        zeros = np.arange(n, dtype=np.int32)
        zeros -= np.repeat(begin.astype(np.int32), many)
        zeros -= before
        ones += np.float32(PRIOR)
        ones /= zeros.astype(np.float32) + np.float32(PRIOR)
        out = np.empty(n, np.float32)
        out[at] = np.log(ones)
        return out

    def inputs(self, code: WordCode, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the predictors (without the constant) and the gate of each bit."""
        x = np.empty((INPUTS - 1, len(self.value)), np.float32)
        x[0] = code.base.take(self.node)
        seen = []
        for k, (slot, table) in enumerate(zip(self.slots, tables, strict=True), start=1):
            cell = table.take(slot.astype(np.int64))
            seen.append((cell & 3).astype(np.uint8))
            np.multiply(cell >> 2, np.float32(1 / STEPS), out=x[k], casting="unsafe")
        x[3] = self.shown()
        return x, seen[1] * np.uint8(4) + seen[0]

    def log(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Natural log of each text's probability; weights and map are corrected along each text."""
        own, gates = np.zeros((INPUTS, self.docs), np.float32), START.shape[1]
        middle = 1 / (1 + np.exp(-(np.arange(LEVELS) - LEVELS // 2) / 1.5))
        ones, every = np.tile(MAP_PRIOR * middle, self.docs), np.full(self.docs * LEVELS, MAP_PRIOR)
        total, at = np.zeros(self.docs), 0
        for a, b, n in zip(self.cuts[:-1], self.cuts[1:], self.reach, strict=True):
            bits = self.segments[at : at + n]
            begin, doc, at = np.cumsum(bits) - bits, np.repeat(np.arange(n), bits), at + n
            part, v = x[:, a:b], self.value[a:b]
            weights = (START[:, None] + own[:, :n, None]).reshape(INPUTS, -1)
            chosen = doc * gates
            chosen += gate[a:b]
            logit = weights[-1].take(chosen)
            for k in range(INPUTS - 1):
                logit += weights[k].take(chosen) * part[k]
            np.clip(logit, -16, 16, out=logit)
            mixed = np.exp(-logit)
            mixed += 1
            np.reciprocal(mixed, out=mixed)
            logit *= np.float32(1.5)
            logit += np.float32(LEVELS // 2 + 0.5)
            cell = doc * LEVELS
            cell += np.clip(logit, 0, LEVELS - 1, out=logit).astype(np.int64)
            prob = (0.25 * ones[: n * LEVELS] / every[: n * LEVELS]).astype(np.float32).take(cell)
            prob += np.float32(0.75) * mixed
            np.clip(prob, 1e-6, 1 - 1e-6, out=prob)
            prob += v
            prob -= 1
            np.abs(prob, out=prob)
            total[:n] += np.add.reduceat(np.log(prob, out=prob), begin, dtype=np.float64)
            wrong = v - mixed
            for k in range(INPUTS - 1):
                own[k, :n] += np.float32(RATE / BLOCK) * np.add.reduceat(wrong * part[k], begin)
            own[-1, :n] += np.float32(RATE / BLOCK) * np.add.reduceat(wrong, begin)
            cell *= 2
            cell += v
            met = np.bincount(cell, minlength=2 * n * LEVELS)
            ones[: n * LEVELS] += met[1::2]
            every[: n * LEVELS] += met[::2] + met[1::2]
        out = np.empty(self.docs)
        out[self.rank] = total
        return out


def frozen(counts: np.ndarray, strong: float) -> np.ndarray:
    """Of each slot of a table its logit in 1/STEPS, times 4, and the step of the gate: how much it has seen."""
    a, b = counts[::2].astype(np.float32), counts[1::2].astype(np.float32)
    seen = np.minimum(3, np.log2(1 + a + b) / strong).astype(np.int16)
    logit = np.log((b + np.float32(PRIOR)) / (a + np.float32(PRIOR)))
    return np.clip(np.rint(logit * STEPS), -8191, 8191).astype(np.int16) * np.int16(4) + seen


def _split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    split = [b.lower().split() for b in raw]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    return hash_words([w for s in split for w in s]).view(np.int64), starts, [len(b) for b in raw]


def _count_contexts(shared, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        tables = [np.zeros(2 << bits, np.uint32) for _ in range(2)]
        for _, texts in text_chunks(batches, MIX_BYTES):
            h, starts, _ = _split(texts)
            p = Places(code, h, starts, bits)
            for t, slot in zip(tables, p.slots, strict=True):
                at = slot.astype(np.int64) * 2
                at += p.value
                np.add.at(t, at, np.uint32(1))
        yield from table_parts(tables)

    return count


def _mix_texts(shared, bits: int):
    names = ["uid", "id", "size", "n_tokens", "n_known", "h", "n", "base", "s"]

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 7 else pa.float64()) for k, c in enumerate(columns)], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, c_head, c_end = shared.value
        base_head = np.append(np.log10(c_head + 0.5), 0.0)
        for keys, texts in text_chunks(batches, MIX_BYTES):
            h, starts, size = _split(texts)
            n = len(size)
            p = Places(code, h, starts, bits)
            s = p.log(*p.inputs(code, tables)) / LN10
            doc, symbol = np.repeat(np.arange(n), np.diff(starts)), code.symbols(h)
            known = np.bincount(doc, symbol != code.escape, minlength=n).astype(np.int64) + (c_end > 0)
            none = [None] * n
            uid = np.array([k["uid"] for k in keys], np.int64)
            yield rows(uid, [k["id"] for k in keys], size, np.diff(starts) + 1, known, none, none, np.bincount(doc, base_head[symbol], minlength=n) + np.log10(c_end + 0.5), s)
            rare = np.flatnonzero(symbol == code.escape)
            if len(rare):
                rare = rare[np.lexsort((h[rare], doc[rare]))]
                d, w = doc[rare], h[rare]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
                none = [None] * len(first)
                yield rows(uid[d[first]], none, none, none, none, w[first], np.diff(np.append(first, len(d))), none, none)

    return score


def _escaped(shared, new: float, discount: float, room: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words, c = part.column(0).to_pylist(), part.column(1).to_numpy()
                s = np.log10(np.maximum(c - discount, 1e-9) / room)
                unknown = np.flatnonzero(c == 0)
                if len(unknown):
                    s[unknown] = np.log10(new) + shared.value.log10([words[k] for k in unknown])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(hash_words(words).view(np.int64)), part.column(1), pa.array(s)], names=["h", "c", "s"])

    return score


def mix_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    As `lm_scoring.score_documents` (rows, nulls and the columns' meaning are the
    same), but every word is coded bit by bit and predicted from its context.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    usable = docs.where(F.col(id_col).isNotNull())
    bound_batches(docs)
    lean_buffers(docs)
    learnt = usable.where(F.coalesce(training, F.lit(False))).select(F.lit(0).alias("key"), F.col(text_col).alias("text"))
    once = materialize(word_counts(usable, training, LanguageModel([], [], []), [], text_col, by=("word",)), "word-counts")
    model = fit(once.select("word", F.lit(0).alias("kind"), "c"), 1)
    group = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.pow(F.lit(2.0), F.length(F.bin("c")) - 1).cast("long"))
    classes = once.where(F.octet_length("word") > 0).groupBy(group.alias("least")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("least")).collect()
    least, room, tokens, types = 1 << 62, HEAD_WORDS, 0, 0
    for r in classes:
        tokens, types = tokens + r.c, types + (r.n if r.least else 0)
        room -= r.n
        if room >= 0 and r.least >= 2:
            least = r.least
        elif r.least:
            room = -1
    c_end = int(once.where(F.octet_length("word") == 0).agg(F.sum("c")).first()[0] or 0)
    n, v = tokens + c_end, types + (c_end > 0)
    head = once.where((F.octet_length("word") > 0) & (F.col("c") >= least)).toArrow()
    hashes, c_head = hash_words(head.column("word").to_pylist()).view(np.int64), head.column("c").to_numpy()
    del head
    order = np.argsort(hashes)  # codes do not depend on the order of rows
    hashes, c_head = hashes[order], c_head[order]
    n_of = {r.least: r.n for r in classes}
    discount = min(0.9, max(0.1, n_of.get(1, 0) / max(1, n_of.get(1, 0) + 2 * n_of.get(2, 0))))
    tail_tokens, tail_types = tokens - int(c_head.sum()), types - len(c_head)
    code = WordCode(hashes, c_head - discount, tail_tokens + discount * len(c_head), c_end)
    bits = min(CONTEXT_BITS, max(10, (8 * n).bit_length()))
    shared = sc.broadcast(code)
    tables = sum_tables(learnt.mapInArrow(_count_contexts(shared, bits), PART_SCHEMA), [2 << bits] * 2)
    shared.destroy()
    shared = sc.broadcast((code, [frozen(t, strong) for t, strong in zip(tables, (3, 1.5), strict=True)], c_head, c_end))
    speller = sc.broadcast(model)
    escaped = once.where((F.octet_length("word") > 0) & (F.col("c") < least))
    scored = materialize(escaped.mapInArrow(_escaped(speller, (discount * tail_types + 1) / (tail_tokens + 1), discount, tail_tokens + 1), "h long, c long, s double"), "word-scores")
    speller.destroy()
    rows = usable.select(F.struct(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id")).alias("key"), F.col(text_col).alias("text"))
    mixed = materialize(rows.mapInArrow(_mix_texts(shared, bits), "uid long, id long, size long, n_tokens long, n_known long, h long, n long, base double, s double"), "doc-scores")
    shared.destroy()
    discard(once)
    rare = (
        mixed.where("h is not null").select("uid", "h", "n").join(scored.withColumnRenamed("s", "s2"), "h").groupBy("uid")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k2"), F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("b2"), F.sum(F.col("n") * F.col("s2")).alias("s2"))
    )
    whole = mixed.where("h is null").join(rare, "uid", "left")
    score = F.col("s") + F.coalesce("s2", F.lit(0.0))
    return whole.select(
        F.col("id").alias("doc_id"), "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        score.alias("score"), (-score / float(np.log10(2)) / (F.col("size") + 1)).alias("bits_per_byte"),
    )
