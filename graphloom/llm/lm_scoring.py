"""Language-model scores by logistic context mixing over bits.

A text is its words and one end. Documents are divided into kinds, the languages
that language identification tells apart. Within a kind a word is known by its
exact count in training, or it is spelled: a share of a kind's tokens, that of
words met once, goes to words by their spelling.

For spelling each word is bytes with a closing symbol (an end is the closing
symbol alone), each byte the bits of a Huffman code of the corpus. Predictors give
each bit a probability from counts in hashed tables, by context: two and three
bytes before and the whole word so far, over all kinds, and one and three bytes
and the whole word so far within a kind. Their logits are mixed by weights which a
gate selects from how much the longest contexts have seen. An adaptive map refines
the mixed probability from what followed such predictions before. A document's
probability is the mixture over kinds: as its words are read, the kinds that
predict them gain weight, so what a document is like need not be known beforehand.

Training covers every training document, through the table of distinct words and
their counts in each kind, which grows with the corpus and is joined, never held
in one place. The speller learns from it as a table of types, as a new word is
more like a rare one: the predictors' counts are summed over all of them; the
mixer learns online, batch by batch in partitions by the words' hashes, in order
of the words, each word left out of its own counts, and the partitions' weights
are averaged; then the map is counted, again without the word itself. Nothing
depends on the order or the partitions of the documents. The speller's tables
grow with the number of distinct words up to SLOT_BITS, beyond which spellings
blur. Contexts do not cross words: a word's score is computed once and not for
each place, which is what makes whole corpora affordable. Frequent words' scores
are sent to the tasks, rare ones are joined.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, hash_words, mix, ragged, text_chunks
from graphloom.llm.language_id import LanguageModel, features, train
from graphloom.llm.substring_dedup import SpanHash
from graphloom.scratch import discard, materialize

#: log2 of the slots of each predictor's table at most, and slots for each distinct word.
SLOT_BITS, SLOTS_A_WORD = (17, 18, 20, 17, 19, 21), 8
#: Distinct words that a task counts before it passes them on, and scores (of a word in a kind) that are sent to every task at most.
COUNT_WORDS, HEAD_SCORES = 500_000, 1 << 21
#: Words in a batch of the mixer, and words that one partition of its training has at least.
BATCH_WORDS, MIXER_WORDS = 1024, 150_000
GATES, INPUTS, LEVELS = 32, len(SLOT_BITS) + 1, 33
PRIOR = 0.2
#: Entries of a table in a row, where tables are summed over tasks.
PART, PART_SCHEMA = 1 << 16, "k int, at int, blob binary"
MULTIPLIER = np.uint64(0xD1342543DE82EF95)
CLOSE = 0x20
LN10 = float(np.log(10))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For symbols with these counts: (start, length) of each code in the flat arrays of (hashed node, bit)."""
    heap = [(float(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    tree: dict[int, tuple[int, int]] = {}
    node = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        tree[node] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], node, node))
        node += 1
    codes: dict[int, list[tuple[int, int]]] = {}
    walk = [(node - 1, [])]
    while walk:
        at, path = walk.pop()
        if at in tree:
            walk += [(child, [*path, (at - len(counts), bit)]) for bit, child in enumerate(tree[at])]
        else:
            codes[at] = path
    lengths = np.array([len(codes[s]) for s in range(len(counts))], np.int64)
    flat = [x for s in range(len(counts)) for x in codes[s]]
    return np.cumsum(lengths) - lengths, lengths, mix(np.array([n for n, _ in flat], np.uint64)), np.array([b for _, b in flat], np.uint8)


class Bits:
    """The bits of a batch of words, each under a kind: which word, value, and the slot of each predictor."""

    def __init__(self, words: list[bytes], kind: np.ndarray, code: tuple, slot_bits: tuple):
        self.slot_bits = slot_bits
        start, length, nodes, values = code
        sym = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        n = len(sym)
        first = np.ones(n, bool)
        first[1:] = sym[:-1] == CLOSE
        word = np.cumsum(first) - 1
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        place = np.arange(n) - begin
        wide = sym.astype(np.uint64) + np.uint64(1)

        def before(k: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            out[k:] = wide[:-k]
            return np.where(place >= k, out, np.uint64(0))

        b1, b2, b3 = before(1), before(2), before(3)
        prefix = SpanHash(wide).of(begin, np.arange(n))
        two = b1 * np.uint64(512) + b2
        three = two * np.uint64(512) + b3
        self._of = np.repeat(np.arange(n), length[sym])
        at = ragged(start[sym], length[sym])
        self._node = nodes[at]
        self.value = values[at]
        self.word, self._word = word[self._of], word
        self._own = (b1, three, prefix)
        self.slots = [self._slots(k, mix(c + np.uint64(k << 40))) for k, c in enumerate((two, three, prefix))]
        self.under(kind)

    def _slots(self, k: int, context: np.ndarray) -> np.ndarray:
        return (((context[self._of] ^ self._node) * MULTIPLIER) >> np.uint64(64 - self.slot_bits[k])).astype(np.int64)

    def under(self, kind: np.ndarray) -> None:
        """Takes the words to be of these kinds."""
        own = mix(kind.astype(np.uint64) + np.uint64(1))[self._word]
        self.slots = self.slots[:3] + [self._slots(k, mix((c ^ own) + np.uint64(k << 40))) for k, c in enumerate(self._own, start=3)]


@dataclass
class MixModel:
    code: tuple
    #: (zeros, ones) of each predictor.
    tables: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    map_ones: np.ndarray
    map_all: np.ndarray
    #: log10 of the share of each kind, its tokens, and the share of them that is spelled.
    prior: np.ndarray
    tokens: np.ndarray
    spelled: np.ndarray
    _frozen: tuple | None = None
    _pairs: list | None = None

    def __getstate__(self) -> dict:
        """Tables are sent compressed: every executor keeps what is sent to it on its disk."""
        blobs = [[pa.compress(t.tobytes(), codec="zstd", asbytes=True) for t in pair] for pair in self.tables]
        return self.__dict__ | {"tables": list(zip(self.slot_bits, blobs, strict=True)), "_frozen": None, "_pairs": None}

    def __setstate__(self, state: dict) -> None:
        tables = [tuple(np.frombuffer(pa.decompress(b, 4 << bits, codec="zstd", asbytes=True), np.float32) for b in blobs) for bits, blobs in state["tables"]]
        self.__dict__.update(state | {"tables": tables})

    @property
    def slot_bits(self) -> tuple:
        return tuple(len(zeros).bit_length() - 1 for zeros, _ in self.tables)

    def word_log10(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 probability of each word from its count in each kind, or its spelling: one column for each kind."""
        known = (1 - self.spelled) * counts / np.maximum(self.tokens, 1)
        with np.errstate(divide="ignore"):  # of a word that a kind has not: minus infinity
            return np.logaddexp(np.log(known), np.log(self.spelled) + self.log10(words) * LN10) / LN10

    def inputs(self, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the predictors (and a constant) and the gate of each bit, by counts without this occurrence of it."""
        if self._pairs is None:
            self._pairs = [np.stack(pair, axis=1).astype(np.float32).view(np.complex64)[:, 0] for pair in self.tables]
        x = np.ones((INPUTS, len(bits.value)), np.float32)
        own = np.stack([bits.value == 0, bits.value == 1], axis=1).astype(np.float32)
        seen = {}
        for k, (slot, pairs) in enumerate(zip(bits.slots, self._pairs, strict=True)):
            n = pairs.take(slot).view(np.float32).reshape(-1, 2)
            n -= own
            np.maximum(n, 0, out=n)
            if k in (2, 5):
                seen[k] = n[:, 0] + n[:, 1]
            n += np.float32(PRIOR)
            np.log(n[:, 1] / n[:, 0], out=x[k])
        return x, long_gate(seen[5]) * 4 + short_gate(seen[2])

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        logit = np.zeros(len(gate), np.float32)
        for w, row in zip(self.weights.astype(np.float32).T, x, strict=True):
            logit += np.ascontiguousarray(w).take(gate) * row
        return np.clip(logit, -18, 18, out=logit)

    def level(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * LEVELS + np.clip(np.rint(logit * 1.5) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)

    def frozen(self) -> tuple:
        """What scoring looks up: logits of slots, gates of the prefix predictors' slots, and the map as p -> p * slope + offset."""
        if self._frozen is None:
            logits = [np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR))) for n0, n1 in self.tables]
            gates = [g(self.tables[k][0] + self.tables[k][1]).astype(np.uint8) for k, g in ((5, long_gate), (2, short_gate))]
            self._frozen = logits, gates, self.weights.astype(np.float32), 0.5 + 2 / (self.map_all + 4), 0.5 * self.map_ones / (self.map_all + 4)
        return self._frozen

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word (with its close): one column for each kind."""
        logits, gates, weights, slope, offset = self.frozen()
        bits = Bits(words, np.zeros(len(words), np.int64), self.code, self.slot_bits)
        one = bits.value == 1
        known = [logits[k][bits.slots[k]] for k in range(3)]
        low = gates[1][bits.slots[2]].astype(np.int64)
        out = []
        for kind in range(len(self.prior)):
            if kind:
                bits.under(np.full(len(words), kind))
            gate = gates[0][bits.slots[5]].astype(np.int64) * 4 + low
            logit = weights[gate, INPUTS - 1]
            for k in range(INPUTS - 1):
                logit += weights[gate, k] * (known[k] if k < 3 else logits[k][bits.slots[k]])
            logit = np.clip(logit, -18, 18)
            at = self.level(logit, gate)
            p = np.clip(slope[at] / (1 + np.exp(-logit)) + offset[at], 1e-7, 1 - 1e-7)
            out.append(np.bincount(bits.word, np.log10(np.where(one, p, 1 - p)), minlength=len(words)))
        return np.stack(out, axis=1)


def long_gate(seen: np.ndarray) -> np.ndarray:
    return np.minimum(7, np.log2(1 + seen).astype(np.int64))


def short_gate(seen: np.ndarray) -> np.ndarray:
    return np.minimum(3, (np.log2(1 + seen) / 2).astype(np.int64))


def _count_words(shared, names: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, kind, occurrences in training) of bounded sets of words; the end is the empty word. Kind -1: not in training."""
        held = [Counter() for _ in range(max(1, len(names)) + 1)]
        place = {n: k for k, n in enumerate(names)}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(0).to_pylist()]
                kinds = [place.get(n, 0) for n in shared.value.predict(features(texts))[0]] if len(names) > 1 else [0] * len(texts)
                for text, training, kind in zip(texts, part.column(1).to_pylist(), kinds, strict=True):
                    words = text.encode("utf-8", "surrogatepass").lower().split()
                    words.append(b"")
                    held[kind if training else -1].update(words)
                if sum(map(len, held)) >= COUNT_WORDS:
                    yield from _flush(held)
        yield from _flush(held)

    return count


def _flush(held: list[Counter]) -> Iterator[pa.RecordBatch]:
    for k, counter in enumerate(held):
        training = k < len(held) - 1
        words, counts = list(counter), list(counter.values())
        counter.clear()
        for at in range(0, len(words), 50_000):
            w = words[at : at + 50_000]
            c = counts[at : at + 50_000] if training else np.zeros(len(w), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(np.full(len(w), k if training else -1, np.int32)), pa.array(c, pa.int64())], names=["word", "kind", "c"])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_WORDS):
            part = batch.slice(at, BATCH_WORDS)
            yield part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).to_numpy()


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256)
    for words, _, c in _word_batches(batches):
        sym = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        lengths = np.array([len(w) + 1 for w in words])
        total += np.bincount(sym, np.repeat(c, lengths), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["symbol", "n"])


def _count_bits(code: tuple, slot_bits: tuple):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << b, np.uint32) for b in slot_bits]
        for words, kind, _ in _word_batches(batches):
            bits = Bits(words, kind, code, slot_bits)
            for slot, table in zip(bits.slots, tables, strict=True):
                np.add.at(table, 2 * slot + bits.value, np.uint32(1))
        yield from table_parts(tables)

    return count


def table_parts(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The tables' counts as rows of PART_SCHEMA."""
    for k, t in enumerate(tables):
        for at in range(0, len(t), PART):
            blob = pa.compress(t[at : at + PART].tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([blob], pa.binary())], names=["k", "at", "blob"])


def sum_tables(parts: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """The sums of tables of these sizes that tasks have counted, from rows of `table_parts`."""

    def opened(k: int, blob: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(blob, 4 * min(PART, sizes[k]), codec="zstd", asbytes=True), np.uint32)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, at, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k, at] = sums[k, at] + opened(k, blob) if (k, at) in sums else opened(k, blob)
        for (k, at), part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["k", "at", "blob"])

    tables = [np.zeros(n, np.uint32) for n in sizes]
    for r in parts.repartition("k", "at").mapInArrow(total, PART_SCHEMA).collect():
        tables[r.k][r.at : r.at + PART] = opened(r.k, r.blob)
    return tables


def _train_mixer(shared):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: MixModel = shared.value
        model = replace(model, weights=model.weights.copy())
        power, total, step = np.full((GATES, INPUTS), 1e-3), np.zeros(GATES), 0
        for words, kind, c in _word_batches(batches):
            bits = Bits(words, kind, model.code, model.slot_bits)
            w = c[bits.word].astype(np.float64)
            x, gate = model.inputs(bits)
            p = 1 / (1 + np.exp(-model.mixed(x, gate)))
            err = (bits.value - p) * w
            mass = np.bincount(gate, w, minlength=GATES)
            grad = np.stack([np.bincount(gate, err * row, minlength=GATES) for row in x], axis=1) / np.maximum(mass, 1)[:, None]
            power = 0.9 * power + 0.1 * grad**2
            model.weights += 0.05 / np.sqrt(1 + step / 20) * grad / np.sqrt(power + 1e-6)
            total += mass
            step += 1
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["weights", "mass"])

    return train


def _count_map(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: MixModel = shared.value
        ones, every = np.zeros(GATES * LEVELS), np.zeros(GATES * LEVELS)
        for words, kind, c in _word_batches(batches):
            bits = Bits(words, kind, model.code, model.slot_bits)
            x, gate = model.inputs(bits)
            at = model.level(model.mixed(x, gate), gate)
            w = c[bits.word].astype(np.float64)
            every += np.bincount(at, w, minlength=GATES * LEVELS)
            ones += np.bincount(at, w * bits.value, minlength=GATES * LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES * LEVELS, dtype=np.int32)), pa.array(ones), pa.array(every)], names=["at", "ones", "every"])

    return count


def word_counts(docs: DataFrame, training: Column, model: LanguageModel, names: list[str], text_col: str = "text", by: tuple = ("word", "kind")) -> DataFrame:
    """(word, kind, c), or what `by` names: distinct tokens of all documents with their counts in training ones of each kind; the end is the empty word."""
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_count_words(shared, names), "word binary, kind int, c long").groupBy(*by).agg(F.sum("c").alias("c"))


def fit(words: DataFrame, kinds: int) -> MixModel:
    """The model of a table of (word, kind, c); words with c of 0 take no part."""
    spark = words.sparkSession
    known = words.where("c > 0")
    symbols = np.zeros(256)
    for r in known.mapInArrow(_count_bytes, "symbol int, n double").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        symbols[r.symbol] = r.n
    share, tokens, once = np.ones(kinds), np.zeros(kinds), np.zeros(kinds)
    of_kind = known.groupBy("kind").agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once"), F.sum(F.when(F.octet_length("word") == 0, F.col("c")).otherwise(0)).alias("ends"))
    for r in of_kind.collect():
        share[r.kind], tokens[r.kind], once[r.kind] = share[r.kind] + r.ends, r.n, r.once
    spelled = np.where(tokens > 0, (once + 1) / (tokens + 2), 1.0)
    code = huffman(symbols)
    # words in order: a task's words share their beginnings, and so their slots
    types = known.select("word", "kind", F.lit(1).cast("long").alias("c"))
    n_words = known.count()
    slot_bits = tuple(min(b, max(10, (SLOTS_A_WORD * n_words).bit_length())) for b in SLOT_BITS)
    ordered = materialize(types.repartitionByRange(max(1, n_words // COUNT_WORDS), "word"), "ordered-words")
    sums = sum_tables(ordered.mapInArrow(_count_bits(code, slot_bits), PART_SCHEMA), [2 << b for b in slot_bits])
    tables = [(t[::2].astype(np.float32), t[1::2].astype(np.float32)) for t in sums]
    discard(ordered)
    start = np.full((GATES, INPUTS), 0.15)
    start[:, 5], start[:, -1] = 0.5, 0
    model = MixModel(code, tables, start, np.zeros(GATES * LEVELS), np.zeros(GATES * LEVELS), np.log10(share / share.sum()), tokens, spelled)
    shared = spark.sparkContext.broadcast(model)
    total, mass = np.zeros((GATES, INPUTS)), np.zeros(GATES)
    mixers = max(1, n_words // MIXER_WORDS)
    batches = types.repartition(mixers, "word").sortWithinPartitions("word", "kind")
    for r in batches.mapInArrow(_train_mixer(shared), "weights binary, mass binary").collect():
        m = np.frombuffer(r.mass)
        total += np.frombuffer(r.weights).reshape(GATES, INPUTS) * m[:, None]
        mass += m
    shared.destroy()
    model = replace(model, weights=np.where(mass[:, None] > 0, total / np.maximum(mass, 1e-12)[:, None], start))
    shared = spark.sparkContext.broadcast(model)
    ones, every = model.map_ones.copy(), model.map_all.copy()
    for r in types.mapInArrow(_count_map(shared), "at int, ones double, every double").groupBy("at").agg(F.sum("ones").alias("ones"), F.sum("every").alias("every")).collect():
        ones[r.at], every[r.at] = r.ones, r.every
    shared.destroy()
    return replace(model, map_ones=ones, map_all=every)


def _score_words(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_WORDS):
                part = batch.slice(at, BATCH_WORDS)
                words = part.column(0).to_pylist()
                s = shared.value.word_log10(words, np.stack([part.column(k).to_numpy() for k in range(2, part.num_columns)], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(hash_words(words).view(np.int64)), part.column(1), *map(pa.array, s.T)], names=["h", "c", *_kind_names(s.shape[1])])

    return score


def _kind_names(kinds: int) -> list[str]:
    return [f"s{k}" for k in range(kinds)]


def _score_docs(shared, end: tuple[int, np.ndarray], names: list[str]):
    kinds = len(names) - 8
    longs = len(names) - kinds - 1

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < longs else pa.float64()) for k, c in enumerate(columns)], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h_head, c_head, *s_head = shared.value
        head = pd.Index(h_head)
        base_head = np.append(np.log10(c_head + 0.5), 0.0)
        known_head, s_head = np.append(c_head > 0, False), [np.append(s, 0.0) for s in s_head]
        c_end, s_end = end
        for keys, texts in text_chunks(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            split = [b.lower().split() for b in raw]
            size = np.array([len(x) for x in split], np.int64)
            h = hash_words([w for x in split for w in x]).view(np.int64)
            at = head.get_indexer(h) if len(h_head) else np.full(len(h), -1)
            n = len(raw)
            doc = np.repeat(np.arange(n), size)
            total = lambda v, doc=doc, n=n: np.bincount(doc, v, minlength=n)
            uid, ids = np.array([k["uid"] for k in keys], np.int64), [k["id"] for k in keys]
            none = [None] * n
            yield rows(
                uid, ids, [len(b) for b in raw], size + 1, total(known_head[at]).astype(np.int64) + (c_end > 0), none, none,
                total(base_head[at]) + np.log10(c_end + 0.5), *(total(s[at]) + e for s, e in zip(s_head, s_end, strict=True)),
            )
            rare = at < 0
            if rare.any():
                order = np.lexsort((h[rare], doc[rare]))
                d, w = doc[rare][order], h[rare][order]
                first = np.ones(len(d), bool)
                first[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
                places = np.flatnonzero(first)
                none = [None] * len(places)
                yield rows(uid[d[places]], none, none, none, none, w[places], np.diff(np.append(places, len(d))), none, *[none] * kinds)

    return score


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    `training` selects the documents to learn from (null: not). The kinds are the
    languages that a classifier learns from the training documents that have a
    value in `lang_col` (a bounded sample of them, see `language_id.train`);
    without that column, or such documents, there is one kind. Tokens are the
    words, A-Z lower-cased, and one end. base_score is the log10 probability by
    additively smoothed token counts, score that by the mixed model, for the same
    tokens; bits_per_byte spreads it over the text's bytes and one for the end. A
    null text counts as empty: one end. Without training documents all counts are
    0 and the model is the prior's. A long text's words are counted and scored in
    one task. A row without id takes no part, neither
    learned from nor returned; repeated rows are learned from and returned each.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    usable = docs.where(F.col(id_col).isNotNull())
    bound_batches(docs)
    speaks = LanguageModel([], [], []) if lang_col is None else train(usable.where(F.coalesce(training, F.lit(False))), id_col, text_col, lang_col)
    langs = sorted(n for family in speaks.families for n in family)
    names = _kind_names(max(1, len(langs)))
    words = materialize(word_counts(usable, training, speaks, langs, text_col), "words")
    model = fit(words, len(names))
    shared_model = spark.sparkContext.broadcast(model)
    once = words.groupBy("word").agg(F.sum("c").alias("c"), *(F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(len(names))))
    scored = materialize(once.mapInArrow(_score_words(shared_model), f"h long, c long, {', '.join(f'{s} double' for s in names)}"), "word-scores")
    shared_model.destroy()
    n, v = (x or 0 for x in scored.where("c > 0").agg(F.sum("c"), F.count("*")).first())
    least, room = 1 << 62, HEAD_SCORES // len(names)  # the largest head of whole count classes that has room
    for r in scored.groupBy(F.least("c", F.lit(1000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        room -= r.n
        if room < 0:
            break
        least = r.c
    head = scored.where(F.col("c") >= least).toArrow()
    shared = spark.sparkContext.broadcast(tuple(head.column(k).to_numpy() for k in ("h", "c", *names)))
    c_ends = np.zeros((1, len(names)))
    for r in words.where((F.octet_length("word") == 0) & (F.col("kind") >= 0)).select("kind", "c").collect():
        c_ends[0, r.kind] = r.c
    c_end = int(c_ends.sum())
    discard(words)
    rows = usable.select(F.struct(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id")).alias("key"), F.col(text_col).alias("text"))
    columns = ["uid", "id", "size", "n_tokens", "n_known", "h", "n", "base", *names]
    kinds = ", ".join(f"{c} {'double' if c == 'base' or c in names else 'long'}" for c in columns)
    parts = materialize(rows.mapInArrow(_score_docs(shared, (c_end, model.word_log10([b""], c_ends)[0]), columns), kinds), "doc-scores")
    shared.destroy()
    rare = (
        parts.where("h is not null").select("uid", "h", "n").join(scored, "h").groupBy("uid")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k2"), F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("b2"), *(F.sum(F.col("n") * F.col(s)).alias(f"{s}2") for s in names))
    )
    whole = parts.where("h is null").join(rare, "uid", "left")
    for s, prior in zip(names, model.prior, strict=True):
        whole = whole.withColumn(s, F.col(s) + F.coalesce(f"{s}2", F.lit(0.0)) + float(prior))
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    score = best + F.log10(sum((F.pow(F.lit(10.0), F.col(s) - best) for s in names), F.lit(0.0)))
    return whole.select(
        F.col("id").alias("doc_id"), "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        score.alias("score"), (-score / float(np.log10(2)) / (F.col("size") + 1)).alias("bits_per_byte"),
    )
