"""N-gram Jaccard join: prefixes of shingles, with token combinations for frequent ones.

A document's set holds the hashes of its five-word shingles. Sets are ordered:
shingles that no other document has, then rare, then frequent ones. With
similarity t, two sets of a linked pair share a shingle among the first
n - ceil(t n) + 1 of each, and k of them among the first n - ceil(t n) + k. So a
rare shingle in the prefix is an index entry by itself, and one that stands alone
needs none: most documents have no entries at all. Which shingles stand alone is
found by an exchange of Golomb-coded hashes and told to all tasks as a bitmap of
bounded size; if a corpus fills it, more shingles count as rare, and links are
still all found.
Frequent ones come into a prefix only where a document has few others; in short
documents, where such chance meetings are common, the prefix is extended by one
and pairs of frequent shingles are indexed instead; long ones index them singly.
Documents near the border between short and long do both, so that no pair falls
between. Pairs that meet are first held against each other by bitmaps (one
parity bit for each shingle, about): bits that differ never outnumber shingles
that differ, so a pair with too many is no link. The rest are verified on the
whole sets.

Documents with equal sets are one class throughout, so copies are never paired.
In each list of classes with the same entry all are first compared with a few of
them; what this links is contracted, and lists within one component are
done. In the lists that are left, the classes outside the list's main component
are compared with all classes of the list, in cells of bounded size: first by
bitmaps, which leaves the classes that may be linked with another of the cell,
then a task gets their whole sets, counts what each two of them share and returns
only links that join components, fewer than the cell has classes. Similar lists fall
to the same task and are compared once. Links between classes of one component
add nothing to the components and are not computed.

Bounds: a shingle, and a class (an equal set), is named by 64 bits, so at 10**10
distinct sets a few wrong merges are to be expected. A list whose classes stay
in different components is compared in (its length / LIST_BLOCK)**2 / 2 cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import GOLDEN, bound_batches, combine, counted, distinct, doc_words, hash_words, keyed_chunks, mix, ragged, release, text_chunks, windows_hash
from graphloom.llm.exact_dedup import golomb_decode, golomb_encode
from graphloom.operators.components import connected_components
from graphloom.scratch import discard, materialize, shuffle_width

WORDS, SIMILARITY = 5, 75
#: Turns in which the classes of a list are compared with a few of them only, and these pivots.
STARS, PIVOTS = 1, 4
#: Classes of a task's cell that are compared with each other whether or not they share a list.
TOGETHER = 48
#: Classes, and shingles of them, in a block of a list, about; two blocks make a cell, whose classes are compared in one task.
LIST_BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Lists longer than LIST_BLOCK and than rows / HOT_LISTS are told to all tasks; there cannot be more than HOT_LISTS of them.
HOT_LISTS = 1_000_000
#: Shingles of sets that one task of that comparison gets on average at most.
TASK_SHINGLES = 4_000_000
#: Sets of up to so many shingles are short.
SHORT = 96
#: Shingles that count as frequent at most (8 bytes each are sent to every task): those found in more documents than
#: total shingles / FREQUENT, so there cannot be more.
FREQUENT, LEAST_FREQUENT = 4_000_000, 16
#: log2 of the bits of the map of shared shingles (a quarter of all shingles, between these), bits of a hash in the exchange, and
#: characters of text for one owner of it.
MAP_BITS, HASH_BITS, OWNER_CHARS = (20, 28), 40, 12_000_000
#: Text read at a time to count shingles, and index entries that one owner gets on average at most.
COUNT_BYTES, OWNER_ENTRIES = 2 << 20, 1_000_000
#: Classes of more copies than this and than rows / HOT_LISTS are joined by broadcast.
HOT_COPIES = 10_000
#: Ids up to this number (16 bytes each) are broadcast to fetch the texts of candidates; beyond it the fetch is a shuffle join.
BROADCAST_IDS = 2_000_000


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words, the whole sequence is the one shingle."""
    all_words, starts = doc_words(texts, lower=True)
    h = hash_words(all_words)
    grams = windows_hash(h, words)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= words:
            out.append(distinct(grams[a : b - words + 1]))
        else:
            out.append(windows_hash(h[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def class_key(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = int(mix(s).sum(dtype=np.uint64)) + len(s) * int(GOLDEN) & (1 << 64) - 1
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def parity_bits(s: np.ndarray) -> bytes:
    """A bit for each of 2**k >= 2n slots: whether an odd number of the set's hashes fall there."""
    size = max(256, 2 << (len(s) - 1).bit_length()) if len(s) else 256
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ, the longer folded to the shorter: at most the shingles of one set only."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def needed(n: int, similarity: int) -> int:
    """Shingles that a set of n shares at least with any set it is linked to."""
    return -(-similarity * n // 100)


def index_entries(s: np.ndarray, shared: np.ndarray, frequent: np.ndarray, similarity: int = SIMILARITY, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """(entries by rare shingles, entries by frequent shingles or pairs of them) of a sorted set.

    `shared` marks the shingles that other sets may have; `frequent` is sorted.
    """
    n = len(s)
    size = n - needed(n, similarity) + 1
    pairs = 100 * n <= 100 * 100 * short // similarity
    singles = 100 * n > similarity * short
    extended = min(n, size + 1) if pairs and n > 1 else size
    alone = n - int(shared.sum())
    if not n or alone >= extended:
        return s[:0], s[:0]
    rest = s[shared]
    at = np.searchsorted(frequent, rest)
    often = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == rest) if len(frequent) else np.zeros(len(rest), bool)
    order = np.concatenate([rest[~often], rest[often]])  # what follows those that stand alone
    n_rare = len(rest) - int(often.sum())
    size, extended = size - alone, extended - alone
    entries = []
    if singles:
        entries.append(order[n_rare : max(size, n_rare)])
    if pairs:
        f = order[n_rare : max(extended, n_rare)]
        i, j = np.triu_indices(len(f), 1)
        entries.append(combine(f[i] ^ GOLDEN, f[j]))
    return order[: min(n_rare, extended)], np.concatenate(entries)


COUNTED = "shingle long, n long, owner int, k int, coded binary"


def _count(words: int, owners: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each stretch of text: the number of shingles, those in several sets with how many, and all of them, coded for their owners."""
        for _, texts in text_chunks(batches, COUNT_BYTES):
            sets = shingle_sets(texts, words)
            _, firsts = np.unique(np.array([class_key(s) if len(s) else 0 for s in sets], np.int64), return_index=True)
            values, n = counted(np.concatenate([sets[k] for k in firsts]))
            often = n > 1
            short = values >> np.uint64(64 - HASH_BITS)
            coded = []
            for part in (short, short[often]):  # what several sets have is sent twice
                part = distinct(part)
                cuts = np.searchsorted(part, np.arange(owners + 1, dtype=np.uint64) * np.uint64((1 << HASH_BITS) // owners + 1))
                coded += [(o, b - a, *golomb_encode(part[a:b])) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            yield _counted(1, n=[int(n.sum())])
            yield _counted(int(often.sum()), shingle=values[often].view(np.int64), n=n[often])
            if coded:
                owner, size, k, blob = map(list, zip(*coded, strict=True))
                yield _counted(len(coded), owner=owner, n=size, k=k, coded=blob)

    return count


def _counted(rows: int, **columns) -> pa.RecordBatch:
    kinds = {"shingle": pa.int64(), "n": pa.int64(), "owner": pa.int32(), "k": pa.int32(), "coded": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(rows, kind) for c, kind in kinds.items()], names=list(kinds))


def _shared(map_bits: int):
    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        """An owner: its part of the map of hashes that it got more than once."""
        values, n = counted(np.concatenate([golomb_decode(c, k, b) for c, k, b in zip(pdf.n, pdf.k, pdf.coded, strict=True)]))
        slots = distinct((values[n > 1] >> np.uint64(HASH_BITS - map_bits)).astype(np.int64))
        first = int(slots[0]) // 8 if len(slots) else 0
        bits = np.zeros((int(slots[-1]) // 8 - first + 1) * 8 if len(slots) else 0, np.uint8)
        bits[slots - first * 8] = 1
        return pd.DataFrame({"first": [first], "bits": [np.packbits(bits).tobytes()]})

    return shared


def is_shared(s: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = (s >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)).astype(np.int64)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


INDEX = "id long, tk long, n int, w int, ck long, bits binary, sig long, owner int, sigs binary, places binary, cks binary, ns binary"


def _index(words: int, similarity: int, owners: int, shared):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, bitmap = shared.value
        for ids, texts, tks in keyed_chunks(batches):
            sets = shingle_sets(texts, words)
            n = np.array([len(s) for s in sets], np.int32)
            ck = np.array([class_key(s) if len(s) else 0 for s in sets], np.int64)
            nulls = [None] * len(ids)
            yield _batch(ids, tks, n, nulls, ck, [parity_bits(s) for s in sets], nulls, nulls, nulls, nulls, nulls, nulls)
            rare, place, fsig, fplace = [], [], [], []
            _, firsts = np.unique(ck, return_index=True)
            w = np.zeros(len(ids), np.int32)
            for k in firsts:
                a, b = index_entries(sets[k], is_shared(sets[k], bitmap), frequent, similarity)
                w[k] = 1000 * (len(a) + len(b)) // max(n[k], 1)
                rare.append(a)
                place.append(np.full(len(a), k, np.uint32))
                fsig.append(b)
                fplace.append(np.full(len(b), k, np.uint32))
            fsig, fplace = np.concatenate(fsig), np.concatenate(fplace)
            if len(fsig):
                nulls = [None] * len(fsig)
                yield _batch(nulls, nulls, n[fplace], w[fplace], ck[fplace], nulls, fsig.view(np.int64), nulls, nulls, nulls, nulls, nulls)
            rare, place = np.concatenate(rare), np.concatenate(place)
            order = np.argsort(rare)
            rare, place = rare[order], place[order]
            # owners hold ranges of the upper half of the hash
            cuts = np.searchsorted((rare >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32), np.arange(owners + 1))
            rows = []
            for o in range(owners):
                a, b = cuts[o], cuts[o + 1]
                if a < b:
                    who, at = np.unique(place[a:b], return_inverse=True)
                    rows.append((o, rare[a:b].tobytes(), at.astype(np.uint32).tobytes(), ck[who].tobytes(), np.stack([n[who], w[who]], axis=1).tobytes()))
            if rows:
                nulls = [None] * len(rows)
                yield _batch(nulls, nulls, nulls, nulls, nulls, nulls, nulls, *map(list, zip(*rows, strict=True)))

    return index


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "tk", "n", "w", "ck", "bits", "sig", "owner", "sigs", "places", "cks", "ns"])


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner: entries that more than one class has, with these classes."""
    sig, ck, n = [], [], []
    for s, p, c, m in zip(pdf.sigs, pdf.places, pdf.cks, pdf.ns, strict=True):
        at = np.frombuffer(p, np.uint32)
        sig.append(np.frombuffer(s, np.uint64))
        ck.append(np.frombuffer(c, np.int64)[at])
        n.append(np.frombuffer(m, np.int32).reshape(-1, 2)[at])
    sig, ck, n = np.concatenate(sig), np.concatenate(ck), np.concatenate(n)
    order = np.lexsort((ck, sig))
    sig, ck, n = sig[order], ck[order], n[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (ck[1:] != ck[:-1])
    sig, ck, n = sig[new], ck[new], n[new]
    shared = np.zeros(len(sig), bool)
    same = sig[1:] == sig[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    return pd.DataFrame({"sig": sig[shared].view(np.int64), "ck": ck[shared], "n": n[shared, 0], "w": n[shared, 1]})


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            found = shingle_sets(texts, words)
            lengths = np.array([len(s) for s in found], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([class_key(s) if len(s) else 0 for s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["ck", "items"])

    return sets


def _fits(n: str, m: str, similarity: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return F.least(F.col(n), F.col(m)) * 100 >= F.greatest(F.col(n), F.col(m)) * similarity


def _near(similarity: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose bitmaps do not rule out a link."""
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(2, 6)]
            keep = [bits_apart(a, b) * (100 + similarity) <= (n + m) * (100 - similarity) for a, b, n, m in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return near


def _plausible(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    a = classes.select(F.col("ck").alias("u"), F.col("bits").alias("bu"), F.col("n").alias("nu"))
    b = classes.select(F.col("ck").alias("v"), F.col("bits").alias("bv"), F.col("n").alias("nv"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "bu", "bv", "nu", "nv").mapInArrow(_near(similarity), "u long, v long")


def _links(pairs: DataFrame, base: DataFrame, classes: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs (u, v) whose sets are linked, as a written table; the sets are those of one document of each class."""
    ends = pairs.select(F.col("u").alias("ck")).unionByName(pairs.select(F.col("v").alias("ck"))).distinct()
    sets = _set_table(ends, base, classes, words)
    a = sets.select(F.col("ck").alias("u"), F.col("items").alias("su"))
    b = sets.select(F.col("ck").alias("v"), F.col("items").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    linked = pairs.join(a, "u").join(b, "v").where(both * 100 >= (F.size("su") + F.size("sv") - both) * similarity).select("u", "v")
    out = materialize(linked, "links")
    discard(sets)
    return out


def _blocked(lists: DataFrame) -> DataFrame:
    """Adds `block`: rows of lists longer than LIST_BLOCK are spread, so that no key (sig, block) has many rows."""
    sizes = materialize(lists.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") > LIST_BLOCK), "list-sizes")
    limit = max(LIST_BLOCK, lists.count() // HOT_LISTS)
    out = lists.join(F.broadcast(sizes.where(F.col("size") > limit)), "sig", "left")
    if limit > LIST_BLOCK:
        out = out.join(sizes.where(F.col("size") <= limit).withColumnRenamed("size", "other"), "sig", "left").withColumn("size", F.coalesce("size", "other")).drop("other")
    block = F.when(F.col("size").isNull(), 0).otherwise(F.pmod(F.xxhash64("ck"), F.ceil(F.col("size") / LIST_BLOCK))).cast("int")
    return out.withColumn("block", block).drop("size")


def _of_lists(rows: DataFrame, *figures: Column) -> DataFrame:
    """Figures of each list, one row for each of its blocks, to be joined by (sig, block)."""
    return rows.groupBy("sig").agg(*figures, F.max("block").alias("_last")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")


def _torn(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Lists (sig, block, ck, n, w, comp) that hold classes of several components."""
    if labels is not None:
        known = labels.select(F.col("vertex").alias("ck"), "component")
        lists = lists.join(known, "ck", "left").select("sig", "block", "ck", "n", "w", F.coalesce("component", "ck").alias("comp"))
    else:
        lists = lists.withColumn("comp", F.col("ck"))
    torn = _of_lists(lists, F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("sig", "block")
    return lists.join(torn, ["sig", "block"], "left_semi")


def _ordered(pairs: DataFrame, similarity: int) -> DataFrame:
    fit = pairs.where("uc <> vc").where(_fits("un", "vn", similarity))
    return fit.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _star_pairs(lists: DataFrame, turn: int, similarity: int) -> DataFrame:
    """Each class of a list with a few pivots of the list: the one with the most entries for its size, and others each turn."""
    one = F.struct("ck", "n", "comp")
    pivots = [F.max_by(one, F.struct("w", F.xxhash64("ck", F.lit(turn)), "ck")).alias("p0")]
    pivots += [F.min_by(one, F.struct(F.xxhash64("ck", F.lit(turn * PIVOTS + k)), "ck")).alias(f"p{k}") for k in range(1, PIVOTS)]
    heads = _of_lists(lists, *pivots).select("sig", "block", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("p"))
    return _ordered(lists.join(heads, ["sig", "block"]).select(F.col("p.ck").alias("u"), F.col("p.n").alias("un"), F.col("p.comp").alias("uc"), F.col("ck").alias("v"), F.col("n").alias("vn"), F.col("comp").alias("vc")), similarity)


def _cells(lists: DataFrame) -> DataFrame:
    """Rows (cell, ck, n, comp) of all cells that hold several components.

    A list's main component is that of its first pivot. Other classes (blocks x >= 0)
    meet each other and those of the main component (blocks y < 0); these do not meet
    among themselves. Numbers of blocks are powers of two and blocks go by the class,
    so that similar lists have similar cells; a cell is named by its blocks and its
    smallest class, so that these often have the same name.
    """
    main = _of_lists(lists, F.max_by("comp", F.struct("w", "ck")).alias("main"))
    rows = lists.join(main, ["sig", "block"]).withColumn("inside", F.col("comp") == F.col("main"))

    def blocks(inside: bool) -> Column:
        n = F.when(F.col("inside") == inside, F.col("n"))
        least = F.greatest(F.lit(1.0), F.count(n) / LIST_BLOCK, F.sum(n) / BLOCK_SHINGLES)
        return F.pow(2.0, F.ceil(F.log2(least))).cast("int")

    size = _of_lists(rows, blocks(True).alias("ins"), blocks(False).alias("outs"))
    h = F.xxhash64("ck")
    at = F.when(F.col("inside"), -1 - F.pmod(h, F.col("ins"))).otherwise(F.pmod(h, F.col("outs"))).cast("int")
    out = lambda: F.sequence(F.lit(0), F.col("outs") - 1)
    meets = F.when(F.col("inside"), out()).otherwise(F.concat(out(), F.transform(F.sequence(F.lit(1), F.col("ins")), lambda k: -k)))
    dealt = rows.join(size, ["sig", "block"]).withColumn("at", at).withColumn("other", F.explode(meets))
    x = F.when(F.col("at") < 0, F.col("other")).when(F.col("other") < 0, F.col("at")).otherwise(F.least("at", "other"))
    y = F.when(F.col("at") < 0, F.col("at")).when(F.col("other") < 0, F.col("other")).otherwise(F.greatest("at", "other"))
    placed = dealt.select("sig", x.alias("x"), y.alias("y"), "ck", "n", "comp")
    names = placed.groupBy("sig", "x", "y").agg(F.min("ck").alias("least"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b")
    cell = F.xxhash64("least", "x", "y").alias("cell")
    return placed.join(names, ["sig", "x", "y"]).select("sig", cell, "ck", "n", "comp")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of some sets share."""
    k = len(sets)
    if k == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[0, both], [both, 0]])
    lengths = np.array([len(s) for s in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(k), lengths)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    often = np.diff(np.append(start, len(value)))
    out = np.zeros((k, k), np.float32)
    heavy = np.flatnonzero(often > max(8, k // 16))
    for at in range(0, len(heavy), 2048):  # common values: a product of matrices
        part = heavy[at : at + 2048]
        has = np.zeros((k, len(part)), np.float32)
        for c, v in enumerate(part):
            has[row[start[v] : start[v] + often[v]], c] = 1
        out += has @ has.T
    light = out.reshape(-1)
    few = often <= max(8, k // 16)
    for step in range(1, int(often[few].max()) if few.any() else 1):  # each entry with the one `step` places on
        go = few & (often > step)
        i = ragged(start[go], often[go] - step)
        light += np.bincount(row[i] * k + row[i + step], minlength=k * k)
    out = np.triu(out, 1)
    return (out + out.T).astype(np.int64)


def joining_links(ck: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """Links that join the components of some classes as all their links do; fewer than there are components."""
    n = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    linked = both * (100 + similarity) >= (n[:, None] + n[None, :]) * similarity
    out, open_ = [], np.ones(len(n), bool)
    for first in range(len(n)):
        if not open_[first]:
            continue
        open_[first] = False
        seen, queue = {comp[first]}, [first]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(linked[i] & open_).tolist():
                open_[j] = False
                queue.append(j)
                if comp[j] not in seen:
                    seen.add(comp[j])
                    out.append((ck[i], ck[j]))
    return out


def _groups(lists: list[np.ndarray], classes: int) -> list[np.ndarray]:
    """Classes to be compared at once: of few classes all, else those of lists that share most of their classes."""
    if classes <= TOGETHER:
        return [np.ones(classes, bool)]
    groups: list[np.ndarray] = []
    for who in sorted(lists, key=len, reverse=True):
        for has in groups:
            if has[who].sum() * 2 >= len(who):
                has[who] = True
                break
        else:
            groups.append(np.zeros(classes, bool))
            groups[-1][who] = True
    return groups


class _Cells:
    """The cells of a task. Rows hold a cell's class in a list, or (sig is null) what is known of a class for a cell."""

    def __init__(self, pdf: pd.DataFrame):
        whole = pdf.sig.isna().to_numpy()
        self.known = pdf[whole].drop_duplicates(["cell", "ck"]).sort_values(["cell", "ck"])
        self.rows = pdf[~whole].sort_values(["cell", "sig"])

    def groups(self) -> Iterator[np.ndarray]:
        """Places in `known` of classes that are to be compared with each other."""
        of_cell, cks = self.known.cell.to_numpy(), self.known.ck.to_numpy()
        row_cell, sig, ck = self.rows.cell.to_numpy(), self.rows.sig.to_numpy(np.int64), self.rows.ck.to_numpy()
        cells, start = np.unique(of_cell, return_index=True)
        row_start = np.searchsorted(row_cell, cells)
        for a, b, x, y in zip(start, np.append(start[1:], len(cks)), row_start, np.append(row_start[1:], len(ck)), strict=True):
            if b - a <= TOGETHER:
                yield np.arange(a, b)
                continue
            at = np.minimum(np.searchsorted(cks[a:b], ck[x:y]), b - a - 1)
            here = cks[a:b][at] == ck[x:y]
            at, own = at[here], sig[x:y][here]
            for has in _groups(np.split(at, np.flatnonzero(own[1:] != own[:-1]) + 1), b - a):
                yield a + np.flatnonzero(has)


def _stacked(bits: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bits[k] for k in rows), np.uint64).reshape(len(rows), width // 8)


def _apart(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits row x of a and row y of b differ, for each x and y."""
    step = max(1, 2_000_000 // a.shape[1])
    parts = [np.bitwise_count(a[x[k : k + step]] ^ b[y[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _may_link(similarity: int):
    def may_link(pdf: pd.DataFrame) -> pd.DataFrame:
        """A task: the classes of its cells that, by their bitmaps, may be linked with one of another component there."""
        cells = _Cells(pdf)
        n, comp, bits = cells.known.n.to_numpy(np.int64), cells.known.comp.to_numpy(np.int64), cells.known.bits.to_numpy()
        found = np.zeros(len(n), bool)
        for at in cells.groups():
            at = at[np.argsort(n[at], kind="stable")]
            width = np.array([len(bits[k]) for k in at])
            for w in np.unique(width):  # each width with itself and the next larger one, folded; sizes further apart cannot be linked
                own, next_ = at[width == w], at[width == 2 * w]
                words = _stacked(bits, own, w)
                wide = _stacked(bits, next_, 2 * w)
                other, words_of = np.concatenate([own, next_]), np.concatenate([words, wide[:, : w // 8] ^ wide[:, w // 8 :]])
                step = max(1, 1_000_000 // len(other))
                for k in range(0, len(own), step):
                    i = own[k : k + step]
                    small, large = np.minimum(n[i][:, None], n[other][None, :]), np.maximum(n[i][:, None], n[other][None, :])
                    x, y = np.nonzero((small * 100 >= large * similarity) & (comp[i][:, None] != comp[other][None, :]))
                    near = _apart(words, k + x, words_of, y) * (100 + similarity) <= (n[i[x]] + n[other[y]]) * (100 - similarity)
                    found[i[x[near]]] = True
                    found[other[y[near]]] = True
        return cells.known.loc[found, ["cell", "ck", "comp"]].astype(np.int64)

    return may_link


def _compare(similarity: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """A task: the links that join components in its cells."""
        cells = _Cells(pdf)
        cks, comp, items = cells.known.ck.to_numpy(), cells.known.comp.to_numpy(np.int64), cells.known["items"].to_numpy()
        out = []
        for at in cells.groups():
            if len(at) > 1:
                out += joining_links(cks[at], comp[at], [items[k] for k in at], similarity)
        u, v = np.array(out, np.int64).reshape(-1, 2).T
        del cells, items
        release()
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return compare


def _set_table(wanted: DataFrame, base: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(ck, items): the whole set of one document of each wanted class, as a written table."""
    ids = materialize(classes.join(wanted, "ck", "left_semi").select(F.col("first").alias("id")), "wanted")
    # rows that share an id may bring other sets along; they are in no pair or are equal
    sets = materialize(base.join(_few(ids), "id", "left_semi").mapInArrow(_sets(words), "ck long, items array<long>").dropDuplicates(["ck"]), "sets")
    discard(ids)
    return sets


def _in_cells(known: DataFrame, rows: DataFrame, weight: Column, work, schema: str) -> DataFrame:
    """`work` on all cells, in tasks of bounded weight. Both tables hold cell and ck, `known` what is to be known of a class, `rows` its lists."""
    total = known.agg(F.sum(weight)).first()[0] or 0
    tasks = max(shuffle_width(known.sparkSession), -(-total // TASK_SHINGLES))
    both = rows.select("cell", "sig", "ck").unionByName(known.withColumn("sig", F.lit(None).cast("long")), allowMissingColumns=True)
    return both.groupBy(F.pmod(F.xxhash64("cell"), F.lit(tasks)).alias("bundle")).applyInPandas(work, schema)


def _joined_in_cells(lists: DataFrame, base: DataFrame, classes: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links (u, v) that join all components which links within a list connect, as a written table."""
    cells = materialize(_cells(lists), "cells")
    known = materialize(cells.select("cell", "ck", "n", "comp").distinct().join(classes.select("ck", "bits"), "ck"), "cell-classes")
    near = materialize(_in_cells(known, cells, F.octet_length("bits") / 8, _may_link(similarity), "cell long, ck long, comp long"), "cell-near")
    sets = _set_table(near.select("ck").distinct(), base, classes, words)
    whole = materialize(near.join(sets, "ck"), "cell-sets")
    left = cells.join(near.select("cell", "ck"), ["cell", "ck"], "left_semi")
    out = materialize(_in_cells(whole, left, F.size("items"), _compare(similarity), "u long, v long").distinct(), "links")
    discard(cells, known, near, sets, whole)
    return out


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def jaccard_groups(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, text_key, first.

    A set holds the distinct `words`-word shingles of the whole text, A-Z
    lower-cased; with fewer words, the whole sequence as one. Sets are linked
    when 100 * intersection >= similarity * union; component_id is the smallest
    id that links lead to. A null text or one without words has an empty set,
    is linked with nothing and is its own component. text_key is xxhash64 of the
    text (null: empty); `first` marks the row of smallest id, then key, of each
    component, with rows equal to it. A row without id takes no part; rows that
    share an id are compared as rows, and each is returned. A long text is read
    whole in one task, in memory of some dozen times its size. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(docs)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null").withColumn("tk", F.xxhash64("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    counters = max(shuffle_width(spark), -(-chars // OWNER_CHARS))
    counts = materialize(base.mapInArrow(_count(words, counters), COUNTED), "shingle-counts")
    total = counts.where("shingle is null and owner is null").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // FREQUENT))
    often = counts.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("shingle")
    frequent = np.sort(often.toArrow().column("shingle").to_numpy().view(np.uint64))
    map_bits = min(max(MAP_BITS[0], (total // 4).bit_length()), MAP_BITS[1])
    bitmap = np.zeros(1 << (map_bits - 3), np.uint8)
    parts = counts.where("owner is not null").select("owner", "n", "k", "coded").groupBy("owner").applyInPandas(_shared(map_bits), "first long, bits binary").toArrow()
    for first, bits in zip(parts.column("first").to_pylist(), parts.column("bits"), strict=True):
        part = np.frombuffer(bits.as_buffer(), np.uint8)
        bitmap[first : first + len(part)] |= part
    discard(counts)
    owners = max(shuffle_width(spark), -(-total // (3 * OWNER_ENTRIES)))
    shared = spark.sparkContext.broadcast((frequent, bitmap))
    del bitmap, parts
    indexed = materialize(base.mapInArrow(_index(words, similarity, owners, shared), INDEX), "index")

    members = indexed.where("id is not null").select("id", "tk", "n", "ck", "bits")
    by_owner = indexed.where("owner is not null").select("owner", "sigs", "places", "cks", "ns").groupBy("owner").applyInPandas(_meet, "sig long, ck long, n int, w int")
    by_frequent = indexed.where("sig is not null").groupBy("sig", "ck").agg(F.min("n").alias("n"), F.max("w").alias("w"))
    met = materialize(by_owner.unionByName(by_frequent), "lists")
    lists = _blocked(met)
    classes = materialize(members.where("n > 0").groupBy("ck").agg(F.min("id").alias("first"), F.min(F.struct("id", "tk")).alias("head"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bits").alias("bits")), "classes")
    links, labels, done = None, None, None
    for turn in (*range(STARS), None):
        open_lists = materialize(_torn(lists, labels), "open-lists")
        if turn is None:
            found = _joined_in_cells(open_lists, base, classes, words, similarity)
        else:
            pairs = _star_pairs(open_lists, turn, similarity)
            pairs = materialize(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), "pairs")
            done = pairs if done is None else done.unionByName(pairs)
            near = materialize(_plausible(pairs, classes, similarity), "near")
            found = _links(near, base, classes, words, similarity)
            discard(near)
        discard(met)
        met, lists = open_lists, open_lists.drop("comp")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = materialize(connected_components(links), "labels")
    shared.unpersist()
    discard(met)
    if labels is None:
        labels = classes.limit(0).select(F.col("ck").alias("vertex"), F.col("ck").alias("component"))
    of_class = labels.withColumnRenamed("vertex", "ck").join(classes, "ck")
    of_component = of_class.groupBy("component").agg(F.min("head").alias("best"))
    linked = of_class.join(_few(of_component), "component").select("ck", "best")
    final = classes.join(linked, "ck", "left").where("best is not null or copies > 1").select("ck", "copies", F.coalesce("best", "head").alias("best"))
    return _of_rows(members, materialize(final, "components"))


def _of_rows(members: DataFrame, final: DataFrame) -> DataFrame:
    """A row for each document, from the first document of its component; classes of many copies are joined apart."""
    limit = max(HOT_COPIES, members.count() // HOT_LISTS)
    hot = F.broadcast(final.where(F.col("copies") > limit).select("ck", "best"))
    some = members.where("n > 0")
    own = F.struct("id", "tk").alias("best")
    every = (
        members.where("n = 0").withColumn("best", own)
        .unionByName(some.join(hot, "ck"))
        .unionByName(some.join(hot, "ck", "left_anti").join(final.where(F.col("copies") <= limit).select("ck", F.col("best").alias("of")), "ck", "left").withColumn("best", F.coalesce("of", own)).drop("of"))
    )
    return every.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("best.id").alias("component_id"),
        F.col("tk").alias("text_key"), (F.struct("id", "tk") == F.col("best")).alias("first"),
    )
