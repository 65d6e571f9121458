"""Phrase collocation mining on FM-indexes over word ids, one for each shard.

A shard is a bounded stretch of one language's text as word ids, with a separator
between pieces. Its index is a pair of Burrows-Wheeler transforms, of the ids and
of the ids reversed. A phrase is a pair of intervals of equal size, one in each.
Extending it by a word on the left reads the first transform, on the right the
second, and moves both intervals; all phrases of one length are extended at once.
As phrases have at most a few words, rows are sorted by that many words only: the
ends of a phrase's intervals do not depend on what follows.

1. Each shard counts its words and pairs and sends their 64-bit hashes, which are
   summed across shards. What reaches the threshold is kept as a bitmap.
2. Each shard sends words, pairs and longer phrases whose words and pairs are all
   in the bitmap. Their counts, exact and under their own texts, are summed across
   shards. A longer phrase is never more frequent than the pairs in it, so none is
   lost; what the bitmap lets through wrongly falls to the threshold afterwards.
3. Cuts, extensions and ranks are joins and aggregations on the summed counts.

A shard ends where a task's buffer is full, inside a piece if need be; the words
carried over are counted by both shards and taken off again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import GOLDEN, bound_batches, combine, hash_words, keyed_chunks, mix, ragged, release
from graphloom.scratch import discard, materialize

#: Words and separators of a shard, about; below 2^21, so that three ids fit 64 bits.
SHARD_WORDS = 3 << 19
#: Characters of a text that are read at a time.
SLICE = 1 << 20
#: Bits of the map for each frequent hash, and of the map in all at most (32 MB).
MAP_BITS, MAP_MOST = 16, 1 << 28
#: Parts into which a language's candidates are ranked before the best of all parts are.
RANK_PARTS = 16

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_MARKS = bytes(10 if c in SEPARATORS else 32 if c == 9 else c for c in range(256))
UNKNOWN = "und"


def slices(text: str) -> Iterator[str]:
    """A text in stretches that end before a space."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(" ", at + SLICE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def tokens(text: str) -> pa.Array:
    """The words of a text, A-Z lower-cased, and a line feed for each separator; some are empty."""
    marked = text.encode("utf-8", "surrogatepass").lower().translate(_MARKS).replace(b"\n", b" \n ")
    return pc.split_pattern(pa.array([marked], pa.binary()), b" ").flatten()


@dataclass
class Phrases:
    """Phrases of one length: their ids, and where their intervals begin in the two orders."""

    ids: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.ids[keep], self.forward[keep], self.backward[keep], self.size[keep])


def limited_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a circular text of ids below 2^21, sorted by their first `depth` ids."""
    key = t.astype(np.uint64)
    for k in range(1, depth):
        if k % 2 == 0 and k + 1 < depth or k >= 3:  # two more ids would not fit: names in sorted order instead
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = (key << np.uint64(21)) | np.roll(t, -k).astype(np.uint64)
    return np.argsort(key, kind="stable")


class ShardIndex:
    """A bidirectional index of ids (separator: 0) for phrases of at most `depth` words."""

    def __init__(self, ids: np.ndarray, depth: int, both: bool = True):
        self.text = np.concatenate([[0], ids, [0]]).astype(np.int64)
        self.last, self.first, self.row = self._transform(self.text, depth)
        if both:
            self.back_last, _, self.back_row = self._transform(self.text[::-1], depth)

    @staticmethod
    def _transform(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id before each row, the id that each row begins with, and the row that begins one id earlier."""
        order = limited_order(t, depth)
        rows = np.empty(len(t), np.int64)
        rows[order] = np.arange(len(t))
        before = order - 1  # of position 0: -1, the last
        return t[before], t[order], rows[before]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first id, second id, count): every word extended on the left."""
        inside = (self.first > 0) & (self.last > 0)
        key, count = _runs(np.sort((self.first[inside] << 32) | self.last[inside]))
        return key & 0xFFFFFFFF, key >> 32, count

    def words(self) -> Phrases:
        ids, size = _runs(self.first)
        start = np.cumsum(size) - size
        keep = ids > 0
        return Phrases(ids[keep][:, None], start[keep], start[keep], size[keep])

    def extend(self, p: Phrases, left: bool) -> Phrases:
        """All phrases one word longer on one side."""
        last, row = (self.last, self.row) if left else (self.back_last, self.back_row)
        here, there = (p.forward, p.backward) if left else (p.backward, p.forward)
        rows = ragged(here, p.size)
        key = (np.repeat(np.arange(len(p.size)), p.size) << 32) | last[rows]
        order = np.argsort(key, kind="stable")
        key, count = _runs(key[order])
        begins = np.cumsum(count) - count
        own, word = key >> 32, key & 0xFFFFFFFF
        moved = np.minimum.reduceat(row[rows[order]], begins) if len(rows) else begins
        beside = there[own] + begins - (np.cumsum(p.size) - p.size)[own]  # after the rows with a smaller id
        ids = np.concatenate([word[:, None], p.ids[own]] if left else [p.ids[own], word[:, None]], axis=1)
        out = Phrases(ids, moved, beside, count) if left else Phrases(ids, beside, moved, count)
        return out.where(word > 0)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array and how often each occurs."""
    if not len(x):
        return x, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x)))


@dataclass
class Shard:
    """A stretch of one language: the vocabulary (a word's id is its place plus one), the ids, and how many of these were carried over."""

    lang: str
    vocabulary: pa.Array
    ids: np.ndarray
    carried: int

    def hashes(self) -> np.ndarray:
        """Of the words by id, in their language."""
        h = hash_words(self.vocabulary.to_pylist())
        return np.concatenate([np.zeros(1, np.uint64), mix(h + hash_words([self.lang.encode("utf-8", "surrogatepass")]) * GOLDEN)])


def shards(batches: Iterator[pa.RecordBatch], depth: int, limit: int) -> Iterator[Shard]:
    """Cuts rows (any, text, lang) into shards; a language's buffer is emptied when it is full, the largest one when all together are."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    carry: dict[str, int] = {}

    def flush(lang: str) -> Shard:
        t = pa.concat_arrays(held.pop(lang)).dictionary_encode()
        size.pop(lang)
        empty, mark = pc.index_in(pa.array([b"", b"\n"]), t.dictionary).to_pylist()
        ids = t.indices.to_numpy()
        ids = ids[ids != (-1 if empty is None else empty)] + 1
        ids[ids == (0 if mark is None else mark + 1)] = 0
        out = Shard(lang, t.dictionary, ids, carry.pop(lang, 0))
        inside = len(ids) - np.flatnonzero(ids == 0)[-1] - 1 if (ids == 0).any() else len(ids)
        rest = ids[len(ids) - min(inside, depth - 1) :]
        if len(rest):  # the text goes on
            held[lang], size[lang], carry[lang] = [t.dictionary.take(pa.array(rest - 1))], len(rest), len(rest)
        return out

    for _, texts, langs in keyed_chunks(batches):
        for text, lang in zip(texts, langs, strict=True):
            lang = UNKNOWN if lang is None else lang
            for s in slices(text):
                held.setdefault(lang, []).append(t := tokens(s))
                size[lang] = size.get(lang, 0) + len(t)
                if size[lang] >= limit:
                    yield flush(lang)
                elif sum(size.values()) >= 2 * limit:
                    yield flush(max(size, key=size.get))
            held.setdefault(lang, []).append(pa.array([b"\n"]))
            size[lang] = size.get(lang, 0) + 1
    for lang in list(held):
        yield flush(lang)


def _count_hashes(depth: int, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches, depth, limit):
            index, h = ShardIndex(s.ids, depth, both=False), s.hashes()
            words = index.words()
            a, b, n = index.pairs()
            keys, counts = [h[words.ids[:, 0]], combine(h[a], h[b])], [words.size, n]
            if s.carried:
                c = s.ids[: s.carried]
                keys += [h[c], combine(h[c[:-1]], h[c[1:]])]
                counts += [np.full(len(c), -1), np.full(len(c) - 1, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))], names=["key", "n"])
            del index, words, keys, counts
            release()

    return count


def frequent_map(keys: DataFrame) -> tuple[bytes, int]:
    """A bitmap of the low bits of `key`, and their number: 16 bits for each of the keys, rounded up to a power of two, 2^28 at most."""
    bits = min(MAP_MOST, 1 << max(16, int(keys.count() * MAP_BITS - 1).bit_length()))
    at = F.col("key").bitwiseAND(bits - 1) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for block, part in blocks:
        out[(block - 1) * 4096 : block * 4096] = np.frombuffer(part, np.uint8)
    return out.tobytes(), bits


def _count_phrases(depth: int, limit: int, sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, bits = sent.value
        known = np.frombuffer(coded, np.uint8)

        def frequent(keys: np.ndarray) -> np.ndarray:
            at = keys & np.uint64(bits - 1)
            return (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        for s in shards(batches, depth, limit):
            index, h = ShardIndex(s.ids, depth), s.hashes()

            def rows(ids: np.ndarray, n: np.ndarray, s=s) -> pa.RecordBatch:
                text = pc.binary_join_element_wise(*(s.vocabulary.take(pa.array(ids[:, k] - 1)) for k in range(ids.shape[1])), b" ")
                return pa.RecordBatch.from_arrays([pa.array([s.lang] * len(n), pa.string()), text.cast(pa.string()), pa.array(np.full(len(n), ids.shape[1], np.int32)), pa.array(n)], names=["lang", "phrase", "words", "n"])

            yield pa.RecordBatch.from_arrays([pa.array([s.lang]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([int((s.ids > 0).sum()) - s.carried])], names=["lang", "phrase", "words", "n"])
            p = index.words()
            p = p.where(frequent(h[p.ids[:, 0]]))
            common = np.zeros(len(h), bool)
            common[p.ids[:, 0]] = True
            yield rows(p.ids, p.size)
            for length in range(2, depth + 1):
                p = index.extend(p, left := length % 2 == 0)
                p = p.where(common[p.ids[:, 0 if left else -1]])
                end = p.ids[:, :2] if left else p.ids[:, -2:]
                p = p.where(frequent(combine(h[end[:, 0]], h[end[:, 1]])))
                for at in range(0, len(p.size), 100_000):
                    yield rows(p.ids[at : at + 100_000], p.size[at : at + 100_000])
            for length in range(1, s.carried + 1):
                again = np.lib.stride_tricks.sliding_window_view(s.ids[: s.carried], length)
                yield rows(again, np.full(len(again), -1))
            del index, p
            release()

    return count


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, words, n): phrases of 1 to `max_words` words that occur `min_count` times or more in a language; with phrase null and words 0: all words of the language.

    Nulls and odd rows are as in `mine_phrases`.
    """
    if max_words < 2 or not 0 < shard_words < 1 << 21:
        raise ValueError("phrases have two words or more, shards fewer than 2^21 words")
    spark = docs.sparkSession
    bound_batches(docs)
    rows = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    hashed = rows.mapInArrow(_count_hashes(max_words, shard_words), "key long, n long")
    keys = materialize(hashed.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("key"), "phrase-hashes")
    sent = spark.sparkContext.broadcast(frequent_map(keys))
    counted = rows.mapInArrow(_count_phrases(max_words, shard_words, sent), "lang string, phrase string, words int, n long")
    out = materialize(counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | F.col("phrase").isNull()), "phrases")
    discard(keys)
    sent.unpersist()
    return out


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10, cover: int = 50, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of 2 to `max_words` words of each language.

    Words are `[^\\x20\\x09]+` between separators `[.,;:!?\\x0A-\\x0D]`, A-Z lower-cased;
    phrases lie between separators. a: how often the phrase occurs (overlaps too),
    `min_count` at least; l and r: of its two parts, cut where the score
    floor(1000000 * a * a / (l * r)) is lowest, of equal ones after the fewest words;
    n: all words of the language. A phrase inside a longer one that has `cover` % of
    its occurrences or more is left out. Ranks: score, then a, descending, then the
    phrase in byte order. Scores are exact decimals; counts beyond 3 * 10^15 fail.

    A null text is empty, a null lang `und`; an empty text, one of separators and an
    empty table have no phrases. Texts of any length are read whole, in slices.
    Repeated rows count each. Other columns, of any name, do not matter.
    """
    counts = count_phrases(docs, text_col, lang_col, max_words, min_count, shard_words)
    totals = counts.where("phrase is null").select("lang", F.col("n").alias("all_words"))
    known = counts.where("phrase is not null")
    part = lambda side, n: known.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    phrases = known.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    ).join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(1000000 * (cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("at"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inner = phrases.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("at.a")))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = left.select("lang", "phrase", "at.a", "at.l", "at.r", "at.score", (F.abs(F.xxhash64("phrase")) % RANK_PARTS).alias("part"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")
