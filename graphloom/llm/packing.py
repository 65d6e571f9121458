"""Packing without padding: documents cut into pieces of power-of-two lengths.

A document of n tokens becomes n // 2048 pieces of 2048 and one piece for each
bit of the rest, longest first. Each piece is a sequence of its own, so that no
sequence crosses documents, and sequences of equal length share a bucket: a
batch drawn from one bucket needs no padding at all.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, ragged, release, text_chunks

#: A unit ends where a character other than white space meets a space or a line feed, or a letter or digit meets ASCII
#: punctuation: no token crosses these borders.
UNIT = re.compile(r"[ \n]*[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++(?=[!-/:-@\[-`{-~ \n]|$)|[ \n]*[^ \n]+|[ \n]+")
#: White space of other kinds; a text that holds one, or an added token, is encoded whole.
OTHER_SPACE = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Units that a task remembers at most.
MEMO_UNITS = 400_000

PIECES = "doc_id long, start long, length long, bucket int, doc_tokens long, ids binary"


class _Memo(dict):
    """Unit -> its place in the pool of ids; units met for the first time wait in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit):
        self[unit] = place = len(self)
        self.new.append(unit)
        return place


class UnitEncoder:
    """Ids of texts, each distinct unit tokenized once while the memo holds it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # an added token is found before the text is cut in words
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.odd = re.compile("|".join([OTHER_SPACE.pattern, *map(re.escape, added)]))
        self.forget()

    def forget(self):
        self.memo, self.starts, self.lengths, self.pool = _Memo(), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.uses = np.empty(0, np.int64)

    def trim(self):
        """Keeps the units met several times, half of what the memo holds at most, and halves what counts for them."""
        kept = np.flatnonzero(self.uses >= 2)
        if len(kept) > MEMO_UNITS // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: MEMO_UNITS // 2]])
        units, starts, lengths, pool, uses = list(self.memo), self.starts[kept], self.lengths[kept], self.pool, self.uses[kept]
        self.forget()
        self.memo.update((units[k], place) for place, k in enumerate(kept.tolist()))
        self.pool = pool[ragged(starts, lengths)]
        self.starts, self.lengths, self.uses = np.cumsum(lengths) - lengths, lengths, uses // 2

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > MEMO_UNITS:
            self.trim()
        places: list[int] = []
        ends, odd = [], {}
        for k, t in enumerate(texts):
            if self.odd.search(t):
                odd[k] = t
            else:
                places.extend(map(self.memo.__getitem__, UNIT.findall(t)))
            ends.append(len(places))
        if self.memo.new:
            found = self._whole(self.memo.new)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])
            self.memo.new = []
        at = np.array(places, np.int64)
        self.uses = np.append(self.uses, np.zeros(len(self.lengths) - len(self.uses), np.int64)) + np.bincount(at, minlength=len(self.lengths))
        lengths = self.lengths[at]
        flat = self.pool[ragged(self.starts[at], lengths)]
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.array([0, *ends], np.int64)]
        out = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k, ids in zip(odd, self._whole(list(odd.values())), strict=True):
            out[k] = np.array(ids, np.uint32)
        return out


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def piece_lengths(n: int, most: int) -> list[int]:
    """The lengths of the pieces of n tokens: as many of `most` as fit, then the binary parts of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, max_length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, bucket, doc_tokens, ids (little-endian uint32), sequence_id, offset.

    A document is the ids of its whole text and `end_id`; a null or empty text is
    `end_id` alone. A row without id takes no part. A repeated row is packed
    again, as sequences of its own. `max_length` must be a power of two. Other
    columns are ignored. A long text is encoded whole in its task, in memory of
    some times its size. An empty table gives an empty result. The job has no
    shuffle: rows are cut where they are read.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    bound_batches(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for ids, texts in text_chunks(batches):
            doc, start, length, total, blobs = [], [], [], [], []
            for i, tokens in zip(ids, enc.encode(texts), strict=True):
                tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                raw, at = tokens.tobytes(), 0
                for n in piece_lengths(len(tokens), max_length):
                    doc.append(i)
                    start.append(at)
                    length.append(n)
                    total.append(len(tokens))
                    blobs.append(raw[4 * at : 4 * (at + n)])
                    at += n
            lengths = np.array(length, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(lengths), pa.array(np.log2(lengths).astype(np.int32)), pa.array(total, pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "start", "length", "bucket", "doc_tokens", "ids"],
            )
        enc.trim()  # the worker's next task goes on with the frequent ones
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(cut, PIECES).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
