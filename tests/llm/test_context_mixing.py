import heapq
import math
import os
import pickle
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import context_mixing, queries
from graphloom.llm.common import hash_words
from graphloom.llm.context_mixing import Places, WordCode, frozen, mix_documents
from graphloom.llm.language_id import LanguageModel
from graphloom.llm.lm_scoring import MixModel, score_documents


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_the_query_predicts_known_words_from_the_words_before(spark, tmp_path):
    line = "the cat sat on a mat while one dog ran to its old house".split()
    other = random.Random(3).sample(line, len(line))
    out = [i for i in range(400) if held(i)]
    texts = {i: " ".join(line * 3) for i in range(400)} | {out[0]: " ".join(line), out[1]: " ".join(other)}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(got) == 400 and math.isclose(got[out[0]].base_score, got[out[1]].base_score)
    assert got[out[0]].score > got[out[1]].score + 10  # the same words in another order
    assert got[out[0]].score > got[out[0]].base_score


def test_rows_and_counts_as_those_of_single_words(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9000, None), (9001, ""), (9002, "zx" * 50_000), (9003, "吾輩は猫である名前はまだ無い"), (None, "the"), (9004, "a b " * 20_000), (9004, "a b")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    for head in (1 << 18, 40):
        monkeypatch.setattr(context_mixing, "HEAD_WORDS", head)
        one, two = (sorted(f(docs.repartition(n), F.col("doc_id") % 5 != 1).collect(), key=lambda r: (r.doc_id, r.n_tokens)) for f, n in ((score_documents, 2), (mix_documents, 3)))
        assert [r[:4] for r in one] == [r[:4] for r in two]
        for a, b in zip(one, two, strict=True):
            assert math.isclose(a.base_score, b.base_score, rel_tol=1e-9)
            assert math.isfinite(b.score) and b.score < 0 and math.isclose(-b.score / math.log10(2), b.bits_per_byte * -a.score / math.log10(2) / a.bits_per_byte)
    again = {(r.doc_id, r.n_tokens): r.score for r in mix_documents(docs.repartition(7), F.col("doc_id") % 5 != 1).collect()}
    assert all(math.isclose(again[r.doc_id, r.n_tokens], r.score, rel_tol=1e-6) for r in two)


def test_better_than_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    out = [r for r in mix_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).collect() if held(r.doc_id)]
    assert 1 - sum(r.score for r in out) / sum(r.base_score for r in out) >= 0.02


def test_probabilities_of_short_texts_are_a_distribution():
    words = hash_words([b"w%d" % k for k in range(50)])
    code = WordCode(words.view(np.int64), np.arange(50.0) + 1, 30.0, 20.0)
    assert (2.0 ** -code.length).sum() <= 1
    tables = [frozen(np.random.default_rng(k).integers(0, 9, 2 << 10, dtype=np.uint32), 1.5) for k in range(2)]
    unseen = hash_words([b"unseen"])
    starts = np.array([0, 0, *range(1, 52)])  # the empty text, each word and an escape alone
    p = Places(code, np.concatenate([words, unseen]).view(np.int64), starts, 10)
    assert np.exp(p.log(*p.inputs(code, tables))).sum() < 1
    pairs = np.array([(a, b) for a in [*words, *unseen] for b in [*words, *unseen]], np.uint64).ravel()
    q = Places(code, pairs.view(np.int64), np.arange(0, len(pairs) + 1, 2), 10)
    both = np.exp(p.log(*p.inputs(code, tables))).sum() + np.exp(q.log(*q.inputs(code, tables))).sum()
    assert 0.001 < both < 1
    # texts side by side and alone
    alone = [Places(code, pairs[k : k + 2].view(np.int64), np.array([0, 2]), 10) for k in range(0, 200, 2)]
    assert np.allclose([x.log(*x.inputs(code, tables))[0] for x in alone], q.log(*q.inputs(code, tables))[:100])


def test_no_training_rows_and_empty_table(docs_of):
    rows = mix_documents(docs_of([(1, "a b"), (1, "a b"), (2, None)]), F.lit(None).cast("boolean")).collect()
    assert len(rows) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in rows)
    assert mix_documents(docs_of([]), F.lit(True)).collect() == []


def test_what_tasks_are_sent_is_small(spark, docs_of, monkeypatch):
    """Every executor keeps a broadcast on its disk, and the driver until it is destroyed."""
    sent = []
    put = type(spark.sparkContext).broadcast

    def broadcast(self, value):
        sent.append((put(self, value), value))
        return sent[-1][0]

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    rng = random.Random(5)
    docs = docs_of([(k, " ".join(f"w{rng.randrange(30_000)}" for _ in range(300))) for k in range(400)])
    assert mix_documents(docs, F.col("doc_id") % 5 != 1).count() == 400
    large = [b for b, v in sent if not isinstance(v, LanguageModel)]
    assert len(large) >= 5 and not any(os.path.exists(b._path) for b in large)
    model, code = (next(v for _, v in sent if isinstance(v, kind)) for kind in (MixModel, WordCode))
    words = len(code.length) - 2
    assert words > 10_000 and len(pickle.dumps(code)) < 16 * words
    assert len(pickle.dumps(model)) < sum(z.nbytes + o.nbytes for z, o in model.tables) / 2
    again = pickle.loads(pickle.dumps(model))
    assert all(np.array_equal(a, b) for x, y in zip(model.tables, again.tables, strict=True) for a, b in zip(x, y, strict=True))


def test_codes_are_those_of_huffman():
    for counts in (np.arange(1.0, 40), np.ones(7), 1.2 ** np.arange(60), np.empty(0)):
        n = len(counts)
        code = WordCode(hash_words([b"w%d" % k for k in range(n)]).view(np.int64), counts, 3.0, 2.0)
        weight = np.append(counts, [3.0, 2.0])
        heap, cost = sorted(weight), 0.0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            heapq.heappush(heap, a)
            cost += a
        length = code.length.astype(int)
        assert (2.0**-length).sum() == 1 and length.max() < 50
        assert math.isclose((length * weight).sum(), cost, rel_tol=1e-6)
        _, start, path, place = pickle.loads(pickle.dumps(code)).derived()
        assert len(place) == n + 1 == len(code.base)
        paths = [tuple(path[a : a + b]) for a, b in zip(start, length, strict=True)]
        assert len(set(paths)) == n + 2 and all(p[0] >> 1 == 0 for p in paths)
        for node in range(n + 1):  # a node's logit is that of the weights below it
            zeros, ones = (sum(w for p, w in zip(paths, weight, strict=True) if node * 2 + v in p) for v in (0, 1))
            assert math.isclose(code.base[node], math.log((ones + 0.4) / (zeros + 0.4)), rel_tol=1e-3, abs_tol=1e-4)
