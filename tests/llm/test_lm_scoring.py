import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import lm_scoring
from graphloom.llm.language_id import LanguageModel
from graphloom.llm.lm_scoring import SLOT_BITS, Bits, fit, huffman, score_documents, word_counts


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def base_of(pairs, trained):
    c = Counter(w for i, t in pairs if trained(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in pairs}


@pytest.mark.parametrize("head", [1 << 20, 3])
def test_counts_and_base_score(docs_of, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD_SCORES", head)
    monkeypatch.setattr(lm_scoring, "COUNT_WORDS", 5)
    pairs = [(i, f"The cat {i % 7} sat\ton word{i} thé") for i in range(40)] + [(100, None), (101, ""), (102, "unseen only here"), (103, "x" * 100_000)]
    got = {r.doc_id: r for r in score_documents(docs_of([*pairs, (None, "the the the")], h="h", n2="x").repartition(3), F.col("doc_id") % 5 != 1).collect()}
    want = base_of(pairs, lambda i: i % 5 != 1)
    assert got.keys() == want.keys()
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_better_than_the_base_on_held_out_documents(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    for sf, least, most in (("sf0.01", 0.02, 0.5), ("sf0.1", 0.05, 0.8)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        got = score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, lang_col="lang").collect()
        assert len(got) == docs.count()
        out = [r for r in got if held(r.doc_id)]
        assert 1 - sum(r.score for r in out) / sum(r.base_score for r in out) >= least
        assert np.mean([r.score > r.base_score for r in out]) >= most
        assert 0.5 < np.mean([r.bits_per_byte for r in out]) < 4


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    runs = [{r.doc_id: r.score for r in score_documents(docs.repartition(n), F.col("doc_id") % 5 != 1, lang_col="lang").collect()} for n in (1, 7, 13)]
    assert runs[0].keys() == runs[1].keys() == runs[2].keys()
    assert all(math.isclose(s, r[i], rel_tol=1e-9) for r in runs[1:] for i, s in runs[0].items())


ODD = {
    900: "https://example.org/a/b?utm_source=feed&" + "&".join(f"k{i}=v{i * 7919}" for i in range(20)), 901: "吾輩は猫である名前はまだ無いどこで生れたか頓と見当がつかぬ", 902: "q" * 150, 903: "zx" * 150, 904: "Jk7+" * 25_000, 905: "the " + "wß" * 400 + " of",
}


@pytest.mark.parametrize("lang_col", [None, "lang"])
def test_long_unseen_words_have_finite_scores(spark, lang_col):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 900")
    odd = spark.createDataFrame([(i, t, None) for i, t in ODD.items()], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in score_documents(docs.unionByName(odd), F.col("doc_id") < 900, lang_col=lang_col).collect()}
    assert ODD.keys() < got.keys()
    assert all(math.isfinite(r.score) and math.isfinite(r.bits_per_byte) and math.isfinite(r.base_score) for r in got.values())
    for i, t in ODD.items():  # a byte of an unseen word costs some bits, not more than the clipped ones of a code of at most 40 bits
        assert -24 * 8 * (len(t.encode()) + 2) < got[i].score < -0.1 * len(t.encode()) / 8
    assert got[904].score < got[903].score < got[902].score < 0


def test_words_are_a_distribution(docs_of):
    docs = docs_of([(1, "ab ab b a abb"), (2, "b ab")])
    model = fit(word_counts(docs, F.lit(True), LanguageModel([], [], []), []), 1)
    letters = b"ab"
    counts = Counter(w for t in ("ab ab b a abb", "b ab") for w in tokens(t))
    level, total = [b""], 0.0
    for _ in range(9):
        total += (10 ** model.word_log10(level, np.array([[counts[w]] for w in level]))).sum(axis=0)
        level = [w + bytes([c]) for w in level for c in letters]
    assert (total > 0.4).all() and (total < 1).all()
    every = [bytes([b]) for b in range(256) if b != 0x20]
    first = 10 ** model.log10([b"", *every])
    assert (first.sum(axis=0) <= 1 + 1e-9).all()


def test_no_training_rows_repeated_rows_and_empty_table(docs_of):
    rows = score_documents(docs_of([(1, "a b"), (1, "a b"), (2, None)]), F.lit(None).cast("boolean")).collect()
    assert len(rows) == 3 and all(r.n_known == 0 and r.train_tokens == 0 for r in rows) and rows[0].score < 0
    assert score_documents(docs_of([]), F.lit(True)).collect() == []


def test_huffman_code_is_prefix_free():
    start, length, nodes, bits = huffman(np.arange(256.0) ** 3)
    codes = ["".join(map(str, bits[s : s + n])) for s, n in zip(start, length, strict=True)]
    assert abs(sum(2.0 ** -len(c) for c in codes) - 1) < 1e-12
    b = Bits([b"ab", b"", b"a"], np.zeros(3, int), (start, length, nodes, bits), SLOT_BITS)
    assert b.word.max() == 2 and len(b.value) == sum(length[list(b"ab  a ")])


def test_scores_against_a_plain_loop(docs_of):
    """Counts and spelling mixed by hand, from the speller's own word probabilities."""
    pairs = [(i, f"the cat {'ab'[i % 2] * 3} sat word{i % 9}") for i in range(30)] + [(31, "the new cat"), (36, None)]
    trained = lambda i: i % 5 != 1
    docs = docs_of(pairs)
    got = {r.doc_id: r.score for r in score_documents(docs, F.col("doc_id") % 5 != 1).collect()}
    counts = Counter(w for i, t in pairs if trained(i) for w in tokens(t))
    n, once = sum(counts.values()), sum(c == 1 for c in counts.values())
    model = fit(word_counts(docs, F.col("doc_id") % 5 != 1, LanguageModel([], [], []), []), 1)
    share = (once + 1) / (n + 2)
    for i, t in pairs:
        spelled = 10 ** model.log10(tokens(t))[:, 0]
        want = sum(math.log10((1 - share) * counts[w] / n + share * p) for w, p in zip(tokens(t), spelled, strict=True))
        assert math.isclose(got[i], want, rel_tol=1e-6), i
