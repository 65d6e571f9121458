import random

import numpy as np
import pytest

from graphloom.llm import substring_dedup
from graphloom.llm.common import doc_words, hash_words
from graphloom.llm.substring_dedup import dedup_substrings, occurrences


def brute(pairs, width):
    words = {}
    for i, t in pairs:
        if i is not None:
            words[i] = (t or "").encode().split()
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), b" ".join(kept).decode())
    return out


def made(seed, vocabulary, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 70, 200]))] for _ in range(6)] + [["a"] * 120, ["a", "b"] * 60, ["a"] * 55 + ["c"] * 55]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [word() for _ in range(rng.randrange(0, 60))]
            p = rng.choice(passages)
            w += p[rng.randrange(0, 20) :] if rng.random() < 0.5 else p
        docs.append((i * 3, rng.choice([" ", "\n", " \t"]).join(w)))
    for i in range(4):  # near copies
        w = docs[i][1].split()
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        docs.append((1000 + i, " ".join(w)))
    return docs + [(2000, docs[0][1]), (2001, docs[0][1])]


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.collect()}


@pytest.mark.parametrize("seed, vocabulary", [(1, 1000), (2, 2), (3, 30)])
def test_against_brute_force(docs_of, seed, vocabulary):
    pairs = made(seed, vocabulary, 40) + [(3000, None), (3001, ""), (3002, "x " * 49), (3003, " x" * 50), (3004, "x " * 300), (None, "x " * 60), (3005, "né " * 60), (3006, "né " * 51), (3007, "a\xa0b " * 50)]
    assert result(dedup_substrings(docs_of(pairs, rest="r", tk="t", text2="u").repartition(3))) == brute(pairs, 50)


def test_shuffled_path_repeated_rows_and_small_windows(docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_RANGES", -1)
    pairs = made(4, 50, 15)
    assert result(dedup_substrings(docs_of(pairs), width=8)) == brute(pairs, 8)
    text = " ".join(map(str, range(60)))
    rows = dedup_substrings(docs_of([(5, text), (5, text), (7, text), (5, "other words")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(5, 0), (5, 0), (5, 0), (7, 60)]


def test_empty_table(docs_of):
    assert dedup_substrings(docs_of([])).collect() == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    common = [f"c{k}" for k in rng.integers(0, 40, 90)]
    texts = [" ".join([f"u{k}" for k in rng.integers(0, 9, int(n))] + common + [f"v{k}" for k in rng.integers(0, 9, int(m))]) for n, m in rng.integers(0, 70, (30, 2))]
    words, starts = doc_words(texts)
    h = hash_words(words)
    o = occurrences(h, starts)
    seen = {}
    for doc, a, b, sym in zip(o["doc"], o["a"], o["b"], o["sym"]):
        for i in range(a, b + 1):
            seen.setdefault(tuple(words[starts[doc] + i : starts[doc] + i + 50]), set()).add(int(sym))
    assert all(len(x) == 1 for x in seen.values())
    assert len(o["a"]) < 0.15 * sum(max(0, n - 49) for n in np.diff(starts))


def test_a_very_long_text_and_a_passage_of_it(docs_of):
    words = [f"w{i % 9973}x{i // 9973}" for i in range(300_000)]
    pairs = [(1, " ".join(words)), (2, "before " + " ".join(words[123_456:123_556]) + " after"), (3, " ".join(words[:49])), (4, "")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in dedup_substrings(docs_of(pairs)).select("doc_id", "n_words", "n_removed", "kept").collect()}
    assert got == {1: (300_000, 0, pairs[0][1]), 2: (102, 100, "before after"), 3: (49, 0, pairs[2][1]), 4: (0, 0, "")}
