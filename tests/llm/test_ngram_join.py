import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import ngram_join
from graphloom.llm.ngram_join import bits_apart, index_entries, jaccard_groups, joining_links, parity_bits, shared_counts


def brute(pairs, words=5):
    sets = {}
    for i, t in pairs:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(ids[a]), find(ids[b])
                label[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def made(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    docs, base = [], [[word() for _ in range(rng.choice([3, 5, 6, 9, 14, 40, 90, 110, 130, 300]))] for _ in range(12)]
    boiler = [word() for _ in range(30)]
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + max(1, len(w) // 18))):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w += boiler
        docs.append((i, " ".join(w)))
    return docs + [(200 + i, " ".join(boiler + [word() for _ in range(rng.randrange(0, 14))])) for i in range(40)]


EDGE = [(500, None), (501, ""), (502, "one"), (503, "One"), (504, "one two three four"), (505, "one two three four five"), (None, "one"), (506, "\t"), (507, "É a b c d e"), (508, "é a b c d e"), (509, "a " * 5000), (510, "a " * 7)]


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed, least", [(1, 16), (2, 2), (3, 10**9)])
def test_against_brute_force(docs_of, monkeypatch, seed, least):
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", least)
    if seed == 2:
        monkeypatch.setattr(ngram_join, "LIST_BLOCK", 5)
        monkeypatch.setattr(ngram_join, "HOT_LISTS", 100)
        monkeypatch.setattr(ngram_join, "TOGETHER", 3)
        monkeypatch.setattr(ngram_join, "STARS", 0)
    pairs = made(seed) + EDGE
    assert result(jaccard_groups(docs_of(pairs, ck="c", sig="s").repartition(3))) == brute(pairs)


@pytest.mark.parametrize("seed", range(6))
def test_joining_links(seed):
    rng = random.Random(seed)
    base = [rng.randrange(2**60) for _ in range(60)]
    sets = [np.array(sorted(rng.sample(base, rng.randrange(30, 60)) + [rng.randrange(2**60) for _ in range(rng.randrange(12))]), np.uint64) for _ in range(rng.choice([2, 3, 40, 150]))]
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    np.fill_diagonal(both, 0)
    assert (shared_counts(sets) == both).all()
    comp = np.array([rng.randrange(len(sets)) // 2 for _ in sets])

    def merged(pairs):
        label = {c: c for c in comp.tolist()}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for i, j in pairs:
            p, q = find(comp[i]), find(comp[j])
            label[max(p, q)] = min(p, q)
        return [find(c) for c in comp.tolist()]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 175 * both[i, j] >= 75 * (len(sets[i]) + len(sets[j]))]
    found = joining_links(np.arange(len(sets)), comp, sets, 75)
    assert set(map(lambda e: tuple(sorted(map(int, e), reverse=True)), found)) <= set(every)
    assert len(found) < max(2, len(set(comp.tolist())))
    assert merged(found) == merged(every)


def test_repeated_rows_and_empty_table(docs_of):
    t = "a b c d e f g h i j"
    rows = jaccard_groups(docs_of([(4, t), (4, t), (9, t), (5, "other")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(4, 4), (4, 4), (5, 5), (9, 4)]
    assert jaccard_groups(docs_of([])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_linked_sets_share_an_entry(data):
    rng = random.Random(data.draw(st.integers(0, 10**9)))
    n = rng.choice([1, 2, 3, 5, 20, 71, 72, 73, 95, 96, 97, 110, 127, 128, 129, 150])
    pool = [rng.randrange(2**63) for _ in range(400)]
    a = set(rng.sample(pool, n))
    b = set(a)
    for x in rng.sample(sorted(a), rng.randrange(0, n // 4 + 1)):
        b.discard(x)
    while rng.random() < 0.7 and len(b) < 2 * n:
        b.add(rng.choice(pool))
    both = len(a & b)
    if a == b or 100 * both < 75 * len(a | b):
        return
    frequent = np.array(sorted(rng.sample(pool, rng.choice([0, 40, 300, 400]))), np.uint64)
    noise = rng.choice([0, 0.3, 1])
    ea, eb = (index_entries(np.array(sorted(s), np.uint64), np.array([x in a & b or hash(x) % 100 < 100 * noise for x in sorted(s)]), frequent) for s in (a, b))
    assert bits_apart(*(parity_bits(np.array(sorted(s), np.uint64)) for s in (a, b))) <= len(a ^ b)
    assert set(ea[0].tolist()) & set(eb[0].tolist()) or set(ea[1].tolist()) & set(eb[1].tolist())
