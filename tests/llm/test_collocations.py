import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm.collocations import ShardIndex, count_phrases, mine_phrases


def brute_counts(rows, most):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    counts[lang][" ".join(w[i : i + n])] += 1
    return counts, total


def brute(rows, most, least, cover=50, top=2000):
    counts, total = brute_counts(rows, most)
    out = []
    for lang, c in counts.items():
        found = []
        for p, a in c.items():
            w = p.split(" ")
            if len(w) < 2 or a < least:
                continue
            cuts = [(1000000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            longer = [f for q, f in c.items() if f >= least and len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
            if any(100 * f >= cover * a for f in longer):
                continue
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), p, a, c[" ".join(w[:k])], c[" ".join(w[k:])], total[lang], score))
        out += [(lang, i + 1, *f[3:]) for i, f in enumerate(sorted(found)[:top])]
    return sorted(out)


def some_rows(seed=3, n=60):
    rnd = random.Random(seed)
    words = ["a", "B", "é", "the", "of", "x-y", "Ünder", "\x00"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rnd.randint(0, 60)))
        rows.append((text, rnd.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), (" .,;\n", "de"), ("a b " * 400, "en"), rows[0], rows[0]]


@pytest.mark.parametrize(("most", "shard", "least"), [(3, 1000, 10), (2, 50, 3), (4, 70, 4), (5, 1 << 20, 6), (3, 7, 10)])
def test_against_brute_force_over_shards_that_cut_pieces(spark, most, shard, least):
    rows = some_rows()
    docs = spark.createDataFrame([(t, g, 1, "p") for t, g in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = mine_phrases(docs, max_words=most, min_count=least, shard_words=shard).collect()
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute(rows, most, least)


def test_counts_are_those_of_all_phrases(spark):
    rows = some_rows(5)
    counts, total = brute_counts(rows, 3)
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {(r.lang, r.phrase): r.n for r in count_phrases(docs, min_count=2, shard_words=40).collect()}
    want = {(g, p): n for g, c in counts.items() for p, n in c.items() if n >= 2} | {(g, None): n for g, n in total.items()}
    assert got == want


def test_best_only_and_ties(spark):
    docs = spark.createDataFrame([("b c. a b. c d", "en")] * 12, "text string, lang string")
    got = [(r.rank, r.phrase) for r in mine_phrases(docs, top=2).orderBy("rank").collect()]
    assert got == [(r[1], r[2]) for r in brute([("b c. a b. c d", "en")] * 12, 3, 10, top=2)]


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert mine_phrases(empty).collect() == []
    long = " ".join(["up", "and", "down"] * 200_000)  # one piece of 2 MB
    got = {r.phrase: (r.a, r.n) for r in mine_phrases(spark.createDataFrame([(long, "en")], "text string, lang string"), shard_words=100_000).collect()}
    assert got == {"up and down": (200_000, 600_000), "and down up": (199_999, 600_000), "down up and": (199_999, 600_000)}


def test_intervals_in_both_directions():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 5, 500)
    index = ShardIndex(ids, 4)
    text = " ".join(map(str, ids))
    p = index.words()
    for left in (True, False, True):
        p = index.extend(p, left)
        assert len(np.unique(p.ids, axis=0)) == len(p.ids)
        for k in range(len(p.size)):
            want = [i for i in range(len(ids)) if (ids[i : i + p.ids.shape[1]]).tolist() == p.ids[k].tolist()]
            assert p.size[k] == len(want), text
            assert (index.first[p.forward[k] : p.forward[k] + p.size[k]] == p.ids[k][0]).all()
            assert sorted(index.last[p.forward[k] : p.forward[k] + p.size[k]]) == sorted(ids[i - 1] if i else 0 for i in want)
            assert sorted(index.back_last[p.backward[k] : p.backward[k] + p.size[k]]) == sorted(([*ids, 0])[i + p.ids.shape[1]] for i in want)
