from itertools import combinations

import numpy as np

from graphloom.llm import language_id
from graphloom.llm.language_id import fit_machine, group_families, identify, train

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def labelled(spark, languages, texts=4):
    """Each language has ten words of its own; the later languages have fewer texts."""
    rows, at = [], 0
    for k in range(languages):
        rng = np.random.default_rng(k)
        words = ["".join(rng.choice(list(LETTERS), 7)) for _ in range(10)]
        for _ in range(texts + (k < 64)):
            rows.append((at, " ".join(rng.choice(words, 30)), f"l{k:03d}"))
            at += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_every_language_is_learned(spark):
    docs = labelled(spark, 70)
    model = train(docs)
    assert sorted(n for f in model.families for n in f) == [f"l{k:03d}" for k in range(70)]
    assert len(model.between) == len(model.families) * (len(model.families) - 1) // 2
    assert [len(m) for m in model.within] == [len(f) * (len(f) - 1) // 2 for f in model.families]
    got = identify(docs, model).select("lang_pred", "row.lang").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_machines_of_groups_are_those_of_the_whole_sample(spark):
    docs = labelled(spark, 6)
    model = train(docs)
    rows = docs.selectExpr("lang", "text", "xxhash64(doc_id, text) AS h").collect()
    rows.sort(key=lambda r: (r.lang, r.h))
    x = language_id.features([r.text for r in rows]).astype(np.float16).astype(np.float32)
    for machines in model.within:
        for a, b, w, bias in machines:
            who = [k for k, r in enumerate(rows) if r.lang in (a, b)]
            want, c = fit_machine(x[who], np.array([1 if rows[k].lang == a else -1 for k in who]))
            assert np.allclose(w, want) and np.isclose(bias, c)


def test_families_are_average_linkage():
    means = np.random.default_rng(3).random((12, 5))
    unit = means / np.linalg.norm(means, axis=1, keepdims=True)
    near, want = unit @ unit.T, [[k] for k in range(12)]
    while len(want) > 2:
        score, i, j = max((near[np.ix_(a, b)].mean(), i, j) for (i, a), (j, b) in combinations(enumerate(want), 2))
        if score <= near[np.triu_indices(12, 1)].mean():
            break
        want[i] += want.pop(j)
    assert group_families(means) == want
