import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=300))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    k, coded = golomb_encode(v)
    assert golomb_decode(len(v), k, coded).tolist() == v.tolist()


def test_golomb_is_compact():
    v = np.unique(np.random.default_rng(1).integers(0, 2**40, 50_000).astype(np.uint64))
    assert len(golomb_encode(v)[1]) < 3.6 * len(v)


def test_against_groups_in_python(docs_of):
    pairs = [(i, f"text {i % 7}") for i in range(50)] + [(100 + i, "hot") for i in range(400)] + [(900, None), (901, ""), (902, " "), (903, "é"), (904, "é"), (None, "hot"), (905, "z" * 300_000), (906, "z" * 300_000)]
    rows = {r.doc_id: r for r in exact_dedup(docs_of(pairs).repartition(5)).collect()}
    groups = defaultdict(list)
    for i, t in pairs:
        if i is not None:
            groups[t or ""].append(i)
    assert len(rows) == sum(map(len, groups.values()))
    for t, ids in groups.items():
        for i in ids:
            r = rows[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_repeated_rows_and_empty_table(docs_of):
    got = exact_dedup(docs_of([(1, "a"), (1, "a"), (2, "a"), (3, "b")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True)]
    assert exact_dedup(docs_of([])).collect() == []


def test_very_long_texts_that_differ_at_their_end(docs_of):
    long = "long text, " * 400_000  # 4.4 MB
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs_of([(1, long), (2, long), (3, long + "x"), (4, None)])).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4}
