import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import line_dedup
from graphloom.llm.line_dedup import CuckooFilter, build_store, dedup_lines, drop_lines, update_store


def brute(pairs, least):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})

    split = {i: (t or "").split("\n") for i, t in pairs if i is not None}
    n = Counter(k for lines in split.values() for k in {key(x) for x in lines} if k)
    return {i: (len(lines), len(lines) - len(kept := [x for x in lines if n[key(x)] < least]), "\n".join(kept)) for i, lines in split.items()}


PAIRS = (
    [(i, f"Common line \n own {i}\n\n  COMMON LINE\t\x0b\nsemi {i % 5}\nÉcole\x85") for i in range(40)]
    + [(100 + i, "common line") for i in range(20)]
    + [(500, None), (501, ""), (502, "\n"), (503, "\n\n"), (504, "x" * 200_000 + "\ncommon line"), (505, "École\x85\nécole\x85"), (None, "common line"), (506, "no newline")]
)


def result(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in df.collect()}


def test_against_brute_force(docs_of):
    assert result(dedup_lines(docs_of(PAIRS, hot="h", row="r", keys="k", lines="l"))) == brute(PAIRS, 10)


@pytest.mark.parametrize("parts", [1, 3])
def test_filters_probed_by_shard(docs_of, monkeypatch, parts):
    rnd = random.Random(7)
    docs = docs_of([(i, "\n".join(f"Line {rnd.randrange(60)}" for _ in range(rnd.randrange(12)))) for i in range(120)] + [(900, None), (901, "line 3\nonly here")]).repartition(5)
    store = line_dedup.build_store(docs, min_docs=11, shards=7)
    rows = lambda: sorted((r.doc_id, r.n_dropped, r.kept) for r in line_dedup.drop_lines(store, docs).collect())
    sent = rows()
    asked = line_dedup._keys(line_dedup._rows(docs, "doc_id", "text").select("id", "text"), 1).select("id", "keys")
    monkeypatch.setattr(line_dedup, "BROADCAST_FILTER_BYTES", -1)
    monkeypatch.setattr(line_dedup, "SHARD_PARTS", parts)
    assert rows() == sent and sum(r[1] for r in sent) > 0
    hot = {(r.h1, r.h2) for r in store.refs.where("n >= 11").collect()}
    every = {(r.id, k.h1, k.h2) for r in asked.collect() for k in r["keys"]}
    found = {(r.id, r.h1, r.h2) for r in line_dedup._probe_shards(store, asked).collect()}
    assert {x for x in every if x[1:] in hot} <= found <= every and len(found) < len(every)


def test_join_path_gives_the_same(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_FILTER_BYTES", -1)
    monkeypatch.setattr(line_dedup, "BROADCAST_HITS", -1)
    assert result(dedup_lines(docs_of(PAIRS))) == brute(PAIRS, 10)


def test_inserting_and_deleting_is_reversible(docs_of):
    old, new = PAIRS[:45], PAIRS[45:]
    docs = docs_of(PAIRS)
    store = build_store(docs_of(old), shards=3)
    more = update_store(store, inserted=docs_of(new))
    assert result(drop_lines(more, docs)) == brute(PAIRS, 10)
    back = update_store(more, deleted=docs_of(new))
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, store.refs.collect()))
    assert result(drop_lines(back, docs)) == result(drop_lines(store, docs))
    gone = update_store(back, deleted=docs_of(old))
    assert gone.refs.count() == 0 and all(not np.frombuffer(r.slots, np.uint16).any() for r in gone.filters.collect())


def test_empty_table(docs_of):
    assert dedup_lines(docs_of([])).collect() == []


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    h1, h2, o1, o2 = (rng.integers(-(2**62), 2**62, 5000) for _ in range(4))
    f = CuckooFilter(5000)
    assert f.insert(h1, h2) and f.contains(h1, h2).all()
    assert f.contains(o1, o2).mean() < 0.002
    f.delete(h1[:2500], h2[:2500])
    assert f.contains(h1[2500:], h2[2500:]).all() and f.contains(h1[:2500], h2[:2500]).mean() < 0.002
    g = CuckooFilter.from_bytes(f.to_bytes())
    g.delete(h1[2500:], h2[2500:])
    assert not g.slots.any()
    assert not CuckooFilter(8).insert(h1, h2)
