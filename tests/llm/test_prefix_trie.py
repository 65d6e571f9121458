import hashlib
import random

import numpy as np

from graphloom.llm.common import distinct
from graphloom.llm.prefix_trie import PerfectTable, branch, conversation_trie, pack_turns, prefix_trie


def in_order(rows):
    """Each conversation's (role, text) in order."""
    said = lambda r, t: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).hexdigest()
    out = {}
    for c, turn, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, said(x[2], x[3]))):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def brute(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = lambda m: [x for x in members if len(x) == len(m) + 1 and x[: len(m)] == m]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in sorted(who) if tuple(paths[c]) == node)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children(node)), sum(not children(m) for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=40):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        base = rnd.choice(["x", "y", "xyé"])
        for t in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", None]), rnd.choice([base, base, "", None, "long " * 3])))
    rows += [(1000 + k, t, "user", "same") for k in range(15) for t in range(6)]  # copies
    rows += [(2000, t, "user", str(t // 7)) for t in range(70)] + [(2001, t, "user", str(t // 7)) for t in range(55)]  # long ones with a common head
    rows += [rows[0], rows[0], (None, 0, "user", "no id"), (-5, 2, "user", "x")]
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "n", 3) for r in rows], "conv_id long, turn long, role string, text string, node string, first int").repartition(parts)


def result(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_against_brute_force(spark):
    rows = rows_of(1)
    assert result(conversation_trie(frame(spark, rows))) == brute(in_order(rows))


def test_small_units_and_shards(spark):
    rows = rows_of(2)
    turns = frame(spark, rows)
    for unit, shard in ((3, 1), (4, 17), (1, 5)):
        assert result(prefix_trie(pack_turns(turns, unit=unit), turns.select("conv_id"), shard_turns=shard)) == brute(in_order(rows))


def test_branches(spark):
    rows = rows_of(3)
    paths = in_order(rows)
    plan = {c: (c - c % 10 if c != 7 else 999_999, c % 6) for c in paths}
    want = {c: paths.get(b, [])[:h] + paths[c][h:] for c, (b, h) in plan.items()}
    assert any(not p for p in want.values())  # one without turns
    turns = frame(spark, rows)
    planned = spark.createDataFrame([(c, b, h) for c, (b, h) in plan.items()], "conv_id long, base_id long, h int")
    units = branch(pack_turns(turns, unit=4), planned, 5)
    assert result(prefix_trie(units, planned.select("conv_id"), shard_turns=30)) == brute(want)


def test_empty_table_and_turnless(spark):
    empty = frame(spark, [], 1)
    assert conversation_trie(empty).collect() == []
    only = spark.createDataFrame([(3,), (4,)], "conv_id long")
    assert result(prefix_trie(pack_turns(empty), only)) == brute({3: [], 4: []})


def test_very_long_text(spark):
    rows = [(1, 0, "user", "ab" * 500_000), (2, 0, "user", "ab" * 500_000), (2, 1, "assistant", "c")]
    assert result(conversation_trie(frame(spark, rows))) == brute(in_order(rows))


def test_perfect_table():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000, 50_000):
        keys = distinct(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for levels in (40, 1):
            table = PerfectTable(keys, levels)
            assert len(table) == len(keys)
            assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
