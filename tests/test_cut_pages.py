"""Pages cut into blocks where they lie, and tables that a run leaves behind."""

import re

from pyspark.sql import functions as F

from graphloom.operators import stream, text
from graphloom.scratch import materialize, scratch_root


def _blocks(content):
    out, before = [], False
    for line in content.split("\n"):
        if not line.strip():
            continue
        numbered = re.match(r"\s*[0-9]+[.)] ", line) is not None
        if numbered and before:
            out[-1] += "\n" + line
        else:
            out.append(line)
        before = numbered
    return list(enumerate(out))


def test_pages_are_cut_without_a_shuffle(spark):
    contents = ["", "a", " \n\n", "1. a\n\n2) b\nx\n3. c\n4. d", "a\n1. b\n2. c", "1. z", "é\n  2. q\n3. r\n\nend\n", "1.a\n2. b"]
    rows = spark.createDataFrame([("s", i, c) for i, c in enumerate(contents)] + [("s", 99, None)], "source string, segment_index long, content string")
    cut = text.segment_blocks(rows)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in cut.collect():
        got.setdefault(r.segment_index, []).append((r.pos, r.content))
    assert got == {i: b for i, c in enumerate(contents) if (b := _blocks(c))}


def test_healing_leaves_one_table(spark):
    rows = spark.createDataFrame([("s", 1, "an open"), ("s", 2, "end of it."), ("s", 3, "Next.")], "source string, segment_index long, content string")
    blocks = text.segment_blocks(rows).withColumn("type", text.block_type(F.col("content")))
    root = spark._jvm.java.io.File(f"{scratch_root(spark)}/graphloom")
    materialize(spark.range(1), "root")
    left = lambda: {f for f in root.list() if f.startswith(("blocks-", "healed-", "pages-"))}
    before = left()
    healed = stream.heal_seams(blocks)
    assert sorted(r.content for r in healed.collect()) == ["Next.", "an open end of it."]
    assert len(left() - before) == 1
