import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from graphloom import catalog
from graphloom.functions.providers import bank_spans
from graphloom.operators import canonical, checks, graph, keys, search, stream, text, windows
from graphloom.sources import io
from graphloom.streaming import incremental


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


def test_uuid5_equals_pythons(spark):
    texts = ["", "a", "book#1", "é日本", "x" * 300]
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select(keys.uuid5(F.col("t")).alias("k")).collect()]
    assert got == [uuid.uuid5(uuid.NAMESPACE_URL, t).hex for t in texts]


@pytest.mark.parametrize("rule, before, after", [
    (text.math_delimiters, r"\(x\) and \[y\]", "$x$ and $$y$$"),
    (text.join_display_math, "$$a$$\n\n$$= b$$", "$$a\n= b$$"),
    (text.join_display_math, "$$a$$\n$$b$$", "$$a$$\n$$b$$"),
    (text.escape_currency, "costs $15, $x$ is", r"costs \$15, $x$ is"),
    (text.part_markers, "ⓐ x\nb) y\nc. z", "(a) x\n(b) y\n(c) z"),
    (text.markdown_markup, "Title\n=====\n* a\n\n\n\n![0]()", "# Title\n- a\n\n![0]()"),
])
def test_text_rules(spark, rule, before, after):
    assert one(spark, rule(F.col("t")), t=before) == after


def test_figures(spark):
    md = "![a](i2) ![b](i1) ![c](i2) ![d](other)"
    assert one(spark, io.rewrite_figure_refs(F.col("t"), F.array(*map(F.lit, ("i1", "i2", "i3")))), t=md) == "![1]() ![2]() ![1]() ![d](other)"
    pages = spark.createDataFrame([("s", [(md, " f ", [("i1", ""), ("i2", ""), ("i3", "")])])], "source string, " + io.PAGES.replace(":", ""))
    assert {r.image_id: r["index"] for r in io.pictures(io.read_ocr_pages(pages)).collect()} == {"i2": 1, "i1": 2, "i3": 3}


def test_edits_apply_in_order(spark):
    edits = F.array(F.struct(F.lit("a").alias("before"), F.lit("b").alias("after")), F.struct(F.lit("b").alias("before"), F.lit("c").alias("after")))
    assert one(spark, text.apply_edits(F.col("t"), edits), t="ab") == "cc"


def test_blocks_types_and_split(spark):
    page = spark.createDataFrame([("s", 0, "# Head\n\n1. one\n2. two\nprose\nPage 7")], "source string, segment_index int, content string")
    b = text.segment_blocks(page).withColumn("type", text.block_type(F.col("content"))).orderBy("pos").collect()
    assert [(r.content, r.type) for r in b] == [("# Head", "header"), ("1. one\n2. two", "list"), ("prose", "paragraph"), ("Page 7", "furniture")]
    n = spark.createDataFrame([("s", 0, 0, "paragraph", "In Exercises 3-4, compute the determinant."), ("s", 1, 0, "list", "3 matrix A\n4 matrix B"), ("s", 2, 0, "paragraph", "ordinary prose")], "source string, id long, segment_index int, type string, content string")
    out = stream.rebuild_stream(n, stream.packed_pieces(n)).orderBy("id").collect()
    assert [(r.id, r.content) for r in out] == [(0, "In Exercises 3-4, compute the determinant."), (1, "3 matrix A"), (2, "4 matrix B"), (3, "ordinary prose")]


def test_seams_heal_past_notes(spark):
    rows = [("s", 0, 0, "paragraph", "This goes on"), ("s", 0, 1, "note", "Note: x"), ("s", 1, 0, "paragraph", "over the page-"), ("s", 2, 0, "paragraph", "end. New."), ("s", 3, 0, "paragraph", "Stands alone.")]
    b = spark.createDataFrame(rows, "source string, segment_index int, pos int, type string, content string")
    got = sorted((r.segment_index, r.pos, r.content) for r in stream.heal_seams(b).collect())
    assert (0, 0, "This goes on over the page-") in got and (3, 0, "Stands alone.") in got and len(got) == 4


def test_windows_against_a_loop(spark):
    import random

    rng = random.Random(4)
    lengths = [rng.choice([0, 3, 40, 400, 900]) for _ in range(300)]
    n = spark.createDataFrame([("s", i, "paragraph", "x" * k) for i, k in enumerate(lengths)], "source string, id long, type string, content string")
    want, w, filled = {}, 0, 0
    for i, k in enumerate(lengths):
        if k:
            t = k // 4 + 1
            if filled + t > 600 and filled:
                w, filled = w + 1, 0
            filled += t
            want[i] = w
    assert {r.id: r.window_id for r in windows.fixed_windows(n).collect()} == want
    before = {r.id: r.context for r in windows.context_before(n).collect()}
    for i in range(len(lengths)):
        spent, parts = 0, []
        for j in range(i - 1, -1, -1):
            if lengths[j]:
                spent += lengths[j] // 4 + 1
                if spent > 400:
                    break
                parts.append("x" * lengths[j])
        assert before.get(i) == ("\n\n".join(parts[::-1]) or None)


@pytest.mark.parametrize(("budget", "span", "fanout"), [(7, 5, 2), (1, 3, 3), (50, 16, 2), (20, 4096, 64)])
def test_windows_over_many_spans(spark, budget, span, fanout):
    import random

    rng = random.Random(budget)
    rows = [(s, i, rng.choice([1, 1, 2, 5, budget, budget + 3])) for s in ("a", "b") for i in sorted(rng.sample(range(400), 150))]
    got = {(r.source, r.id): r.window_id for r in windows.pack_windows(spark.createDataFrame(rows, "source string, id long, tokens long"), budget, span, fanout).collect()}
    want, filled, w, book = {}, 0, 0, None
    for s, i, t in rows:
        if s != book:
            book, filled, w = s, 0, 0
        if filled and filled + t > budget:
            filled, w = 0, w + 1
        filled += t
        want[s, i] = w
    assert got == want


def test_units_members_and_roles(spark):
    rows = [("s", i, "header" if i == 7 else "paragraph", t) for i, t in enumerate(["intro", "Theorem 1", "it holds", " ", "Proof of it", "Hence", "Example 2", "Part", "prose", "Lemma 3"])]
    n = spark.createDataFrame(rows, "source string, id long, type string, content string").where("id <> 5")
    spans = stream.find_units(n)
    assert sorted((r.start, r.end, r.n) for r in spans.collect()) == [(1, 3, 3), (4, 4, 1), (6, 6, 1), (9, 9, 1)]
    m = stream.span_members(spans, n)
    assert sorted((r.span_id, r.id) for r in m.collect()) == [(1, 1), (1, 2), (1, 3), (4, 4), (6, 6), (9, 9)]
    assert 3 not in {r.id for r in stream.span_contents(m, n).collect()}
    roles = stream.type_roles(stream.span_contents(m, n))
    assert {r.span_id: (r.has_statement, r.has_procedure) for r in roles.collect()} == {1: (True, False), 4: (False, True), 6: (True, True), 9: (True, False)}
    st, pr = stream.build_hubs(spans, roles, n)
    assert {r.span_id for r in st.collect()} == {1, 6, 9} and {r.span_id for r in pr.collect()} == {4, 6}
    assert [(r.start, r.end) for r in stream.both_blocks(st, pr).collect()] == [(6, 6)]
    chosen = spark.createDataFrame([("s", 1, 2), ("s", 1, 50), ("s", 4, 50)], "source string, span_id long, position long")
    assert sorted((r.span_id, r.id) for r in stream.select_members(m, chosen).collect()) == [(1, 3), (4, 4), (6, 6), (9, 9)]
    keys_of = {r.span_id: r.uuid for r in graph.span_statements(m).collect()}
    assert keys_of[1] == uuid.uuid5(uuid.NAMESPACE_URL, "s#statement#1#2#3").hex
    wide = spark.createDataFrame([("s", 0, 0, 20_000)], "source string, span_id long, start long, end long")
    many = spark.range(0, 30_000, 7).select(F.lit("s").alias("source"), "id")
    assert stream.span_members(wide, many).count() == 20_000 // 7 + 1


@pytest.mark.parametrize("fact, want", [
    ("The area of $T$ is $ab/2$.", [("The area of $T$", "is", "$ab/2$")]),
    ("The group $G$ is abelian and has order $n^2$.", [("$G$", "is", "abelian"), ("$G$", "has order", "$n^2$")]),
    ("A map $h$ is injective on $X$ if $h(x) = h(y)$ implies $x = y$.", [("$h$", "is injective on", "$X$"), ("$h(x) = h(y)$", "implies", "$x = y$")]),
    ("A curve $c$ is flat if $k(t) = 0$.", [("$c$", "is", "flat"), ("k(t)", "equals", "0")]),
    ("Show that each open set is measurable.", [("each open set", "is", "measurable")]),
    ("Is the series $s_n$ divergent?", [("the series $s_n$", "is", "divergent")]),
    ("Is the series $s_n$ finite, and if so, what is its sum?", [("the series $s_n$", "is", "finite")]),
    ("If the series is finite, what is its sum?", []),
    ("The ring is not commutative because there are two such products.", [("The ring", "is not", "commutative")]),
    ("There is no path from here.", []),
    ("$K$ is not a subset of $L$.", [("$K$", "is not a subset of", "$L$")]),
    ("Such curves are closed.", []),
    ("The field has the property that every sum is finite.", []),
    ("Graphs without circles are called forests.", [("Graphs without circles", "are called", "forests")]),
    ("No relation here", []),
    ("", []),
])
def test_triplets_of_facts(spark, fact, want):
    from graphloom.operators import semantics

    got = [(t.subject, t.predicate, t.object) for t in one(spark, semantics.fact_triplets(F.col("t")), t=fact)]
    assert sorted(got) == sorted(want)
    assert all(s in fact and o in fact for s, _, o in got)


def test_upsert_twice_is_once(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "uuid string, name string")
    now = lambda y: F.to_timestamp(F.lit(f"{y}-01-01"))
    first = graph.upsert_vertices(graph.empty_like(rows), rows, now(2020))
    second = graph.upsert_vertices(first, rows, now(2021)).collect()
    assert sorted((r.uuid, r.name, r.created_at.year, r.modified_at.year) for r in second) == [("a", "x", 2020, 2021), ("b", None, 2020, 2021)]


def test_cosine_and_names(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, canonical.cosine(v(1.0, 0.0), v(0.0, 0.0)), t=1) == 0.0
    with pytest.raises(Exception, match="unequal"):
        one(spark, canonical.cosine(v(1.0), v(1.0, 2.0)), t=1)
    forms = spark.createDataFrame([(1, "long name", 0), (1, "name", 1)], "component int, name string, pos int")
    assert canonical.display_name(forms).first().display_name == "name"


def test_bank_spans_and_unknown_target(spark):
    n = spark.createDataFrame([("s", i, "x" * 400) for i in range(60)], "source string, id long, content string")
    find = lambda held: [(k, k + 2) for k, (i, _) in enumerate(held) if i % 3 == 0]
    got = sorted((r.start, r.end) for r in bank_spans(n, find).collect())
    assert got == [(i, i + 2) for i in range(0, 60, 3)]
    with pytest.raises(ValueError):
        search.search({}, "nothing", n)


def test_examples_gold_and_ingest(spark, tmp_path):
    path = str(tmp_path / "ex")
    assert io.read_examples(spark, path, "m", "inputs struct<a:int>, outputs struct<b:int>").collect() == []
    d = spark.createDataFrame([(1, 2)], "a int, b int")
    for run in ("r1", "r2"):
        io.write_examples(d, path, "m", run, ["a"], ["b"])
    last = io.read_examples(spark, path, "m", "inputs struct<a:int>, outputs struct<b:int>").collect()
    assert [(r.run_id, r.inputs.a, r.outputs.b) for r in last] == [("r2", 1, 2)]
    pages = spark.createDataFrame([("s", 0, "one\ntwo")], incremental.PAGE_SCHEMA)
    pages.write.parquet(str(tmp_path / "in"))
    store = incremental.NodeStore(spark, str(tmp_path / "graph"))
    for k in range(2):  # the second run replays the page
        incremental.ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / f"cp{k}")).awaitTermination()
    assert sorted(r.content for r in store.read().collect()) == ["one", "two"]


def test_reports(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "type string")
    assert checks.histogram_line(rows).first().line == "b=2 ?=1 a=1"
    assert checks.histogram_line(spark.createDataFrame([("",), (None,)], "type string")).first().line == "?=2"
    assert checks.histogram_line(rows.limit(0)).first().line == "none"
    assert one(spark, checks.snippet(F.col("t"), 3), t=" ab  cd ") == "ab …" and one(spark, checks.snippet(F.col("t"), 3), t=" abc ") == "abc"


def test_upsert_applies_repeated_keys_in_order(spark):
    rows = spark.createDataFrame([(1, "a", "x", None), (2, "a", None, "y"), (3, "a", "z", None), (1, "b", None, "q")], "n int, uuid string, p string, q string")
    out = graph.upsert_vertices(graph.empty_like(rows.drop("n")), rows, F.current_timestamp(), order=F.col("n"))
    assert sorted((r.uuid, r.p, r.q) for r in out.collect()) == [("a", "z", "y"), ("b", None, "q")]


def test_longest_chain(spark):
    nodes = spark.createDataFrame([(f"{s}{k}", s) for s in "abcd" for k in range(4)], "uuid string, source string")
    edges = [("a0", "a1"), ("a1", "a2"), ("a2", "a3"), ("b0", "b1"), ("c0", "c1"), ("c0", "c2"), ("d0", "d1"), ("d1", "d0")]
    got = checks.longest_chain(spark.createDataFrame(edges, "src string, dst string"), nodes).collect()
    assert {r.source: r.length for r in got} == {"a": 3, "b": 1, "c": None, "d": None}


def test_decisions_in_rounds(spark):
    from graphloom.functions.providers import decisions_from_function

    ask = lambda pdf: pdf[["id"]].assign(n=pdf.id * 2)
    got = decisions_from_function(spark.range(300), ask, "id long, n long", 2, 7, task_requests=40)
    assert sorted((r.id, r.n) for r in got.collect()) == [(i, 2 * i) for i in range(300)]


def test_tables_by_book_and_responses_without_bytes(spark, tmp_path):
    books = spark.range(200).select(F.concat(F.lit("b"), (F.col("id") % 30).cast("string")).alias("source"), "id")
    io.graph_write(books, str(tmp_path), "Node", parts=8)
    one = io.graph_read(spark, str(tmp_path), "Node", parts=8, source="b7")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and sorted(r.id for r in one.collect()) == list(range(7, 200, 30))
    assert io.graph_read(spark, str(tmp_path), "Node", parts=8).count() == 200
    (tmp_path / "r.json").write_text('{"source": "s", "pages": [{"markdown": "m", "footer": null, "images": [{"id": "i", "image_base64": "QUJD"}]}]}\n')
    pages = io.read_ocr_json(spark, str(tmp_path / "r.json"))
    assert "image_base64" not in pages._jdf.queryExecution().executedPlan().toString()
    assert [(r.source, r.segment_index, r.markdown, [i.id for i in r.images]) for r in pages.collect()] == [("s", 0, "m", ["i"])]
    assert io.read_ocr_json(spark, str(tmp_path / "r.json"), image_bytes=True).first().images[0].image_base64 == "QUJD"


def test_positions_from_edges(spark):
    chain = [(f"a{k}", f"a{k + 1}") for k in range(299)]
    odd = [("b0", "b1"), ("c0", "c1"), ("c1", "c2"), ("c2", "c1"), ("d0", "d2"), ("d1", "d2"), ("d2", "d3"), ("e1", "e2"), ("f0", "f1"), ("f1", "f0")]
    edges = spark.createDataFrame(chain[::-1] + odd, "src string, dst string").repartition(5)
    heads = spark.createDataFrame([(x, f"{x}0") for x in "abcdf"] + [("g", "g0")], "src string, dst string")
    names = {x for e in chain + odd for x in e} | {"g0", "h0"}
    got = {r.uuid: (r.head, r.position) for r in checks.stream_positions(heads, edges, spark.createDataFrame([(x,) for x in names], "uuid string")).collect()}
    want = dict.fromkeys(names, (None, None)) | {f"a{k}": ("a0", k) for k in range(300)} | {"b0": ("b0", 0), "b1": ("b0", 1), "c0": ("c0", 0), "d0": ("d0", 0), "f0": ("f0", 0), "f1": ("f0", 1), "g0": ("g0", 0)}
    assert got == want


@pytest.mark.parametrize("step", [3, 9, 40, 150])
def test_bank_spans_against_a_loop(spark, step):
    lengths = [(k * 37) % 700 for k in range(500)]
    n = spark.createDataFrame([("s", i, "x" * k) for i, k in enumerate(lengths)], "source string, id long, content string")

    def find(held):
        at = [k for k, (i, _) in enumerate(held) if i % step == 0]
        return [(a, (at[m + 1] if m + 1 < len(at) else len(held)) - 1) for m, a in enumerate(at)]

    want, cursor = [], 0
    while cursor < 500:
        size = 2000
        while True:
            end, total = cursor, 0
            while end < 500 and (end == cursor or total + lengths[end] // 4 + 1 <= size):
                total += lengths[end] // 4 + 1
                end += 1
            spans = find([(i, "") for i in range(cursor, end)])
            bounded = [s for s in spans if s[1] < end - cursor - 1]
            if spans and not bounded and end < 500 and size < 8000:
                size *= 2
                continue
            whole = not bounded or end == 500 or size >= 8000
            want += [(cursor + a, cursor + b) for a, b in (spans if whole else bounded)]
            cursor = end if whole else cursor + bounded[-1][1] + 1
            break
    assert sorted((r.start, r.end) for r in bank_spans(n, find).collect()) == sorted(want)


def test_entry_and_every_oracle_has_a_query(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_gold_set_joins_texts(spark, tmp_path):
    import json

    (tmp_path / "texts").mkdir()
    for name, body in (("a.md", "one\ntwo"), ("b.md", "three")):
        (tmp_path / "texts" / name).write_text(body)
    (tmp_path / "index.json").write_text(json.dumps({"records": [{"id": "x", "transcription": "a.md", "corrected": "b.md"}, {"id": "y", "transcription": "b.md", "corrected": "missing.md"}]}))
    got = io.read_gold_set(spark, str(tmp_path / "index.json"), str(tmp_path / "texts"), "id: STRING, transcription: STRING, corrected: STRING").collect()
    assert {r.id: (r.transcription_text, r.corrected_text) for r in got} == {"x": ("one\ntwo", "three"), "y": ("three", None)}


def test_types_vectors_and_embeddings(spark):
    t = spark.createDataFrame([(1, " Table "), (2, "Poem"), (3, None)], "id int, type string")
    assert {r.id for r in text.invalid_types(t).collect()} == {2, 3}
    with pytest.raises(Exception, match="unknown block type: Poem"):
        text.require_types(t.where("id < 3")).collect()
    v = spark.createDataFrame([("a", [1.0]), ("b", None)], "uuid string, embedding array<double>")
    assert [r.uuid for r in canonical.require_embeddings(v.where("uuid = 'a'")).collect()] == ["a"]
    with pytest.raises(Exception):
        canonical.require_embeddings(v).collect()
    from graphloom.operators import semantics

    rows = spark.createDataFrame([(1, "a b a"), (2, "a b a"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.embedding for r in semantics.attach_embeddings(rows).collect()}
    assert got[1] == got[2] == semantics.hashed_vector("a b a").tolist() and got[3] is None and got[4] == [0.0] * 64


def test_canonicalize_against_a_loop(spark):
    vectors = {0: [1.0, 0.0, 0.0], 1: [0.99, 0.1, 0.0], 2: [0.0, 1.0, 0.0], 3: [0.0, 0.0, 1.0]}
    spokes = spark.createDataFrame([(i, f"name{i}", f"about {i}", v, i) for i, v in vectors.items()], "id long, name string, description string, embedding array<double>, pos long")
    hubs = spark.createDataFrame([("h", [0.0, 0.9, 0.1])], "hub_uuid string, embedding array<double>")
    got = {r.cluster_id: (r.display_name, r.definition, r.hub_uuid) for r in canonical.canonicalize(spokes, hubs, 0.9, 0.9).collect()}
    assert got == {0: ("name0", "about 0 about 1", None), 2: ("name2", "about 2", "h"), 3: ("name3", "about 3", None)}
    known = incremental.incremental_canonicalize(spokes, hubs, 0.9, 0.9)[1].collect()
    assert len(known) == 3 and "h" in {r.hub_uuid for r in known} and all(len(r.embedding) == 3 for r in known)
