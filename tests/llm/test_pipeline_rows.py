import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)


def test_line_stage_returns_every_document(spark):
    texts = ["one line\nof a copy"] * 12 + ["one line\nwith a rest", "another text", " \none line"]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, docs_of(spark, texts), "").collect()}
    assert got == {i: ("", 0) for i in range(12)} | {12: ("with a rest", 11), 13: ("another text", 12), 14: (" ", 1)}


def test_substring_stage_returns_every_document(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.substring_stage(spark, docs_of(spark, [passage, passage, f"more {passage}", "short"]), "").collect()}
    assert got == {0: (passage, len(passage)), 1: ("", 0), 2: ("more", 4), 3: ("short", 5)}


def test_emptied_documents_reach_the_last_stage(spark):
    docs = docs_of(spark, ["one line\nof a copy"] * 12 + ["another text"])
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert {r.doc_id for r in docs.select("doc_id").collect()} == set(range(13)), name


TALK = [" ".join(f"{w}{k % 7}" for k in range(80)) for w in ("alpha", "beta", "gamma")]


def odd_docs(spark):
    """Nulls, repeated ids and rows, a very long text, and columns whose names clash with internal ones."""
    texts = [(1, TALK[0]), (5, TALK[0]), (5, "another text altogether"), (5, "another text altogether"), (6, None), (7, ""), (8, " \t"), (9, "1234 5678"), (None, TALK[0])]
    texts += [(20 + k, f"{TALK[1]} {'tail ' * k}") for k in range(3)] + [(30, "long words " * 60_000), (31, f"start {TALK[2]}"), (32, f"{TALK[2]} and more than that was here before")]
    rows = [(i, t, None if k % 4 == 3 else "en" if k % 2 else "de", None, None if t is None else len(t), 7, "x", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, row string, kept int")


def keys(df):
    return sorted(r.kept for r in df.collect())


def test_stages_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = {name: stage(spark, docs, "") for name, stage in corpus_pipeline.STAGES}
    assert all(df.columns == docs.columns for name, df in out.items() if name != "packing")
    with_id = [r.kept for r in docs.collect() if r.doc_id is not None]
    assert keys(out["line_dedup"]) == with_id and keys(out["substring_dedup"]) == with_id
    assert set(keys(out["language_id"])) <= set(with_id) - {4, 5, 6, 7}
    near = keys(out["ngram_join"])
    assert 0 in near and 1 not in near  # (5, TALK[0]) goes, the other rows of id 5 stay
    assert {2, 3, 4, 5, 6, 7, 8} <= set(near)
    assert sum(k in near for k in (9, 10, 11)) == 1
    text = {r.kept: r.text for r in out["substring_dedup"].collect()}
    assert text[0] == TALK[0] and text[1] == "" and text[2] == text[3] == "another text altogether" and text[4] is None and text[6] == " \t"
    assert text[13] == f"start {TALK[2]}" and text[14] == "and more than that was here before"
    assert {r.doc_id for r in out["packing"].collect()} == {r.doc_id for r in docs.collect()} - {None}


def test_stages_on_an_empty_table(spark):
    docs = odd_docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []
