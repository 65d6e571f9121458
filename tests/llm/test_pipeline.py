from collections import Counter

import pytest

import corpus_pipeline
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_groups
from test_substring_dedup import brute as brute_words


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input and each stage's rows, on the smallest given documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        out.append(docs.collect())
    return out


def pairs(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_language_stage_keeps_what_it_can_tell(spark, stages):
    from graphloom.llm.language_id import identify, train

    docs = spark.createDataFrame(stages[0], "doc_id long, text string, lang string, source string, n_chars long")
    said = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, train(docs)).collect()}
    want = {i for i, (lang, score) in said.items() if lang != "und" and score >= 0.5}
    assert {r.doc_id for r in stages[1]} == want and len(want) >= 0.98 * len(said)
    assert all(r.text and any(c.isalpha() for c in r.text) for r in stages[1])


def test_line_stage(stages):
    text = dict(pairs(stages[1]))
    want = {i: kept if dropped else text[i] for i, (_, dropped, kept) in brute_lines(pairs(stages[1]), 10).items()}
    assert {r.doc_id: r.text for r in stages[2]} == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_duplicate_stage(stages):
    want = {i for i, (_, group) in brute_groups(pairs(stages[2])).items() if i == group}
    assert {r.doc_id for r in stages[3]} == want and Counter(map(len, stages[3])) == {5: len(want)}


def test_substring_stage(stages):
    want = brute_words(pairs(stages[3]), 50)
    text = dict(pairs(stages[3]))
    assert {r.doc_id: r.text for r in stages[4]} == {i: text[i] if not gone else kept for i, (_, gone, kept) in want.items()}


def test_packing_stage(stages):
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    assert all(r.length & (r.length - 1) == 0 for r in stages[5]) and len({r.sequence_id for r in stages[5]}) == len(stages[5])


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages[5])
