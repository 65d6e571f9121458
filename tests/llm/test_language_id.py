import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.language_id import features, fit_machine, group_families, identify, train


def split(docs):
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return docs.where((rest != 2) & F.col("lang").isNotNull())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs, train(split(docs))).select("doc_id", "lang_pred", "score", "row.lang").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang_pred != "und"]
    assert len(held) > 150 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_results(docs_of, spark, sf_dir):
    model = train(split(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    pairs = [(1, None), (2, ""), (3, "123 !!! ..."), (4, "the of and with"), (5, "the of and with"), (5, "the of and with"), (None, "the"), (6, "the and of " * 60000), (7, "é")]
    got = identify(docs_of(pairs, p="p", row="r", lang_pred="q"), model).collect()
    assert len(got) == 8
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4] == by[5] and by[6][0] == "en" and by[7][0] != "und"
    assert identify(docs_of([]), model).collect() == []


def test_nothing_to_learn_from(docs_of, spark):
    none = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = identify(docs_of([(1, "words")]), train(none)).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)
    one = spark.createDataFrame([(1, "text", "xx")], "doc_id long, text string, lang string")
    assert identify(docs_of([(1, "words")]), train(one)).first().lang_pred == "xx"


def test_parts():
    x = features(["abc", "abc", "xyz", ""])
    assert np.allclose(x[0], x[1]) and not np.allclose(x[0], x[2]) and not x[3].any()
    w, b = fit_machine(np.array([[1.0, 0.0], [0.0, 1.0]], np.float32), np.array([1, -1]))
    assert w[0] + b > 0 > w[1] + b
    assert sorted(map(sorted, group_families(np.array([[1, 0.1, 0], [1, 0.2, 0], [0, 0.1, 1], [0, 0.2, 1]])))) == [[0, 1], [2, 3]]
