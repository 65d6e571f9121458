import hashlib

from pyspark.sql import functions as F

from graphloom.operators.digests import ordered_digest


def test_groups_within_and_across_partitions(spark):
    groups = {"big": 5000, "one": 1, "two": 2, "": 3, "é": 40}
    rows = spark.createDataFrame([(k, i, f"v{i}") for k, n in groups.items() for i in range(n)] + [(None, 1, "x"), ("null", 1, None)], "k string, i int, v string").repartition(7)
    want = {k: (hashlib.sha256(b"h" + ",".join(f"v{i}" for i in range(n)).encode()).hexdigest(), n) for k, n in groups.items()} | {"null": (hashlib.sha256(b"h").hexdigest(), 1)}
    for block in (1 << 18, 100, 1):
        out = ordered_digest(rows, "k", ["i"], F.col("v"), "sha256", ",", F.lit(b"h"), block_bytes=block).collect()
        assert {r.key: (r.digest, r.n) for r in out} == want
        assert len(out) == len(want)


def test_order_of_many_keys_and_an_empty_table(spark):
    rows = spark.range(3000).select((F.col("id") % 700).cast("string").alias("k"), (-F.col("id")).alias("o"), F.col("id").alias("v"))
    out = {r.key: r.digest for r in ordered_digest(rows, "k", ["o"], F.col("v"), "sha1", "#").collect()}
    want = {str(k): hashlib.sha1("#".join(str(i) for i in sorted((i for i in range(3000) if i % 700 == k), reverse=True)).encode(), usedforsecurity=False).hexdigest() for k in range(700)}
    assert out == want
    assert ordered_digest(rows.where("false"), "k", ["o"], F.col("v")).collect() == []
