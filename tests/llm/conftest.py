import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with internal ones."""

    def make(pairs, **extra):
        names = list(extra)
        rows = [(i, t, *(extra[n] for n in names), "x", 1) for i, t in pairs]
        kinds = ", ".join(f"{n} string" for n in names)
        return spark.createDataFrame(rows, f"doc_id long, text string, {kinds + ', ' if kinds else ''}id string, n int")

    return make
