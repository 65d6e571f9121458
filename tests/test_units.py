import duckdb

from graphloom import catalog
from graphloom.plans.base import nodes


def test_units_with_members_by_given_and_planted_labels(spark, sf_dir):
    got = catalog.queries()["c16_find_units"](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(catalog.oracle_sql()["c16_find_units"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(rows) == sorted(want.fetchall())
    # by hand: a unit at each ninth node, up to the next one or the next heading
    ids = {}
    for r in nodes(spark, sf_dir).select("source", "id").collect():
        ids.setdefault(r.source, []).append(r.id)
    units = {}
    for source, held in ids.items():
        unit = None
        for i in sorted(held):
            if i % 9 == 0:
                unit = units.setdefault((source, i), [])
            elif i % 20 == 5:
                unit = None
            if unit is not None:
                unit.append(i)
    found = {}
    for labels, source, span, _, _, n, i in rows:
        if labels == "planted":
            found.setdefault((source, span), []).append(i)
            assert n == len(units[source, span])
    assert {k: sorted(v) for k, v in found.items()} == units
    assert any(r[0] == "given" for r in rows)
