"""Every query that has SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from codeweave.plans import catalog, catalog_symbols  # noqa: F401 - registers its queries in the catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows):
    return sorted((tuple(None if v is None else round(v, 5) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute("select {} from ({})".format(", ".join(f'"{c}"' for c in columns), catalog.ORACLES[name])).fetchall()
    assert plain(df.select(*(f"`{c}`" for c in columns)).collect()) == plain(want)


def test_rows_only_queries(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"louvain"}):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_lsh_recall_against_brute_force(spark, sf):
    d = SF.replace("sf0.001", sf)
    v = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    score = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    want = {(q, i) for q in v if q % 100 == 0 for i in sorted(v.keys() - {q}, key=lambda i: (-score(q, i), i))[:5]}
    got = {(r.query, r.id) for r in catalog.QUERIES["lsh_neighbours"](spark, d).collect()}
    print(sf, "recall", len(got & want) / len(want))
    assert len(got & want) >= 0.9 * len(want)
