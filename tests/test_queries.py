"""Every query against its SQL, on small tables, and the entry points."""

import math
import os

import pytest

from lumenfold.plans import catalog

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def plain(rows, columns, names):
    at = [names.index(c) for c in columns]
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, FOLDER)
    got, columns = df.collect(), sorted(df.columns)
    if (sql := catalog.oracle_sql().get(name)) is None:
        assert got
        return
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    assert plain(got, columns, df.columns) == plain(found.fetchall(), columns, names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, partitions):
    names = ("run_summary", "lexical_topk", "nearest_join", "suppress_near", "object_tracks", "round_robin_sample")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {n: sorted(map(str, catalog.queries()[n](spark, FOLDER).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert want == {n: sorted(map(str, catalog.queries()[n](spark, FOLDER).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
