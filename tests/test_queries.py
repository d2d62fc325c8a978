"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from weftline import queries

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    show = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(show, r)) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_whole_tables_are_used(spark):
    assert queries.flagship(spark, FOLDER).where("t > 600").count() > 0
    parts = spark.read.parquet(f"{FOLDER}/part.parquet")
    assert queries.QUERIES["agreement_equal"](spark, FOLDER).where("i = j").count() == parts.count()
    users = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id").distinct()
    assert queries.QUERIES["module_z_und"](spark, FOLDER).select("node").distinct().count() == users.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
