"""Every catalogue query against its SQL on the smallest tables, with two partition counts."""

import math
import os

import duckdb
import pytest

from folioframe.plans import catalog, filecat

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | filecat.QUERIES, catalog.ORACLES | filecat.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["asof_label", "renumber", "newest_wins", "last_wins_collisions", "leverage"])
def test_partitions_do_not_matter(spark, name):
    one = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert sorted(map(str, QUERIES[name](spark, DATA).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
