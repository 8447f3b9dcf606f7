"""Each registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomcat.plans import catalogue, judging, policies, screens  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame, columns):
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, db, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)
