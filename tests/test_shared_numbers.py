"""Queries on edges against their SQL where parts have the numbers of suppliers' nodes, as from a million parts on."""

import duckdb
import pytest

from loomcat.plans import catalogue, judging  # noqa: F401

#: Parts, suppliers and line items (order, line, part, supplier): edges both ways between the numbers 1000001 and 1000002, one from 1000003 to itself.
PARTS = [1, 2, 1_000_001, 1_000_002, 1_000_003, 1_000_009, 1_000_051]
LINES = [(1, 1, 1_000_002, 1), (2, 1, 1_000_001, 2), (3, 1, 1_000_003, 3), (7, 2, 1_000_002, 2), (14, 1, 1_000_001, 2), (4, 1, 1, 4), (4, 2, 1, 4), (5, 1, 1_000_009, 4), (6, 1, 2, 2), (8, 1, 1_000_009, 2), (9, 1, 1_000_001, 51)]


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    con = duckdb.connect()
    flags = [(*line, flag, status, 0.01 * (i % 5)) for i, line in enumerate(LINES) for flag, status in (("A", "F"), ("A", "O"), ("R", "F"))]
    con.execute("create table lineitem(l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag varchar, l_linestatus varchar, l_discount double)")
    con.executemany("insert into lineitem values (?, ?, ?, ?, ?, ?, ?)", flags)
    con.execute("alter table lineitem add column l_shipdate timestamp")
    con.execute("create table part as select unnest(?::bigint[]) as p_partkey", [PARTS])
    con.execute("create or replace table part as select p_partkey, case when p_partkey % 2 = 0 then 45 else 5 end::int as p_size from part")
    con.execute("create table supplier as select i::bigint as s_suppkey, (i % 25)::int as s_nationkey, (i - 2)::double as s_acctbal from unnest([1, 2, 3, 4, 51]) t(i)")
    con.execute("create table embeddings as select i::bigint as vec_id from range(5) t(i)")
    for t in ("lineitem", "part", "supplier", "embeddings"):
        con.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
    return str(folder), con


def check(spark, sf, name):
    folder, con = sf
    ours, theirs = catalogue.QUERIES[name](spark, folder).toPandas(), con.sql(catalogue.SQL[name]).df()
    columns = sorted(theirs.columns)
    assert columns == sorted(ours.columns)
    rows = lambda frame: sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in frame[columns].itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)


def test_assets_under_kind(spark, sf):
    """1000004 is a supplier's node only, 1000001 to 1000003 are parts and suppliers."""
    folder, con = sf
    con.execute("insert into part values (1000004, 5)")
    con.execute(f"copy part to '{folder}/part.parquet' (format parquet)")
    check(spark, sf, "assets_under_kind")


def test_graph_violations(spark, sf):
    """Edges at a number that is a part's and a supplier's count once."""
    check(spark, sf, "graph_violations")


def test_graph_rules(spark, sf):
    """A part and a supplier are never one node; an edge counts once for each pair of node rows, in repeats too."""
    check(spark, sf, "graph_rules")


def test_upserted_edges(spark, sf):
    """A part keeps its place before a supplier of a lower number, and is none of a supplier's loops."""
    check(spark, sf, "upserted_edges")


def test_judged_pairs(spark, sf):
    """1000002 to 1000001 and 1000001 to 1000002 are two pairs, each of a part and a supplier."""
    check(spark, sf, "judged_pairs")


def test_linked_candidates(spark, sf):
    """The edge of 1000001 to the supplier at 1000051 does not link 1000051 to the supplier at 1000001."""
    check(spark, sf, "linked_candidates")
