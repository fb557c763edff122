"""Every registered SQL-backed query against DuckDB on the smallest tables, and order independence of a search."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
TABLES = [f.removesuffix(".parquet") for f in os.listdir(DATA)] if os.path.isdir(DATA) else []


def shown(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return repr(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    mine = sorted(tuple(shown(v) for v in r) for r in got.select([f"`{c}`" for c in columns]).collect())
    theirs = sorted(tuple(shown(dict(zip(names, r))[c]) for c in columns) for r in want.fetchall())
    assert mine == theirs


def test_numbered_page_titles_match_sql(spark, tmp_path):
    """An h1 is of level 1 even if its title begins with an address or a section number."""
    html = "<h1>{}</h1><p>One.</p><p> Two. </p>"
    rows = [(1, "u/1", html.format("56.187.231.175 Keit")), (2, "u/2", html.format("2.1 Scope")), (3, "u/3", html.format("Plain"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("section_tree_text", "structure_score"):
        want = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        got = entry.queries()[name](spark, str(tmp_path)).select(columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_partitioning_does_not_matter(spark):
    from docloom.plans import catalog

    want = sorted(map(tuple, catalog.two_phase_search(spark, DATA).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(map(tuple, catalog.two_phase_search(spark, DATA).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
