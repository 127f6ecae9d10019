from __future__ import annotations

import duckdb
import pytest

from docspark.llm import url_filter
from docspark.llm.queries import op4_url_filters

COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def canonical(href):
    return f'<html><head><LINK rel="alternate canonical" data-x="1" href="{href}"></head></html>'


PAGES = [
    (1, "http://A.Example.NET/en/1#x", None),
    (2, "https://b.net/x", canonical("https://c.com/a?b=1&amp;c=2")),
    (3, "http://c.com/a?b=1&c=2#frag", ""),
    (4, "https://d.com/dir/page", "<meta http-equiv='Refresh' content='0; url=other'>"),
    (5, "https://d.com/dir/other", canonical("//c.com/a?b=1&c=2")),
    (6, "https://e.com/", canonical("/root")),
    (7, "https://e.com/root", canonical("https://f.org/fr/ok")),
    (8, "https://g.net/", canonical("https://e.com/root")),
    (9, None, canonical("https://b.net/x")),
    (10, "no scheme", None),
    (11, "x://", None),
    (12, "https://net", None),
    (13, "https://h.com/de/1", canonical("mailto:x")),
    (13, "https://h.com/de/1", canonical("mailto:x")),
    (14, "https://example.com/de/", None),
    (15, "https://notexample.com/de/?x#y", None),
    (16, "https://example.net?/en/", None),
    (17, "https://i.com/a/b/c", canonical("../x/./y?q=.&#46;/z")),
    (18, "https://j.net/1", canonical("https:&sol;/i.com/a/&#120;/y?q=../z")),
    (19, "https://i.com/a/x/y?q=../z", None),
    (20, "https://k.com/a/", canonical("..")),
    (21, "https://k.com/", "<meta http-equiv=refresh content='5; url=&#x2F;&#x2f;j.net/..&#47;1'>"),
]
EXPECTED = {
    1: ("a.example.net", "/en/1", "example.net/en/", "allow"),
    2: ("b.net", "/x", "net/", "block"),
    3: ("c.com", "/a", None, "block"),  # alias of a blocked page
    4: ("d.com", "/dir/page", None, "block"),  # refreshes to 5, which names 3
    5: ("d.com", "/dir/other", None, "block"),
    6: ("e.com", "/", None, "allow"),
    7: ("e.com", "/root", None, "allow"),  # blocked by 8, but explicitly allowed by its canonical page
    8: ("g.net", "/", "net/", "block"),
    9: ("", "", None, "allow"),
    10: ("", "", None, "allow"),
    11: ("", "", None, "allow"),
    12: ("net", "", None, "allow"),
    13: ("h.com", "/de/1", None, "allow"),
    14: ("example.com", "/de/", "example.com/de/", "block"),
    15: ("notexample.com", "/de/", None, "allow"),
    16: ("example.net", "", None, "allow"),
    17: ("i.com", "/a/b/c", None, "block"),  # by dot segments and references an alias of 18's
    18: ("j.net", "/1", "net/", "block"),
    19: ("i.com", "/a/x/y", None, "block"),
    20: ("k.com", "/a/", None, "block"),
    21: ("k.com", "/", None, "block"),
}


def test_verdicts(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = url_filter.filter_urls(pages, url_filter.rules_table(spark)).select(*COLUMNS).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert tuple(r)[1:] == EXPECTED[r["page_id"]], r


def test_many_rules_are_joined(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = url_filter.filter_urls(pages, url_filter.rules_table(spark), most_literal=2).select(*COLUMNS).collect()
    assert sorted((r[0], tuple(r)[1:]) for r in rows) == sorted([*EXPECTED.items(), (13, EXPECTED[13])])
    none = url_filter.filter_urls(pages, url_filter.rules_table(spark).limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}


def test_oracle_sql_says_the_same(spark):
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    said = con.sql(url_filter.ORACLE)
    assert said.columns == COLUMNS
    assert {r[0]: r[1:] for r in said.fetchall()} == EXPECTED


def test_query_is_native_and_equals_sql(spark, sf_dir):
    found = op4_url_filters(spark, sf_dir)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(url_filter.ORACLE).fetchall())


def test_table_of_redirects_clashing_columns_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/1", "mine", "x"), (2, "http://b.com/2", "mine", "y")], "page_id long, url string, host string, other string")
    redirects = spark.createDataFrame([("http://a.com/1", "http://t.net/x"), (None, "http://b.com/2"), ("http://a.com/1", "http://t.net/x")], "source string, target string")
    rules = url_filter.rules_table(spark)
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules, redirects).collect()}
    assert (rows[1]["verdict"], rows[2]["verdict"], rows[1]["host"], rows[1]["other"]) == ("block", "allow", "a.com", "x")
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_components(spark, shape):
    from docspark.llm.components import connected_components
    from docspark.storage import Workspace

    edges = [(i, i + 1) if shape == "chain" else (0, i + 1) for i in range(200)] + [(1000, 1000), (2000, 1999), (1999, 2000), (None, 5)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(201)] + [(1999, 1999), (2000, 1999)]
