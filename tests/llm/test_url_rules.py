"""Rules of urls against every rule on every url."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from nearfield.llm import url_rules

ODD = [
    (1, None), (2, "nothing"), (3, "HTTP://Www.EXAMPLE.com/en/x"), (4, "http://a.net"), (5, "http://a.net/es/"), (6, "x://y://net/fr/"), (7, "http://spam.org/\n?q"),
    (None, "http://net/es/"), (8, "http://anti-spam.org"), (8, "http://anti-spam.org"), (9, "http://é.com/én/" + "x" * 100000), (10, "http://xcom/"), (11, "://"), (12, "http://q.org/POKER"),
    (13, "http://evil.net/es/casino"), (14, "http://a.org/clickme.php?x"), (15, ""), (16, "http://a.com#/x"), (17, "http://a.org?com/"), (18, "http://example.com/en"), (19, "http://example.com/EN/"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "page_id long, url string").withColumns({c: F.lit("x") for c in ("token", "best", "rule", "host", "_url", "low")}).repartition(3)


def by_sql(sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", ODD)
    return con.execute(sql).fetchall()


def test_against_sql(odd):
    got = url_rules.judge(odd)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, by_sql(url_rules.SQL)))
    assert url_rules.judge(odd.limit(0)).count() == 0


def test_main_path_is_native(odd):
    plan = url_rules.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_of_a_table(spark):
    rules = [("block", "host", "b.example/"), ("allow", "host", "b.example/x"), ("block", "host", "bare.example"), ("block", "host", "a.example/q?x"), ("block", "pattern", "*ell*"), ("allow", "pattern", "^shell^"), ("block", "pattern", "^a.b^*z")]
    pages = [(1, "http://b.example/"), (2, "http://b.example/xy"), (3, "http://bare.example"), (4, "http://c.bare.example/p"), (5, "http://bare.example.org/"), (6, "http://u.org/bells"), (7, "http://u.org/shell"), (8, "http://a.b/12z"), (9, "http://a.example/q?x"), (10, "http://axb/z")]
    table = spark.createDataFrame(rules, "verdict string, kind string, rule string")
    got = {r.page_id: (r.rule or r.pattern, r.verdict) for r in url_rules.judge(spark.createDataFrame(pages, "page_id long, url string"), table).collect()}
    assert got == {
        1: ("b.example/", "block"), 2: ("b.example/x", "allow"), 3: ("bare.example", "block"), 4: ("bare.example", "block"), 5: (None, "allow"),
        6: ("*ell*", "block"), 7: ("^shell^", "allow"), 8: ("^a.b^*z", "block"), 9: (None, "allow"), 10: (None, "allow"),
    }


def test_rarest_tokens(spark):
    urls = spark.createDataFrame([("www.example.com/en/",)] * 3 + [("example.com/fr/",)] * 2 + [("other.com/en/",)], "low string")
    index = {r.rank.rule: r.token for r in url_rules.rule_index(url_rules.default_rules(spark), urls).collect()}
    assert index["www.example.com/en/"] == "www" and index["example.com/en/"] == "en" and index["com/"] == "com" and index["net/es/"] in ("es", "net")
    tokens = {r.rule: r.tokens for r in url_rules.compiled(spark.createDataFrame([("block", "host", "a.b/cd"), ("block", "pattern", "ads*x^y")], "verdict string, kind string, rule string")).collect()}
    assert tokens == {"a.b/cd": ["a", "b"], "ads*x^y": []}  # what may go on in the url is no whole token
