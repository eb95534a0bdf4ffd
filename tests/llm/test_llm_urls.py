import pyarrow.parquet as pq
import pytest

from oracle import compare, connect
from fleetgauge.llm import urls

SCHEMA = "page_id bigint, url string, html string"


def link(*hosts):
    return "".join(f'<p><a class="x" href="http://{h}/p?q">x</a><a href=\'/home\'>y</a>' for h in hosts)


PAGES = [
    (1, "http://EXAMPLE.org/es/x", None), (2, "http://a.example.org/en/12?q", ""),
    (3, "https://good.com/fr/a", link("Friend.net", "friend.net", "both.net")),
    (4, "https://bad.com/de/a#x", link("far.net")), (5, "http://friend.net/", link("next.net")),
    (6, "http://spam.net/p", link("bad.com", "worse.net", "friend.net")), (7, "http://next.net", None),
    (8, "http://both.net?x", link("bad.com")), (9, "http://far.net#y", None),
    (10, None, link("bad.com")), (11, "no scheme", None), (12, "http:///path", None),
    (13, "http://notexample.orgs/es/", None), (14, "http://x.org", None), (15, "http://x.org/", None),
    (16, "://lone.net/a", '<a href="//bad.com/x">z</a>'), (17, "http://worse.net/u", link("spam.net")),
    (18, "a://b.com/fr/?u=http://c.org/", None), (18, "a://b.com/fr/?u=http://c.org/", None),
    (None, "http://bad.com/de/b", link("friend.net")),
]


def unique(rows):
    return [r for i, r in enumerate(rows) if r[0] is not None and r not in rows[:i]]


def test_links_and_rules_equal_sql(spark, frame, tmp_path):
    rows = unique(PAGES)
    df = frame(rows, SCHEMA)
    pq.write_table(df.toArrow(), tmp_path / "pages.parquet")
    assert compare(urls.judged(df.repartition(3)), connect(str(tmp_path)), urls.SQL) == []


def test_trust_and_distrust_travel(spark, frame):
    found = {r.page_id: r for r in urls.judged(frame(PAGES, SCHEMA)).collect()}
    assert (found[1].rule, found[1].verdict, found[1].path) == ("example.org/es/", "block", "/es/x")
    assert found[2].rule == "example.org/en/1" and found[2].path == "/en/12"
    assert found[5].verdict == "allow" and found[7].verdict == "allow"
    assert found[6].verdict == "block" and found[16].verdict == "block"
    assert found[17].verdict == "block" and found[9].verdict == "allow"
    assert (found[10].host, found[10].path, found[10].rule, found[10].verdict) == ("", "", None, "allow")
    assert found[11].host == "" and found[12].path == "/path"
    assert found[14].rule is None and found[15].rule == "org/"
    assert found[18].rule == "com/fr/" and found[None].verdict == "block"


def test_rows_are_kept(spark, frame):
    assert urls.judged(frame(PAGES, SCHEMA)).count() == len(PAGES)
    assert urls.judged(frame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rounds", [1, 3])
def test_ranks_follow_the_formula(spark, rounds):
    links = spark.createDataFrame(
        [("a", "b", 1), ("a", "c", 3), ("b", "c", 1)], "source string, target string, links bigint")
    start = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "c", 1.0)], "kind string, host string, seed double")
    got = {(r.kind, r.host): r["rank"] for r in urls.ranks(links, start, rounds).collect()}
    base = 1 - urls.FOLLOWED
    assert got["trust", "a"] == pytest.approx(base)
    assert got["trust", "b"] == pytest.approx(base * urls.FOLLOWED / 4)
    c = base * urls.FOLLOWED * 3 / 4 + (base * urls.FOLLOWED**2 / 4 if rounds > 1 else 0)
    assert got["trust", "c"] == pytest.approx(c)
    assert got["distrust", "a"] == pytest.approx(
        base * urls.FOLLOWED * 3 / 4 + (base * urls.FOLLOWED**2 / 4 if rounds > 1 else 0))
