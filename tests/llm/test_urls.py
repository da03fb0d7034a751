import random

import pytest
from pyspark.sql import functions as F

from maskloom.llm.queries import URL_RULES
from maskloom.llm.urls import alias_edges, judge

SCHEMA = "page_id long, url string, html string, host string, root long"


def page(head=""):
    return f"<html><head>{head}</head><body>x</body></html>"


ROWS = [
    (0, "https://A.example.NET/en/1?x=1#t", page()),
    (1, "http://b.example.net/fr/1", page()),
    (2, "https://example.com/de/7", page()),
    (3, "https://notexample.com/de/7", page()),
    (4, "https://x.org/fr/1", page()),
    (5, None, None),
    (6, "no scheme", page()),
    (7, "ftp://shop.biz", page()),
    # aliases of a blocked page, over two hops and in both directions
    (8, "https://one.biz/a", page('<link rel="canonical" href="https://two.biz/b?x=1&amp;y=2">')),
    (9, "https://two.biz/b?x=1&y=2", page("<META HTTP-EQUIV=refresh CONTENT='0; URL=//evil.net/z'>")),
    (10, "https://three.biz/c/d", page("<link href=../up rel='shortcut canonical'>")),
    # a component with an allowed member
    (11, "https://four.biz/a", page('<link rel=canonical href="https://x.org/fr/2">')),
    (12, "https://five.biz/a", page('<link rel=canonical href="https://four.biz/a"><meta http-equiv="refresh" content="1;url=https://evil.net/q">')),
    # own rule beats the aliases
    (13, "https://y.org/fr/9", page('<link rel=canonical href="https://evil.net/own">')),
    (14, "https://six.biz/a", page('<!-- <link rel=canonical href="https://evil.net/z"> --><script>"<link rel=canonical href=https://evil.net/z>"</script>')),
    (15, "https://seven.biz/p/q", page('<link rel="canonical" href="r">')),
    (16, "https://seven.biz/p/r", page('<link rel="canonical" href="https://evil.net/only">')),
    (8, "https://one.biz/a", page('<link rel="canonical" href="https://two.biz/b?x=1&amp;y=2">')),
    (17, "http://one.biz/a#frag", page()),
    (18, "https://net/", ""),
]


def frame(spark):
    return spark.createDataFrame([(*r, "mine", 1) for r in ROWS], SCHEMA).repartition(3)


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(frame(spark), URL_RULES).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("b.example.net", "/fr/1", "net/", "block")
    assert got[2] == ("example.com", "/de/7", "example.com/de/", "block")
    assert got[3] == ("notexample.com", "/de/7", None, "allow")
    assert got[4] == ("x.org", "/fr/1", "org/fr/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7] == ("shop.biz", "", None, "allow")
    assert got[18] == ("net", "/", "net/", "block")


def test_aliases(spark):
    rows = judge(frame(spark), URL_RULES)
    got = {r.page_id: r.verdict for r in rows.collect()}
    assert rows.count() == len(ROWS)
    assert rows.columns == ["page_id", "url", "root", "host", "path", "rule", "verdict"]
    assert got[8] == got[9] == got[17] == got[15] == got[16] == "block"
    assert got[11] == got[12] == got[13] == got[14] == got[10] == "allow"
    known = spark.createDataFrame([("https://six.biz/a", "https://evil.net/new"), (None, "x")], "a string, b string")
    assert {r.page_id: r.verdict for r in judge(frame(spark), URL_RULES, edges=known).collect()}[14] == "block"


def test_longest_rule_and_empty(spark):
    rules = [("block", "biz/"), ("allow", "one.biz/"), ("block", "one.biz/a"), ("allow", "biz/abcdefg")]
    got = {r.page_id: r.rule for r in judge(frame(spark), rules).collect()}
    assert got[8] == "one.biz/a" and got[9] == "biz/"
    assert judge(spark.createDataFrame([], SCHEMA), URL_RULES).count() == 0
    assert alias_edges(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_aliases_against_brute_force(spark):
    """Chains, cycles, a hot target and random links of 400 pages against a plain search."""
    rng = random.Random(6)
    hosts = ["a.net", "b.net", "x.example.net", "one.biz", "two.biz", "three.biz", "four.org"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'fr'])}/{i}" for i in range(400)]
    target = {}
    for i in range(100):
        target[i] = i + 1 if i % 20 else None  # chains of 20
    for i in range(100, 140):
        target[i] = 100 + (i - 99) % 40  # a cycle
    for i in range(140, 260):
        target[i] = 300  # a hot target
    for i in range(260, 300):
        target[i] = rng.randrange(260, 400)
    rows = []
    for i, url in enumerate(urls):
        goal = target.get(i)
        rows.append((i, url, "" if goal is None else f'<html><head><link rel="canonical" href="{urls[goal]}"></head>', "x"))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, root string")
    rules = [("block", "net/"), ("allow", "example.net/en/")]

    def own(url):
        host, _, path = url.removeprefix("https://").partition("/")
        if host.endswith("example.net") and path.startswith("en/"):
            return "allow"
        return "block" if host.endswith(".net") else None

    near = {i: set() for i in range(400)}
    for i, goal in target.items():
        if goal is not None:
            near[i].add(goal), near[goal].add(i)
    want = {}
    for i in range(400):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        rest = {own(urls[j]) for j in seen}
        want[i] = own(urls[i]) or ("block" if "block" in rest and "allow" not in rest else "allow")
    got = {r.page_id: r.verdict for r in judge(docs, rules).collect()}
    assert got == want and sum(own(u) is None and v == "block" for u, v in zip(urls, want.values())) > 20


@pytest.mark.parametrize("name", ["_node", "_by_alias", "_found", "node", "by_alias", "found", "root", "own_0", "a", "b", "blocked", "goal"])
def test_clashing_names(spark, name):
    want = {r.page_id: r.verdict for r in judge(frame(spark), URL_RULES).collect()}
    got = judge(frame(spark).withColumn(name, F.lit("theirs")), URL_RULES)
    assert {r.page_id: r.verdict for r in got.collect()} == want
    assert [r[0] for r in got.select(name).distinct().collect()] == ["theirs"]
