"""Golden cases, invariants and plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from contactlake.functions import classify, dom, email, names, text, url
from contactlake.operators.merge import coalesced, merged, new_value
from contactlake.operators.sampling import positions
from contactlake.sources.bindings import Tables, with_bindings


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_email_valid(spark):
    cases = {"a@b.com": True, "a..b@c.com": False, "x@mail.acme.in": False, "x@a.co.in": True, "x@a.com.tr": False, ".a@b.com": False, "a@b@c.com": False, "": False, "a@b.com\n": False}
    assert column(spark, list(cases), email.valid) == list(cases.values())
    assert [dom.email_ok(x) for x in list(cases)[:-1]] == list(cases.values())[:-1]


def test_email_category(spark):
    assert column(spark, ["sales@x.com", "christopher@x.com", "accounts@x.com", "john@x.com"], email.category) == ["Sales", "Careers", "Billing", "General"]


def test_candidates(spark):
    got = column(spark, ["Ana B Silva", "Cher"], lambda c: email.candidates(c, F.lit("x.com")))
    assert got[0][:3] == ["ana.silva@x.com", "anas@x.com", "asilva@x.com"] and len(got[0]) == 11 and got[1] == []


def test_patterns(spark):
    pair = lambda c: email.inferred_from_pair(F.lit("jane"), F.lit("doe"), c)
    assert column(spark, ["j.doe@x.com", "jane+a@x.com", "x@x.com"], pair) == ["firstinitial.last", "first", None]
    assert column(spark, ["jane.doe@x.com", "sales.uk@x.com", "jane@x.com"], email.inferred_from_local) == ["first.last", None, None]


def test_names(spark):
    assert column(spark, ["O’Meara", "Anna López", "Web Team"], names.looks_like) == [False, True, False]
    assert column(spark, ["José", "Łukasz", "straße"], text.accent_fold) == ["Jose", "Łukasz", "straße"]
    assert dom.split_role("Neil Cawse Founder and CEO") == ("Neil Cawse", "Founder and CEO")
    assert dom.split_role("Vice President, Global Solutions Brad Taylor") is None
    assert dom.split_reversed("Vice President, Global Fleet Solutions Brad Taylor") == ("Brad Taylor", "Vice President Global Fleet Solutions")
    assert dom.split_reversed("Sales Manager, National Accounts Christian Wales") == ("Christian Wales", "Sales Manager National Accounts")


def test_urls(spark):
    assert column(spark, ["https://www.m.acme.com/p", "http://localhost/", "x"], url.url_domain) == ["acme.com", "localhost", ""]
    assert column(spark, ["jobs.linkedin.com", "localhost", "acme.com"], url.blocked) == [True, True, False]
    assert column(spark, ["https://x.com/acme", "https://www.x.com/acme", "https://facebook.com/sharer?u=1"], url.social_network) == [None, "x", None]


def test_blocklist(spark):
    rows = spark.createDataFrame([("Optimum Automotive", "motive"), ("OnelapTelematics", "onelap"), ("Teletrac Navman UK", "navman teletrac")], "c string, e string")
    got = [r.m for r in rows.select(classify.matches_entry(F.col("c"), F.lit(""), F.col("e"), F.lit(None).cast("string")).alias("m")).collect()]
    assert got == [False, True, True]


def test_verdicts(spark):
    rows = spark.createDataFrame([("bad", True, None, None), ("a@yopmail.com", True, None, None), ("a@b.com", False, None, None), ("a@b.com", True, "rejected", None), ("a@b.com", True, "deliverable", "yes"), ("a@b.com", True, "deliverable", "no"), ("a@b.com", True, "blocked", None), ("a@b.com", True, "unknown", None)], "e string, m boolean, s string, c string")
    got = [r.v for r in rows.select(email.verdict(F.col("e"), F.col("m"), F.col("s"), F.col("c")).alias("v")).collect()]
    assert got == ["invalid", "disposable", "invalid", "rejected", "catchall", "deliverable", "blocked", "mx-ok"]


def test_json():
    assert [sorted(d) for d in dom.flattened([{"a": {"name": "x"}}, "s"])] == [["a"], ["name"]]
    assert dom.address({"address": {"streetAddress": "1 Rd", "addressLocality": "X", "addressCountry": "DE"}}) == "1 Rd, X, DE"
    assert dom.people_items("Ann Lee (CEO)") == dom.people_items("Ann Lee|(CEO)") == [("Ann Lee", "CEO")]


def test_tree_is_tolerant():
    root = dom.tree("<p><b>x<br><p>y</b></i><li>a<li>b<script>z</script>")
    assert root.text() == "x y a b"
    assert dom.tree("").text() == "" and list(dom.cards(dom.tree("<h1>" + "x " * 60))) == []


def test_merge_keeps_keys_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "k")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "c", None, 1), (2, "d", "m", 2), (2, "e", None, 3), (3, None, "z", 4)], "id int, v string, w string, ord int")
    rules = {"v": new_value, "w": coalesced}
    once = merged(old, new, ["id"], rules, "ord")
    want = [(1, "a", None), (2, "e", "m"), (3, None, "z")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, merged(once, new, ["id"], rules, "ord").collect())) == want


def test_positions_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = {r.k: r._pos for r in positions(df, [F.col("k")]).collect()}
    assert got == {k: k for k in range(1000)}


def test_bindings_nest():
    sql = with_bindings("with x as (select * from emails) select * from x")
    assert sql.index("found_emails as") < sql.index(" emails as") < sql.index("x as (select * from emails)")


@pytest.mark.parametrize("column", ["name", "domain"])
def test_scan_prunes_columns(spark, column):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t.companies.where("country = 'NATION_3'").select(column)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "PushedFilters" in plan


def test_markup(spark):
    from contactlake.functions import markup

    assert column(spark, ["a [[B|C D]]<ref name=x/> [[E]]<ref>[[F]]</ref><BR/>g {{small|h}} i", "[[x|y|z]]"], markup.clean) == ["a C D E, g i", "y|z"]
    assert column(spark, ["{{ubl|Ann|([[x|CEO]])|{{small|Bo}}}}", "( [[CTO]] )"], markup.prepared) == ["Ann|(CEO)|Bo", "(CTO)"]
    assert column(spark, ["Ann Lee (1950–2001) et al.", "Bo (born 1970) Ek 1999", "bo", "x" * 61, "(2010) lower case"], markup.clean_name) == ["Ann Lee", "Bo  Ek", None, None, None]


def test_now_is_utc(spark):
    import datetime

    from contactlake.plans.catalog import QUERIES

    got = QUERIES["ts_now_utc"](spark, "/root/testdata/sf0.001").selectExpr("unix_timestamp(now) as s").distinct().collect()
    assert len(got) == 1 and abs(got[0].s - datetime.datetime.now(datetime.timezone.utc).timestamp()) < 120


def test_seed_is_incremental(spark):
    from contactlake.sources.seed import DIRECTORY, SEGMENTS, seed_rows, seeded

    assert seed_rows(spark).count() == len(DIRECTORY) == 143 and {r[5] for r in DIRECTORY} <= set(SEGMENTS) and len({r[2] for r in DIRECTORY}) == 38
    first = spark.createDataFrame([(1, "Mine", DIRECTORY[0][1], False)], "id long, name string, domain string, blocked boolean")
    once = seeded(first)
    assert once.count() == 143 and once.where("id = 1").first().name == "Mine" and seeded(once).count() == 143


def test_robots_first_match_decides(spark):
    from contactlake.operators.frontier import robots_allowed

    body = "User-agent: *\nAllow: /a/b\nDisallow: /a\n\nUser-agent: leads\nDisallow:\n"
    rows = [(1, "https://x.com/a/b/c", 200, body), (2, "https://x.com/a/c", 200, body), (3, "https://x.com/", 401, None), (4, "https://x.com/", 500, None), (5, "https://x.com/", 200, None)]
    df = spark.createDataFrame(rows, "k long, url string, status int, body string")
    assert {r.k: r.allowed for r in robots_allowed(df, "k", "other/1").collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    assert all(r.allowed for r in robots_allowed(df.where("k < 3"), "k", "Leads/2").collect())


def test_redirects_end_and_never_return(spark):
    from contactlake.operators.frontier import followed

    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x")], "source string, target string")
    got = {x.title: (x.final, x.hops) for x in followed(spark.createDataFrame([("a",), ("x",), ("q",)], "title string"), r).collect()}
    assert got == {"a": ("d", 3), "x": ("y", 1), "q": ("q", 0)}


def test_text_stops_early():
    root = dom.tree("<div>" + "<p>word</p>" * 50 + "</div>")
    assert root.text(most=90) == "" and root.text(most=10_000) == root.text() and dom.tree("<p>ab<p>c").text(most=4) == "ab c"


PIECES = (
    "<p>|</p>|<div class='a'>|</div>|<a href=\"mailto:p@acme.example.com?x\">|<a href=\"https://www.linkedin.com/in/x?a\">|<a href=\"tel:+49 30 123456\">|</a>|<br>|<br/>|<br />|<i x=y>|<i x=y/>|<b a b = 'c'>|<b a=\"1\"c=\"2\">|</b >|</ b>|</>|<>|< p>|<!-- c -->|<!---->|<!--> x|<!-- a -- b -->|"
    "<!DOCTYPE html>|<!doctype|<![CDATA[x]]>|<?pi?>|&amp;|&|&#65|&nosuch;|a < b|<script>|</script>|</ script >|<script>if (a<b) x('</p>')</script>|<SCRIPT type=\"t\">x</SCRIPT>|<style>p</style>|<title>|</title>|<textarea>|</textarea>|<li>|<h3>Ann Lee</h3>|<h3>Bo Ek</h3>|<p>Head of Data</p>|"
    "<div class=\"team-name\">Ann Lee</div>|<div class=\"team-role\">CEO</div>|<p title=\"a&lt;b>c\">|Founder and CEO|\n | |<p x>|<P CLASS=Big>|<a-b c>|<p/ >|<x a= >|<p a=\"|'|\""
).split("|")


def random_page(r):
    return "".join(r.choice(PIECES) for _ in range(r.randrange(30)))


def test_plain_markup_gives_the_standard_parsers_tree():
    """What one pattern takes at once makes the same tree as the standard parser alone."""
    import random
    from html.parser import HTMLParser

    class Alone(dom._Builder):
        goahead = HTMLParser.goahead

    def shape(n):
        return (n.tag, list(n.attrs.items()), [c if isinstance(c, str) else shape(c) for c in n.children])

    r = random.Random(5)
    for _ in range(4000):
        page = random_page(r)
        alone = Alone()
        alone.feed(page)
        alone.close()
        root = dom.tree(page)
        assert shape(root) == shape(alone.root), page
        for n in [root, *root.walk()]:
            below, todo = [], [c for c in reversed(n.children) if isinstance(c, dom.Node)]
            while todo:
                below.append(todo.pop())
                todo += [c for c in reversed(below[-1].children) if isinstance(c, dom.Node)]
            assert [id(x) for x in n.walk()] == [id(x) for x in below]


def test_cards_of_a_large_page_take_linear_time():
    """Links and roles are gathered once, not for every card; a page of many people in one list."""
    import time

    def seconds(n):
        page = "<div>" + "".join(f'<h3>{a}n Lee{b}</h3><p>Head of Data {a}{b}</p><div class="team-name">{a}n Lee{b}</div>' for a, b in ((chr(65 + i % 26) + chr(97 + i // 26 % 26), chr(97 + i // 676) * 2) for i in range(n))) + '<div class="team-role">CEO</div></div>'
        root = dom.tree(page)
        began = time.perf_counter()
        assert len(list(dom.cards(root))) > 0.9 * n and len(list(dom.class_cards(root))) > 0.9 * n
        return time.perf_counter() - began

    assert seconds(8000) < 20 * seconds(1000) + 0.5
