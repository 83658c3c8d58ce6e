"""Helpers that were plain Python as columns: against it, on ordinary and odd rows; totals counted while writing; robots without an answer."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from contactlake.functions import dom, markup, names, text
from contactlake.operators.frontier import robots_allowed
from contactlake.operators.scrape import Totals

LINES = ["Ann Lee – Founder and CEO", "Ann Lee CEO", "CEO Ann Lee", "José da Silva Managing Director of X", "One two three four five Director", "Ann Lee, Head of Data, EMEA", "Ann Lee Director, a", "nobody here", "", " ", "Vice President, Fleet Brad Taylor", "Chief Executive Officer Dr Ann Marie Böckers", "President of Mr Bo Ek and more", "Vice President", "Managing Director Acme Fleet Cleo Ito", "Board Chairman"]
LISTS = ["[[Ann Lee]] (CEO)|Eva Berg|([[Chair]])|lone", "Ann Lee ( Founder , CEO )|Bo", "x|(CEO)", "", "||", "[[a|Cleo Ito]]|[[b|Role]]|(CTO)", "ann lee (CEO)", "Ann Lee ()|(x)", "Ann Lee (" + "r" * 80 + ")", "Dmitri Novak|(Chair)|(CEO)", "Eva Berg;  (Chair) "]
JSONS = ['"text"', '[1,"a","b"]', "[]", '[1,2,{"name":"x"}]', '{"name":"n","email":"e"}', '{"name":7,"email":"e"}', '{"telephone":"t"}', "{}", "7", "null", "not json", "", '{"name":["x"],"telephone":"1"}', " [\"z\"]"]


def columns(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v string")
    return [r[1] for r in rows.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


def test_split_role(spark):
    got = [tuple(x) if x else None for x in columns(spark, LINES, names.split_role)]
    assert got == [dom.split_role(x) for x in LINES] + [None] and sum(x is not None for x in got) >= 4


def test_split_reversed(spark):
    got = [tuple(x) if x else None for x in columns(spark, LINES, names.split_reversed)]
    assert got == [dom.split_reversed(x) for x in LINES] + [None] and sum(x is not None for x in got) >= 2
    own = [tuple(x) if x else None for x in columns(spark, LINES, lambda c: names.split_reversed(c, F.lit("Acme-Fleet & Co")))]
    assert own == [dom.split_reversed(x, "Acme-Fleet & Co") for x in LINES] + [None]


def test_people_items(spark):
    got = [[tuple(p) for p in x] if x is not None else None for x in columns(spark, LISTS, markup.people_items)]
    assert got == [dom.people_items(x) for x in LISTS] + [None] and sum(map(len, got[:-1])) >= 5


def test_json_first_str(spark):
    def plain(x):
        try:
            return dom.first_str(json.loads(x))
        except ValueError:
            return None

    assert columns(spark, JSONS, text.json_first_str) == [plain(x) for x in JSONS] + [None]


def test_totals_are_counted_while_writing(spark, tmp_path):
    scrapes = spark.createDataFrame([(1, "ok", 1.5), (2, "partial", 2.5), (3, "failed", None)], "company_id long, status string, seconds double")
    people = spark.createDataFrame([(1, "profile", "verified"), (1, "search", "pattern-derived"), (2, None, None)], "company_id long, linkedin_type string, email_status string")
    t = Totals()
    t.watch("scrapes", scrapes).write.parquet(str(tmp_path / "s"))
    t.watch("people", people).write.parquet(str(tmp_path / "p"))
    t.watch("emails", scrapes.limit(0)).write.parquet(str(tmp_path / "e"))
    assert t.total() == {"n": 3, "ok": 1, "partial": 1, "failed": 1, "emails": 0, "phones": 0, "people": 3, "linkedin_profiles": 1, "derived_emails": 1, "socials": 0, "success_rate": 66.7, "avg_seconds": 1.333}
    with pytest.raises(ValueError):
        t.watch("people", people)
    nothing = Totals()
    nothing.watch("scrapes", scrapes.limit(0)).write.parquet(str(tmp_path / "n"))
    assert nothing.total()["success_rate"] is None and nothing.total()["n"] == 0


def test_robots_without_a_status(spark):
    rows = [(1, "https://a.com/x", None, None), (2, "https://a.com/x", 403, ""), (3, "https://a.com/x", 200, "User-agent: *\nDisallow: /x"), (4, "https://a.com/y", 500, None), (5, "https://a.com/x", 200, None)]
    got = robots_allowed(spark.createDataFrame(rows, "id long, url string, status int, body string"), "id", "bot")
    assert {r.id: r.allowed for r in got.collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_pages_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    """Several tasks a core, evenly, though one file's partition holds all pages; also for the table function."""
    from types import SimpleNamespace

    from contactlake.plans.pagequeries import CARD, made

    spark.range(6000).selectExpr("id as event_id").coalesce(1).write.parquet(str(tmp_path / "events"))
    pages = made(SimpleNamespace(events=spark.read.parquet(str(tmp_path / "events"))), CARD)
    sizes = [r[0] for r in pages.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) < 3 * min(sizes)


def test_adjacent_dup_of_a_long_text_is_linear(spark):
    """Words are split once; neighbours only, nulls and texts of one word have none."""
    import time

    texts = [" ".join(str(i) for i in range(100_000)), " ".join(str(i) for i in range(50_000)) + " 49999", "a b a", "a a", "a", "", None]
    began = time.perf_counter()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(names.adjacent_dup(F.split("t", " "))).collect()]
    assert got == [False, True, False, True, False, False, False] and time.perf_counter() - began < 20


def test_relative_time_and_its_sql_count_whole_seconds(spark, tmp_path):
    """59.9 seconds that cross 60 boundaries of seconds are less than a minute, in the query and in its SQL."""
    from contactlake.plans.catalog import ORACLES, QUERIES
    from tests.compare import differences, duck

    rows = spark.sql("select event_id, timestamp '2024-01-02 00:00:00.5' - make_dt_interval(0, 0, 0, s) as ts, 1L as user_id, 'view' as event_type, 1.0D as value, '{}' as props from values (1L, 0.0), (2L, 59.9), (3L, 60.0), (4L, 3599.9), (5L, 86399.8), (6L, 86400.0) v(event_id, s)")
    rows.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert differences(spark, duck(str(tmp_path)), QUERIES["project_rel_time"], ORACLES["project_rel_time"], str(tmp_path)) is None
    assert [r.label for r in QUERIES["project_rel_time"](spark, str(tmp_path)).orderBy("id").collect()] == ["just now", "just now", "1m ago", "59m ago", "23h ago", "2024-01-01"]


def test_a_link_is_judged_once(spark):
    """Each word pattern stands once in the plan, not again in the filters on what it gives."""
    from contactlake.operators.frontier import linked_pages, sitemap_urls

    links = spark.createDataFrame([(1, "https://a.example/", "/team/"), (1, "https://a.example/", "/team/#x"), (1, "https://a.example/", "/shop"), (1, None, "x")], "k long, base string, href string")
    site = spark.createDataFrame([(1, "https://a.example", "<loc>/team/</loc><loc> https://a.example/cart/team </loc><loc>/x</loc>")], "k long, base string, xml string")
    for rows, word in ((linked_pages(links, "k"), "meet-the-team"), (sitemap_urls(site, "k"), "who-we-are")):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count(word) == 1
        assert [tuple(r) for r in rows.collect()] == [(1, "https://a.example/team/", 1)]
