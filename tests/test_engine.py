"""The entry points over the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from contactlake.engine import Engine
from contactlake.sources.bindings import Tables


@pytest.fixture(scope="module")
def engine(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    return Engine({n: getattr(t, n) for n in ("companies", "emails", "phones", "socials", "people", "scrapes", "blocklist", "settings", "worker_log")})


def test_reads(engine):
    page = engine.list_companies(page=2, page_size=10).collect()
    assert len(page) == 10 and {"n_emails", "n_people"} <= set(page[0].asDict()) and all(x.website for x in page)
    assert engine.total().first().pages == -(-engine.total().first().total // 24)
    assert engine.lookup("customer#000000003").first().id == 3
    assert [x.domain for x in engine.lookup("No Such Co").collect()][:2] == ["nosuchco.com", "nosuchco.io"]
    assert engine.countries().count() and engine.categories().count() == 5 and engine.stats().count() == 1
    assert engine.contacts(1).count() > 0 and engine.worker_tail(10).count() == 10
    with pytest.raises(ValueError):
        engine.list_companies(page=0)


def test_save_never_loses(engine):
    batch = engine.emails.limit(3).select("company_id", "email", F.lit("New").alias("category"), F.lit(None).cast("string").alias("source_url"), F.lit(1).alias("ord"))
    after = engine.save(emails=batch).emails
    assert after.count() == engine.emails.count() and after.where("category = 'New' and source_url is not null").count() == 3


def test_suppression_round_trip(engine):
    base = engine.apply_blocklist()
    was = {x.id for x in base.companies.where("blocked").collect()}
    assert {x.id for x in base.apply_blocklist().companies.where("blocked").collect()} == was
    more = base.block("Customer#000000001")
    assert {x.id for x in more.companies.where("blocked").collect()} == was | {1}
    assert {x.id for x in more.unblock_entry("Customer#000000001").companies.where("blocked").collect()} == was
    assert engine.blocklist_entries().count() == engine.blocklist.count()


def test_settings_and_discovery(engine, spark):
    assert engine.put_settings(max_pages=4).get_settings().first().max_pages == 4
    rows = spark.createDataFrame([(1, "Acme Fleet - Home", "https://www.acme.com/"), (2, "again", "https://acme.com/x"), (3, "In", "https://jobs.linkedin.com/a"), (4, "Known", "https://c5.example.com/"), (5, "Customer#000000007 Ltd | x", "https://other.de/")], "ord int, title string, url string")
    got = {x.domain: (x.name, x.outcome) for x in engine.discover(rows).collect()}
    assert got["acme.com"] == ("Acme Fleet", "new") and got["jobs.linkedin.com"][1] == "blocked" and got["c5.example.com"][1] == "known" and got["other.de"][1] == "suppressed"


def test_verify(engine, spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    todo = engine.to_verify(5)
    assert todo.count() == 5 and engine.verify(todo, t.mx, t.smtp, t.catchall).count() == todo.select("email").distinct().count()


def test_discovery_with_homes_is_added_once(engine, spark):
    rows = spark.createDataFrame([(1, "Acme Fleet - Home", "https://www.acme.com/"), (2, "Shoe Shop | x", "https://shoes.com/"), (3, "No Home Co - y", "https://nohome.com/")], "ord int, title string, url string")
    homes = spark.createDataFrame([("acme.com", "Fleet tracking", None, None), ("shoes.com", "Running shoes", None, None)], "domain string, title string, meta string, body string")
    trusted = spark.createDataFrame([(1, "Trusted Co", "trusted.com")], "ord int, name string, domain string")
    found = engine.discover(rows, homes, trusted)
    assert {x.domain: x.outcome for x in found.collect()} == {"acme.com": "new", "shoes.com": "rejected", "nohome.com": "rejected", "trusted.com": "new"}
    after = engine.with_discovered(found, "Kenya")
    assert after.companies.count() == engine.companies.count() + 2 and after.companies.where("domain = 'acme.com'").first().country_code == "KE"
    assert {x.domain: x.outcome for x in after.discover(rows, homes, trusted).collect()}["acme.com"] == "known"


def test_scrape_keeps_cached_and_never_loses(engine, spark):
    pages = spark.createDataFrame([(1, 3), (2, 0), (3, 2)], "company_id long, pages_checked int")
    before = Engine({**engine.tables, "scrapes": spark.createDataFrame([(1, "ok", 1)], "company_id long, status string, pages_checked int")})
    mail = spark.createDataFrame([(1, "new@a.com", "General", None, None, 1), (3, "new@a.com", "General", "u", None, 2)], "company_id long, email string, category string, source_url string, mx_status string, ord int").withColumn("verdict", F.lit(None).cast("string"))
    who = spark.createDataFrame([(3, "Web Team", "CEO", None, None, None, None, 1), (3, "Ann Berg", "CEO", None, None, None, None, 2), (3, "ann berg", "CTO", None, None, None, None, 3)], "company_id long, name string, title string, email string, email_status string, linkedin_url string, linkedin_type string, ord int")
    open_people = spark.createDataFrame([(2, "Eva Costa", "CEO", 1), (3, "Eva Costa", "CEO", 2)], "company_id long, name string, title string, ord int")
    phone = spark.createDataFrame([(3, "+1 200", None, None, 1), (3, "1-200", None, None, 2)], "company_id long, phone string, label string, source_url string, ord int")
    social = spark.createDataFrame([(3, "x", "https://x.com/a", 1)], "company_id long, network string, url string, ord int")
    mx = spark.createDataFrame([("a.com", "mx.a.com", 1)], "domain string, host string, pref int")
    smtp = spark.createDataFrame([("new@a.com", 250, False)], "email string, code int, refused boolean")
    probes = spark.createDataFrame([("a.com", "rejected")], "domain string, probe string")
    found = {"emails": mail, "people": who, "phones": phone, "socials": social}
    after = before.scrape(pages, found, open_people, mx, smtp, probes)
    assert {x.company_id: x.status for x in after.scrapes.collect()} == {1: "ok", 2: "failed", 3: "ok"}
    assert [(x.company_id, x.verdict) for x in after.emails.where("email = 'new@a.com'").collect()] == [(3, "deliverable")]
    new = {(x.company_id, x.name, x.linkedin_type) for x in after.people.join(before.people, ["company_id", "name"], "left_anti").collect()}
    assert new == {(3, "Ann Berg", "search"), (2, "Eva Costa", "search")}
    assert after.phones.count() == before.phones.count() + 1
    assert before.scrape(pages, found, open_people, mx, smtp, probes, force=True).emails.where("email = 'new@a.com'").count() == 2


def test_worker_from_the_engine(engine, spark, tmp_path):
    from contactlake.streaming.worker import events_stream

    k = engine.worker(events_stream(spark, "/root/testdata/sf0.001"), {"scrape": lambda b: b.count()}, str(tmp_path / "w"))
    k.start(once=True).awaitTermination()
    assert k.status()["cycles"] == 1
    k.close()


def test_search_sources_take_part_in_discovery(engine, spark):
    from contactlake.sources.search import KnownSites, StoredResults, searched

    queries = spark.createDataFrame([(1, " Fleet Kenya "), (2, "acme"), (3, None)], "query_id long, q string")
    first = StoredResults("stored", spark.createDataFrame([("fleet kenya", 2, "Second - Home", "https://second.com/"), ("fleet kenya", 1, "First Fleet - Home", "https://first.com/"), ("fleet kenya", 3, "none", None), ("other", 1, "x", "https://x.com")], "q string, pos int, title string, url string"))
    sites = KnownSites("sites", spark.createDataFrame([("Acme Fleet", "https://acme.io/"), ("First in Kenya Fleet", "https://first.com/about"), (None, "https://n.com")], "name string, website string"))
    rows = searched([first, sites], queries).orderBy("ord").collect()
    assert [(r.ord.source, r.ord.query_id, r.url) for r in rows] == [(0, 1, "https://first.com/"), (0, 1, "https://second.com/"), (1, 1, "https://first.com/about"), (1, 2, "https://acme.io/")]
    found = {r.domain: (r.title, r.outcome) for r in engine.discover_from([first, sites], queries).collect()}
    assert found["first.com"] == ("First Fleet - Home", "new") and set(found) == {"first.com", "second.com", "acme.io"}
    for bad in ([], [first, first]):
        with pytest.raises(ValueError):
            searched(bad, queries)


def test_sql_functions_of_the_engine(engine, spark):
    assert {"email_domain", "page_facts", "url_domain"} <= set(engine.sql_functions())
    assert spark.sql("select email_domain('a@b.com') as d").first().d == "b.com"


def test_a_scrape_stores_what_several_tables_need(spark):
    """People are cleaned and addresses judged by jobs of their own, not again by each table that is read."""
    t = Tables(spark, "/root/testdata/sf0.001")
    tables = {"companies": t.companies, "scrapes": t.scrapes.select("company_id", "status", "pages_checked").limit(0)}
    tables |= {k: getattr(t, k).drop("id").limit(0) for k in ("emails", "people", "phones", "socials")}
    found = {k: getattr(t, f"found_{k}") for k in ("emails", "people", "phones", "socials")}
    after = Engine(tables).scrape(t.scrapes.select("company_id", "pages_checked"), found, t.web_people, t.mx, t.smtp, t.catchall)
    for df in (after.emails, after.people, after.scrapes):
        assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert after.scrapes.count() == t.scrapes.count()
