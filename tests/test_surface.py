"""The helpers as SQL functions, and the table function over pages."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from contactlake.functions import surface
from contactlake.operators.pages import TOLD, register_page_facts

TEXTS = ["Ann Lee", "jane.doe@acme.co.in", "https://www.linkedin.com/in/x?y=1#z", "<html><title>Acme – Team</title><a href='mailto:a@b.com'>m</a>+49 30 1234567</html>", "it's \\n a “quote”, said Bo Ek, Chief Executive Officer of X.", "2024-05-01 10:00:00", "", None, "{first}.{last}", "DE", "Germany"]


@pytest.fixture(scope="module")
def registered(spark):
    assert surface.register(spark) == list(surface.HELPERS)
    return spark


@pytest.mark.parametrize("name", sorted(surface.HELPERS))
def test_functions_equal_their_helpers(registered, name):
    h = surface.HELPERS[name]
    columns = []
    for k, a in enumerate(h.arguments.split(", ")):
        arg, kind = a.split()
        value = {"int": F.col("i") * 37, "boolean": F.col("i") % 2 == 0, "timestamp": F.to_timestamp(F.lit("2024-05-01 10:00:00")) + F.make_interval(hours=F.col("i") * (k + 1))}.get(kind)
        columns.append((value if value is not None else F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("i") + k) % len(TEXTS) + 1)).cast(kind).alias(arg))
    rows = registered.range(2 * len(TEXTS)).select(F.col("id").cast("int").alias("i")).select("i", *columns)
    want = rows.select("i", h.body(*[F.col(a) for a in h.names]).alias("r"))
    got = registered.sql(f"select i, {name}({', '.join(h.names)}) as r from {{rows}}", rows=rows)
    assert got.dtypes == want.dtypes
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_functions_join_group_and_filter(registered):
    mails = registered.createDataFrame([("a@x.com",), ("b@x.com",), ("c@y.org",), (None,)], "email string")
    sites = registered.createDataFrame([(1, "https://www.x.com/a"), (2, "http://z.net"), (3, None)], "id int, site string")
    got = registered.sql("select s.id, count(*) as n from {mails} m join {sites} s on email_domain(m.email) = url_domain(s.site) where email_valid(m.email) group by s.id", mails=mails, sites=sites)
    assert [tuple(r) for r in got.collect()] == [(1, 2)]
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_page_facts_takes_any_table_with_html(spark):
    register_page_facts(spark)
    card = '<ul><li><h3>Ann Lee</h3><p>Founder and CEO</p><a href="mailto:a@acme.example.com">m</a></li></ul>'
    pages = spark.createDataFrame([("a", 1.5, card), ("b", None, None), ("c", 2.0, "")], "site string, weight double, html string")
    got = spark.sql("select * from page_facts(TABLE(select * from {pages}), 'cards')", pages=pages)
    assert got.columns == ["site", "weight", "pos", *TOLD["cards"]] and dict(got.dtypes)["weight"] == "double"
    assert {(r.site, r.weight, r.name, r.title, r.email) for r in got.collect()} == {("a", 1.5, "Ann Lee", "Founder and CEO", "a@acme.example.com")}
    for stage, told in TOLD.items():
        assert spark.sql(f"select * from page_facts(TABLE(select html from {{pages}}), '{stage}')", pages=pages).columns == ["pos", *told]


def test_page_facts_refuses_what_it_cannot_do(spark):
    register_page_facts(spark)
    pages = spark.createDataFrame([("a", "x")], "name string, html string")
    for sql, told in (("TABLE(select * from {pages}), 'nothing'", "knows"), ("TABLE(select name from {pages}), 'cards'", "column html"), ("TABLE(select * from {pages}), 'cards'", "itself")):
        with pytest.raises(AnalysisException, match=told):
            spark.sql(f"select * from page_facts({sql})", pages=pages)
