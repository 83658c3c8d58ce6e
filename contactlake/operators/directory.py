"""Directory reads: predicates, paging, counts, facets, KPIs, queues and export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the predicates that are given."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def text_filter(q: str | None, *columns: str) -> Column | None:
    """Any column contains q without regard to case; % and _ in q are wildcards, as in LIKE."""
    if not q:
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False)) for c in columns])


def filtered(companies: DataFrame, country: str | None = None, category: str | None = None, q: str | None = None, columns: tuple[str, ...] = ("name", "domain", "city", "category")) -> DataFrame:
    return companies.where(all_of(~F.col("blocked"), F.col("country") == country if country else None, F.col("category") == category if category else None, text_filter(q, *columns)))


def with_website(companies: DataFrame) -> DataFrame:
    """website, or the www address of the domain where it is missing or empty."""
    return companies.withColumn("website", F.coalesce(F.nullif("website", F.lit("")), F.concat(F.lit("https://www."), F.col("domain"))))


def counts_by_company(facts: DataFrame, name: str) -> DataFrame:
    return facts.groupBy("company_id").agg(F.count("*").alias(name))


def with_counts(companies: DataFrame, **facts: DataFrame) -> DataFrame:
    """n_<fact> columns. Each fact is grouped before its join, so facts don't multiply each other."""
    out = companies
    for name, rows in facts.items():
        n = counts_by_company(rows, f"n_{name}").withColumnRenamed("company_id", "_c")
        out = out.join(n, F.col("id") == F.col("_c"), "left").drop("_c").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    return out


def by_size(df: DataFrame) -> DataFrame:
    """Largest first, unknown sizes last, then by name and id."""
    return df.orderBy(F.col("employees").desc_nulls_last(), F.col("name").asc(), F.col("id").asc())


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    return by_size(df).offset((number - 1) * size).limit(size)


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor((total + (size - 1)) / size).cast("long"))


def facet(companies: DataFrame, *columns: str) -> DataFrame:
    return companies.where(~F.col("blocked")).groupBy(*columns).agg(F.count("*").alias("c"))


def visible(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """facts of companies that aren't blocked."""
    ids = companies.where(~F.col("blocked")).select(F.col("id").alias("_i"))
    return facts.join(ids, facts["company_id"] == F.col("_i"), "left_semi")


def without(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """Companies with no row in facts."""
    ids = facts.select(F.col("company_id").alias("_i"))
    return companies.join(ids, companies["id"] == F.col("_i"), "left_anti")


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row frames side by side."""
    keyed = [p.withColumn("_k", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_k"), keyed).drop("_k")


def dashboard(companies: DataFrame, emails: DataFrame, phones: DataFrame, people: DataFrame, scrapes: DataFrame) -> DataFrame:
    """Ten KPIs over companies that aren't blocked: one pass per table."""
    live = companies.where(~F.col("blocked"))
    c = live.agg(F.count("*").alias("companies"), F.count_distinct("country").alias("countries"))
    e = visible(emails, companies).agg(F.count("*").alias("emails"), F.count_if(F.col("verdict") == "deliverable").alias("ve"))
    p = visible(people, companies).agg(F.count("*").alias("people"), F.count_if(F.col("email_status") == "verified").alias("vp"), F.count_if(F.col("email_status") == "pattern-derived").alias("derived"))
    h = visible(phones, companies).agg(F.count("*").alias("phones"))
    s = visible(scrapes, companies).agg(F.count_if(F.col("status").isin("ok", "partial")).alias("scraped_companies"))
    u = without(live, scrapes).agg(F.count("*").alias("unscraped"))
    b = companies.agg(F.count_if("blocked").alias("blocked"))
    return one_row(c, e, p, h, s, u, b).select("companies", "countries", "emails", "phones", "people", "scraped_companies", (F.col("ve") + F.col("vp")).alias("verified"), "derived", "blocked", "unscraped")


def snapshot(companies: DataFrame, emails: DataFrame, people: DataFrame, scrapes: DataFrame, final: tuple[str, ...]) -> DataFrame:
    """The worker's eleven KPIs over companies that aren't blocked, and what its queues still hold as a nested record."""
    live = companies.where(~F.col("blocked"))
    pending = F.col("verdict").isNull() | ~F.col("verdict").isin(*final)
    status = lambda s: F.count_if(F.col("email_status") == s)
    rows = one_row(
        live.agg(F.count("*").alias("companies"), F.count_distinct("country").alias("countries")),
        visible(people, companies).agg(F.count("*").alias("people"), status("verified").alias("verified_people"), status("pattern-derived").alias("derived_people"), status("published").alias("published_people")),
        visible(emails, companies).agg(F.count("*").alias("emails"), F.count_if(F.col("verdict") == "deliverable").alias("verified_emails"), F.count_if(pending).alias("pending_verify")),
        without(live, scrapes).agg(F.count("*").alias("unscraped")),
        without(live, people).agg(F.count("*").alias("zero_people")),
    )
    kpis = rows.select("companies", "countries", "people", "verified_people", "derived_people", "published_people", "emails", "verified_emails", "unscraped", "zero_people", "pending_verify")
    return kpis.withColumn("pipeline", F.struct(F.col("unscraped").alias("scrape_remaining"), F.col("zero_people").alias("people_remaining"), F.col("pending_verify").alias("verify_remaining")))


def bench_totals(scrapes: DataFrame, times: DataFrame, emails: DataFrame, phones: DataFrame, people: DataFrame, socials: DataFrame) -> DataFrame:
    """Outcomes, success rate, mean seconds and six sums over scrapes (company_id, status) with times (company_id, seconds)."""
    rows = scrapes.select("company_id", "status").join(times, "company_id")
    of = lambda df, **more: df.groupBy("company_id").agg(*[x.alias(n) for n, x in more.items()])
    n = F.count("*")
    for facts in (
        of(emails, emails=n),
        of(phones, phones=n),
        of(people, people=n, linkedin_profiles=F.count_if(F.col("linkedin_type") == "profile"), derived_emails=F.count_if(F.col("email_status") == "pattern-derived")),
        of(socials, socials=n),
    ):
        rows = rows.join(facts, "company_id", "left")
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    return rows.agg(
        n.alias("n"), count("ok").alias("ok"), count("partial").alias("partial"), count("failed").alias("failed"), F.round(100.0 * count("ok", "partial") / n, 1).alias("success_rate"), F.round(F.sum("seconds") / n, 3).alias("avg_seconds"),
        *map(total, ("emails", "phones", "people", "linkedin_profiles", "socials", "derived_emails")),
    )


def export_rows(companies: DataFrame, emails: DataFrame, phones: DataFrame, people: DataFrame, socials: DataFrame) -> DataFrame:
    """(ord, company, domain, country, category, type, value, detail, source_url): four kinds of facts one after another."""
    live = companies.where(~F.col("blocked")).select(F.col("id").alias("company_id"), F.col("name").alias("company"), "domain", "country", F.col("category").alias("segment"))
    none = F.lit(None).cast("string")
    parts = (
        emails.select("company_id", F.lit(1).alias("ord"), F.lit("email").alias("type"), F.col("email").alias("value"), F.col("category").alias("detail"), "source_url"),
        phones.select("company_id", F.lit(2).alias("ord"), F.lit("phone").alias("type"), F.col("phone").alias("value"), F.col("label").alias("detail"), "source_url"),
        people.select("company_id", F.lit(3).alias("ord"), F.lit("person").alias("type"), F.col("name").alias("value"), F.col("title").alias("detail"), none.alias("source_url")),
        socials.select("company_id", F.lit(4).alias("ord"), F.lit("social").alias("type"), F.col("url").alias("value"), F.col("network").alias("detail"), none.alias("source_url")),
    )
    rows = reduce(DataFrame.unionByName, parts)
    return rows.join(live, "company_id").select("ord", "company", "domain", "country", F.col("segment").alias("category"), "type", "value", "detail", "source_url")


def read_csv(spark, schema, path: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"')


def write_csv(rows: DataFrame, path: str) -> None:
    """The export as CSV files that follow each other in order, each with a header. An empty text and none look the same there.

    The sort deals rows out by range, so no task holds all of them.
    """
    rows.orderBy("ord", "company", "value").drop("ord").write.mode("overwrite").csv(path, header=True, escape='"')
