"""The directory's entry points as functions of tables: each gives a DataFrame, or the engine with changed tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import classify, surface, url
from contactlake.functions.text import slug
from contactlake.operators import blocklist as suppression
from contactlake.operators import directory as d
from contactlake.operators import scrape as sc
from contactlake.operators.frontier import best_domain
from contactlake.operators.keep import keep_first
from contactlake.operators.merge import coalesced, inserted, merged, new_value, non_empty
from contactlake.operators.pages import register_page_facts
from contactlake.operators.resolve import verified_people
from contactlake.sources.search import SearchSource, searched
from contactlake.sources.seed import seeded
from contactlake.sources.settings import effective
from contactlake.sources.work import stored
from contactlake.streaming.worker import Worker

KEYS = {"emails": ["company_id", "email"], "phones": ["company_id", "phone"], "socials": ["company_id", "network"], "people": ["company_id", "name"], "scrapes": ["company_id"]}
POLICIES = {"category": new_value, "url": new_value, "status": new_value, "pages_checked": new_value, "title": non_empty}


@dataclass(frozen=True)
class Engine:
    """Tables by name: companies, emails, phones, socials, people, scrapes, blocklist, settings, worker_log."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(name) from None

    def _with(self, **changed: DataFrame) -> Engine:
        return replace(self, tables={**self.tables, **changed})

    # reads

    def health(self) -> DataFrame:
        return self.companies.agg(F.lit("ok").alias("status"), F.count("*").alias("companies"))

    def list_companies(self, country: str | None = None, category: str | None = None, q: str | None = None, page: int = 1, page_size: int = 24) -> DataFrame:
        if page < 1 or not 1 <= page_size <= 200:
            raise ValueError("page from 1, page_size from 1 to 200")
        rows = d.page(d.filtered(self.companies, country, category, q), page, page_size)
        facts = {k: self.tables[k] for k in ("emails", "phones", "people", "socials") if k in self.tables}
        return d.by_size(d.with_counts(d.with_website(rows), **facts))

    def total(self, page_size: int = 24, **filters) -> DataFrame:
        return d.filtered(self.companies, **filters).agg(F.count("*").alias("total")).withColumn("pages", d.page_count(F.col("total"), page_size))

    def get_company(self, company_id: int) -> DataFrame:
        return d.with_website(self.companies.where(F.col("id") == company_id))

    def lookup(self, name: str) -> DataFrame:
        """Companies by name or domain; if none, guessed domains with a null id."""
        wanted = F.lower(F.lit(name))
        found = self.companies.where((F.lower("name") == wanted) | (F.lower("domain") == F.regexp_replace(wanted, r"^www\.", ""))).select("id", "domain")
        base = self.companies.sparkSession.range(1).select(F.explode(url.guesses(F.lit(name))).alias("domain"))
        none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("one"))
        guessed = base.withColumn("one", F.lit(1)).join(none, "one").select(F.lit(None).cast("long").alias("id"), "domain")
        return found.unionByName(guessed)

    def countries(self) -> DataFrame:
        return d.facet(self.companies, "country", "country_code").orderBy(F.col("c").desc(), "country")

    def categories(self) -> DataFrame:
        return d.facet(self.companies, "category").orderBy(F.col("c").desc(), "category")

    def stats(self) -> DataFrame:
        return d.dashboard(self.companies, self.emails, self.phones, self.people, self.scrapes)

    def contacts(self, company_id: int) -> DataFrame:
        one = self.companies.where(F.col("id") == company_id).withColumn("blocked", F.lit(False))
        return d.export_rows(one, *(self.tables[k].where(F.col("company_id") == company_id) for k in ("emails", "phones", "people", "socials"))).orderBy("ord", "detail", "value")

    def export(self, **filters) -> DataFrame:
        return d.export_rows(d.filtered(self.companies, columns=("name", "domain"), **filters), self.emails, self.phones, self.people, self.socials)

    # enrichment and discovery

    def to_enrich(self, limit: int = 500, only_new: bool = True, **filters) -> DataFrame:
        rows = d.filtered(self.companies, **filters)
        return d.by_size(d.without(rows, self.scrapes) if only_new else rows).limit(min(limit, 500))

    def save(self, **batches: DataFrame) -> Engine:
        """Merges batches of facts (with a column ord) into their tables; what was known is never lost."""
        out = {}
        for name, batch in batches.items():
            old = self.tables[name]
            policies = {c: POLICIES.get(c, coalesced) for c in batch.columns if c in old.columns and c not in KEYS[name]}
            out[name] = merged(old, batch, KEYS[name], policies, "ord" if "ord" in batch.columns else None)
        return self._with(**out)

    def scrape(self, pages: DataFrame, found: dict[str, DataFrame], open_people: DataFrame, mx: DataFrame, smtp: DataFrame, catchall: DataFrame, force: bool = False) -> Engine:
        """The tables after a scrape of the companies in pages (company_id, pages_checked).

        Companies scraped before are left alone unless force. found: what the pages told (emails, phones, socials, people,
        each with company_id and ord); companies without people take those of open_people. Addresses are verified before
        they are saved, and merges never lose what was known. What several of the tables need is computed once, by jobs that run here.
        """
        todo = stored(pages if force else pages.join(self.scrapes.select("company_id"), "company_id", "left_anti"), "todo")
        mine = lambda df: df.join(todo.select("company_id"), "company_id", "left_semi")
        emails = keep_first(mine(found["emails"]), KEYS["emails"]).drop("verdict")
        people = stored(sc.clean_people(mine(found["people"]), self.companies), "people")
        people = sc.with_fallback(people, todo.select("company_id"), open_people)
        people = people.withColumn("id", F.xxhash64("company_id", "name"))
        told = stored(sc.verdicts(emails.select("email").unionByName(people.where("email is not null").select("email")), mx, smtp, catchall), "told")
        emails = stored(emails.join(told, "email", "left"), "emails")
        none = people.sparkSession.createDataFrame([], "id long, pos int, email string")
        judged = verified_people(people.select("id", "email", "email_status"), told, none)
        people = sc.saved_people(people.drop("email", "email_status").join(judged, "id").drop("id"))
        n = emails.groupBy("company_id").agg(F.count("*").alias("n"))
        status = sc.scrape_status(F.col("pages_checked"), F.coalesce("n", F.lit(0)))
        scrapes = todo.join(n, "company_id", "left").select("company_id", status.alias("status"), "pages_checked")
        return self.save(emails=emails, people=people, phones=sc.distinct_phones(mine(found["phones"])), socials=sc.distinct_socials(mine(found["socials"])), scrapes=scrapes)

    def discover(self, results: DataFrame, homes: DataFrame | None = None, trusted: DataFrame | None = None, block: list[str] | None = None) -> DataFrame:
        """(domain, title, name, outcome) of search results (ord, title, url), and of trusted ones (ord, name, domain) before them: the first of each domain.

        outcome: blocked by the rules for web domains; rejected if homes (domain, title, meta, body) are given and the
        domain's isn't relevant or is missing, unless it is trusted; known in the directory; suppressed by the blocklist;
        else new.
        """
        rows = results.select("ord", "title", url.url_domain(F.col("url")).alias("domain"), F.lit(1).alias("stage"))
        if trusted is not None:
            rows = rows.unionByName(trusted.select("ord", F.col("name").alias("title"), "domain", F.lit(0).alias("stage")))
        rows = keep_first(rows.withColumn("at", F.struct("stage", "ord")), ["domain"], "at")
        known = self.companies.select("domain", F.lit(True).alias("known")).dropDuplicates(["domain"])
        rows = rows.withColumn("id", F.xxhash64("domain")).withColumn("name", url.company_from_title(F.col("title"), F.col("domain")))
        hit = suppression.matches(rows, self.blocklist).select(F.col("company_id").alias("id")).distinct().withColumn("hit", F.lit(True))
        rows = rows.join(known, "domain", "left").join(hit, "id", "left").withColumn("ok", F.lit(True))
        if homes is not None:
            text = lambda c: F.coalesce(c, F.lit(""))
            judged = homes.select("domain", classify.relevance(text(F.col("title")), text(F.col("meta")), text(F.col("body")))[0].alias("relevant"))
            rows = rows.join(judged, "domain", "left").withColumn("ok", (F.col("stage") == 0) | F.coalesce("relevant", F.lit(False)))
        out = F.when(url.blocked(F.col("domain"), block) & (F.col("stage") == 1), "blocked").when(~F.col("ok"), "rejected").when(F.col("known"), "known").when(F.col("hit"), "suppressed").otherwise("new")
        return rows.select("domain", "title", "name", out.alias("outcome"))

    def discover_from(self, sources: list[SearchSource], queries: DataFrame, **how) -> DataFrame:
        """discover() of what search sources tell about queries (query_id, q); earlier sources come first."""
        return self.discover(searched(sources, queries), **how)

    def with_discovered(self, found: DataFrame, country: str) -> Engine:
        """The directory with the new domains of discover()."""
        new = found.where("outcome = 'new'").select(slug_id(F.col("domain")).alias("id"), "name", "domain", F.concat(F.lit("https://"), "domain").alias("website"), F.lit(country).alias("country"), url.country_code(F.lit(country)).alias("country_code"), F.lit("Fleet Management Software").alias("category"), F.lit(False).alias("blocked"))
        return self._with(companies=self.companies.unionByName(new.select(*[c for c in new.columns if c in self.companies.columns]), allowMissingColumns=True))

    def lookups(self, queries: DataFrame, probes: DataFrame) -> DataFrame:
        """(query_id, q, outcome, domain) of queries (query_id, q): existing by name or domain; else the best of the
        domains that answered, probes (query_id, name, pos, domain, title), which is added unless the blocklist fits."""
        low = queries.withColumn("k", F.lower(F.trim("q")))
        names = self.companies.select(F.lower("name").alias("k")).unionByName(self.companies.select(F.lower("domain").alias("k"))).distinct().withColumn("known", F.lit(True))
        rows = low.join(names, "k", "left").join(best_domain(probes, "query_id").select("query_id", "domain"), "query_id", "left")
        listed = self.companies.select("domain", F.lit(True).alias("listed")).dropDuplicates(["domain"])
        hit = suppression.matches(rows.where("domain is not null").select(F.col("query_id").alias("id"), F.col("q").alias("name"), "domain"), self.blocklist).select(F.col("company_id").alias("query_id")).distinct().withColumn("hit", F.lit(True))
        rows = rows.join(hit, "query_id", "left").join(listed, "domain", "left")
        out = F.when(F.col("known"), "existing").when(F.col("domain").isNull(), "unresolved").when(F.col("hit"), "blocked").when(F.col("listed"), "existing").otherwise("added")
        return rows.select("query_id", "q", out.alias("outcome"), F.when(F.col("known").isNull(), F.col("domain")).alias("domain"))

    def start(self, legacy: tuple[str, ...] = ()) -> Engine:
        """Seeds the directory, removes legacy entries from the blocklist and applies it; safe to repeat."""
        gone = [x.strip().lower() for x in legacy]
        kept = self.blocklist.where(~F.lower(F.trim("name")).isin(*gone)) if gone else self.blocklist
        engine = self._with(companies=seeded(self.companies), blocklist=kept)
        flags = suppression.flags(engine.companies, kept).select("id", F.col("blocked").alias("_b"))
        rows = engine.companies.join(flags, "id").withColumn("blocked", F.col("blocked") | F.col("_b"))
        return engine._with(companies=rows.select(*engine.companies.columns))

    # verification

    def to_verify(self, limit: int = 8) -> DataFrame:
        a = self.emails.where("smtp_status is null").select(F.lit(0).alias("kind"), "id", "email")
        b = self.people.where("email is not null and smtp_status is null").select(F.lit(1).alias("kind"), "id", "email")
        return a.unionByName(b).orderBy("kind", "id").limit(limit).select("id", "email")

    def verify(self, addresses: DataFrame, mx: DataFrame, smtp: DataFrame, catchall: DataFrame) -> DataFrame:
        """(email, verdict) of addresses from facts: mx (domain, …), smtp (email, code, refused), catchall (domain, probe)."""
        return sc.verdicts(addresses, mx, smtp, catchall)

    # suppression

    def block(self, name: str, domain: str | None = None) -> Engine:
        b = self.blocklist
        new = b.sparkSession.createDataFrame([(name, domain)], "name string, domain string").withColumn("id", slug_id(F.col("name")))
        return self._with(blocklist=inserted(b.select("id", "name", "domain"), new, ["name"])).apply_blocklist()

    def unblock_entry(self, name: str) -> Engine:
        gone = suppression.remaining_after(self.companies, self.blocklist, F.col("name") == name).withColumn("_g", F.lit(True))
        companies = self.companies.join(gone, "id", "left").withColumn("blocked", F.col("blocked") & F.col("_g").isNull()).select(*self.companies.columns)
        return self._with(companies=companies, blocklist=self.blocklist.where(F.col("name") != name))

    def set_blocked(self, company_id: int, blocked: bool) -> Engine:
        """The flag alone: the entry stays, so the next apply_blocklist() may set it again."""
        return self._with(companies=self.companies.withColumn("blocked", F.when(F.col("id") == company_id, F.lit(blocked)).otherwise(F.col("blocked"))))

    def apply_blocklist(self) -> Engine:
        flags = suppression.flags(self.companies, self.blocklist).select("id", F.col("blocked").alias("_b"))
        return self._with(companies=self.companies.join(flags, "id").withColumn("blocked", F.col("_b")).select(*self.companies.columns))

    def blocklist_entries(self) -> DataFrame:
        hit = suppression.matches(self.companies.where("blocked"), self.blocklist).groupBy("entry_id").agg(F.count("*").alias("n"))
        return self.blocklist.join(hit, F.col("id") == F.col("entry_id"), "left").select("id", "name", "domain", F.coalesce("n", F.lit(0).cast("long")).alias("companies"))

    # SQL

    def sql_functions(self) -> list[str]:
        """Makes the helpers and the table function page_facts callable from the session's SQL; their names."""
        spark = self.companies.sparkSession
        register_page_facts(spark)
        return [*surface.register(spark), "page_facts"]

    # settings and worker

    def get_settings(self) -> DataFrame:
        return effective(self.settings)

    def put_settings(self, **values) -> Engine:
        s = self.settings
        new = s.sparkSession.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")
        return self._with(settings=merged(s, new, ["key"], {"value": new_value}))

    def worker(self, events: DataFrame, jobs: dict, at: str | None = None) -> Worker:
        """The worker over a stream of events; at: the folder that its state survives in. It has start, stop, wake and status."""
        return Worker(self.companies.sparkSession, events, jobs, at=at)

    def worker_tail(self, limit: int = 50) -> DataFrame:
        return self.worker_log.orderBy(F.col("id").desc()).limit(max(1, min(limit, 300)))


def slug_id(name: Column) -> Column:
    """A stable id of an entry made by name."""
    return F.abs(F.xxhash64(slug(name)))
