"""The helpers as SQL functions: each is a temporary function whose body is the helper's own expression, so that SQL
and DataFrames share one definition and Catalyst sees through both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import classify, email, markup, names, people, phone, text, url


@dataclass(frozen=True)
class Helper:
    """body of arguments (name and type each); what: for DESCRIBE FUNCTION."""

    arguments: str
    body: Callable[..., Column]
    what: str

    @property
    def names(self) -> list[str]:
        return [a.split()[0] for a in self.arguments.split(", ")]


def _relevance(title, meta, body):
    verdict, score = classify.relevance(title, meta, body)
    return F.struct(verdict.alias("verdict"), score.alias("score"))


def _headline(title):
    name, role = people.from_headline(title)
    return F.struct(name.alias("name"), role.alias("role"))


HELPERS: dict[str, Helper] = {
    "email_extract_text": Helper("text string", email.found_in, "addresses in running text"),
    "email_extract_mailto": Helper("html string", email.mailto, "addresses of mailto links"),
    "email_local": Helper("email string", email.local, "what stands before the @"),
    "email_domain": Helper("email string", email.domain, "what stands after the last @"),
    "email_valid": Helper("email string", email.valid, "whether the address can be one"),
    "email_category": Helper("email string", email.category, "who reads the address"),
    "email_syntax": Helper("email string", email.well_formed, "whether the address is well formed"),
    "email_disposable": Helper("email string", email.disposable, "whether the domain hands out throw-away addresses"),
    "smtp_code_class": Helper("code int, refused boolean", email.smtp_class, "what a mail server's answer means"),
    "email_catchall": Helper("probe string, has_mx boolean", email.catchall_class, "what the probe of a made-up address means"),
    "email_verdict": Helper("email string, has_mx boolean, smtp string, catchall string", email.verdict, "the verdict of all that is known of an address"),
    "email_verdict_rank": Helper("verdict string", email.verdict_rank, "verdicts in order"),
    "email_pattern_apply": Helper("pattern string, first string, last string", email.applied, "local part by a naming pattern"),
    "email_pattern_infer_pair": Helper("first string, last string, email string", email.inferred_from_pair, "pattern that makes the address of the name"),
    "email_pattern_infer_local": Helper("email string", email.inferred_from_local, "pattern that the address looks like"),
    "email_candidates": Helper("name string, domain string", email.candidates, "addresses that a person may have"),
    "name_email_pair": Helper("text string", lambda c: F.struct(*people.name_email(c)), "the first name and address next to each other"),
    "phone_digits": Helper("phone string", phone.digit_count, "number of digits"),
    "phone_extract_intl": Helper("text string", phone.intl_found_in, "international numbers in running text"),
    "phone_extract_us": Helper("text string", phone.us_found_in, "American numbers in running text"),
    "phone_extract_tel": Helper("html string", phone.tel, "numbers of tel links"),
    "social_classify": Helper("href string", url.social_network, "network of a profile link"),
    "url_domain": Helper("url string", url.url_domain, "host without www"),
    "url_blocked": Helper("domain string", url.blocked, "whether the domain is no company's"),
    "url_strip_query": Helper("url string", url.strip_query, "without the query"),
    "url_strip_fragment": Helper("url string", url.strip_fragment, "without the fragment"),
    "url_join": Helper("base string, href string", url.joined, "the link seen from the page"),
    "url_path": Helper("url string", url.path, "path"),
    "url_path_class_people": Helper("url string", url.people_page, "whether the page may name people"),
    "url_path_class_press": Helper("url string", url.press_page, "whether the page is news"),
    "url_decode_ddg": Helper("href string", url.decode_target, "target of a search result's link"),
    "url_decode_bing": Helper("href string", url.decode_tracked, "target of a tracked link"),
    "url_search_link": Helper("name string", url.people_search, "link that searches for a person"),
    "domain_guess": Helper("name string", url.guesses, "domains that a company of the name may have"),
    "domain_prettify": Helper("domain string", url.prettified, "a name made of a domain"),
    "company_name_from_title": Helper("title string, domain string", url.company_from_title, "company's name in a page title"),
    "title_name_candidate": Helper("title string", url.name_from_title, "what a title may name"),
    "country_code": Helper("country string", url.country_code, "code of a country"),
    "country_qid": Helper("country string", url.country_item, "item of a country"),
    "person_initials": Helper("name string", names.initials, "initials"),
    "name_is_stop": Helper("name string", names.is_stop, "whether a word rules a name out"),
    "name_looks_like": Helper("name string", names.looks_like, "whether it looks like a person's name"),
    "name_company_word": Helper("company string", names.company_words, "words of a company's name"),
    "name_is_company": Helper("name string, company string", names.is_company, "whether the name is the company's"),
    "person_noise": Helper("name string, title string, email string, company string", names.is_noise, "whether a found person is none"),
    "title_clean": Helper("title string", names.clean_title, "title without padding"),
    "accent_fold": Helper("text string", text.accent_fold, "without accents"),
    "slug_normalize": Helper("text string", text.slug, "lower-case letters and digits only"),
    "tokenize_alnum": Helper("text string", text.alnum_tokens, "words of letters and digits"),
    "str_squeeze_ws": Helper("text string", text.squeezed, "blanks made single"),
    "html_text": Helper("html string", text.html_text, "a page's text"),
    "html_title": Helper("html string", text.html_title, "a page's title"),
    "html_links": Helper("html string", text.html_links, "a page's links"),
    "fmt_employees": Helper("n int", text.employees_label, "number of employees as shown"),
    "rel_time": Helper("ts timestamp, now timestamp", text.relative_time, "time as told from now"),
    "elapsed": Helper("seconds int", text.elapsed_label, "duration as shown"),
    "flag_emoji": Helper("code string", text.flag_emoji, "flag of a country code"),
    "ts_format_iso": Helper("ts timestamp", text.iso_time, "time as ISO text"),
    "ts_parse_mixed": Helper("ts string", text.parsed_time, "time of any of the texts in use"),
    "markup_wiki_clean": Helper("wikitext string", markup.clean, "text without markup"),
    "markup_infobox_prep": Helper("wikitext string", markup.prepared, "infobox ready for its fields"),
    "markup_clean_name": Helper("wikitext string", markup.clean_name, "a person's name"),
    "markup_clean_role": Helper("wikitext string", markup.clean_role, "a person's role"),
    "people_press": Helper("text string", people.pressed, "name and role in press sentences"),
    "people_press_reversed": Helper("text string", people.pressed_reversed, "role and name in press sentences"),
    "snippet_people": Helper("title string", _headline, "name and role of a search result"),
    "classify_relevance": Helper("title string, meta string, body string", _relevance, "whether a page is of the industry"),
    "blocklist_match": Helper("name string, domain string, entry string, entry_domain string", classify.matches_entry, "whether a blocklist entry meets a company"),
}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(c: Column) -> str:
    """The column's expression as SQL; operators are written as the functions that they are."""

    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def say(n) -> str:
        kind = n.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name, of = n.functionName(), [say(a) for a in items(n.arguments())]
            if name == "timestampdiff":  # a keyword, and so is its unit
                return f"{name}({of[0].strip(chr(39))}, {', '.join(of[1:])})"
            return f"{name if name == 'struct' else _quoted(name)}({', '.join(of)})"  # only the keyword gives names
        if kind == "CaseWhenOtherwise":
            whens = [f"WHEN {say(b._1())} THEN {say(b._2())}" for b in items(n.branches())]
            rest = [f"ELSE {say(n.otherwise().get())}"] if n.otherwise().isDefined() else []
            return " ".join(["CASE", *whens, *rest, "END"])
        if kind == "Cast":
            return f"CAST({say(n.child())} AS {n.dataType().sql()})"
        if kind == "Alias":  # a name within a struct
            return f"{say(n.child())} AS {_quoted(items(n.name())[0])}"
        if kind == "UnresolvedExtractValue":
            return f"{say(n.child())}[{say(n.extraction())}]"
        if kind == "LambdaFunction":
            of = [say(a) for a in items(n.arguments())]
            return f"{of[0] if len(of) == 1 else '(' + ', '.join(of) + ')'} -> {say(n.function())}"
        return n.sql()  # literals and names

    return say(c._jc.node())


def definition(spark: SparkSession, name: str) -> str:
    """CREATE statement of a helper; its type is what the expression has."""
    h = HELPERS[name]
    body = h.body(*[F.col(a) for a in h.names])
    told = spark.createDataFrame([], h.arguments).select(body.alias("r")).schema[0].dataType.simpleString()
    what = h.what.replace("'", "\\'")
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({h.arguments}) RETURNS {told} COMMENT '{what}' RETURN {sql_text(body)}"


def register(spark: SparkSession, *only: str) -> list[str]:
    """Makes the helpers, or those named, callable from the session's SQL; returns their names."""
    done = list(only or HELPERS)
    for name in done:
        spark.sql(definition(spark, name))
    return done
