"""Queries of the page parser, over pages made from events so that what they hold is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.functions import dom, markup, names, people, text
from contactlake.operators.pages import mapped, parsed, spread

from .registry import query

WHO = "case event_id % 4 when 0 then 'Ann Lee' when 1 then 'Bo Ek' when 2 then 'Cleo Ito' else 'Dmitri Novak' end"
ROLE = "case event_id % 3 when 0 then 'Founder and CEO' when 1 then 'Managing Director' else 'Head of Data' end"


def made(t, template: str):
    """Pages of events, dealt over tasks before they are made; @who, @role and @id in the template are filled in."""
    rows = spread(t.events.select("event_id")).selectExpr("event_id as page_id", f"{WHO} as who", f"{ROLE} as role")
    html = F.lit(template)
    for mark, value in (("@who", F.col("who")), ("@role", F.col("role")), ("@id", F.col("page_id").cast("string"))):
        html = F.replace(html, F.lit(mark), value)
    return rows.select("page_id", html.alias("html"))


PERSON = f"select event_id as page_id, {WHO} as name, {ROLE} as title"
MAIL = "concat('p', cast(event_id as varchar), '@acme.example.com')"


@query("people_jsonld", f"{PERSON}, {MAIL} as email from events")
def people_jsonld(t):
    p = made(t, '<p>x<script type="application/ld+json">{"@graph":[{"@type":["Person","X"],"name":"@who","jobTitle":["@role"],"email":"P@id@Acme.example.com","sameAs":["https://linkedin.com/in/x"]}]}</script><script type="application/ld+json">{bad</script>')
    return parsed(p, "structured").where("kind = 'jsonld_person'").select("page_id", "name", "title", "email")


@query("org_jsonld", "select event_id as page_id, concat('o', cast(event_id as varchar), '@acme.example.com') as email, '+49 30 1234567' as phone, concat(cast(event_id as varchar), ' Rd, X, DE') as address from events")
def org_jsonld(t):
    p = made(t, '<script type="application/ld+json">[{"@type":"Organization","email":"o@id@acme.example.com","telephone":"+49 30 1234567","address":{"streetAddress":"@id Rd","addressLocality":"X","addressCountry":{"name":"DE"}}}]</script>')
    return parsed(p, "structured").where("kind = 'jsonld_org'").select("page_id", "email", "phone", F.col("value").alias("address"))


@query("people_microdata", f"{PERSON}, {MAIL} as email from events")
def people_microdata(t):
    p = made(t, '<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">@who</span><br><i itemprop=jobTitle>@role</i><a itemprop="email">P@id@acme.example.com</a></div>')
    return parsed(p, "structured").where("kind = 'microdata'").select("page_id", "name", "title", "email")


CARD = '<ul><li><h3>@who</h3><p>@role</p><a href="mailto:P@id@acme.example.com?x">m</a><a href="tel:+49 30 123456">t</a><a href="https://www.linkedin.com/in/x@id?a=b">l</a></ul><p>About us<p>Contact us today'


@query("people_cards", f"{PERSON} from events")
def people_cards(t):
    return parsed(made(t, CARD), "cards").select("page_id", "name", "title").distinct()


CONTACT = f"{PERSON}, {MAIL} as email, '+49 30 123456' as phone, concat('https://www.linkedin.com/in/x', cast(event_id as varchar)) as link from events"


@query("people_card_contact", CONTACT)
def people_card_contact(t):
    return parsed(made(t, CARD), "cards").where("name is not null").select("page_id", "name", "title", "email", "phone", "link").distinct()


@query("html_ancestor_search", CONTACT)
def html_ancestor_search(t):
    deep = CARD.replace("<h3>@who</h3><p>@role</p>", "<div><div><h3>@who</h3><p>@role</p></div></div>")
    return parsed(made(t, deep), "cards").select("page_id", "name", "title", "email", "phone", "link").distinct()


@query("people_class_cards", f"{PERSON}, {MAIL} as email from events")
def people_class_cards(t):
    p = made(t, '<div class="lm__member"><div class="lm__member-name">@who</div><div class="wrap"><div class="lm__member-role">@role</div></div><a href="MAILTO:P@id@acme.example.com">m</a></div><div class="team-name">Our Team</div>')
    return parsed(p, "class_cards").select("page_id", "name", "title", "email")


@query("dedupe_text_block", f"select event_id as page_id, unnest([{WHO}, {ROLE}]) as value from events")
def dedupe_text_block(t):
    p = made(t, "<h2>@who</h2><p>@role</p><section><b>@who</b></section><p>" + "x" * 91 + "</p>")
    return parsed(p, "blocks").select("page_id", "value")


@query("html_unescape", f"select event_id, concat({WHO}, ' & Söhne') as name from events")
def html_unescape(t):
    raw = t.events.selectExpr("event_id", f"concat({WHO}, ' &amp; S&ouml;hne') as raw")
    return mapped(raw, "event_id", "raw", lambda v: [(dom.unescape(v),)], "name string")


JSON = "concat('[{\"a\":{\"name\":\"', {w}, '\"},\"k\":\"outer\"},\"text\",7]')"


@query("json_flatten", "select event_id, unnest(['a,k', 'name']) as keys from events")
def json_flatten(t):
    import json

    rows = t.events.selectExpr("event_id", JSON.replace("{w}", WHO) + " as j")
    return mapped(rows, "event_id", "j", lambda v: [(",".join(sorted(d)),) for d in dom.flattened(json.loads(v))], "keys string")


@query("json_first_str", f"select event_id, {WHO} as first from events")
def json_first_str(t):
    rows = t.events.selectExpr("event_id", f"case event_id % 2 when 0 then concat('[1,\"', {WHO}, '\",\"z\"]') else concat('{{\"name\":\"', {WHO}, '\"}}') end as j")
    return rows.select("event_id", text.json_first_str(F.col("j")).alias("first"))


@query("name_split_role", f"select event_id, {WHO} as name, {ROLE} as role from events")
def name_split_role(t):
    rows = t.events.selectExpr("event_id", f"concat({WHO}, ' – ', {ROLE}) as line")
    return rows.select("event_id", names.split_role(F.col("line")).alias("p")).where("p is not null").select("event_id", "p.name", F.regexp_replace("p.role", "^– ", "").alias("role"))


@query("name_split_reversed", f"select event_id, {WHO} as name, 'Vice President Fleet' as role from events")
def name_split_reversed(t):
    rows = t.events.selectExpr("event_id", f"concat('Vice President, Fleet ', {WHO}) as line")
    return rows.select("event_id", names.split_reversed(F.col("line")).alias("p")).where("p is not null").select("event_id", "p.name", "p.role")


@query("markup_people_items", f"select event_id, unnest([{WHO}, 'Eva Berg']) as name, unnest(['CEO', 'Chair']) as role from events")
def markup_people_items(t):
    rows = t.events.selectExpr("event_id", f"concat('[[', {WHO}, ']] (CEO)|Eva Berg|([[Chair]])|lone') as v")
    return rows.select("event_id", F.explode(markup.people_items(F.col("v"))).alias("p")).select("event_id", "p.name", "p.role")


@query("people_press", f"select event_id, {WHO} as name, 'Chief Executive Officer of Acme' as role from events")
def people_press(t):
    line = F.concat(F.lit("“All is well,” said "), F.expr(WHO), F.lit(", Chief Executive Officer of Acme. More."))
    return t.events.select("event_id", F.explode(people.pressed(line)).alias("p")).select("event_id", F.col("p.name").alias("name"), F.col("p.role").alias("role"))


@query("people_press_reversed", f"select event_id, {WHO} as name, 'Group Chairman' as role from events")
def people_press_reversed(t):
    line = F.concat(F.lit("as told by Group Chairman Mr. "), F.expr(WHO), F.lit(", in Rome"))
    found = t.events.select("event_id", F.explode(people.pressed_reversed(line)).alias("p"))
    return found.select("event_id", F.regexp_replace("p.name", r"\.$", "").alias("name"), F.col("p.role").alias("role"))


@query("snippet_people", f"select event_id, {WHO} as name, 'Managing Director' as role from events")
def snippet_people(t):
    title = F.concat(F.expr(WHO), F.lit(" – Managing Director – Acme | site"))
    name, role = people.from_headline(title)
    return t.events.select("event_id", name.alias("name"), role.alias("role")).where("name is not null")
