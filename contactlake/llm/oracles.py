"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
TEXT = "coalesce(text, '')"

NEAR = f"""
with recursive d as (select doc_id, {WORDS.format(LOWER.format(TEXT))} as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
l as (select a, b from e union all select b, a from e),
r as (select doc_id as node, doc_id as seen from documents union select r.node, l.b from r join l on l.a = r.seen)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, c.component_id = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id join (select node, min(seen) as component_id from r group by node) c on c.node = d.doc_id"""

QUALITY = f"""
with d as (select doc_id, {TEXT} as t, {WORDS.format(TEXT)} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
f as (select doc_id, i from (select *, count(*) over (partition by doc_id, run) as k from g) where k > 1),
c as (select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as k from (select *, lead(i) over (partition by doc_id order by i) as nxt from f) group by doc_id),
m as (select d.doc_id, t, len(w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
   (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.k, 0)::bigint as n_repeat_words, len(string_split(t, chr(10))) as n_lines,
   length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as caps, length(t) - length(translate(t, 'abcdefghijklmnopqrstuvwxyz', '')) as small
   from (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d) d left join c on c.doc_id = d.doc_id),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
   not base_failed and not (100 * n_symbols > 10 * n_words or 100 * word_chars < 200 * n_words or 100 * word_chars > 1500 * n_words or (n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines) or 100 * caps > 60 * (caps + small)) as kept
from b"""

BYTES = f"""
with d as (select doc_id, hex(encode({TEXT})) as x, octet_length(encode({TEXT})) as n from documents),
g as (select doc_id, p, substr(x, 2 * p + 1, 200) as s from (select doc_id, x, unnest(range(0, n - 99)) as p from d)),
o as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from g) where k > 1),
m as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before, lead(p) over (partition by doc_id order by p) as after from o),
i as (select doc_id, p, coalesce(least(100, after - p), 100) as len, sum(case when before is null or p - before > 100 then 1 else 0 end) over (partition by doc_id order by p) as run from m),
r as (select doc_id, run, min(p) as a, max(p) + 100 as z, sum(len) as removed from i group by doc_id, run),
k as (select doc_id, a, coalesce(lag(z) over (partition by doc_id order by a), 0) as from_, a as to_, removed, z from r),
parts as (select k.doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (to_ - from_)), '' order by a) as head, max(z) as last, sum(removed)::bigint as n_removed, count(*)::bigint as n_spans from k join d on d.doc_id = k.doc_id group by k.doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(case when head is null then x else concat(head, substr(x, 2 * last + 1)) end)) as kept_sha256
from d left join parts on parts.doc_id = d.doc_id"""

PHRASES = f"""
with d as (select doc_id, {WORDS.format(TEXT)} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
o as (select distinct doc_id, unnest(range(i, i + 13)) as pos from (select doc_id, i, min(doc_id) over (partition by s) as first from g) where doc_id > first),
a as (select doc_id, pos, w[pos] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as pos from d)),
k as (select a.doc_id, count(o.pos)::bigint as n_removed, string_agg(word, ' ' order by a.pos) filter (o.pos is null) as kept from a left join o on o.doc_id = a.doc_id and o.pos = a.pos group by a.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k on k.doc_id = d.doc_id"""

ITEM_WORDS = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".format(LOWER.format(TEXT))
CONTAMINATION = f"""
with b as (select item_id, w, least(13, len(w)) as n from (select item_id, {ITEM_WORDS} as w from benchmark) where len(w) > 0),
q as (select distinct cast(item_id as varchar) as item_id, n, array_to_string(w[i:i + n - 1], ' ') as s from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
d as (select doc_id, {ITEM_WORDS} as w from documents),
z as (select distinct n from q),
g as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, z)),
h as (select g.doc_id, g.i, g.n, q.item_id from g join q on q.n = g.n and q.s = g.s),
k as (select doc_id, count(distinct pos)::bigint as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from h) group by doc_id),
t as (select doc_id, count(*)::bigint as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join k on k.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""

#: Without alias edges, which the test tables don't have.
URLS = f"""
with p as (select page_id, coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, q, v)),
m as (select page_id, concat(h, q) as rule, v from p join r on (host = h or ends_with(host, concat('.', h))) and starts_with(path, q) qualify row_number() over (partition by page_id order by length(concat(h, q)) desc) = 1)
select p.page_id, host, path, rule, coalesce(v, 'allow') as verdict from p left join m on m.page_id = p.page_id"""

GROUP_TERMS = "regexp_extract_all({}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(LOWER.format(TEXT))
SHARE = "(1 + (1000000000::hugeint * ({} + 5)) // ({} + 5 * {}))"
DIVERGENCE = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {GROUP_TERMS} as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as n from t group by all having count(distinct r) >= 30),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
s as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c on c.lang = g.lang and c.source = g.source group by all),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as c, {SHARE.format("coalesce(c.n, 0)", "s.n", "v.v")} as p, {SHARE.format("k.n", "v.n", "v.v")} as q
   from s join k on k.lang = s.lang join v on v.lang = s.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0)::bigint as value from g a join g b on b.lang = a.lang and b.source <> a.source
   left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
   union all select lang, source, 'term', term, (p - q)::bigint from p where c > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from x qualify part = 'pair' or rank <= 50"""


def lloyd_sql(rounds: int = 10) -> str:
    """Each round is a table of its own."""
    floored = "((total - ((total % n) + n) % n) // n)::bigint"
    nearest = "d{k} as materialized (select vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::bigint as d from v join c{k} c on c.j = v.j group by all), a{k} as materialized (select vec_id, cluster, d from d{k} qualify row_number() over (partition by vec_id order by d, cluster) = 1)"
    moved = "c{n} as materialized (select c.cluster, c.j, coalesce({floored}, c.x) as x from c{k} c left join (select cluster, j, sum(x)::hugeint as total, count(*) as n from a{k} join v using (vec_id) group by all) m on m.cluster = c.cluster and m.j = c.j)"
    steps = [nearest.format(k=k) + ", " + moved.format(k=k, n=k + 1, floored=floored) for k in range(rounds)]
    return f"""
with e as (select vec_id, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64),
v as materialized (select vec_id, unnest(range(64)) as j, unnest(list_transform(embedding, lambda x: floor(1024 * x::double)::bigint)) as x from e),
s as materialized (select vec_id, row_number() over (order by sha256(concat('3:', vec_id))) - 1 as cluster from e qualify cluster < 8),
c0 as materialized (select cluster, j, x from s join v using (vec_id)),
{", ".join(steps)}, {nearest.format(k=rounds)},
h as (select cluster, sha256(string_agg(x::varchar, ',' order by j)) as centroid_sha256 from c{rounds} group by cluster)
select vec_id, cluster::int as cluster, d as distance, (sum(d) over (partition by cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256 from a{rounds} join h using (cluster)"""


ORACLES = {"op3_minhash": NEAR, "op4_quality": QUALITY, "op5_suffix_array": BYTES, "op6_decontaminate": CONTAMINATION, "op8_substrings": PHRASES, "op10_url_filters": URLS, "op11_divergence": DIVERGENCE, "op13_centroids": lloyd_sql()}
