"""Text and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with a mark and their bare form, in order.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉČčĎďĒēĖėĘęĚěĜĝĞğĢģĨĩĪīĮįİĶķĹĺĻļĽľŃńŅņŇňŌōŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŮůŰűŲųŴŵŶŷŸŹźŻżŽžȘșȚț"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcDdEeEeEeEeGgGgGgIiIiIiIKkLlLlLlNnNnNnOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuWwYyYZzZzZzSsTt"


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, where the optimizer would repeat it at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def accent_fold(c: Column) -> Column:
    """Letters without their marks; letters that only look marked (ł, ø, ß) stay."""
    return F.translate(c, MARKED, PLAIN)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def trim_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, tags to blanks, five entities decoded, blanks squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return squeezed(out)


def html_title(html: Column) -> Column:
    return squeezed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))


def html_meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf'(?i)<meta\b[^>]*\bname="{name}"[^>]*\bcontent="([^"]*)"', 1)


def employees_label(n: Column) -> Column:
    tenths = F.floor((n + 50) / 100)
    thousands = F.when(n % 1000 == 0, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k")))
    return F.when(n.isNull() | (n == 0), "—").when(n >= 1000, thousands).otherwise(n.cast("string"))


def relative_time(ts: Column, now: Column) -> Column:
    s = F.timestamp_diff("SECOND", ts, now)
    ago = lambda unit, mark: F.concat(F.floor(s / unit).cast("string"), F.lit(mark))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m ago")).when(s < 86400, ago(3600, "h ago")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def elapsed_label(seconds: Column) -> Column:
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(minutes)


def flag_emoji(code: Column) -> Column:
    """The first two letters as regional indicators."""
    indicator = lambda i: F.decode(F.unhex(F.lpad(F.hex(F.lit(127397) + F.ascii(F.substring(code, i, 1))), 8, "0")), "UTF-32")
    return F.concat(indicator(1), indicator(2))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parsed_time(c: Column) -> Column:
    """Either of the two layouts that times are stored in."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def joined_address(street: Column, *rest: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in (street, *rest)])


def json_first_str(json: Column) -> Column:
    """Of JSON a text, the first text of a list, or an object's name, email or telephone; null if there is none, or it is no JSON."""
    kind = lambda v: F.schema_of_variant(v) == "STRING"
    said = lambda v, at="$": F.variant_get(v, at, "string")
    whole = F.try_parse_json(json)
    listed = F.get(F.filter(F.from_json(json, "array<variant>"), lambda x: F.coalesce(kind(x), F.lit(False))), F.lit(0))
    part = lambda k: F.when(F.coalesce(kind(F.try_variant_get(whole, f"$.{k}", "variant")), F.lit(False)), F.try_variant_get(whole, f"$.{k}", "string"))
    return F.when(F.schema_of_variant(whole) == "STRING", said(whole)).when(F.ltrim(json).startswith("["), said(listed)).otherwise(F.coalesce(part("name"), part("email"), part("telephone")))
