"""Phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTL = r"\+[0-9][0-9 \t\n\f\r\-().]{6,18}[0-9]"
US = r"\([0-9]{3}\)[ \t\n\f\r.\-]?[0-9]{3}[ \t\n\f\r.\-]?[0-9]{4}"


def digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def intl_found_in(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(INTL), F.lit(0)), lambda x: digit_count(x).between(7, 15))


def us_found_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(US), F.lit(0))


def tel(html: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r'(?i)href="tel:([^"]*)"'), F.lit(1)), lambda x: F.trim(x)), lambda x: digit_count(x).between(7, 15))
