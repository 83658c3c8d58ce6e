"""People in running text: pairs with addresses, press sentences, search snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .email import EMAIL
from .values import NAME_THEN_ADDRESS, NAME_THEN_ROLE, ROLE_CORE, ROLE_THEN_NAME

PAIR = rf"{NAME_THEN_ADDRESS}({EMAIL})"


def name_email(text: Column) -> tuple[Column, Column]:
    """The first name and address that stand next to each other."""
    return F.regexp_extract(text, PAIR, 1).alias("name"), F.regexp_extract(text, PAIR, 2).alias("email")


def _pairs(text: Column, shape: str, name: int, role: int) -> Column:
    """Array of (name, role), the shape's groups of those numbers."""
    names, roles = (F.regexp_extract_all(text, F.lit(shape), F.lit(k)) for k in (name, role))
    return F.zip_with(names, roles, lambda n, r: F.struct(n.alias("name"), r.alias("role")))


def pressed(text: Column) -> Column:
    """Array of (name, role) from sentences like `Ann Lee, Chief Executive Officer of X`."""
    return _pairs(text, NAME_THEN_ROLE, 1, 2)


def pressed_reversed(text: Column) -> Column:
    """Array of (name, role) from `Group Chairman Mr. Bo Ek`; names must look like names."""
    from .names import looks_like

    return F.filter(_pairs(text, ROLE_THEN_NAME, 2, 1), lambda x: looks_like(x["name"]))


def from_headline(title: Column) -> tuple[Column, Column]:
    """(name, role) of `Name – Role – …` where the role is one."""
    shape = r"^(.+?)\s+[–—-]\s+(.+?)\s*[–—-]"
    role = F.trim(F.regexp_extract(title, shape, 2))
    ok = role.rlike(rf"(?i)^\s*(?:{ROLE_CORE})(?![\p{{L}}\p{{N}}_])")
    return F.when(ok, F.trim(F.regexp_extract(title, shape, 1))), F.when(ok, role)
