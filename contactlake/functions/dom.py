"""People and organisations in HTML: a tolerant tree, then structured data, class-named cards and plain text cards.

Everything here is plain Python over one page; operators.pages runs it over Arrow batches.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

from .names import STOP
from .values import HONORIFICS, SOCIAL_EXCLUDED, STRONG_TITLE_WORDS, TITLE_WORDS, TLDS, TWO_LABEL

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY_SIBLING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SILENT = frozenset(("script", "style", "template"))
CARD_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p span div strong b li figcaption dt dd".split())
LETTER = "A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ"
WORD = re.compile(rf"[{LETTER}][{LETTER}.'’\-]*")
NAME_WORD = re.compile(rf"[A-ZÀ-ÖØ-ÞĀ-ɏ][{LETTER}.'’\-]*")
#: The longest text of a card, and what class names tell name and role.
CARD_TEXT = 90
NAME_CLASS = re.compile(r"(?:member|team|staff|person|leadership|bio)[\w-]*name", re.I)
ROLE_CLASS = re.compile(r"(?:member|team|staff|person|leadership|bio)[\w-]*(?:role|title|position|job)", re.I)
PROFILE = re.compile(r"linkedin\.com/in/", re.I)
STOP_SET, TITLES, STRONG = frozenset(STOP), frozenset(TITLE_WORDS), frozenset(STRONG_TITLE_WORDS)


class Node:
    """An element. pos is its place among the page's elements, order, in document order; last that of the last one below it."""

    __slots__ = ("tag", "attrs", "parent", "children", "order", "pos", "last")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.order = parent.order if parent else []
        self.pos = self.last = len(self.order)
        self.order.append(self)

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        return iter(self.order[self.pos + 1 : self.last + 1])

    def text(self, joint: str = " ", most: int | None = None) -> str:
        """The text below; with most, nothing as soon as it is longer."""
        if len(self.children) == 1 and isinstance(self.children[0], str) and self.tag not in SILENT:
            only = self.children[0].strip()
            return "" if most is not None and len(only) > most else only
        out: list[str] = []
        todo: list = [self]
        size = 0
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                n = n.strip()
                if n:
                    size += len(n) + (len(joint) if out else 0)
                    if most is not None and size > most:
                        return ""
                    out.append(n)
            elif n.tag not in SILENT:
                todo.extend(reversed(n.children))
        return joint.join(out)

    def ancestors(self, k: int) -> Iterator[Node]:
        n = self
        for _ in range(k):
            n = n.parent
            if n is None:
                return
            yield n


#: What most of a page consists of: text, then a tag with quoted, plain or no values, a doctype or a plain comment.
_BLANK = r"[ \t\n\r\f]"


def _attr(group: str) -> str:
    """Name, and value if any, each in such a group."""
    return rf"""{group}[A-Za-z_][\w:.-]*+)(?:=(?:"{group}[^"]*+)"|'{group}[^']*+)'|{group}[\w-]++)(?={_BLANK}|>|\Z)))?+"""


ATTR = re.compile(_attr("("), re.A)
PLAIN = re.compile(rf"([^<]*+)<(?:/([a-zA-Z][a-zA-Z0-9]*+)>|([a-zA-Z][a-zA-Z0-9]*+)((?:{_BLANK}++{_attr('(?:')}(?=[ \t\n\r\f/>]))*+){_BLANK}*+(/?)>|(?i:!doctype)[^>]*+>|!--[^->](?:[^-]|-(?!-))*+-->)", re.A)
_CLOSE = {t: re.compile(rf"</\s*{t}", re.I) for t in ("script", "style")}


class _Builder(HTMLParser):
    #: elements whose content is no markup
    opaque = frozenset((*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def goahead(self, end):
        """Takes what is plain by one pattern; from the first thing that isn't, the standard parser goes on, so the tree is the same."""
        source, i = self.rawdata, 0
        while self.cdata_elem is None and (m := PLAIN.match(source, i)):
            text, shut, name, attrs, empty = m.groups()
            tag, inside, k = name and name.lower(), None, m.end()
            if tag in self.opaque:
                close = _CLOSE[tag].search(source, k) if tag in _CLOSE and not empty else None
                if close is None or source[close.end() : close.end() + 1] != ">" or close.end() - close.start() != len(tag) + 2 or "<!--" in source[k : close.start()]:
                    break
                inside, k = source[k : close.start()], close.end() + 1
            if text:
                self.handle_data(html.unescape(text) if "&" in text else text)
            if shut:
                self.handle_endtag(shut.lower())
            elif tag:
                pairs = []
                for key, *values in ATTR.findall(attrs) if attrs else ():
                    value = values[0] or values[1] or values[2]
                    pairs.append((key.lower(), html.unescape(value) if "&" in value else value))
                self.lasttag = tag
                (self.handle_startendtag if empty else self.handle_starttag)(tag, pairs)
                if inside is not None:
                    if inside:
                        self.handle_data(inside)
                    self.handle_endtag(tag)
            i = k
        self.rawdata = source[i:] if i else source
        super().goahead(end)

    def updatepos(self, i, j):
        return j  # lines aren't counted

    def handle_starttag(self, tag, attrs):
        shut = CLOSED_BY_SIBLING.get(tag, ())
        if self.at.tag in shut:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(source: str) -> Node:
    b = _Builder()
    b.feed(source or "")
    b.close()
    order = b.root.order
    for n in reversed(order):
        if n.parent is not None and n.parent.last < n.last:
            n.parent.last = n.last
    return b.root


# names and addresses



def told(f):
    """f, with what it told of the latest texts kept: blocks of text recur from page to page of a site. A plain function, so that it travels with a task."""
    known: dict = {}

    def run(*of):
        if of not in known:
            if len(known) >= 1 << 14:
                known.clear()
            known[of] = f(*of)
        return known[of]

    return run



def name_is_stop(name: str) -> bool:
    return len(name or "") < 3 or any(w.lower() in STOP_SET for w in name.split())


@told
def looks_like_name(name: str) -> bool:
    words = name.split()
    return 4 <= len(name) <= 40 and 2 <= len(words) <= 4 and not name_is_stop(name) and all(NAME_WORD.fullmatch(w) for w in words)


def email_ok(address: str) -> bool:
    who, _, domain = address.partition("@")
    labels = domain.lower().split(".")
    if ".." in address or address.startswith(".") or not re.fullmatch(r"[A-Za-z0-9._%+\-]+", who) or not re.fullmatch(r"[A-Za-z0-9.\-]+", domain) or len(labels) < 2 or not labels[0] or not labels[-1]:
        return False
    return (".".join(labels[-2:]) if labels[-1] in TWO_LABEL and len(labels) > 2 else labels[-1]) in TLDS


def phone_ok(phone: str) -> bool:
    return 7 <= sum(c.isdigit() for c in phone) <= 15


@told
def split_role(text: str) -> tuple[str, str] | None:
    """`Ann Lee Founder and CEO` at its first title word, which must leave two to four words of a name before it."""
    words = WORD.findall(text)
    at = next((i for i, w in enumerate(words) if i and w.lower() in TITLES), None)
    if at is None or len(words) < 3 or not 2 <= at <= 4:
        return None
    name = " ".join(words[:at])
    role = re.sub(r"\b[A-Za-z]\b\s*", "", text[len(name) :].strip().lstrip("–—,;: "))
    role = " ".join(role.split()).strip(" ,–—-")
    return (name, role) if len(role) >= 3 else None


@told
def split_reversed(text: str, company: str = "") -> tuple[str, str] | None:
    """`Vice President, Fleet Brad Taylor`: the first name of two, else three words with a leadership title before it."""
    own = {w for w in re.split(r"[\s&-]+", company.lower()) if len(w) >= 3}
    words = WORD.findall(text)
    if len(words) < 4:
        return None
    for size in (2, 3):
        for at in range(1, len(words) - size + 1):
            name = " ".join(words[at : at + size])
            role = [w for w in words[:at] if w.lower() not in HONORIFICS and w.lower() not in own]
            if looks_like_name(name) and any(w.lower() in STRONG for w in role) and len(" ".join(role).strip(" ,–—-")) >= 3:
                return name, " ".join(role).strip(" ,–—-")
    return None


# JSON-LD


def flattened(data) -> Iterator[dict]:
    """Every object, outer before inner."""
    if isinstance(data, list):
        for x in data:
            yield from flattened(x)
    elif isinstance(data, dict):
        yield data
        for x in data.values():
            if isinstance(x, (dict, list)):
                yield from flattened(x)


def first_str(value) -> str | None:
    """A text, the first in a list, or an object's name, email or telephone."""
    if isinstance(value, list):
        return next((x for x in value if isinstance(x, str)), None)
    if isinstance(value, dict):
        return next((value[k] for k in ("name", "email", "telephone") if isinstance(value.get(k), str)), None)
    return value if isinstance(value, str) else None


def address(item: dict) -> str | None:
    a = item.get("address")
    if isinstance(a, str):
        return a or None
    if isinstance(a, list):
        a = next((x for x in a if isinstance(x, dict)), {})
    parts = [first_str((a or {}).get(k)) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
    return ", ".join(p for p in parts if p) or None


FIELDS = ("kind", "name", "title", "email", "phone", "link", "value")


def found(kind: str, **values) -> tuple:
    return tuple(map({"kind": kind, **values}.get, FIELDS))


def structured(root: Node, same_as: bool = False) -> Iterator[tuple]:
    """Persons and organisations of JSON-LD scripts, then of microdata. same_as: profile links are taken from sameAs texts too."""
    for node in root.walk():
        if node.tag != "script" or node.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(c for c in node.children if isinstance(c, str)))
        except ValueError:
            continue
        for item in flattened(data):
            kind = item.get("@type")
            kind = next((x for x in kind if isinstance(x, str)), None) if isinstance(kind, list) else kind
            mail, phone = first_str(item.get("email")), first_str(item.get("telephone"))
            mail = mail.lower() if mail and email_ok(mail) else None
            if kind == "Person" and first_str(item.get("name")):
                links = item.get("sameAs") if same_as else None
                link = next((x.split("?")[0] for x in (links if isinstance(links, list) else [links]) if isinstance(x, str) and PROFILE.search(x)), None)
                yield found("jsonld_person", name=first_str(item["name"]), title=first_str(item.get("jobTitle")) or "", email=mail, phone=phone if phone and phone_ok(phone) else None, link=link)
            elif kind == "Organization":
                yield found("jsonld_org", email=mail, phone=phone, value=address(item))
    for node in root.walk():
        if "schema.org/Person" not in node.attrs.get("itemtype", ""):
            continue
        prop = lambda p, at=node: next((n.text("") for n in at.walk() if n.attrs.get("itemprop") == p), "")
        if prop("name"):
            mail = prop("email").lower()
            yield found("microdata", name=prop("name"), title=prop("jobTitle"), email=mail if email_ok(mail) else None, phone=prop("telephone") or None)


# cards


class Marked:
    """Values of some of a page's elements, found by where they stand: the first at or below a node by bisection."""

    def __init__(self):
        self.at: list[int] = []
        self.values: list = []

    def add(self, pos: int, value) -> None:
        self.at.append(pos)
        self.values.append(value)

    def first(self, low: int, high: int):
        k = bisect_left(self.at, low)
        return self.values[k] if k < len(self.at) and self.at[k] <= high else None


class Contacts:
    """A page's e-mail, telephone and profile links, gathered once."""

    def __init__(self, root: Node):
        self.mails, self.phones, self.profiles = Marked(), Marked(), Marked()
        for n in root.walk():
            if n.tag != "a":
                continue
            href = n.attrs.get("href", "")
            low = href.lower()
            if low.startswith("mailto:"):
                mail = href[7:].split("?")[0].strip().lower()
                if email_ok(mail):
                    self.mails.add(n.pos, mail)
            elif low.startswith("tel:"):
                phone = href[4:].strip()
                if phone_ok(phone):
                    self.phones.add(n.pos, phone)
            if PROFILE.search(href):
                self.profiles.add(n.pos, href.split("?")[0])

    def near(self, node: Node, climb: int = 4) -> tuple[str | None, str | None, str | None]:
        """(e-mail, phone, profile) each from the nearest of node and its ancestors that has one."""
        mail = phone = profile = None
        for at in (node, *node.ancestors(climb)):
            mail = mail or self.mails.first(at.pos, at.last)
            phone = phone or self.phones.first(at.pos, at.last)
            profile = profile or self.profiles.first(at.pos, at.last)
        return mail, phone, profile


@told
def has_title(text: str) -> bool:
    return any(w.lower() in TITLES for w in WORD.findall(text))


def sibling_role(node: Node, reach: int = 2) -> str | None:
    """Text of up to 60 characters with a title word in one of the next siblings."""
    if node.parent is None:
        return None
    at, end = node.last + 1, node.parent.last
    for _ in range(reach):
        if at > end:
            break
        n = node.order[at]
        text = n.text(most=60)
        if text and has_title(text):
            return text
        at = n.last + 1
    return None


def cards(root: Node, company: str = "") -> Iterator[tuple]:
    """Short text blocks that name a person and a role: together, in neighbours, or the other way round. Equal blocks count once."""
    seen: set[str] = set()
    contacts = None
    for node in root.walk():
        if node.tag not in CARD_TAGS:
            continue
        text = node.text(most=CARD_TEXT)
        if not text or text in seen:
            continue
        seen.add(text)
        hit = split_role(text)
        if hit and name_is_stop(hit[0]):
            hit = None
        if not hit and len(text) <= 40 and looks_like_name(text):
            role = sibling_role(node)
            if not role:
                continue
            hit = text, role
        hit = hit or split_reversed(text, company)
        if hit:
            contacts = contacts or Contacts(root)
            mail, phone, profile = contacts.near(node)
            yield found("card", name=hit[0], title=hit[1], email=mail, phone=phone, link=profile)


def class_cards(root: Node) -> Iterator[tuple]:
    """Cards whose class names tell name and role, the role within three ancestors."""
    contacts = roles = None
    for node in root.walk():
        name = node.text(most=CARD_TEXT) if NAME_CLASS.search(node.attrs.get("class", "")) else ""
        if not looks_like_name(name):
            continue
        if roles is None:
            contacts, roles = Contacts(root), Marked()
            for n in root.walk():
                if ROLE_CLASS.search(n.attrs.get("class", "")):
                    roles.add(n.pos, n)
        for card in node.ancestors(3):
            at = roles.first(card.pos + 1, card.last)
            role = at.text(most=CARD_TEXT) if at else ""
            if role:
                mail, phone, profile = contacts.near(card, 0)
                yield found("class_card", name=name, title=role, email=mail, phone=phone, link=profile)
                break


def text_blocks(root: Node) -> Iterator[tuple]:
    """Distinct texts of card tags, up to 90 characters."""
    texts = (n.text(most=CARD_TEXT) for n in root.walk() if n.tag in CARD_TAGS)
    for t in dict.fromkeys(t for t in texts if t):
        yield found("block", value=t)


def socials(root: Node) -> Iterator[tuple]:
    for n in root.walk():
        href = n.attrs.get("href", "") if n.tag == "a" else ""
        if href and not re.search("|".join(SOCIAL_EXCLUDED), href, re.I):
            yield found("link", link=href.split("#")[0])


STAGES = {"structured": structured, "class_cards": class_cards, "cards": cards, "blocks": text_blocks, "links": socials}


def people_items(value: str) -> list[tuple[str, str]]:
    """(name, role) of an infobox list: `Name (Role)`, or a role in brackets after a bare name."""
    out, waiting = [], None
    for item in value.split("|"):
        item = " ".join(re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", item).split())
        if not item:
            continue
        m = re.fullmatch(r"(.*?)\s*\(\s*(.+?)\s*\)", item)
        name, role = (m[1], m[2].strip(" (),")) if m else (item, None)
        name = name.strip(" ,;–—-.")
        good = 4 <= len(name) <= 60 and re.search(r"[A-ZÀ-ÖØ-Þ]", name)
        if role is None:
            waiting = name if good else waiting
            continue
        who = name if m[1] else waiting
        if who and role and len(role) <= 70 and (good or not m[1]):
            out.append((who, role))
        waiting = None
    return out


unescape = html.unescape
