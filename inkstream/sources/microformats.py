"""Microformats in HTML as records, by rules: a root class, the properties below it, and what follows from them.

All formats share one tree of the page. A record has flat fields with dotted names, and lists of child records
(authors, tags, cards). The first value of a field wins, other than for texts that a format joins. A root within a
root of the same class is no record, but counts for the index; so do roots in quotations, where a format ignores them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote, urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions import dates
from inkstream.operators.lookup import HONORIFICS
from inkstream.sources import html_tree as ht
from inkstream.sources.arrow import parse_column

RECORD = "array<struct<format:string,index:string,fields:map<string,string>,children:array<struct<name:string,fields:map<string,string>>>>>"
QUOTES = frozenset(("blockquote", "cite", "q"))
#: Text properties of a card (fixed values), and those below adr, n, org, geo and tel or email.
CARD = "fn nickname bday tz title role note sort-string uid class key label mailer rev sound category".split()
CARD_PARTS = {
    "adr": "post-office-box extended-address street-address locality region postal-code country-name".split(),
    "n": "honorific-prefix given-name additional-name family-name honorific-suffix".split(),
    "org": "organization-name organization-unit".split(),
    "geo": "latitude longitude".split(),
}
#: Kinds of addresses and numbers that become part of a field's name.
KINDS = frozenset("home work cell fax pager voice pref dom intl postal parcel".split())
_DATE = re.compile(dates.PARTIAL, re.ASCII)


def date_text(value: str) -> str:
    """A date as far as it is given, with a Z for no offset; empty if the text opens with none."""
    m = _DATE.match(value.strip())
    if not m:
        return ""
    year, month, day, hour, minute, second, zone = (x or "" for x in m.groups())
    out = "-".join(p for p in (year, month, day) if p)
    if hour:
        out += "T" + ":".join(p for p in (hour, minute, second) if p)
    return out + ("Z" if zone.replace(":", "") in ("+0000", "-0000") else re.sub(r"^([-+]\d\d)(\d\d)$", r"\1:\2", zone))


def line(node: ht.Node) -> str:
    """One line of text; images give their alternative text. Parts marked as values stand for the whole."""
    if node.tag in ("img", "area"):
        return node.attrs.get("alt", "")
    values = [n for n in node.walk() if n is not node and "value" in n.words("class")] if any(isinstance(c, ht.Node) for c in node.children) else ()
    return "".join(map(line, values)) if values else ht.text_of(node)


def abbreviated(node: ht.Node) -> str:
    """The title of an abbreviation, else the value-title within, else the text."""
    for n in node.walk():
        if "value-title" in n.words("class"):
            return n.attrs.get("title", "")
    return node.attrs["title"] if node.tag == "abbr" and node.attrs.get("title") else node.attrs.get("datetime") or line(node)


def link_of(node: ht.Node) -> str:
    return next((node.attrs[k] for k in ("href", "src", "data") if k in node.attrs), "")


READERS: dict[str, Callable[[ht.Node], str]] = {
    "line": line,
    "text": lambda n: ht.text_of(n, lines=True),
    "abbr": abbreviated,
    "date": lambda n: date_text(abbreviated(n)),
    "inner": lambda n: trim_empty(ht.serialize(n, outer=False)),
    "outer": ht.serialize,
    "int": lambda n: (re.match(r"\s*(-?\d+)", line(n)) or [None, ""])[1],
    "float": lambda n: (re.match(r"\s*(-?\d+(?:\.\d+)?)", abbreviated(n)) or [None, ""])[1],
    "link": link_of,
}


def trim_empty(markup: str) -> str:
    """Without empty divisions at either end."""
    return re.sub(r"^(?:\s*<div>\s*</div>)+|(?:<div>\s*</div>\s*)+$", "", markup).strip()


@dataclass(frozen=True)
class Format:
    """What makes a record: root class (or rel), properties by class and by rel with how to read them, joined ones,
    child records by class, and a last step; whether cells of a table take what their header cells say."""

    name: str
    root: str
    by_class: dict[str, str] = field(default_factory=dict)
    by_rel: dict[str, str] = field(default_factory=dict)
    joined: frozenset[str] = frozenset()
    children: dict[str, str] = field(default_factory=dict)
    finish: Callable[[ht.Node, dict, list], dict | None] | None = None
    root_by: str = "class"
    quotes: bool = False
    include: bool = False
    headers: bool = False


def _is_root(node: ht.Node, f: Format) -> bool:
    value = node.attrs.get(f.root_by)
    return bool(value) and f.root in value and f.root in value.split()


def _put(out: dict[str, str], name: str, value: str, joined: bool = False) -> None:
    if value:
        if name not in out:
            out[name] = value
        elif joined:
            out[name] += "\n" + value


def _included(page: ht.Node) -> None:
    """References of class include give way to copies of what they name."""
    by_id = {n.attrs["id"]: n for n in page.walk() if "id" in n.attrs}
    for node in list(page.walk()):
        if "include" in node.words("class"):
            to = by_id.get((node.attrs.get("data") or node.attrs.get("href") or "").removeprefix("#"))
            if to is not None and to is not node and all(a is not to for a in node.ancestors()):
                twin = ht.copy(to, node)
                twin.attrs.pop("id", None)
                node.tag, node.attrs, node.children = "span", {}, [twin]


def extract(page: ht.Node, f: Format, uri: str = "") -> list[dict]:
    """Records of one format in a page's tree."""
    if f.include:
        page = ht.copy(page)
        _included(page)
    out, index = [], 0
    by_id: dict[str, ht.Node] | None = None
    for root in page.walk():
        if not _is_root(root, f):
            continue
        index += 1
        above = list(root.ancestors())
        if any(_is_root(a, f) for a in above) or (f.quotes and any(a.tag in QUOTES for a in above)):
            continue
        fields, children = _collect(root, f)
        if f.headers and root.tag == "td" and root.attrs.get("headers"):
            by_id = by_id or {n.attrs["id"]: n for n in page.walk() if "id" in n.attrs}
            for cell in filter(None, map(by_id.get, root.words("headers"))):
                more, inner = _collect(cell, f)
                fields = more | fields
                children += inner
        if f.finish:
            fields = f.finish(root, fields, children)
        if fields is None or not (fields or children):
            continue
        if uri:
            fields = {k: urljoin(uri, v) if k in ("url", "bookmark", "@uri", "photo", "logo", "feedurl", "principles") else v for k, v in fields.items()}
            fields.setdefault("@uri", f"{uri}#{root.attrs['id']}" if root.attrs.get("id") else uri)
        classes = sorted({c for a in above for c in a.words("class")})
        if classes:
            fields["@parents"] = " ".join(classes)
        out.append({"format": f.name, "index": f"{f.root}-{index}", "fields": fields, "children": children})
    return out


def _collect(root: ht.Node, f: Format) -> tuple[dict[str, str], list[dict]]:
    fields: dict[str, str] = {}
    children: list[dict] = []

    def visit(node: ht.Node, kinds: tuple[str, ...]) -> None:
        if node is not root and (_is_root(node, f) or f.quotes and node.tag in QUOTES):
            return
        classes, rels = node.words("class"), node.words("rel")
        nested = False
        if classes or rels:
            for c in classes:
                if c in f.by_class and node is not root:
                    _put(fields, c, READERS[f.by_class[c]](node), c in f.joined)
            for r in rels:
                if r in f.by_rel:
                    _put(fields, r, READERS[f.by_rel[r]](node))
            for c in [*classes, *(f"rel:{r}" for r in rels)] if f.children else ():
                if c in f.children and node is not root:
                    child = child_record(node, f.children[c])
                    if child:
                        children.append({"name": c.removeprefix("rel:"), "fields": child})
                    nested = nested or f.children[c] == "hcard" and "vcard" in classes
        if not nested:
            for x in node.children:
                if isinstance(x, ht.Node):
                    visit(x, kinds)

    visit(root, ())
    return fields, children


def child_record(node: ht.Node, kind: str) -> dict[str, str]:
    if kind == "hcard":
        if "vcard" in node.words("class"):
            return card(node)
        inner = next((n for n in node.walk() if "vcard" in n.words("class")), None)
        return card(inner) if inner is not None else {"fn": ht.text_of(node)} if ht.text_of(node) else {}
    if kind == "tag":
        return tag(node)
    if kind == "event":
        found = _collect(node, FORMATS["hcalendar"])[0]
        return found | {k: v for k, v in card(node).items() if k not in found}
    return {}


def tag(node: ht.Node) -> dict[str, str]:
    """Name of a tag link: the last part of its path, else its text; and its address."""
    href = node.attrs.get("href", "")
    name = unquote(href.split("#")[0].split("?")[0].rstrip("/").rsplit("/", 1)[-1].replace("+", " "))
    return {k: v for k, v in (("name", name or ht.text_of(node)), ("title", ht.text_of(node)), ("uri", href)) if v}


def card(root: ht.Node) -> dict[str, str]:
    """Fields of a card, with parts and kinds in dotted names, and what its name implies."""
    out: dict[str, str] = {}

    def visit(node: ht.Node, group: str, kinds: tuple[str, ...]) -> None:
        classes = node.words("class")
        for c in classes if node is not root else []:
            if group and c in CARD_PARTS.get(group.split(".")[0], ()):
                _put(out, ".".join([group, *kinds, c]), abbreviated(node))
            elif c in CARD:
                _put(out, c, line(node))
            elif c == "org" and not any(set(n.words("class")) & set(CARD_PARTS["org"]) for n in node.walk()):
                _put(out, "org.organization-name", line(node))
            elif c in ("url", "photo", "logo", "source"):
                _put(out, c, link_of(node) or line(node))
            elif c in ("tel", "email"):
                here = sorted({t.lower() for n in node.walk() if "type" in n.words("class") for t in [ht.text_of(n)]} & KINDS)
                value = re.sub(r"\?.*$", "", re.sub("^mailto:", "", link_of(node), flags=re.I)) if c == "email" and link_of(node) else line(node) if any("value" in n.words("class") for n in node.walk()) else re.sub(rf"^({'|'.join(KINDS)})\b[:\s]*", "", ht.text_of(node), flags=re.I)
                _put(out, ".".join([c, *here]), value)
        inner, below = group, kinds
        for c in classes if node is not root else []:
            if c in CARD_PARTS:
                inner = c
                below = tuple(sorted({t.lower() for n in node.walk() if "type" in n.words("class") for t in [ht.text_of(n)]} & KINDS))
        for x in node.children:
            if isinstance(x, ht.Node) and "vcard" not in x.words("class"):
                visit(x, inner, below)

    visit(root, "", ())
    fn, org = out.get("fn", ""), out.get("org.organization-name", "")
    if fn and fn != org and not any(k.startswith("n.") for k in out):
        words = fn.split()
        if words and words[0].endswith(","):
            words = [*words[1:], words[0][:-1]]
        if words and words[0].lower() in HONORIFICS:
            out["n.honorific-prefix"] = words.pop(0)
        places = {1: ("given-name",), 2: ("given-name", "family-name")}.get(len(words), ("given-name", "additional-name", "family-name", "honorific-suffix"))
        for place, word in zip(places, words, strict=False):
            out[f"n.{place}"] = word.rstrip(",")
    if fn or org:
        out["@title"] = fn or org
    return out


def _entry(root: ht.Node, fields: dict, children: list) -> dict:
    if "posted" in fields:
        fields.setdefault("published", fields["posted"])
        fields.pop("posted")
    if "entry-title" not in fields:
        heads = [n for n in root.walk() if re.fullmatch("h[1-6]", n.tag)]
        if heads:
            _put(fields, "entry-title", ht.text_of(min(heads, key=lambda n: n.tag)))
    if "entry-title" not in fields and not any("hfeed" in a.words("class") for a in root.ancestors()):
        top = [*root.ancestors()][-1] if root.parent else root
        _put(fields, "entry-title", next((ht.text_of(n) for n in top.walk() if n.tag == "title"), ""))
    if not any(c["name"] == "author" for c in children):
        for a in root.ancestors():
            found = next((n for n in a.walk() if n.tag == "address" and {"author", "vcard"} <= set(n.words("class")) and not any("hentry" in x.words("class") for x in n.ancestors())), None)
            if found is not None:
                children.append({"name": "author", "fields": card(found)})
                break
    if "bookmark" in fields:
        fields["@title"] = fields.get("entry-title", "")
    return fields


def _news(root: ht.Node, fields: dict, children: list) -> dict:
    children[:] = [c for c in children if c["name"] != "source-org" or any(k != "fn" for k in c["fields"])]
    return fields


def _event(root: ht.Node, fields: dict, children: list) -> dict:
    from datetime import datetime

    if "dtstart" in fields and "dtend" in fields:
        try:
            seconds = int((datetime.fromisoformat(fields["dtend"]) - datetime.fromisoformat(fields["dtstart"])).total_seconds())
            fields["@duration"] = f"{seconds // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"
        except (TypeError, ValueError):  # one with a zone and one without, or partial dates
            pass
    _put(fields, "@title", fields.get("summary", ""))
    return fields


def _signed(name: str) -> Callable[[ht.Node, dict, list], dict]:
    def finish(root: ht.Node, fields: dict, children: list) -> dict:
        if not any(c["name"] == name for c in children):
            children.append({"name": name, "fields": {"fn": "anonymous"}})
        _put(fields, "@title", fields.get("summary", ""))
        return fields

    return finish


def _folk(root: ht.Node, fields: dict, children: list) -> dict | None:
    for n in root.walk():
        if "taggedlink" in n.words("class"):
            _put(fields, "url", n.attrs.get("href", ""))
            _put(fields, "title", n.attrs.get("title") or ht.text_of(n))
    _put(fields, "description", fields.pop("extended", ""))
    return fields if "url" in fields else None


def _tag_record(root: ht.Node, fields: dict, children: list) -> dict:
    return tag(root)


FORMATS: dict[str, Format] = {
    f.name: f
    for f in (
        Format("hatom", "hentry", {"entry-title": "line", "entry-content": "inner", "entry-summary": "inner", "updated": "date", "published": "date", "posted": "date"}, {"bookmark": "link"}, frozenset(("entry-content", "entry-summary")), {"author": "hcard", "rel:tag": "tag"}, _entry, quotes=True),
        Format("hnews", "hentry", {"dateline": "line", "latitude": "abbr", "longitude": "abbr"}, {"principles": "link"}, frozenset(), {"source-org": "hcard"}, _news, quotes=True),
        Format("hcard", "vcard", finish=lambda root, fields, children: card(root)),
        Format("hcalendar", "vevent", {"summary": "line", "dtstart": "date", "dtend": "date", "location": "line", "description": "text", "url": "link", "uid": "line", "status": "line", "duration": "abbr", "class": "line"}, {}, frozenset(), {"location": "hcard", "organizer": "hcard"}, _event, headers=True),
        Format("hreview", "hreview", {"summary": "line", "description": "inner", "rating": "float", "best": "float", "worst": "float", "dtreviewed": "date", "type": "line", "version": "line"}, {"permalink": "link", "bookmark": "link"}, frozenset(), {"item": "hcard", "reviewer": "hcard", "rel:tag": "tag"}, _signed("reviewer")),
        Format("hresume", "hresume", {"summary": "text", "publications": "text"}, {}, frozenset(), {"contact": "hcard", "affiliation": "hcard", "education": "event", "experience": "event", "skill": "tag"}, include=True),
        Format("hlisting", "hlisting", {"summary": "line", "description": "inner", "price": "line", "dtlisted": "date", "dtexpired": "date", "version": "line"}, {"permalink": "link"}, frozenset(), {"item": "hcard", "lister": "hcard", "rel:tag": "tag"}, _signed("lister")),
        Format("hslice", "hslice", {"entry-title": "line", "entry-content": "inner", "ttl": "int", "endtime": "date"}, {"feedurl": "link", "entry-content": "link", "bookmark": "link"}, frozenset(("entry-content",)), quotes=True),
        Format("reltag", "tag", finish=_tag_record, root_by="rel"),
        Format("xfolk", "xfolkentry", {"description": "inner", "extended": "inner", "title": "line"}, {}, frozenset(("description", "extended")), {"rel:tag": "tag"}, _folk),
    )
}
#: Other names of formats (fixed values).
ALIASES = {"hentry": "hatom", "atom": "hatom", "vcard": "hcard", "card": "hcard", "vevent": "hcalendar", "event": "hcalendar", "review": "hreview", "resume": "hresume", "listing": "hlisting", "slice": "hslice", "webslice": "hslice", "tag": "reltag", "rel-tag": "reltag", "xfolkentry": "xfolk"}
DEFAULTS = ("hatom", "hcalendar", "hcard", "xfolk")


def register(f: Format) -> None:
    """Adds a format, or puts one of the same name in its place; for jobs that ship the module which calls this."""
    FORMATS[f.name] = f


def parse_page(text: str, formats: tuple[str, ...] = DEFAULTS, uri: str = "") -> list[dict]:
    """Records of all wanted formats over one tree; a format that fails does not keep the others from theirs."""
    page, out = ht.parse(text), []
    for name in formats:
        try:
            out += extract(page, FORMATS[ALIASES.get(name, name)], uri)
        except (AttributeError, ValueError, RecursionError) as problem:
            out.append({"format": name, "index": "", "fields": {"@error": str(problem)}, "children": []})
    return out


def microformats(pages: DataFrame, html: str = "html", formats: tuple[str, ...] = DEFAULTS, out: str = "records") -> DataFrame:
    """pages with the records of all wanted formats, from one parse of each page."""
    unknown = [f for f in formats if ALIASES.get(f, f) not in FORMATS]
    if unknown:
        raise ValueError(f"unknown formats {unknown}")
    return parse_column(pages, html, lambda text: parse_page(text, formats), out, RECORD)


def records(pages: DataFrame, name: str, keys: list[str], html: str = "html") -> DataFrame:
    """A row for each record of one format: keys, pos from 0, index, fields, children."""
    found = microformats(pages.select(*keys, html), html, (name,))
    return found.select(*keys, F.posexplode("records").alias("pos", "r")).select(*keys, "pos", "r.index", "r.fields", "r.children")


#: Names of feed fields by those of records (fixed values).
FEED_FIELDS = {"hatom": {"content": "entry-content", "summary": "entry-summary", "title": "entry-title", "link": "bookmark", "published": "published"}}


def feed_items(found: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Records as items of a feed: keys, pos, title, content, summary, link, published, the name of the first author and
    categories by the titles of tags. Events and cards have their title, and their url or else place on the page as link."""
    at = lambda k: F.try_element_at("fields", F.lit(k))
    named = FEED_FIELDS.get(name, {"title": "@title", "content": "description", "link": "url"})
    columns = {k: at(named[k]) if k in named else F.lit(None).cast("string") for k in ("title", "content", "summary", "link", "published")}
    if name not in FEED_FIELDS:
        columns |= {"title": F.coalesce(at("@title"), at("fn"), at("summary")), "link": F.coalesce(at("url"), at("@uri"))}
    author = F.get(F.filter("children", lambda c: c["name"] == "author"), F.lit(0))["fields"]
    tags = F.transform(F.filter("children", lambda c: c["name"] == "tag"), lambda c: F.coalesce(F.try_element_at(c["fields"], F.lit("title")), F.try_element_at(c["fields"], F.lit("name"))))
    return found.select(*keys, "pos", *[c.alias(k) for k, c in columns.items()], F.try_element_at(author, F.lit("fn")).alias("author"), tags.alias("categories"))
