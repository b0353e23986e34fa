"""RSS, Atom, RDF and CDF feeds as one kind of record, and writers for RSS and Atom."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from functools import lru_cache
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import dates
from inkstream.functions.text import escape_html
from inkstream.sources import html_tree as ht
from inkstream.sources.arrow import parse_column

FEED = (
    "struct<version:string,bozo:boolean,title:string,link:string,subtitle:string,language:string,updated:string,"
    "entries:array<struct<id:string,title:string,link:string,summary:string,content:string,published:string,updated:string,"
    "author:string,author_email:string,contributors:array<string>,categories:array<string>,enclosures:array<string>,source:string,"
    "rights:string,license:string,comments:string,publisher:string,image:string,duration:string,explicit:boolean,block:boolean,created:string,expired:string,"
    "tags:array<struct<term:string,scheme:string,label:string>>,media:array<struct<href:string,type:string,length:long>>>>,"
    "author:string,author_email:string,rights:string,license:string,generator:string,publisher:string,image:string,icon:string,info:string,errors_to:string,ttl:int,"
    "cloud:map<string,string>,textinput:struct<title:string,link:string,name:string,description:string>,explicit:boolean,block:boolean,tags:array<struct<term:string,scheme:string,label:string>>>"
)
#: Names under which a field may stand, best first (fixed values).
NAMES = {
    "id": ("id", "guid"), "title": ("title",), "summary": ("summary", "description", "abstract", "subtitle"), "content": ("encoded", "content", "body", "fullitem"),
    "published": ("published", "pubDate", "issued", "date"), "updated": ("updated", "modified", "lastBuildDate", "lastmod", "date", "pubDate"), "subtitle": ("subtitle", "tagline", "description"),
    "language": ("language",), "author": ("author", "creator", "managingEditor", "publisher", "owner"),
    "rights": ("rights", "copyright"), "publisher": ("publisher", "webMaster"), "info": ("info",), "created": ("created",), "expired": ("expired", "expirationDate"),
}
#: The scheme of tags that podcasts name (fixed value).
PODCAST = "http://www.itunes.com/"
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


@lru_cache(4096)
def iso(value: str) -> str:
    """A feed's date in ISO 8601 UTC, from ISO, RFC 822 or day-month-year; empty if it is none."""
    value = value.strip()
    if not value:
        return ""
    try:
        found = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        try:
            found = parsedate_to_datetime(value)
        except (ValueError, TypeError, IndexError):
            m = re.search(r"(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4})", value)
            if not m or m[2].lower() not in _MONTHS:
                return ""
            try:
                found = datetime(int(m[3]), _MONTHS[m[2].lower()], int(m[1]))
            except ValueError:
                return ""
    if found.tzinfo:
        found = found.astimezone(UTC)
    return found.strftime("%Y-%m-%dT%H:%M:%SZ")


class _Element:
    """One view of strict XML and of a loose tree. What lies below is looked at once and kept."""

    __slots__ = ("node", "strict", "tag", "low", "attrs", "_kids", "_named", "_text")

    def __init__(self, node):
        self.node = node
        self.strict = not isinstance(node, ht.Node)
        self.tag = _name(node.tag)
        self.low = self.tag.lower()
        self.attrs = {_name(k): v for k, v in (node.attrib if self.strict else node.attrs).items()}
        self._kids = self._named = self._text = None

    def kids(self) -> list[_Element]:
        if self._kids is None:
            self._kids = [_Element(c) for c in (self.node if self.strict else self.node.children) if self.strict or isinstance(c, ht.Node)]
        return self._kids

    def __iter__(self):
        return iter(self.kids())

    def named(self) -> dict[str, list[_Element]]:
        """What lies directly below by its name in lower case."""
        if self._named is None:
            self._named = {}
            for c in self.kids():
                self._named.setdefault(c.low, []).append(c)
        return self._named

    def text(self) -> str:
        if self._text is None:
            self._text = self._read()
        return self._text

    def _read(self) -> str:
        if not self.strict:
            return ht.text_of(self.node)
        if not len(self.node):
            return (self.node.text or "").strip()
        if self.attrs.get("type") == "xhtml":
            whole = "".join(ElementTree.tostring(c, encoding="unicode") for c in self.node)
            return re.sub(r'(</?)ns\d+:|\sxmlns(:\w+)?="[^"]*"', lambda m: m[1] or "", whole)
        return "".join(self.node.itertext()).strip()

    def find(self, *names: str) -> str:
        named = self.named()
        for n in names:
            for c in named.get(n.lower(), ()):
                if t := c.text():
                    return t
        return ""

    def every(self, *names: str) -> list[_Element]:
        named = self.named()
        if not any(n in named for n in names):
            return []
        return [c for c in self.kids() if c.low in names]


def _person(e: _Element) -> tuple[str, str]:
    for c in e:
        if c.low in NAMES["author"] or c.tag in ("creator", "managingEditor"):
            name, mail = c.find("name"), c.find("email")
            if not name:
                m = re.match(r"\s*([^\s@]+@[^\s()]+)?\s*\(?([^()]*)\)?", c.text())
                name, mail = (m[2].strip() or m[1] or "", mail or m[1] or "") if m else ("", "")
            return name, mail
    return "", ""


def _tags(e: _Element) -> list[dict]:
    """Term, scheme and label of all tags, each once."""
    out = []
    for c in e:
        low = c.low
        if low == "category":
            podcast = "text" in c.attrs and not c.attrs.get("term")
            out.append((c.attrs.get("term") or (c.attrs["text"] if podcast else c.text()), PODCAST if podcast else c.attrs.get("scheme") or c.attrs.get("domain"), c.attrs.get("label")))
            out += [(n.attrs["text"], PODCAST, None) for n in c if "text" in n.attrs]
        elif low == "subject":
            out.append((c.text(), None, None))
        elif low == "keywords":
            out += [(w, PODCAST, None) for w in c.text().replace(",", " ").split()]
    return [{"term": t, "scheme": s, "label": n} for t, s, n in dict.fromkeys(out) if t or n]


def _image(e: _Element) -> str:
    """An image by reference, else by the address it holds."""
    return next((x for c in e.every("image") if (x := c.attrs.get("href") or c.attrs.get("resource") or c.find("url"))), "")


def _license(e: _Element) -> str:
    links = [c.attrs.get("href", "") for c in e.every("link") if c.attrs.get("rel") == "license"]
    return next((x for x in [*links, *(c.attrs.get("resource") or c.text() for c in e.every("license"))] if x), "")


def _details(e: _Element) -> dict:
    """What feeds and entries have alike."""
    said = {n: e.find(n).lower() for n in ("explicit", "block")}
    return {"rights": e.find(*NAMES["rights"]), "license": _license(e), "publisher": e.find(*NAMES["publisher"]), "image": _image(e), "tags": _tags(e)} | {n: v == "yes" if v else None for n, v in said.items()}


def _about(head: _Element) -> dict:
    """What feeds have alone, besides title, link and language."""
    name, mail = _person(head)
    cloud = next((c.attrs for c in head.every("cloud")), None)
    asked = next((c for c in head.every("textinput")), None)
    ttl = head.find("ttl")
    return _details(head) | {
        "author": name, "author_email": mail, "generator": head.find("generator") or next((c.attrs.get("resource", "") for c in head.every("generatoragent")), ""), "icon": head.find("icon", "logo"), "info": head.find(*NAMES["info"]),
        "errors_to": next((c.attrs.get("resource") or c.text() for c in head.every("errorreportsto")), ""), "ttl": int(ttl) if ttl.isdecimal() and len(ttl) < 10 else None, "cloud": dict(cloud) if cloud is not None else None,
        "textinput": {n: asked.find(n) for n in ("title", "link", "name", "description")} if asked is not None else None,
    }


def _media(e: _Element) -> list[dict]:
    found = [(c, c.attrs.get("url", "")) for c in e.every("enclosure")] + [(c, c.attrs.get("href", "")) for c in e.every("link") if c.attrs.get("rel") == "enclosure"]
    size = lambda c: int(n) if (n := c.attrs.get("length", "")).isdecimal() and len(n) < 19 else None
    return [{"href": href, "type": c.attrs.get("type"), "length": size(c)} for c, href in found]


def _link(e: _Element) -> str:
    links = e.every("link", "logo" if e.tag.lower() == "channel" and "href" in e.attrs else "link")
    best = [x for x in links if x.attrs.get("rel", "alternate") == "alternate"]
    for x in best:
        if x.attrs.get("href"):
            return x.attrs["href"]
        if x.text():
            return x.text()
    guid = next((c for c in e.every("guid") if c.attrs.get("ispermalink", c.attrs.get("isPermaLink", "true")) != "false"), None)
    return e.attrs.get("href", "") or e.attrs.get("about", "") or (guid.text() if guid else "")


def _entry(e: _Element) -> dict:
    name, mail = _person(e)
    tags = [c.attrs.get("term") or c.attrs.get("label") or c.text() for c in e.every("category", "subject")] + [w.strip() for c in e.every("keywords") for w in c.text().split(",")]
    summary, content = e.find(*NAMES["summary"]), e.find(*NAMES["content"])
    link = _link(e)
    published, updated = iso(e.find(*NAMES["published"])), iso(e.find(*NAMES["updated"]))
    return _details(e) | {
        "comments": e.find("comments"), "duration": e.find("duration"), "created": iso(e.find(*NAMES["created"])), "expired": iso(e.find(*NAMES["expired"])), "media": _media(e),
        "id": e.find(*NAMES["id"]) or link, "title": e.find(*NAMES["title"]), "link": link, "summary": summary or content, "content": content or summary,
        "published": published or updated, "updated": updated or published, "author": name, "author_email": mail,
        "contributors": [c.find("name") or c.text() for c in e.every("contributor")], "categories": list(dict.fromkeys(t for t in tags if t)),
        "enclosures": [c.attrs.get("url", "") for c in e.every("enclosure")] + [c.attrs.get("href", "") for c in e.every("link") if c.attrs.get("rel") == "enclosure"],
        "source": next((c.find("title") or c.text() for c in e.every("source")), ""),
    }


def _version(root: _Element) -> str:
    low = root.tag.lower()
    if low == "rss":
        return "rss" + root.attrs.get("version", "").replace(".", "")
    if low == "rdf":
        return "rss090" if "netscape.com/rdf/simple/0.9" in str(getattr(next(iter(root.node), None), "tag", "")) else "rss10"
    if low == "feed":
        return {"0.1": "atom01", "0.2": "atom02", "0.3": "atom03"}.get(root.attrs.get("version", ""), "atom10")
    return "cdf" if low == "channel" else ""


def parse_feed(text: str) -> dict:
    """A feed's record. What is no well-formed XML is read loosely, with bozo true."""
    bozo = False
    try:
        if "<!ENTITY" in text:
            raise ElementTree.ParseError("entity declarations are not expanded")
        root = _Element(ElementTree.fromstring(text.strip().encode()))
    except ElementTree.ParseError:
        bozo = True
        loose = ht.parse(re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: m[1].replace("&", "&amp;").replace("<", "&lt;"), re.sub(r"<(/?)link>", r"<\1x-link>", text), flags=re.S))
        for n in loose.walk():
            n.tag = "link" if n.tag == "x-link" else n.tag.rsplit(":", 1)[-1]
        root = _Element(next((n for n in loose.walk() if n.tag in ("rss", "rdf", "feed", "channel")), loose))
    head = next((c for c in root if c.low == "channel"), root)
    items = [c for part in ([head, root] if head.node is not root.node else [root]) for c in part if c.low in ("item", "entry")]
    return _about(head) | {
        "version": _version(root), "bozo": bozo, "title": head.find("title") or head.attrs.get("title", ""), "link": _link(head), "subtitle": head.find(*NAMES["subtitle"]),
        "language": head.find("language") or root.attrs.get("lang", ""), "updated": iso(head.find(*NAMES["updated"])), "entries": [_entry(i) for i in items],
    }


def feeds(df: DataFrame, xml: str, out: str = "feed") -> DataFrame:
    return parse_column(df, xml, parse_feed, out, FEED)


def entries(df: DataFrame, xml: str, keys: list[str]) -> DataFrame:
    """A row for each entry: keys, pos, then the entry's fields."""
    return feeds(df.select(*keys, xml), xml).select(*keys, F.posexplode("feed.entries").alias("pos", "e")).select(*keys, "pos", "e.*")


def _tag(name: str, value: Column) -> Column:
    """<name>escaped</name>, or nothing for null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), escape_html(value), F.lit(f"</{name}>")))


def _document(df: DataFrame, keys: list[str], order: str, item: Column, head: Column, before: str, after: str, out: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))))
    body = df.groupBy(*keys).agg(F.min(head).alias("_head"), F.array_join(F.transform(listed, lambda e: e["x"]), "").alias("_items"))
    return body.select(*keys, F.concat(F.lit(before), "_head", "_items", F.lit(after)).alias(out))


def write_rss(items: DataFrame, keys: list[str], order: str, channel: Column, fields: dict[str, Column], out: str = "rss") -> DataFrame:
    """An RSS 2.0 document for each key: channel title, and items with title, link, description, pubDate and more."""
    parts = [_tag(k, dates.rfc822(v) if k == "pubDate" else v) for k, v in fields.items()]
    item = F.concat(F.lit("<item>"), F.concat_ws("", *parts), F.lit("</item>"))
    return _document(items, keys, order, item, _tag("title", channel), '<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel>', "</channel></rss>", out)


def write_atom(items: DataFrame, keys: list[str], order: str, title: Column, fields: dict[str, Column], out: str = "atom") -> DataFrame:
    """An Atom 1.0 document for each key; link becomes an href, author a person, updated a UTC time."""
    parts = []
    for k, v in fields.items():
        if k == "link":
            parts.append(F.concat(F.lit('<link rel="alternate" href="'), escape_html(v), F.lit('"/>')))
        elif k == "author":
            parts.append(F.concat(F.lit("<author>"), _tag("name", v), F.lit("</author>")))
        else:
            parts.append(_tag(k, F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss'Z'") if k in ("updated", "published") else v))
    item = F.concat(F.lit("<entry>"), F.concat_ws("", *parts), F.lit("</entry>"))
    return _document(items, keys, order, item, _tag("title", title), '<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom">', "</feed>", out)


def write_opml(nodes: DataFrame, keys: list[str], order: str, title: Column, fields: dict[str, Column], out: str = "opml") -> DataFrame:
    """An OPML document for each key, with a flat list of outlines."""
    attributes = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escape_html(v), F.lit('"'))) for k, v in fields.items()]
    item = F.concat(F.lit("<outline"), F.concat_ws("", *attributes), F.lit("/>"))
    head = F.concat(F.lit("<head>"), _tag("title", title), F.lit("</head><body>"))
    return _document(nodes, keys, order, item, head, '<?xml version="1.0" encoding="utf-8"?><opml version="2.0">', "</body></opml>", out)
