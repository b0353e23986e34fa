"""XML, HTML and JSON as nested objects in JSON text: repeated elements are lists, attributes and text have @ names."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from inkstream.sources import html_tree as ht
from inkstream.sources.arrow import parse_column


def slug_key(key: str) -> str:
    """Letters, digits and colons of a key as they are, runs of all else as one underscore, none at its ends."""
    return re.sub("_+", "_", re.sub(r"[^A-Za-z0-9_:]", "_", key)).strip("_")


def slugged(value: object) -> object:
    """Keys as slugs throughout; empty texts go."""
    if isinstance(value, dict):
        return {slug_key(k): slugged(v) for k, v in value.items() if v != ""}
    return [slugged(v) for v in value] if isinstance(value, list) else value


def _add(out: dict, key: str, value: object) -> None:
    if key not in out:
        out[key] = value
    elif isinstance(out[key], list):
        out[key].append(value)
    else:
        out[key] = [out[key], value]


def xml_object(text: str, attributes: bool = True, prefix: str = "@") -> object:
    """Namespaces go; an element without children and attributes is its text; repeats become lists."""

    def convert(e: ElementTree.Element) -> object:
        out: dict = {}
        if attributes:
            for k, v in e.attrib.items():
                out[prefix + k.rsplit("}", 1)[-1]] = v
        for c in e:
            _add(out, c.tag.rsplit("}", 1)[-1], convert(c))
        own = " ".join(t for t in ((x or "").strip() for x in (e.text, *(c.tail for c in e))) if t)
        if not out:
            return own
        if own:
            out["@"] = own
        return out

    if "<!ENTITY" in text:
        raise ValueError("entity declarations are not expanded")
    root = ElementTree.fromstring(text.strip().encode())
    return {root.tag.rsplit("}", 1)[-1]: convert(root)}


def html_object(text: str) -> object:
    """As xml_object over a page's tree: own text is @, all text below @text; what is empty goes."""

    def convert(n: ht.Node) -> object:
        out: dict = {f"@{k}": v for k, v in n.attrs.items() if v}
        for c in n.children:
            if isinstance(c, ht.Node) and (v := convert(c)):
                _add(out, c.tag, v)
        own = " ".join("".join(c for c in n.children if isinstance(c, str)).split())
        if not out:
            return own
        if own:
            out["@"] = own
        if any(isinstance(c, ht.Node) for c in n.children) and (whole := ht.text_of(n, lines=True)):
            out["@text"] = whole
        return out

    return convert(ht.parse(text))


def json_object(text: str) -> object:
    """JSON, or JSON in a call of a function, with keys as slugs."""
    m = re.match(r"\s*[\w.$]+\s*\((.*)\)\s*;?\s*$", text, re.S)
    return slugged(json.loads(m[1] if m else text))


def without_hidden(value: object) -> object:
    """Without keys that begin with @@."""
    if isinstance(value, dict):
        return {k: without_hidden(v) for k, v in value.items() if not k.startswith("@@")}
    return [without_hidden(v) for v in value] if isinstance(value, list) else value


def xml_text(value: object, root: str, namespaces: dict[str, str] | None = None) -> str:
    """An object as XML: @k attributes, @ text, lists as repeats, @@ hidden, namespaces declared at the root."""

    def write(name: str, v: object) -> Iterator[str]:
        if isinstance(v, list):
            for x in v:
                yield from write(name, x)
        elif isinstance(v, dict):
            attrs = "".join(f' {k[1:]}="{_escape(str(x))}"' for k, x in v.items() if len(k) > 1 and k[0] == "@" and not k.startswith("@@"))
            inner = _escape(str(v.get("@", ""))) + "".join(p for k, x in v.items() if k[0] != "@" for p in write(k, x))
            yield f"<{name}{attrs}>{inner}</{name}>"
        elif v is not None:
            yield f"<{name}>{_escape(str(v))}</{name}>"

    whole = "".join(write(root, value))
    known = "".join(f' xmlns:{p}="{_escape(u)}"' for p, u in (namespaces or {}).items() if f"<{p}:" in whole)
    return f'<?xml version="1.0" encoding="utf-8"?>{whole.replace(f"<{root}", f"<{root}{known}", 1)}'


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def separate(value: dict, known: set[str]) -> tuple[dict, dict]:
    """Known fields, and the others."""
    return {k: v for k, v in value.items() if k in known}, {k: v for k, v in value.items() if k not in known}


READERS = {"xml": xml_object, "html": html_object, "json": json_object}


def objects(df: DataFrame, column: str, kind: str, out: str = "object") -> DataFrame:
    """df with the object as JSON text; null for what cannot be read."""
    read = READERS[kind]

    def parse(text: str) -> str | None:
        try:
            return json.dumps(read(text), ensure_ascii=False)
        except (ValueError, ElementTree.ParseError):
            return None

    return parse_column(df, column, parse, out, "string")
