"""Trees of HTML written as text, with the choices that the standard leaves open; token streams of trees checked.

Options of a document: quoting, optional tags left out, boolean attributes without values, solidus, entities, charset
declaration, white space, sanitising. xhtml() writes the same trees as XML.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from html.entities import codepoint2name

from inkstream.sources import html_tree as ht
from inkstream.sources.html5 import FORMATTING, IN_HEAD
from inkstream.sources.html_tree import Node

# Fixed values of the standard: elements without end tags, of verbatim text, of white space that counts; true-or-absent attributes.
VOID = ht.VOID | {"basefont", "bgsound", "frame", "keygen"}
VERBATIM = frozenset("iframe noembed noframes plaintext script style xmp".split())
PREFORMATTED = VERBATIM | {"pre", "textarea", "listing"}
BOOLEAN = {
    "": "hidden itemscope autofocus", "audio": "autoplay controls loop muted", "video": "autoplay controls loop muted", "button": "disabled", "details": "open", "dl": "compact", "fieldset": "disabled", "form": "novalidate", "hr": "noshade", "img": "ismap",
    "input": "checked disabled multiple readonly required", "menu": "compact", "ol": "compact reversed", "optgroup": "disabled", "option": "disabled selected", "script": "async defer", "select": "disabled multiple required", "td": "nowrap", "textarea": "disabled readonly required", "th": "nowrap", "ul": "compact",
}
#: What an end tag may be left out before: elements that follow, or None for the end of the parent.
END_BEFORE: dict[str, tuple[frozenset[str], bool]] = {
    "li": (frozenset(("li",)), True), "dt": (frozenset(("dt", "dd")), False), "dd": (frozenset(("dt", "dd")), True), "rt": (frozenset(("rt", "rp")), True), "rp": (frozenset(("rt", "rp")), True),
    "optgroup": (frozenset(("optgroup", "hr")), True), "option": (frozenset(("option", "optgroup", "hr")), True), "thead": (frozenset(("tbody", "tfoot")), False), "tbody": (frozenset(("tbody", "tfoot")), True), "tfoot": (frozenset(), True),
    "tr": (frozenset(("tr",)), True), "td": (frozenset(("td", "th")), True), "th": (frozenset(("td", "th")), True),
    "p": (frozenset("address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()), True),
}
#: Parents whose end does not end a paragraph without a tag.
NO_P_END = frozenset("a audio del ins map noscript video".split())


@dataclass(frozen=True)
class Options:
    quote_always: bool = True
    quote: str = '"'
    best_quote: bool = False
    minimize_boolean: bool = False
    omit_optional_tags: bool = False
    trailing_solidus: bool = False
    space_before_solidus: bool = True
    escape_lt: bool = False
    escape_verbatim: bool = False
    named_entities: bool = False
    charset: str = ""
    strip_space: bool = False
    sanitize: bool = False


XHTML = Options(trailing_solidus=True, escape_lt=True, escape_verbatim=True)


def _space(x: Node | str | None) -> bool:
    return isinstance(x, str) and x[:1].isspace()


def _tag(x: Node | str | None) -> str:
    return x.tag if isinstance(x, Node) else ""


def start_optional(node: Node, before: Node | str | None) -> bool:
    """Whether the start tag of an element may be left out, by its first child and by what stands before it."""
    first = node.children[0] if node.children else None
    if node.attrs:
        return False
    if node.tag == "html":
        return _tag(first) != "#comment"
    if node.tag == "head":
        return first is None or isinstance(first, Node) and first.tag != "#comment"
    if node.tag == "body":
        return first is None or not (_space(first) or _tag(first) in IN_HEAD | {"#comment", "template"})
    if node.tag == "colgroup":
        return _tag(first) == "col" and not (_tag(before) == "colgroup" and end_optional(before, node))
    if node.tag == "tbody":
        return _tag(first) == "tr" and not (_tag(before) in ("tbody", "thead", "tfoot") and end_optional(before, node))
    return False


def end_optional(node: Node, after: Node | str | None) -> bool:
    """Whether the end tag of an element may be left out, by what follows it. Not at the end of a formatting element,
    which would be opened anew."""
    if node.tag in ("html", "body"):
        return _tag(after) != "#comment"
    if node.tag in ("head", "caption", "colgroup"):
        return not _space(after) and _tag(after) != "#comment"
    followers, last = END_BEFORE.get(node.tag, (frozenset(), False))
    if after is None:
        parent = _tag(node.parent)
        return last and parent not in FORMATTING and not (node.tag == "p" and (parent in NO_P_END or "-" in parent))
    return _tag(after) in followers


def _escaped(text: str, o: Options) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if o.named_entities:
        text = re.sub(r"[^\x00-\x7f]", lambda m: f"&{codepoint2name[ord(m[0])]};" if ord(m[0]) in codepoint2name else m[0], text)
    return text


def _attribute(node: Node, key: str, value: str, o: Options) -> str:
    if o.minimize_boolean and key in f"{BOOLEAN['']} {BOOLEAN.get(node.tag, '')}".split():
        return f" {key}"
    if not o.quote_always and value and not re.search(r"""[\s"'=<>`]""", value):
        return f" {key}={value.replace('&', '&amp;')}"
    quote = o.quote
    if o.best_quote and (('"' in value) != ("'" in value)):
        quote = "'" if '"' in value else '"'
    value = value.replace("&", "&amp;").replace(quote, "&quot;" if quote == '"' else "&#39;")
    return f" {key}={quote}{value.replace('<', '&lt;') if o.escape_lt else value}{quote}"


def _declared(root: Node, charset: str) -> None:
    """A charset declaration: the one that is there is set, else one goes first into the head."""
    head = next((n for n in root.walk() if n.tag == "head"), None)
    if head is None:
        return
    for n in head.walk():
        if n.tag == "meta" and "charset" in n.attrs:
            n.attrs["charset"] = charset
            return
        if n.tag == "meta" and n.attrs.get("http-equiv", "").lower() == "content-type":
            n.attrs["content"] = f"text/html; charset={charset}"
            return
    head.children.insert(0, Node("meta", {"charset": charset}, [], head))


def write(node: Node, options: Options | None = None) -> str:
    """A tree as markup."""
    o = options or Options()
    if o.charset:
        node = ht.copy(node)
        _declared(node, o.charset)
    out: list[str] = []
    todo: list[tuple] = [(node, None, None, False)]

    def below(x: Node, kept: bool) -> None:
        children = x.children
        kept = kept or x.tag in PREFORMATTED
        for i in range(len(children) - 1, -1, -1):
            todo.append((children[i], children[i - 1] if i else None, children[i + 1] if i + 1 < len(children) else None, kept))

    while todo:
        x, before, after, kept = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            text = re.sub(r"[\t\n\f\r ]+", " ", x) if o.strip_space and not kept else x
            out.append(_escaped(text, o))
        elif x.tag == "#document":
            below(x, kept)
        elif x.tag == "#comment":
            out.append("" if o.sanitize else f"<!--{x.attrs['data']}-->")
        elif x.tag == "#doctype":
            public, system = x.attrs.get("public"), x.attrs.get("system")
            out.append(f"<!DOCTYPE {x.attrs['name']}" + (f' PUBLIC "{public}"' if public is not None else " SYSTEM" if system is not None else "") + (f' "{system}"' if system is not None else "") + ">")
        else:
            attrs = x.attrs
            if o.sanitize:
                if x.tag in ht.RAW:
                    continue
                if x.tag not in ht.SAFE_TAGS:
                    below(x, kept)
                    continue
                attrs = ht.safe_attributes(attrs)
            if not (o.omit_optional_tags and start_optional(x, before)):
                solidus = "" if not o.trailing_solidus or x.tag not in VOID else " /" if o.space_before_solidus else "/"
                out.append(f"<{x.tag}{''.join(_attribute(x, k, v, o) for k, v in attrs.items())}{solidus}>")
            if x.tag in VOID:
                continue
            if not (o.omit_optional_tags and end_optional(x, after)):
                todo.append(((f"</{x.tag}>",), None, None, False))
            if x.tag in VERBATIM and not o.escape_verbatim:
                out.extend(c for c in x.children if isinstance(c, str))
            else:
                below(x, kept)
    return "".join(out)


def xhtml(node: Node, options: Options = XHTML) -> str:
    """A tree as XML: every attribute with a quoted value, every element ended, comments without --."""
    for n in node.walk():
        if n.tag == "#comment" and ("--" in n.attrs["data"] or n.attrs["data"].endswith("-")):
            node = ht.copy(node)
            for c in node.walk():
                if c.tag == "#comment":
                    c.attrs["data"] = re.sub("-(?=-|$)", "- ", c.attrs["data"])
            break
    return write(node, replace(options, quote_always=True, minimize_boolean=False, omit_optional_tags=False, trailing_solidus=True, escape_verbatim=True))


def lint(stream: Iterable[dict]) -> list[str]:
    """What is wrong with a stream of tokens: names, tags that do not match, texts that are empty or of the wrong kind."""
    out, stack = [], []
    for t in stream:
        kind, name, data = t.get("type"), t.get("name"), t.get("data")
        if kind in ("StartTag", "EmptyTag", "EndTag") and (not isinstance(name, str) or not name):
            out.append(f"{kind} without a name")
        elif kind == "StartTag":
            if name in VOID:
                out.append(f"void element as start tag {name}")
            stack.append(name)
        elif kind == "EmptyTag":
            if name not in VOID:
                out.append(f"element as empty tag {name}")
        elif kind == "EndTag":
            if name in VOID:
                out.append(f"end tag of a void element {name}")
            elif not stack or stack.pop() != name:
                out.append(f"end tag of another element {name}")
        elif kind in ("Characters", "SpaceCharacters"):
            if not isinstance(data, str) or not data:
                out.append(f"{kind} without text")
            elif (not data.strip()) != (kind == "SpaceCharacters"):
                out.append(f"{kind} of another kind")
        elif kind not in ("Comment", "Doctype"):
            out.append(f"unknown token {kind}")
    return out + [f"element does not end {name}" for name in reversed(stack)]
