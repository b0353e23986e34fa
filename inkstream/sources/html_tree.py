"""A small HTML tree on the standard tokenizer, with text, serialisation, sanitising and checks."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements without content, elements that start a line, elements whose text is code (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript".split())
#: What an opening tag closes: the open elements of these names, up to the elements that bound them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
_P = ({"p"}, {"td", "th", "li", "table", "body", "blockquote", "div"})
#: Elements, attributes and schemes that sanitising keeps (fixed values).
SAFE_TAGS = frozenset("a abbr address article b bdi bdo blockquote br caption cite code col dd del dfn div dl dt em figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q s samp section small span strong sub sup table tbody td tfoot th thead tr tt u ul var".split())
SAFE_ATTRIBUTES = frozenset("alt cite class colspan datetime dir height href hreflang id lang rel rev rowspan scope src span title type width".split())
SAFE_SCHEMES = frozenset(("http", "https", "mailto", "ftp", "tel", ""))


@dataclass(eq=False)
class Node:
    """An element with its attributes and, in order, child elements and texts."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = field(default=None, repr=False)

    def walk(self) -> Iterator[Node]:
        """The element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def words(self, attribute: str) -> list[str]:
        value = self.attrs.get(attribute)
        return value.split() if value else []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("#document")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = CLOSES.get(tag) or (_P if tag in BLOCK else None)
        if closes:
            node = self.open
            last = None
            while node.parent is not None and node.tag not in closes[1]:
                if node.tag in closes[0]:
                    last = node
                node = node.parent
            if last is not None:
                self.open = last.parent
        node = Node(tag, {}, [], self.open)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open.tag == tag:
            self.open = self.open.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)


#: Plain markup: a start tag with quoted attributes, an end tag, or text. What else there is, the standard tokenizer reads.
_PLAIN = re.compile(r"""<([a-z][a-z0-9]*)((?:[ \n]+[a-z][a-z0-9-]*="[^"<>&]*")*)(/?)>|</([a-z][a-z0-9]*)>|([^<]+)""")
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9-]*)="([^"]*)\"""")
#: Elements whose content the tokenizer does not read as markup (fixed values).
_OPAQUE = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())


def _plain(text: str) -> Node | None:
    """The tree of a text that is plain markup throughout, by one pattern, as the tokenizer would give it; else null."""
    if not text or text[-1] != ">":
        return None
    builder, at = _Builder.__new__(_Builder), 0
    builder.root = builder.open = Node("#document")
    for m in _PLAIN.finditer(text):
        if m.start() != at:
            return None
        at = m.end()
        tag, attrs, closed, ended, data = m.groups()
        if data is not None:
            builder.open.children.append(html.unescape(data) if "&" in data else data)
        elif ended is not None:
            builder.handle_endtag(ended)
        elif tag in _OPAQUE:
            return None
        else:
            (builder.handle_startendtag if closed else builder.handle_starttag)(tag, _ATTRIBUTE.findall(attrs) if attrs else ())
    return builder.root if at == len(text) else None


def parse(text: str) -> Node:
    """The tree of a document or fragment; every text gives some tree."""
    root = _plain(text)
    if root is not None:
        return root
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


#: What a walk says of a node: text before and after it, and whether to go below.
Said = tuple[str, str, bool]


def _written(top: Node | str, say: Callable[[Node | str, Node | None], Said]) -> str:
    """What say(node, parent) gives for a node and all below it, in document order; trees may be of any depth."""
    out: list[str] = []
    todo: list[tuple[Node | str | None, Node | None, str]] = [(top, None, "")]
    while todo:
        x, parent, after = todo.pop()
        if x is None:
            out.append(after)
            continue
        before, after, below = say(x, parent)
        out.append(before)
        todo.append((None, None, after))
        if below:
            todo += [(c, x, "") for c in reversed(x.children)]
    return "".join(out)


def text_of(node: Node | str, lines: bool = False) -> str:
    """Text below a node on one line, or with lines where blocks begin and end."""

    def say(x: Node | str, _: Node | None) -> Said:
        if isinstance(x, str):
            return x, "", False
        if x.tag == "br":
            return "\n" if lines else " ", "", False
        if x.tag in RAW:
            return "", "", False
        edge = "\n" if lines and x.tag in BLOCK else ""
        return edge, edge, True

    flat = not isinstance(node, str) and node.tag != "br" and node.tag not in RAW and not lines and all(isinstance(c, str) for c in node.children)
    whole = "".join(node.children) if flat else _written(node, say)
    if not lines:
        return " ".join(whole.split())
    return "\n".join(s for s in (" ".join(x.split()) for x in whole.split("\n")) if s)


def _opened(node: Node, attrs: dict[str, str]) -> Said:
    """The tags of an element around what is below it."""
    tag = f"<{node.tag}{''.join(f' {k}="{html.escape(v)}"' for k, v in attrs.items())}>"
    return (tag, "", False) if node.tag in VOID else (tag, f"</{node.tag}>", True)


def serialize(node: Node | str, outer: bool = True) -> str:
    def say(x: Node | str, parent: Node | None) -> Said:
        if isinstance(x, str):
            return x if parent is not None and parent.tag in RAW else html.escape(x, quote=False), "", False
        if x.tag == "#document" or x is node and not outer:
            return "", "", True
        if x.tag == "#comment":
            return f"<!--{x.attrs['data']}-->", "", False
        if x.tag == "#doctype":
            return f"<!DOCTYPE {x.attrs['name']}>", "", False
        return _opened(x, x.attrs)

    return _written(node, say)


def copy(node: Node, parent: Node | None = None) -> Node:
    top = Node(node.tag, dict(node.attrs), [], parent)
    todo = [(node, top)]
    while todo:
        old, new = todo.pop()
        for c in old.children:
            if isinstance(c, Node):
                twin = Node(c.tag, dict(c.attrs), [], new)
                todo.append((c, twin))
                c = twin
            new.children.append(c)
    return top


def tokens(node: Node) -> Iterator[dict]:
    """Start, end and text tokens of a tree in order."""
    todo: list[Node | str | dict] = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, dict):
            yield c
        elif isinstance(c, str):
            yield {"type": "SpaceCharacters" if not c.strip() else "Characters", "name": "", "data": c}
        elif c.tag in VOID:
            yield {"type": "EmptyTag", "name": c.tag, "data": serialize(c)}
        else:
            yield {"type": "StartTag", "name": c.tag, "data": ""}
            todo.append({"type": "EndTag", "name": c.tag, "data": ""})
            todo += reversed(c.children)


def _safe_uri(uri: str) -> bool:
    bare = re.sub(r"[\x00-\x20\x7f]+", "", uri).lower()
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", bare)
    return (scheme[1] if scheme else "") in SAFE_SCHEMES


def safe_attributes(attrs: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in attrs.items() if k in SAFE_ATTRIBUTES and (k not in ("href", "src", "cite") or _safe_uri(v))}


def sanitize(text: str) -> str:
    """The markup with safe elements, attributes and schemes only; other elements give way to their text. The tree is
    that of the HTML standard, so what is misnested is read as browsers read it."""
    from inkstream.sources import html5

    def say(node: Node | str, _: Node | None) -> Said:
        if isinstance(node, str):
            return html.escape(node, quote=False), "", False
        if node.tag in RAW:
            return "", "", False
        if node.tag not in SAFE_TAGS:
            return "", "", True
        return _opened(node, safe_attributes(node.attrs))

    return _written(html5.parse_fragment(text), say)


def resolve_links(text: str, base: str) -> str:
    """The markup with href and src made absolute."""
    from urllib.parse import urljoin

    root = parse(text)
    for node in root.walk():
        for k in ("href", "src"):
            if k in node.attrs:
                node.attrs[k] = urljoin(base, node.attrs[k])
    return serialize(root)


def collapse(text: str) -> str:
    """The markup with white space collapsed, other than in pre and textarea."""
    root = parse(text)
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag not in {"pre", "textarea"} | RAW:
            node.children = [re.sub(r"\s+", " ", c) if isinstance(c, str) else c for c in node.children]
            todo += [c for c in node.children if isinstance(c, Node)]
    return serialize(root)


def with_charset(text: str, charset: str = "utf-8") -> str:
    """The document with a charset declaration first in its head."""
    root = parse(text)
    for node in root.walk():
        if node.tag == "meta" and ("charset" in node.attrs or node.attrs.get("http-equiv", "").lower() == "content-type"):
            if "charset" in node.attrs:
                node.attrs["charset"] = charset
            else:
                node.attrs["content"] = f"text/html; charset={charset}"
            return serialize(root)
    for node in root.walk():
        if node.tag == "head":
            node.children.insert(0, Node("meta", {"charset": charset}, [], node))
            break
    return serialize(root)


def fill_form(text: str, values: dict[str, str]) -> str:
    """The form with the given values in its inputs, text areas and selections."""
    root = parse(text)
    for node in root.walk():
        name = node.attrs.get("name")
        if node.tag == "input" and name in values:
            if node.attrs.get("type", "text") in ("checkbox", "radio"):
                node.attrs.pop("checked", None)
                if node.attrs.get("value", "on") == values[name]:
                    node.attrs["checked"] = ""
            else:
                node.attrs["value"] = values[name]
        elif node.tag == "textarea" and name in values:
            node.children = [values[name]]
        elif node.tag == "option":
            select = next((a.attrs.get("name") for a in node.ancestors() if a.tag == "select"), None)
            if select in values:
                node.attrs.pop("selected", None)
                if node.attrs.get("value", text_of(node)) == values[select]:
                    node.attrs["selected"] = ""
    return serialize(root)


def problems(text: str | Node) -> list[str]:
    """What a conformance check finds: unknown elements, repeated ids, references to no id, bad numbers and URIs."""
    root, out, ids = text if isinstance(text, Node) else parse(text), [], set()
    known = SAFE_TAGS | BLOCK | VOID | RAW | frozenset("html head body title form label select option textarea button legend iframe object video audio canvas details summary".split())
    for node in root.walk():
        if node.tag not in known and node.tag != "#document":
            out.append(f"unknown-element {node.tag}")
        if (i := node.attrs.get("id")) is not None:
            if not i or re.search(r"\s", i):
                out.append(f"invalid-id {i}")
            elif i in ids:
                out.append(f"duplicate-id {i}")
            ids.add(i)
        for k in ("colspan", "rowspan", "width", "height", "span", "tabindex"):
            if k in node.attrs and not re.fullmatch(r"-?\d+%?", node.attrs[k].strip()):
                out.append(f"invalid-integer {node.tag}@{k}")
        for k in ("href", "src"):
            if re.search(r"\s", node.attrs.get(k, "").strip()):
                out.append(f"invalid-uri {node.tag}@{k}")
        if (lang := node.attrs.get("lang")) and not re.fullmatch(r"[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*", lang):
            out.append(f"invalid-lang {lang}")
    for node in root.walk():
        if (to := node.attrs.get("for")) and to not in ids:
            out.append(f"no-such-id {to}")
    return out


def checked(text: str) -> dict:
    """Safe markup, tokens by type and name, and problems of a page; null for the one that cannot be told."""

    def told(f: Callable, *given: object) -> object:
        try:
            return f(*given)
        except Exception:  # one that fails leaves the others alone
            return None

    root = told(parse, text)
    return {"safe": told(sanitize, text), "tokens": told(lambda: [f"{x['type']} {x['name']}" for x in tokens(root)]), "problems": told(problems, root) if root is not None else None}
