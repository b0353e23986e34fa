"""HTML documents and fragments as trees, by the tokenizer and the tree construction of the HTML standard.

parse and parse_fragment take any text: every text gives a tree. Elements are html_tree.Node; comments and doctypes are
nodes #comment and #doctype. Scripting is off, and template is an ordinary element. Work grows with the length of the
text and with the depth at which tags are misnested; nothing recurses over the tree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5 as ENTITIES

from inkstream.sources.html_tree import Node

# Fixed values of the standard: names by what tree construction makes of them.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
ENDS_BLOCK = CLOSES_P - {"p"} | {"button", "listing", "pre"}
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style title".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
SPECIAL = CLOSES_P - {"dialog"} | HEADINGS | IN_HEAD | TABLE_PARTS | frozenset(
    "applet area body br button dd dt embed form frame frameset head hr html iframe img input keygen li listing marquee noembed noscript object param plaintext pre select source table textarea track wbr xmp".split()
)
SCOPE = frozenset("applet caption html marquee object table td th".split())
BUTTON_SCOPE, LIST_SCOPE, TABLE_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}, frozenset(("html", "table"))
FOREIGN_SCOPE = frozenset(("math mi", "math mo", "math mn", "math ms", "math mtext", "math annotation-xml", "svg foreignObject", "svg desc", "svg title"))
LEAVES_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SVG_TAGS = "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath".split()
SVG_ATTRIBUTES = "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan".split()
OLD_DOCTYPES = ("-//w3c//dtd html 3", "-//w3c//dtd html 4.0 transitional//", "-//w3c//dtd html 4.0 frameset//", "-//ietf//dtd html", "-//netscape comm. corp.//dtd", "-//microsoft//dtd internet explorer")
RCDATA, RAWTEXT = frozenset(("title", "textarea")), frozenset("style xmp iframe noembed noframes".split())

_SVG_TAG, _SVG_ATTRIBUTE = ({x.lower(): x for x in names} for names in (SVG_TAGS, SVG_ATTRIBUTES))
_WS = "\t\n\f "
_MARKUP = re.compile(r"<(?=[A-Za-z!?]|/.)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\t\n\f />]*)")
_GAP = re.compile(r"[\t\n\f /]*")
_KEY = re.compile(r"[^\t\n\f />][^\t\n\f />=]*")
_EQUALS = re.compile(r"[\t\n\f ]*=[\t\n\f ]*")
_BARE = re.compile(r"[^\t\n\f >]*")
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.I)
_DOCTYPE = re.compile(r"""[\t\n\f ]*([^\t\n\f >]*)[\t\n\f ]*(?:(public)[\t\n\f ]*(?:"([^">]*)"|'([^'>]*)')|(system))?[\t\n\f ]*(?:"([^">]*)"|'([^'>]*)')?""", re.I)
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")


def _lower(name: str) -> str:
    return name.lower() if name.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), name)


def _attribute(value: str) -> str:
    """Character references of an attribute: a name without a semicolon counts only where no letter, digit or = follows."""

    def one(m: re.Match) -> str:
        whole = m[0][: len(m[0]) - len(m[1])]
        if whole[1] == "#" or whole[1:] in ENTITIES and (whole[-1] == ";" or not m[1]):
            return unescape(whole) + m[1]
        return m[0]

    return _REFERENCE.sub(one, value) if "&" in value else value


@dataclass(slots=True)
class Token:
    """A piece of the text: start, end, chars, space, comment, doctype or eof."""

    kind: str
    name: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    closed: bool = False
    data: str = ""


class Tokens:
    """The tokens of a text. `model` is set by tree construction: how to read what follows a start tag."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.at, self.model, self.cdata = 0, "", False

    def __iter__(self) -> Iterator[Token]:
        text, n = self.text, len(self.text)
        while self.at < n:
            start = self.at
            if self.model:
                model, self.model = self.model, ""
                end = n if model == "plaintext" else self._script_end() if model == "script" else self._end_of(model)
                if end > start:
                    self.at = end
                    raw = text[start:end].replace("\0", "�")
                    yield Token("chars", data=unescape(raw) if model in RCDATA else raw)
                    continue
            m = _MARKUP.search(text, start)
            if m is None or m.start() > start:
                self.at = m.start() if m else n
                data = text[start : self.at]
                yield Token("chars", data=unescape(data) if "&" in data else data)
                continue
            yield from self._markup(start)
        yield Token("eof")

    def _end_of(self, tag: str) -> int:
        m = re.compile(rf"</{tag}(?=[\t\n\f />])", re.I).search(self.text, self.at)
        return m.start() if m else len(self.text)

    def _script_end(self) -> int:
        """Where a script ends: an end tag does not count after <!-- and <script, up to its own end tag or -->."""
        state, at = 0, self.at
        while m := _SCRIPT.search(self.text, at):
            at = m.end()
            if m[0] == "<!--":
                if state == 0:
                    state, at = 1, at - 2
            elif m[0] == "-->":
                state = 0
            elif not m[1]:
                state = 2 if state == 1 else state
            elif state == 2:
                state = 1
            else:
                return m.start()
        return len(self.text)

    def _comment(self, start: int, end: str = ">") -> Token:
        stop = self.text.find(end, start)
        self.at = len(self.text) if stop < 0 else stop + len(end)
        return Token("comment", data=self.text[start : stop if stop >= 0 else len(self.text)].replace("\0", "�"))

    def _markup(self, start: int) -> Iterator[Token]:
        text = self.text
        if m := _TAG.match(text, start):
            if (token := self._tag(m)) is not None:
                yield token
        elif text.startswith("</", start):
            if text.startswith("</>", start):
                self.at = start + 3
            else:
                yield self._comment(start + 2)
        elif text.startswith("<!--", start):
            if m := re.compile("-?>").match(text, start + 4):
                self.at = m.end()
                yield Token("comment")
            else:
                m = re.compile("--!?>").search(text, start + 4)
                self.at = m.end() if m else len(text)
                data = text[start + 4 : m.start()] if m else re.sub("--?!?$", "", text[start + 4 :])
                yield Token("comment", data=data.replace("\0", "�"))
        elif text[start : start + 9].lower() == "<!doctype":
            m = _DOCTYPE.match(text, start + 9)
            stop = text.find(">", m.end())
            self.at = len(text) if stop < 0 else stop + 1
            public, system = m[3] if m[3] is not None else m[4], m[6] if m[6] is not None else m[7]
            yield Token("doctype", _lower(m[1]), {k: v for k, v in (("public", public), ("system", system)) if v is not None}, closed=stop >= 0)
        elif self.cdata and text.startswith("<![CDATA[", start):
            yield Token("chars", data=self._comment(start + 9, "]]>").data)
        else:
            yield self._comment(start + (2 if text[start + 1] == "!" else 1))

    def _tag(self, m: re.Match) -> Token | None:
        """The tag, or nothing if the text ends within it."""
        text, n, attrs, at = self.text, len(self.text), {}, m.end()
        while True:
            gap = _GAP.match(text, at)
            at = gap.end()
            if at >= n:
                self.at = n
                return None
            if text[at] == ">":
                self.at = at + 1
                return Token("end" if m[1] else "start", _lower(m[2]).replace("\0", "�"), attrs, gap[0].endswith("/"))
            key = _KEY.match(text, at)
            at, value = key.end(), ""
            if eq := _EQUALS.match(text, at):
                at = eq.end()
                quote = text[at : at + 1]
                if quote in ('"', "'") and quote:
                    stop = text.find(quote, at + 1)
                    if stop < 0:
                        self.at = n
                        return None
                    value, at = text[at + 1 : stop], stop + 1
                else:
                    bare = _BARE.match(text, at)
                    value, at = bare[0], bare.end()
            attrs.setdefault(_lower(key[0].replace("\0", "�")), _attribute(value).replace("\0", "�"))


Mode = Callable[[Token], None]


class Construction:
    """The tree of a text, token by token; each insertion mode of the standard is a method of its name."""

    def __init__(self, text: str, container: str = ""):
        self.tokens, self.document = Tokens(text), Node("#document")
        self.open: list[Node] = []
        self.names: Counter = Counter()
        self.formatting: list[Node | None] = []
        self.head: Node | None = None
        self.form: Node | None = None
        self.spaces: dict[Node, str] = {}
        self.mode: Mode = self.initial
        self.after_text: Mode = self.in_body
        self.frames_ok, self.foster, self.quirks, self.skip_line = True, False, False, False
        self.pending: list[str] = []
        self.container = container
        if container:
            self._push(self._append(Node("html"), self.document))
            self.tokens.model = container if container in RCDATA | RAWTEXT | {"script", "plaintext"} else ""
            self._reset_mode()

    def run(self) -> Node:
        for token in self.tokens:
            if token.kind == "chars":
                data = token.data
                if self.skip_line and data.startswith("\n"):
                    data = data[1:]
                self.skip_line = False
                rest = data.lstrip(_WS)
                if len(rest) < len(data):
                    self.process(Token("space", data=data[: len(data) - len(rest)]))
                if rest:
                    self.process(Token("chars", data=rest))
            else:
                self.skip_line = False
                self.process(token)
            self.tokens.cdata = bool(self.open and self.spaces.get(self.open[-1]))
        return self.document

    # Stack and tree

    def _push(self, node: Node) -> Node:
        self.open.append(node)
        self.names[node.tag] += 1
        return node

    def _pop(self) -> Node:
        node = self.open.pop()
        self.names[node.tag] -= 1
        return node

    def _drop(self, node: Node) -> None:
        """Takes an element out of the stack, wherever it stands."""
        self.open.remove(node)
        self.names[node.tag] -= 1

    def _pop_to(self, *names: str) -> None:
        while self._pop().tag not in names:
            pass

    def _pop_to_node(self, node: Node) -> None:
        while self._pop() is not node:
            pass

    @staticmethod
    def _append(node: Node, parent: Node) -> Node:
        node.parent = parent
        parent.children.append(node)
        return node

    @staticmethod
    def _detach(node: Node) -> None:
        if node.parent is not None:
            node.parent.children.remove(node)
            node.parent = None

    def _place(self, target: Node | None = None) -> tuple[Node, int]:
        """Where the next node goes: into the current element, or in front of a table that it may not stand in."""
        target = target or self.open[-1]
        if self.foster and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == "table"), None)
            if at is None:
                return self.open[0], len(self.open[0].children)
            table = self.open[at]
            if table.parent is not None:
                return table.parent, table.parent.children.index(table)
            target = self.open[at - 1]
        return target, len(target.children)

    def _put(self, node: Node, target: Node | None = None) -> Node:
        parent, at = self._place(target)
        node.parent = parent
        parent.children.insert(at, node)
        return node

    def _insert(self, t: Token) -> Node:
        return self._push(self._put(Node(t.name, t.attrs)))

    def _insert_void(self, t: Token) -> None:
        self._insert(t)
        self._pop()

    def _text(self, data: str) -> None:
        data = data.replace("\0", "")
        parent, at = self._place()
        if at and isinstance(parent.children[at - 1], str):
            parent.children[at - 1] += data
        elif data:
            parent.children.insert(at, data)

    def _comment(self, t: Token, parent: Node | None = None) -> None:
        node = Node("#comment", {"data": t.data})
        self._append(node, parent) if parent is not None else self._put(node)

    def _merge(self, node: Node, t: Token) -> None:
        for k, v in t.attrs.items():
            node.attrs.setdefault(k, v)

    def _kind(self, node: Node) -> str:
        """The name of an element, with its vocabulary if that is not HTML."""
        space = self.spaces.get(node)
        return f"{space} {node.tag}" if space else node.tag

    def _has(self, names: frozenset[str] | set[str], bounds: frozenset[str] = SCOPE) -> bool:
        if not any(self.names[x] for x in names):
            return False
        for node in reversed(self.open):
            kind = self._kind(node)
            if kind in names:
                return True
            if kind in bounds or bounds is not TABLE_SCOPE and kind in FOREIGN_SCOPE:
                return False
        return False

    def _imply(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED and self.open[-1].tag != but:
            self._pop()

    def _close_p(self) -> None:
        if self._has({"p"}, BUTTON_SCOPE):
            self._imply("p")
            self._pop_to("p")

    def _back_to(self, *names: str) -> None:
        while self.open[-1].tag not in names and self.open[-1].tag != "html":
            self._pop()

    # Active formatting elements

    def _since_marker(self) -> list[Node]:
        at = next((i for i in range(len(self.formatting) - 1, -1, -1) if self.formatting[i] is None), -1)
        return self.formatting[at + 1 :]

    def _format(self, node: Node) -> None:
        """Lists a formatting element; of equal ones three at most are kept."""
        same = [x for x in self._since_marker() if x.tag == node.tag and x.attrs == node.attrs]
        if len(same) >= 3:
            self.formatting.remove(same[0])
        self.formatting.append(node)

    def _reconstruct(self) -> None:
        if not self.formatting or self.formatting[-1] is None:
            return
        standing = set(self.open)
        at = len(self.formatting)
        while at and self.formatting[at - 1] is not None and self.formatting[at - 1] not in standing:
            at -= 1
        for i in range(at, len(self.formatting)):
            old = self.formatting[i]
            self.formatting[i] = self._insert(Token("start", old.tag, dict(old.attrs)))

    def _clear_to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def _adopt(self, name: str) -> None:
        """The adoption agency: ends a formatting element that other elements have opened within."""
        if self.open[-1].tag == name and self.open[-1] not in self.formatting:
            self._pop()
            return
        for _ in range(8):
            entry = next((x for x in reversed(self._since_marker()) if x.tag == name), None)
            if entry is None:
                return self._other_end(name)
            if entry not in self.open:
                self.formatting.remove(entry)
                return None
            at = self.open.index(entry)
            if any(self._kind(x) in SCOPE | FOREIGN_SCOPE for x in self.open[at + 1 :]):
                return None
            furthest = next((x for x in self.open[at + 1 :] if self._special(x)), None)
            if furthest is None:
                self._pop_to_node(entry)
                self.formatting.remove(entry)
                return None
            above, mark = self.open[at - 1], self.formatting.index(entry)
            last, i, inner = furthest, self.open.index(furthest), 0
            while (node := self.open[i := i - 1]) is not entry:
                inner += 1
                if inner > 3 and node in self.formatting:
                    mark -= self.formatting.index(node) < mark
                    self.formatting.remove(node)
                if node not in self.formatting:
                    self._drop(node)
                    continue
                twin = Node(node.tag, dict(node.attrs))
                self.formatting[self.formatting.index(node)] = self.open[i] = twin
                if last is furthest:
                    mark = self.formatting.index(twin) + 1
                self._detach(last)
                last = self._append(last, twin).parent
            self._detach(last)
            foster, self.foster = self.foster, True
            self._put(last, above)
            self.foster = foster
            twin = Node(entry.tag, dict(entry.attrs), furthest.children)
            for c in twin.children:
                if isinstance(c, Node):
                    c.parent = twin
            furthest.children = []
            self._append(twin, furthest)
            mark -= self.formatting.index(entry) < mark
            self.formatting.remove(entry)
            self.formatting.insert(mark, twin)
            self._drop(entry)
            self.open.insert(self.open.index(furthest) + 1, twin)
            self.names[twin.tag] += 1
        return None

    def _special(self, node: Node) -> bool:
        kind = self._kind(node)
        return kind in SPECIAL or kind in FOREIGN_SCOPE

    def _other_end(self, name: str) -> None:
        if not self.names[name]:
            return
        for node in reversed(self.open):
            if self._kind(node) == name:
                self._imply(name)
                self._pop_to_node(node)
                return
            if self._special(node):
                return

    # Dispatch

    def process(self, t: Token) -> None:
        if t.kind != "eof" and self.open and (space := self.spaces.get(self.open[-1])):
            kind = self._kind(self.open[-1])
            text = kind in ("math mi", "math mo", "math mn", "math ms", "math mtext") and (t.kind in ("chars", "space") or t.kind == "start" and t.name not in ("mglyph", "malignmark"))
            inside = self._html_inside(self.open[-1]) and t.kind in ("start", "chars", "space")
            if not (text or inside or kind == "math annotation-xml" and t.kind == "start" and t.name == "svg"):
                self.foreign(t, space)
                return
        self.mode(t)

    def _again(self, t: Token, mode: Mode) -> None:
        self.mode = mode
        self.process(t)

    def _html_inside(self, node: Node) -> bool:
        kind = self._kind(node)
        return kind in ("svg foreignObject", "svg desc", "svg title") or kind == "math annotation-xml" and node.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")

    def foreign(self, t: Token, space: str) -> None:
        if t.kind in ("chars", "space"):
            self._text(t.data.replace("\0", "�"))
            self.frames_ok = self.frames_ok and t.kind == "space"
        elif t.kind == "comment":
            self._comment(t)
        elif t.name in LEAVES_FOREIGN and t.kind == "start" or t.name in ("br", "p") and t.kind == "end" or t.name == "font" and t.kind == "start" and {"color", "face", "size"} & t.attrs.keys():
            while self.spaces.get(self.open[-1]) and not self._html_inside(self.open[-1]) and self._kind(self.open[-1]) not in ("math mi", "math mo", "math mn", "math ms", "math mtext"):
                self._pop()
            self.mode(t)
        elif t.kind == "start":
            self._insert_foreign(t, space)
        elif t.kind == "end":
            for node in reversed(self.open):
                if not self.spaces.get(node):
                    self.mode(t)
                    return
                if node.tag.lower() == t.name:
                    self._pop_to_node(node)
                    return

    def _insert_foreign(self, t: Token, space: str) -> None:
        if space == "svg":
            t.name = _SVG_TAG.get(t.name, t.name)
            t.attrs = {_SVG_ATTRIBUTE.get(k, k): v for k, v in t.attrs.items()}
        elif "definitionurl" in t.attrs:
            t.attrs = {"definitionURL" if k == "definitionurl" else k: v for k, v in t.attrs.items()}
        self.spaces[self._insert(t)] = space
        if t.closed:
            self._pop()

    def _raw(self, t: Token, model: str) -> None:
        self._insert(t)
        self.tokens.model, self.after_text, self.mode = model, self.mode, self.text

    def _reset_mode(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            name = self.container if i == 0 and self.container else self.open[i].tag
            if name == "select":
                self.mode = self.in_select_in_table if any(x.tag == "table" for x in self.open[:i]) else self.in_select
                return
            if name in ("td", "th") and i:
                self.mode = self.in_cell
                return
            found = {"tr": self.in_row, "tbody": self.in_table_body, "thead": self.in_table_body, "tfoot": self.in_table_body, "caption": self.in_caption, "colgroup": self.in_column_group, "table": self.in_table, "body": self.in_body, "frameset": self.in_frameset}.get(name)
            if name == "head" and i:
                found = self.in_head
            if name == "html":
                found = self.before_head if self.head is None else self.after_head
            if found or i == 0:
                self.mode = found or self.in_body
                return

    # Insertion modes

    def initial(self, t: Token) -> None:
        if t.kind == "comment":
            self._comment(t, self.document)
        elif t.kind == "doctype":
            self._append(Node("#doctype", {"name": t.name, **t.attrs}), self.document)
            public, system = t.attrs.get("public", "").lower(), t.attrs.get("system")
            self.quirks = t.name != "html" or not t.closed or public.startswith(OLD_DOCTYPES) or system is None and public.startswith(("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//"))
            self.mode = self.before_html
        elif t.kind != "space":
            self.quirks = True
            self._again(t, self.before_html)

    def before_html(self, t: Token) -> None:
        if t.kind == "comment":
            self._comment(t, self.document)
        elif t.kind == "start" and t.name == "html":
            self._push(self._append(Node("html", t.attrs), self.document))
            self.mode = self.before_head
        elif t.kind not in ("space", "doctype") and (t.kind != "end" or t.name in ("head", "body", "html", "br")):
            self._push(self._append(Node("html"), self.document))
            self._again(t, self.before_head)

    def before_head(self, t: Token) -> None:
        if t.kind == "comment":
            self._comment(t)
        elif t.kind == "start" and t.name == "html":
            self.in_body(t)
        elif t.kind == "start" and t.name == "head":
            self.head = self._insert(t)
            self.mode = self.in_head
        elif t.kind not in ("space", "doctype") and (t.kind != "end" or t.name in ("head", "body", "html", "br")):
            self.head = self._insert(Token("start", "head"))
            self._again(t, self.in_head)

    def in_head(self, t: Token) -> None:
        if t.kind == "space":
            self._text(t.data)
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "start" and t.name == "html":
            self.in_body(t)
        elif t.kind == "start" and t.name in ("base", "basefont", "bgsound", "link", "meta"):
            self._insert_void(t)
        elif t.kind == "start" and t.name in ("title", "script", "style", "noframes"):
            self._raw(t, t.name)
        elif t.kind == "start" and t.name == "noscript":
            self._insert(t)
            self.mode = self.in_head_noscript
        elif t.kind == "end" and t.name == "head":
            self._pop()
            self.mode = self.after_head
        elif t.kind != "doctype" and not (t.kind == "start" and t.name == "head") and (t.kind != "end" or t.name in ("body", "html", "br")):
            self._pop()
            self._again(t, self.after_head)

    def in_head_noscript(self, t: Token) -> None:
        if t.kind == "end" and t.name == "noscript":
            self._pop()
            self.mode = self.in_head
        elif t.kind in ("space", "comment") or t.kind == "start" and t.name in IN_HEAD - {"base", "script", "title"}:
            self.in_head(t)
        elif t.kind == "start" and t.name == "html":
            self.in_body(t)
        elif t.kind != "doctype" and not (t.kind == "start" and t.name in ("head", "noscript")) and (t.kind != "end" or t.name == "br"):
            self._pop()
            self._again(t, self.in_head)

    def after_head(self, t: Token) -> None:
        if t.kind == "space":
            self._text(t.data)
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "start" and t.name == "html":
            self.in_body(t)
        elif t.kind == "start" and t.name in ("body", "frameset"):
            self._insert(t)
            self.frames_ok = self.frames_ok and t.name != "body"
            self.mode = self.in_body if t.name == "body" else self.in_frameset
        elif t.kind == "start" and t.name in IN_HEAD:
            self._push(self.head)
            self.in_head(t)
            self._drop(self.head)
        elif t.kind != "doctype" and not (t.kind == "start" and t.name == "head") and (t.kind != "end" or t.name in ("body", "html", "br")):
            self._insert(Token("start", "body"))
            self._again(t, self.in_body)

    def in_body(self, t: Token) -> None:
        if t.kind in ("chars", "space"):
            if t.data.strip("\0"):
                self._reconstruct()
                self._text(t.data)
                self.frames_ok = self.frames_ok and t.kind == "space"
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "start":
            self._start(t)
        elif t.kind == "end":
            self._end(t)

    def _start(self, t: Token) -> None:
        name = t.name
        if name in CLOSES_P:
            self._close_p()
            self._insert(t)
        elif name in FORMATTING:
            if name == "a" and (old := next((x for x in reversed(self._since_marker()) if x.tag == "a"), None)) is not None:
                self._adopt("a")
                if old in self.formatting:
                    self.formatting.remove(old)
                if old in self.open:
                    self._drop(old)
            self._reconstruct()
            if name == "nobr" and self._has({"nobr"}):
                self._adopt("nobr")
                self._reconstruct()
            self._format(self._insert(t))
        elif name in ("area", "br", "embed", "img", "image", "keygen", "wbr", "input"):
            t.name = "img" if name == "image" else name
            self._reconstruct()
            self._insert_void(t)
            self.frames_ok = self.frames_ok and name == "input" and t.attrs.get("type", "").lower() == "hidden"
        elif name in HEADINGS:
            self._close_p()
            if self.open[-1].tag in HEADINGS:
                self._pop()
            self._insert(t)
        elif name in ("li", "dd", "dt"):
            self.frames_ok = False
            same = {"li"} if name == "li" else {"dd", "dt"}
            if any(self.names[x] for x in same):
                for node in reversed(self.open):
                    if node.tag in same:
                        self._imply(node.tag)
                        self._pop_to(node.tag)
                        break
                    if self._special(node) and node.tag not in ("address", "div", "p"):
                        break
            self._close_p()
            self._insert(t)
        elif name in IN_HEAD:
            self.in_head(t)
        elif name == "html":
            self._merge(self.open[0], t)
        elif name in ("body", "frameset"):
            body = self.open[1] if len(self.open) > 1 and self.open[1].tag == "body" else None
            if body is None:
                return
            if name == "body":
                self.frames_ok = False
                self._merge(body, t)
            elif self.frames_ok:
                self._detach(body)
                while len(self.open) > 1:
                    self._pop()
                self._insert(t)
                self.mode = self.in_frameset
        elif name in ("pre", "listing"):
            self._close_p()
            self._insert(t)
            self.skip_line, self.frames_ok = True, False
        elif name == "form":
            if self.form is None:
                self._close_p()
                self.form = self._insert(t)
        elif name == "plaintext":
            self._close_p()
            self._insert(t)
            self.tokens.model = "plaintext"
        elif name == "button":
            if self._has({"button"}):
                self._imply()
                self._pop_to("button")
            self._reconstruct()
            self._insert(t)
            self.frames_ok = False
        elif name in ("applet", "marquee", "object"):
            self._reconstruct()
            self._insert(t)
            self.formatting.append(None)
            self.frames_ok = False
        elif name == "table":
            if not self.quirks:
                self._close_p()
            self._insert(t)
            self.frames_ok = False
            self.mode = self.in_table
        elif name in ("param", "source", "track"):
            self._insert_void(t)
        elif name == "hr":
            self._close_p()
            self._insert_void(t)
            self.frames_ok = False
        elif name in ("textarea", "xmp", "iframe", "noembed"):
            if name == "xmp":
                self._close_p()
                self._reconstruct()
            self.frames_ok = self.frames_ok and name == "noembed"
            self._raw(t, name)
            self.skip_line = name == "textarea"
        elif name == "select":
            self._reconstruct()
            self._insert(t)
            self.frames_ok = False
            self.mode = self.in_select_in_table if self.mode in (self.in_table, self.in_caption, self.in_table_body, self.in_row, self.in_cell) else self.in_select
        elif name in ("optgroup", "option"):
            if self.open[-1].tag == "option":
                self._pop()
            self._reconstruct()
            self._insert(t)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self._has({"ruby"}):
                self._imply("rtc" if name in ("rp", "rt") else "")
            self._insert(t)
        elif name in ("math", "svg"):
            self._reconstruct()
            self._insert_foreign(t, name)
        elif name not in TABLE_PARTS and name not in ("frame", "head"):
            self._reconstruct()
            self._insert(t)

    def _end(self, t: Token) -> None:
        name = t.name
        if name in FORMATTING:
            self._adopt(name)
        elif name == "p":
            if not self._has({"p"}, BUTTON_SCOPE):
                self._insert(Token("start", "p"))
            self._close_p()
        elif name in ENDS_BLOCK or name in ("dd", "dt", "li"):
            if self._has({name}, LIST_SCOPE if name == "li" else SCOPE):
                self._imply(name if name in ("dd", "dt", "li") else "")
                self._pop_to(name)
        elif name in HEADINGS:
            if self._has(HEADINGS):
                self._imply()
                self._pop_to(*HEADINGS)
        elif name in ("body", "html"):
            if self._has({"body"}):
                self.mode = self.after_body
                if name == "html":
                    self.process(t)
        elif name == "form":
            node, self.form = self.form, None
            if node is not None and node in self.open and self._has({"form"}):
                self._imply()
                self._drop(node)
        elif name in ("applet", "marquee", "object"):
            if self._has({name}):
                self._imply()
                self._pop_to(name)
                self._clear_to_marker()
        elif name == "br":
            self._start(Token("start", "br"))
        else:
            self._other_end(name)

    def text(self, t: Token) -> None:
        if t.kind in ("chars", "space"):
            self._text(t.data)
        else:
            self._pop()
            self.mode = self.after_text
            if t.kind == "eof":
                self.process(t)

    def in_table(self, t: Token) -> None:
        if t.kind in ("chars", "space") and self.open[-1].tag in ("table", "tbody", "tfoot", "thead", "tr"):
            self.pending, self.after_text = [], self.mode
            self._again(t, self.in_table_text)
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "start" and t.name in TABLE_PARTS:
            self._back_to("table")
            if t.name == "caption":
                self.formatting.append(None)
            wrap = {"col": "colgroup", "td": "tbody", "th": "tbody", "tr": "tbody"}.get(t.name, "")
            self._insert(Token("start", wrap) if wrap else t)
            self.mode = {"caption": self.in_caption, "col": self.in_column_group, "colgroup": self.in_column_group}.get(t.name, self.in_table_body)
            if wrap:
                self.process(t)
        elif t.name == "table" and t.kind in ("start", "end"):
            if self._has({"table"}, TABLE_SCOPE):
                self._pop_to("table")
                self._reset_mode()
                if t.kind == "start":
                    self.process(t)
        elif t.kind == "start" and t.name in ("style", "script"):
            self.in_head(t)
        elif t.kind == "start" and t.name == "input" and t.attrs.get("type", "").lower() == "hidden":
            self._insert_void(t)
        elif t.kind == "start" and t.name == "form":
            if self.form is None:
                self.form = self._insert(t)
                self._pop()
        elif t.kind not in ("doctype", "eof") and not (t.kind == "end" and t.name in TABLE_PARTS | {"body", "html"}):
            self.foster = True
            self.in_body(t)
            self.foster = False

    def in_table_text(self, t: Token) -> None:
        if t.kind in ("chars", "space"):
            self.pending.append(t.data.replace("\0", ""))
            return
        data = "".join(self.pending)
        self.mode = self.after_text
        if data.strip(_WS):
            self.foster = True
            self.in_body(Token("chars", data=data))
            self.foster = False
        elif data:
            self._text(data)
        self.process(t)

    def _close_part(self, name: str, mode: Mode) -> bool:
        """Ends a part of a table that is in table scope."""
        if not self._has({name}, TABLE_SCOPE):
            return False
        self._imply()
        self._pop_to(name)
        if name in ("caption", "td", "th"):
            self._clear_to_marker()
        self.mode = mode
        return True

    def in_caption(self, t: Token) -> None:
        if t.kind == "end" and t.name == "caption":
            self._close_part("caption", self.in_table)
        elif t.kind == "start" and t.name in TABLE_PARTS or t.kind == "end" and t.name == "table":
            if self._close_part("caption", self.in_table):
                self.process(t)
        elif not (t.kind == "end" and t.name in TABLE_PARTS | {"body", "html"}):
            self.in_body(t)

    def in_column_group(self, t: Token) -> None:
        if t.kind == "space":
            self._text(t.data)
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "start" and t.name == "col":
            self._insert_void(t)
        elif t.kind == "start" and t.name == "html":
            self.in_body(t)
        elif t.kind == "end" and t.name == "colgroup":
            if self.open[-1].tag == "colgroup":
                self._pop()
                self.mode = self.in_table
        elif t.kind not in ("doctype", "eof") and not (t.kind == "end" and t.name == "col") and self.open[-1].tag == "colgroup":
            self._pop()
            self._again(t, self.in_table)

    def in_table_body(self, t: Token) -> None:
        bodies = ("tbody", "tfoot", "thead")
        if t.kind == "start" and t.name in ("tr", "td", "th"):
            self._back_to(*bodies)
            self._insert(t if t.name == "tr" else Token("start", "tr"))
            self.mode = self.in_row
            if t.name != "tr":
                self.process(t)
        elif t.kind == "end" and t.name in bodies:
            if self._has({t.name}, TABLE_SCOPE):
                self._back_to(*bodies)
                self._pop()
                self.mode = self.in_table
        elif t.kind == "start" and t.name in TABLE_PARTS or t.kind == "end" and t.name == "table":
            if self._has(set(bodies), TABLE_SCOPE):
                self._back_to(*bodies)
                self._pop()
                self._again(t, self.in_table)
        elif not (t.kind == "end" and t.name in TABLE_PARTS | {"body", "html"}):
            self.in_table(t)

    def in_row(self, t: Token) -> None:
        if t.kind == "start" and t.name in ("td", "th"):
            self._back_to("tr")
            self._insert(t)
            self.mode = self.in_cell
            self.formatting.append(None)
        elif t.kind == "end" and t.name == "tr" or t.kind == "start" and t.name in TABLE_PARTS or t.kind == "end" and t.name in ("table", "tbody", "tfoot", "thead"):
            ends = t.kind == "end" and t.name in ("tbody", "tfoot", "thead")
            if self._has({"tr"}, TABLE_SCOPE) and (not ends or self._has({t.name}, TABLE_SCOPE)):
                self._back_to("tr")
                self._pop()
                self.mode = self.in_table_body
                if t.name != "tr" or t.kind == "start":
                    self.process(t)
        elif not (t.kind == "end" and t.name in TABLE_PARTS | {"body", "html"}):
            self.in_table(t)

    def in_cell(self, t: Token) -> None:
        if t.kind == "end" and t.name in ("td", "th"):
            self._close_part(t.name, self.in_row)
        elif t.kind == "start" and t.name in TABLE_PARTS or t.kind == "end" and t.name in ("table", "tbody", "tfoot", "thead", "tr"):
            if (t.kind == "start" or self._has({t.name}, TABLE_SCOPE)) and (self._close_part("td", self.in_row) or self._close_part("th", self.in_row)):
                self.process(t)
        elif not (t.kind == "end" and t.name in ("body", "caption", "col", "colgroup", "html")):
            self.in_body(t)

    def in_select(self, t: Token) -> None:
        if t.kind in ("chars", "space"):
            self._text(t.data)
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "start" and t.name in ("option", "optgroup", "hr"):
            if self.open[-1].tag == "option":
                self._pop()
            if t.name != "option" and self.open[-1].tag == "optgroup":
                self._pop()
            self._insert(t) if t.name != "hr" else self._insert_void(t)
        elif t.kind == "end" and t.name in ("option", "optgroup"):
            if t.name == "optgroup" and self.open[-1].tag == "option" and len(self.open) > 1 and self.open[-2].tag == "optgroup":
                self._pop()
            if self.open[-1].tag == t.name:
                self._pop()
        elif t.kind in ("start", "end") and t.name == "select" or t.kind == "start" and t.name in ("input", "keygen", "textarea"):
            if self.names["select"]:
                self._pop_to("select")
                self._reset_mode()
                if t.name != "select":
                    self.process(t)
        elif t.kind == "start" and t.name == "script":
            self.in_head(t)

    def in_select_in_table(self, t: Token) -> None:
        if t.kind in ("start", "end") and t.name in TABLE_PARTS - {"col", "colgroup"} | {"table"}:
            if t.kind == "start" or self._has({t.name}, TABLE_SCOPE):
                self._pop_to("select")
                self._reset_mode()
                self.process(t)
        else:
            self.in_select(t)

    def after_body(self, t: Token) -> None:
        if t.kind == "comment":
            self._comment(t, self.open[0])
        elif t.kind == "space" or t.kind == "start" and t.name == "html":
            self.in_body(t)
        elif t.kind == "end" and t.name == "html":
            if not self.container:
                self.mode = self.after_after_body
        elif t.kind not in ("doctype", "eof"):
            self._again(t, self.in_body)

    def after_after_body(self, t: Token) -> None:
        if t.kind == "comment":
            self._comment(t, self.document)
        elif t.kind in ("space", "doctype") or t.kind == "start" and t.name == "html":
            self.in_body(t)
        elif t.kind != "eof":
            self._again(t, self.in_body)

    def in_frameset(self, t: Token) -> None:
        if t.kind in ("chars", "space"):
            self._text("".join(c for c in t.data if c in _WS))
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "start" and t.name == "frameset":
            self._insert(t)
        elif t.kind == "start" and t.name == "frame":
            self._insert_void(t)
        elif t.kind == "start" and t.name in ("html", "noframes"):
            self.in_body(t) if t.name == "html" else self.in_head(t)
        elif t.kind == "end" and t.name == "frameset" and len(self.open) > 1:
            self._pop()
            if self.open[-1].tag != "frameset" and not self.container:
                self.mode = self.after_frameset

    def after_frameset(self, t: Token) -> None:
        if t.kind == "end" and t.name == "html":
            self.mode = self.after_after_frameset
        elif t.kind in ("chars", "space", "comment") or t.kind == "start" and t.name in ("html", "noframes"):
            self.in_frameset(t)

    def after_after_frameset(self, t: Token) -> None:
        if t.kind == "comment":
            self._comment(t, self.document)
        elif t.kind == "space" or t.kind == "start" and t.name in ("html", "noframes"):
            self.in_frameset(t) if t.name == "noframes" else self.in_body(t)


def parse(text: str) -> Node:
    """The tree of a document."""
    return Construction(text).run()


def parse_fragment(text: str, container: str = "div") -> Node:
    """The tree of a fragment, as it would stand within the named element."""
    root = Construction(text, container).run()
    top = root.children[0]
    root.children = top.children
    for c in root.children:
        if isinstance(c, Node):
            c.parent = root
    return root
