"""Templates compiled to a Column: {{ path|filter:"argument" }}, {% if %}, {% for %}, {% asis %}, autoescape.

Names are looked up by `resolve`; inside a for block the loop's variable and `forloop` come first. A template is
compiled once, on the driver, so rendering stays in the JVM.

Templates may also be values of the table (`render_values`), and a template may name such a value, {{ *path }} (`render`).
Of those the shapes are compiled, that is the tags without the text between them, which stays data: a table whose rows
each have a text of their own has as many shapes as it has ways to put tags together.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import coerce, expression
from inkstream.functions import text as tx

_PART = re.compile(r"\{\{\s*(.+?)\s*\}\}|\{%\s*(.+?)\s*%\}", re.S)
_FILTER = re.compile(r'\|\s*(\w+)(?::("[^"]*"|[^|\s]+))?')

#: Filters by name; each takes the value and an argument (None if there is none).
FILTERS: dict[str, Callable[[Column, str | None], Column]] = {
    "lower": lambda c, a: F.lower(c),
    "upper": lambda c, a: F.upper(c),
    "capitalize": lambda c, a: tx.capwords(c),
    "title": lambda c, a: tx.capwords(c),
    "slug": lambda c, a: tx.slug(c),
    "jslug": lambda c, a: tx.jslug(c),
    "strip": lambda c, a: tx.strip(c, a),
    "lstrip": lambda c, a: tx.lstrip(c, a),
    "rstrip": lambda c, a: tx.rstrip(c, a),
    "split": lambda c, a: tx.split(c, a),
    "join": lambda c, a: tx.join(c, a or ""),
    "first": lambda c, a: tx.at_index(c, 0),
    "last": lambda c, a: tx.at_index(c, -1),
    "atindex": lambda c, a: tx.at_index(c, int(a or 0)),
    "length": lambda c, a: F.length(c).cast("string"),
    "length_is": lambda c, a: (F.length(c) == int(a or 0)).cast("string"),
    "add": lambda c, a: tx.add(c, F.lit(a)),
    "cut": lambda c, a: tx.cut(c, a or ""),
    "default": lambda c, a: tx.default(c, F.lit(a)),
    "otherwise": lambda c, a: tx.otherwise(c, F.lit(a)),
    "default_if_none": lambda c, a: tx.default_if_none(c, F.lit(a)),
    "divisibleby": lambda c, a: tx.divisible_by(c, int(a or 1)).cast("string"),
    "pluralize": lambda c, a: tx.pluralize(c, a or "s"),
    "linebreaks": lambda c, a: tx.line_breaks(c),
    "urlencode": lambda c, a: tx.url_quote(c),
    "escapejs": lambda c, a: tx.escape_js(c),
    "json": lambda c, a: F.to_json(F.array(c)),
    "random": lambda c, a: F.get(F.shuffle(c), F.lit(0)),
}
#: Filters whose result is markup already.
SAFE = {"safe", "raw", "linebreaks"}


class TemplateError(ValueError):
    """A tag is unknown or does not end."""


def register(name: str, f: Callable[[Column, str | None], Column]) -> None:
    """Adds a filter."""
    FILTERS[name] = f


Resolve = Callable[[str], Column]
#: Blocks by name; each takes a resolver and its arguments as text, and gives what stands in its place.
BLOCKS: dict[str, Callable[..., Column]] = {}


def register_block(name: str, f: Callable[..., Column]) -> None:
    """Adds a block {% name key:"text" key:path %}: f(resolve, key=Column, ...) gives its Column."""
    BLOCKS[name] = f


def block_arguments(text: str) -> dict[str, tuple[bool, str]]:
    """key:"text" and key:path, as key -> (is it text, which)."""
    out, at = {}, 0
    for m in re.finditer(r'\s*(\w+):(?:"((?:\\.|[^"\\])*)"|([^\s"]+))', text):
        if m.start() != at:
            break
        out[m[1]] = (m[2] is not None, re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else m[3])
        at = m.end()
    if text[at:].strip():
        raise TemplateError(f"cannot read arguments {text[at:]!r}")
    return out


class _Template:
    #: What stands between the tags, if that is data: an array column.
    between: Column | None = None

    def __init__(self, text: str):
        self.parts: list[tuple[str, str]] = []
        at = 0
        for m in _PART.finditer(text):
            self.parts.append(("text", text[at : m.start()]))
            self.parts.append(("value", m[1]) if m[1] is not None else ("tag", m[2]))
            at = m.end()
        self.parts.append(("text", text[at:]))
        self.at = 0

    def literal(self, place: int, text: str) -> Column:
        """The text at a place among the parts, where texts and tags take turns."""
        return F.lit(text) if self.between is None else F.get(self.between, F.lit(place // 2))

    def block(self, ends: tuple[str, ...], escape: bool) -> tuple[list, str]:
        """Nodes up to one of the closing tags, as functions of a resolver; and that tag."""
        out: list[Callable[[Resolve], Column]] = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            if kind == "text":
                if body or self.between is not None:
                    out.append(lambda r, c=self.literal(self.at - 1, body): c)
            elif kind == "value":
                out.append(_value(body, escape))
            else:
                name, _, rest = body.partition(" ")
                if name in ends:
                    return out, name
                out.append(self.tag(name, rest.strip(), escape))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return out, ""

    def tag(self, name: str, rest: str, escape: bool) -> Callable[[Resolve], Column]:
        if name == "if":
            yes, end = self.block(("else", "endif"), escape)
            no = self.block(("endif",), escape)[0] if end == "else" else []
            return lambda r: F.when(F.coalesce(coerce.to_bool(expression.compile_expression(rest, r).cast("string")), F.lit(False)), _whole(yes, r)).otherwise(_whole(no, r))
        if name == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+([\w.\[\]]+)", rest)
            if not m:
                raise TemplateError(f"cannot read for {rest!r}")
            body = self.block(("endfor",), escape)[0]
            return lambda r: _loop(m[1], r(m[2]), body, r)
        if name == "autoescape":
            body = self.block(("endautoescape",), rest != "off")[0]
            return lambda r: _whole(body, r)
        if name == "asis":
            start = self.at
            while self.at < len(self.parts) and self.parts[self.at] != ("tag", "endasis"):
                self.at += 1
            marks = {"value": "{{{{ {0} }}}}", "tag": "{{% {0} %}}"}
            whole = [self.literal(start + i, b) if k == "text" else F.lit(marks[k].format(b)) for i, (k, b) in enumerate(self.parts[start : self.at])]
            self.at += 1
            return lambda r: F.concat(*whole)
        if name in BLOCKS:
            given = block_arguments(rest)
            return lambda r: BLOCKS[name](r, **{k: F.lit(v) if literal else r(v) for k, (literal, v) in given.items()})
        raise TemplateError(f"unknown tag {name!r}")


def _value(body: str, escape: bool) -> Callable[[Resolve], Column]:
    path = re.match(r"[^|]+", body)[0].strip()
    filters = [(m[1], m[2].strip('"') if m[2] else None) for m in _FILTER.finditer(body)]
    unknown = [n for n, _ in filters if n not in FILTERS and n not in SAFE | {"escape"}]
    if unknown:
        raise TemplateError(f"unknown filter {unknown[0]!r}")
    marked = escape and not SAFE & {n for n, _ in filters} or "escape" in dict(filters)

    def render(r: Resolve) -> Column:
        c = F.lit(path[1:-1]) if path[0] in "\"'" else r(path)
        for name, argument in filters:
            if name in FILTERS:
                c = FILTERS[name](c, argument)
        c = F.coalesce(c.cast("string"), F.lit(""))
        return tx.escape_html(c) if marked else c

    return render


def _whole(nodes: list, r: Resolve) -> Column:
    return F.concat(*[n(r) for n in nodes]) if nodes else F.lit("")


def _loop(name: str, items: Column, body: list, outer: Resolve) -> Column:
    size = F.size(items)

    def each(item: Column, index: Column) -> Column:
        counters = {"counter": index + 1, "counter0": index, "revcounter": size - index, "revcounter0": size - index - 1, "first": index == 0, "last": index == size - 1}

        def resolve(path: str) -> Column:
            head, _, rest = path.partition(".")
            if head == name:
                return coerce.field(item, rest) if rest else item
            return counters[rest] if head == "forloop" else outer(path)

        return _whole(body, resolve)

    return F.coalesce(F.array_join(F.transform(items, each), ""), F.lit(""))


def columns(path: str) -> Column:
    """The plain resolver: a column, and within it a path."""
    head, _, rest = path.partition(".")
    return coerce.field(F.col(head), rest) if rest else F.col(head)


def compile_template(text: str, resolve: Resolve = columns, escape: bool = True) -> Column:
    """The Column of a template's rendered text."""
    return _whole(_Template(text).block((), escape)[0], resolve)


#: Shapes compiled into one plan.
SHAPES = 100
_TAG = r"(?s)(\{\{\s*.+?\s*\}\}|\{%\s*.+?\s*%\})"


def render_values(df: DataFrame, template: str, out: str, resolve: Resolve = columns, escape: bool = True, depth: int = 1) -> DataFrame:
    """df with `out`: each row's own template, a text column, rendered over the row; what comes out is rendered again until
    depth is reached. Templates that cannot be compiled give null, as null ones do.

    The distinct shapes are found first and compiled in blocks of SHAPES. Rows of one block take one pass, in which each row
    has its shape chosen by digest; of several blocks each reads its own rows of a written table.
    """
    from inkstream.shared import settled

    for _ in range(depth):
        tags = F.regexp_extract_all(F.col(template), F.lit(_TAG), F.lit(1))
        rows = df.withColumns({"_shape": F.md5(F.to_json(tags)), "_tags": tags, "_between": F.split(F.col(template), _TAG, -1)})
        shapes = rows.filter("_tags is not null").select("_shape", "_tags").distinct()
        first = shapes.limit(SHAPES + 1).collect()
        if len(first) <= SHAPES:
            df = _chosen(rows, first, out, resolve, escape)
        else:
            rows = settled(rows, "templates")
            done, block = rows.filter("_shape is null").transform(lambda d: _chosen(d, [], out, resolve, escape)), []
            for shape in itertools.chain(settled(shapes, "shapes").toLocalIterator(), [None]):
                if shape is not None:
                    block.append(shape)
                if block and (shape is None or len(block) == SHAPES):
                    done = done.unionByName(_chosen(rows.filter(F.col("_shape").isin([b["_shape"] for b in block])), block, out, resolve, escape))
                    block = []
            df = done
        template = out
    return df


def _chosen(rows: DataFrame, shapes: list, out: str, resolve: Resolve, escape: bool) -> DataFrame:
    found = F.lit(None).cast("string")
    for shape in shapes:
        # Texts and tags take turns, so a text stands at every even place; \0 cannot open a tag.
        made = _Template("\0".join(["", *shape["_tags"], ""]))
        made.between = F.col("_between")
        try:
            made = _whole(made.block((), escape)[0], resolve)
        except (TemplateError, expression.ExpressionError):
            continue
        found = F.when(F.col("_shape") == shape["_shape"], made).otherwise(found)
    return rows.withColumn(out, found).drop("_shape", "_tags", "_between")


def render(df: DataFrame, text: str, out: str, resolve: Resolve = columns, escape: bool = True) -> DataFrame:
    """df with `out`: the template rendered over each row. {{ *path }} stands for what the path's value gives as a template
    over the same row, {{ **path }} for what that gives in turn."""
    stars = {m[1]: (len(m[2]), m[3]) for m in re.finditer(r"\{\{\s*((\*+)([^|}\s]+))", text)}
    held = {}
    for i, (name, (depth, path)) in enumerate(sorted(stars.items())):
        held[name] = f"_star{i}"
        df = render_values(df.withColumn(held[name], resolve(path).cast("string")), held[name], held[name], resolve, depth=depth)
    found = compile_template(text, lambda path: F.col(held[path]) if path in held else resolve(path), escape)
    return df.withColumn(out, found).drop(*held.values())


def render_object(o: object, resolve: Resolve = columns) -> Column:
    """An object as JSON text in which every text, at any depth, is rendered as a template; all else stays."""
    if isinstance(o, dict):
        parts = [F.concat(F.lit(f"{json.dumps(str(k))}:"), render_object(v, resolve)) for k, v in o.items()]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    if isinstance(o, list | tuple):
        return F.concat(F.lit("["), F.concat_ws(",", *[render_object(v, resolve) for v in o]), F.lit("]"))
    if isinstance(o, str):
        quoted = F.to_json(F.array(compile_template(o, resolve)))
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.lit(json.dumps(o))
