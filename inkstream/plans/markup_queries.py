"""Queries over planted markup that is misnested, incomplete or to be written anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.plans.base import query, read, spread
from inkstream.plans.parsed_queries import _markup
from inkstream.sources import html5, html_writer
from inkstream.sources import html_tree as ht
from inkstream.sources.arrow import parse_column


def _forms(k: Column, name: Column, forms: list[str]) -> Column:
    """One of the forms by the key, with the name for each @."""
    filled = [_markup(*[p for part in f.split("@") for p in (part, name)][:-1]) for f in forms]
    return F.element_at(F.array(*filled), (k % len(forms) + 1).cast("int"))


def _expected(table: str, key: str, name: str, forms: list[str]) -> str:
    """SQL of one of the forms by the key, with the name for each @."""
    cases = " ".join(f"WHEN {i} THEN replace('{f.replace(chr(39), chr(39) * 2)}', '@', {name})" for i, f in enumerate(forms))
    return f"SELECT {key}, CASE {key} % {len(forms)} {cases} END AS html FROM {table}"


#: Markup, and its tree by the rules of the standard, written in full.
MISNESTED = [
    ("<b>1<p>@</b>3</p>", "<html><head></head><body><b>1</b><p><b>@</b>3</p></body></html>"),
    ("<p>1<b>2<i>@</b>4</i>5</p>", "<html><head></head><body><p>1<b>2<i>@</i></b><i>4</i>5</p></body></html>"),
    ("<table><b><tr><td>aaa</td></tr>@</table>ccc", "<html><head></head><body><b></b><b>@</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b></body></html>"),
    ("<!doctype html><title>@</title><p>a<div>b</p>c<ul><li>x<li>y", "<!DOCTYPE html><html><head><title>@</title></head><body><p>a</p><div>b<p></p>c<ul><li>x</li><li>y</li></ul></div></body></html>"),
    ("<table><td>@<td>b<tr><th>c</table><!-- d -->", "<html><head></head><body><table><tbody><tr><td>@</td><td>b</td></tr><tr><th>c</th></tr></tbody></table><!-- d --></body></html>"),
    ("<select><option>@<option>b<table></select><svg viewbox=1><path/>x<p>y", '<html><head></head><body><select><option>@</option><option>b</option></select><svg viewBox="1"><path></path>x</svg><p>y</p></body></html>'),
    ("<script>if (a < b) '</p>'</script><textarea>\n<i>@</textarea><a href=?a&amp=1&copy=2>&notit;", "<html><head><script>if (a < b) '</p>'</script></head><body><textarea>&lt;i&gt;@</textarea><a href=\"?a&amp;amp=1&amp;copy=2\">¬it;</a></body></html>"),
]


@query(_expected("customer", "c_custkey", "c_name", [tree for _, tree in MISNESTED]))
def constructed_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adoption, foster parents, implied elements, tables, selections, vocabularies, raw texts, references."""
    c = spread(read(spark, sf_dir, "customer"))
    raw = c.select("c_custkey", _forms(F.col("c_custkey"), F.col("c_name"), [m for m, _ in MISNESTED]).alias("raw"))
    return parse_column(raw, "raw", lambda t: ht.serialize(html5.parse(t)), "html", "string").drop("raw")


#: Options, and what a page with them is written as.
PAGE = "<!DOCTYPE html><html><head><title>@</title></head><body><p class='a b' title=x hidden>1<p>2<br><ul><li>\"3\"  4<li>é</ul><table><tr><td>5<td>6</table><pre>  7</pre>"
_FULL = '<!DOCTYPE html><html><head><title>@</title></head><body><p class="a b" title="x" hidden="">1</p><p>2<br></p><ul><li>"3"  4</li><li>é</li></ul><table><tbody><tr><td>5</td><td>6</td></tr></tbody></table><pre>  7</pre></body></html>'
WRITTEN = [
    (html_writer.Options(), _FULL),
    (html_writer.Options(omit_optional_tags=True), '<!DOCTYPE html><title>@</title><p class="a b" title="x" hidden="">1<p>2<br><ul><li>"3"  4<li>é</ul><table><tr><td>5<td>6</table><pre>  7</pre>'),
    (html_writer.Options(quote_always=False, minimize_boolean=True), _FULL.replace('title="x" hidden=""', "title=x hidden")),
    (html_writer.Options(strip_space=True, named_entities=True), _FULL.replace('"3"  4', '"3" 4').replace("é", "&eacute;")),
    (html_writer.Options(charset="utf-8", trailing_solidus=True), _FULL.replace("<head>", '<head><meta charset="utf-8" />').replace("<br>", "<br />")),
    (html_writer.Options(sanitize=True), '<!DOCTYPE html>@<p class="a b" title="x">1</p><p>2<br></p><ul><li>"3"  4</li><li>é</li></ul><table><tbody><tr><td>5</td><td>6</td></tr></tbody></table><pre>  7</pre>'),
    (html_writer.XHTML, _FULL.replace("<br>", "<br />")),
]


@query(_expected("customer", "c_custkey", "c_name", [text for _, text in WRITTEN]))
def written_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page, written with options."""
    c = spread(read(spark, sf_dir, "customer"))
    html = _forms(F.lit(0), F.col("c_name"), [PAGE])
    raw = c.select("c_custkey", F.concat_ws("\n", (F.col("c_custkey") % len(WRITTEN)).cast("string"), html).alias("raw"))

    def write(text: str) -> str:
        which, _, page = text.partition("\n")
        options = WRITTEN[int(which)][0]
        return (html_writer.xhtml if options is html_writer.XHTML else html_writer.write)(html5.parse(page), options)

    return parse_column(raw, "raw", write, "html", "string").drop("raw")


SANITISED = [
    ("<p onclick=x>@<script>b</script><blink>c</blink><a href='java\nscript:x' title=t>d", '<p>@c<a title="t">d</a></p>'),
    ("<b><p>@</b><iframe src=x>y</iframe>z", "<b></b><p><b>@</b>yz</p>"),
    ("<img src=http://h.example/i onerror=x><style>a{}</style><table>@<tr><td style=x>1", '<img src="http://h.example/i">@<table><tbody><tr><td>1</td></tr></tbody></table>'),
]


@query(_expected("supplier", "s_suppkey", "s_name", [safe for _, safe in SANITISED]))
def sanitized_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is unsafe goes, and the tree is that of a browser."""
    s = read(spark, sf_dir, "supplier")
    raw = s.select("s_suppkey", _forms(F.col("s_suppkey"), F.col("s_name"), [m for m, _ in SANITISED]).alias("raw"))
    return parse_column(raw, "raw", ht.sanitize, "html", "string").drop("raw")


#: Streams of tokens as kinds and names, and what is wrong with them.
_STREAMS = [("StartTag p,Characters x,EndTag p", ""), ("StartTag br,EmptyTag i,EndTag p", "void element as start tag br;element as empty tag i;end tag of another element p"), ("StartTag p,SpaceCharacters x,What y", "SpaceCharacters of another kind;unknown token What;element does not end p")]


@query(_expected("supplier", "s_suppkey", "s_name", [found for _, found in _STREAMS]).replace("AS html", "AS problems"))
def linted_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token streams that break their own rules."""
    raw = read(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(s) for s, _ in _STREAMS]), (F.col("s_suppkey") % len(_STREAMS) + 1).cast("int")).alias("raw"))

    def told(text: str) -> str:
        parts = [t.split(" ") for t in text.split(",")]
        return ";".join(html_writer.lint({"type": k, "name": n, "data": n} for k, n in parts))

    return parse_column(raw, "raw", told, "problems", "string").drop("raw")
