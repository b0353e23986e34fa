"""Trees of misnested markup, as the rules of the standard give them, and what is written from trees."""

import random
import re

import pytest

from inkstream.sources import html5, html_writer
from inkstream.sources import html_tree as ht

CASES = {
    "<b>1<p>2</b>3</p>": "<b>1</b><p><b>2</b>3</p>",
    "<p>1<b>2<i>3</b>4</i>5</p>": "<p>1<b>2<i>3</i></b><i>4</i>5</p>",
    "<a><p></a></p>": "<a></a><p><a></a></p>",
    "<div><a><b><div></a>x": "<div><a><b></b></a><b><div><a></a>x</div></b></div>",
    "<p>1<s id=A>2<b id=B>3</p>4</s>5</b>": '<p>1<s id="A">2<b id="B">3</b></s></p><s id="A"><b id="B">4</b></s><b id="B">5</b>',
    "<font><p>hello<b>cruel</font>world": "<font></font><p><font>hello<b>cruel</b></font><b>world</b></p>",
    "<p><b><b><b><b><p>x": "<p><b><b><b><b></b></b></b></b></p><p><b><b><b>x</b></b></b></p>",
    "<table><b><tr><td>aaa</td></tr>bbb</table>ccc": "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>",
    "a<table><tr> <td>x</td></tr>b</table>c": "ab<table><tbody><tr> <td>x</td></tr></tbody></table>c",
    "<table><form><tr><td><input></form></table>": "<table><form></form><tbody><tr><td><input></td></tr></tbody></table>",
    "<table><caption>a<col><td>b": "<table><caption>a</caption><colgroup><col></colgroup><tbody><tr><td>b</td></tr></tbody></table>",
    "<p>a<div>b</p>c": "<p>a</p><div>b<p></p>c</div>",
    "<h1>a<h2>b</h1>c": "<h1>a</h1><h2>b</h2>c",
    "<a href=1>x<a href=2>y": '<a href="1">x</a><a href="2">y</a>',
    "<dl><dt>a<dd>b<dt>c</dl>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>",
    "<button>a<button>b": "<button>a</button><button>b</button>",
    "<form><form>a</form>b": "<form>a</form>b",
    "<select><option>a<option>b<table></select>c": "<select><option>a</option><option>b</option></select>c",
    "<svg><foreignobject><p>a</svg>b": "<svg><foreignObject><p>ab</p></foreignObject></svg>",
    "<svg viewbox=1><g/><path/>x<p>y": '<svg viewBox="1"><g></g><path></path>x</svg><p>y</p>',
    "<svg><![CDATA[<a>]]></svg><![CDATA[b]]>": "<svg>&lt;a&gt;</svg><!--[CDATA[b]]-->",
    "x &amp &copy; &notit; &#x41; <a href='?a&copy=1&lt;&ltx'>": 'x &amp; © ¬it; A <a href="?a&amp;copy=1&lt;&amp;ltx"></a>',
    "<textarea>\n<b>&lt;</textarea><pre>\n\nx</pre>": "<textarea>&lt;b&gt;&lt;</textarea><pre>\nx</pre>",
    "</br><p/>x</ p>y</>z<?a>": "<br><p>x<!-- p-->yz<!--?a--></p>",
    "x<a href='": "x",
}


@pytest.mark.parametrize("text", CASES)
def test_trees_of_the_standard(text):
    whole = ht.serialize(html5.parse(text))
    assert re.fullmatch("<html><head></head><body>(.*)</body></html>", whole, re.S)[1] == CASES[text]


def test_documents_and_fragments():
    show = lambda t, c: ht.serialize(html5.parse_fragment(t, c))
    assert ht.serialize(html5.parse("")) == "<html><head></head><body></body></html>"
    assert ht.serialize(html5.parse("<!DOCTYPE html><title>a&lt;b</title><script><!--<script></script>--></script>x")) == "<!DOCTYPE html><html><head><title>a&lt;b</title><script><!--<script></script>--></script></head><body>x</body></html>"
    assert ht.serialize(html5.parse("<frameset><frame>")).startswith("<html><head></head><frameset><frame>")
    assert show("<td>a<td>b", "tr") == "<td>a</td><td>b</td>" and show("<td>a<td>b", "div") == "ab" and show("<b>x", "title") == "&lt;b&gt;x"
    assert show("<p>a<table>", "div") == "<p>a</p><table></table>"
    assert ht.serialize(html5.parse("<p>a<table>")).count("<p>a<table>") == 1  # without a doctype a table stays in the paragraph
    assert "<p>a</p><table>" in ht.serialize(html5.parse("<!doctype html><p>a<table>"))
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert show(deep, "div") == deep


def test_any_text_gives_a_sound_tree():
    rng = random.Random(7)
    tags = "a b i p div table tr td tbody select option svg math mi title ul li dd button form h1 body html head frameset script style textarea font nobr caption col object ruby rt input br plaintext annotation-xml foreignObject".split()
    for _ in range(1500):
        text = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", " ", "x", "<!--c-->", "&amp", "<", "</", "\0", "'"]) for _ in range(rng.randint(1, 25)))
        for root in (html5.parse(text), html5.parse_fragment(text, rng.choice(["div", "tr", "table", "select", "td", "svg", "colgroup", "html"]))):
            seen = list(root.walk())
            assert len({id(n) for n in seen}) == len(seen)
            assert all(c.parent is n for n in seen for c in n.children if isinstance(c, ht.Node))


def test_omitted_tags_are_implied_again():
    rng = random.Random(3)
    tags = "p div table tr td tbody ul li dd dl dt h1 option select thead tfoot caption colgroup col pre ruby rt".split()
    left_out = 0
    for _ in range(3000):
        text = "<!DOCTYPE html>" + "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", " ", "x", "<!--c-->"]) for _ in range(rng.randint(1, 16)))
        full = ht.serialize(html5.parse(text))
        if ht.serialize(html5.parse(full)) == full:  # trees that markup can say
            short = html_writer.write(html5.parse(text), html_writer.Options(omit_optional_tags=True))
            assert ht.serialize(html5.parse(short)) == full, text
            left_out += len(full) - len(short)
    assert left_out > 10_000


def test_writing():
    write = lambda t, **o: html_writer.write(html5.parse_fragment(t), html_writer.Options(**o))
    assert write("<input checked value=a title='a\"b<' class='x y'>é", quote_always=False, best_quote=True, minimize_boolean=True, escape_lt=True, named_entities=True, trailing_solidus=True) == "<input checked value=a title='a\"b&lt;' class=\"x y\" />&eacute;"
    assert write("<a title='it&apos;s'>", quote="'") == "<a title='it&#39;s'></a>" and write("<br>", trailing_solidus=True, space_before_solidus=False) == "<br/>"
    assert write("<p> a  b<pre> c  d", strip_space=True) == "<p> a b</p><pre> c  d</pre>"
    assert html_writer.xhtml(html5.parse_fragment("<!-- a--b- --><br><script>1<2</script>")) == "<!-- a- -b- --><br /><script>1&lt;2</script>"
    assert html_writer.lint(ht.tokens(html5.parse("<p>a <b>x</b><br>"))) == []
    assert html_writer.lint([{"type": "StartTag", "name": ""}, {"type": "Characters", "data": ""}, {"type": "EndTag", "name": "br"}]) == ["StartTag without a name", "Characters without text", "end tag of a void element br"]
