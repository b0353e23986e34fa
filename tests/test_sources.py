import json

import pytest
from pyspark.sql import functions as F

from inkstream.sources import connectors, feeds, microformats, objects, tables
from inkstream.sources import html_tree as ht

PAGE = """<html><head><title>Page</title></head><body class="hfeed">
<address class="author vcard"><a class="url fn" href="http://a/x">Ann B. Lee</a></address>
<div class="hentry" id="e1"><h2 class="entry-title">One <em>two</em></h2><div class="entry-content"><p>Hi</p><div class="hentry">nested</div></div><div class="entry-content">more</div>
<abbr class="published" title="2024-01-02T03:04:05+00:00">Jan</abbr><a rel="bookmark" href="/p/1">x</a><a rel="tag" href="http://t/foo+bar/">Foo</a><blockquote><b class="entry-summary">quoted</b></blockquote></div>
<blockquote><div class="hentry">quoted</div></blockquote>
<div class="hentry"><span class="author vcard"><span class="fn">Bob</span></span><h3>Three</h3><a rel="principles" href="/pr">p</a><span class="source-org">no card</span></div></body></html>"""


def test_entries_of_a_page():
    one, two = microformats.parse_page(PAGE, ("hatom",), "http://site/x")
    assert one["index"] == "hentry-1" and two["index"] == "hentry-4"
    assert one["fields"]["entry-content"].endswith("\nmore") and "entry-summary" not in one["fields"]
    assert one["fields"]["bookmark"] == "http://site/p/1" and one["fields"]["published"] == "2024-01-02T03:04:05Z"
    assert [c["fields"].get("fn", c["fields"].get("name")) for c in one["children"]] == ["foo bar", "Ann B. Lee"]
    assert two["fields"]["entry-title"] == "Three" and two["children"][0]["fields"]["fn"] == "Bob"
    news = microformats.parse_page(PAGE, ("hnews",))
    assert news[-1]["fields"]["principles"] == "/pr" and news[-1]["children"] == []


def test_included_and_signed_records():
    resume = '<div id="me" class="vcard"><b class="fn">Ann Lee</b></div><div class="hresume"><p class="summary">s</p><div class="contact"><a class="include" href="#me"></a></div><div class="experience vevent vcard"><b class="summary">Work</b><b class="org">ACME</b><abbr class="dtstart" title="2001">a</abbr></div></div>'
    (r,) = microformats.parse_page(resume, ("hresume",))
    assert {c["name"]: c["fields"]["@title"] for c in r["children"]} == {"contact": "Ann Lee", "experience": "ACME"}
    assert r["children"][1]["fields"]["dtstart"] == "2001"
    (r,) = microformats.parse_page('<div class="hlisting"><b class="price">9</b></div>', ("listing",))
    assert r["children"] == [{"name": "lister", "fields": {"fn": "anonymous"}}]


def test_unknown_format_and_empty_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, PAGE)], "id int, html string")
    found = microformats.microformats(df).select("id", F.size("records").alias("n")).orderBy("id").collect()
    assert [r.n for r in found][:2] == [None, 0] and found[2].n > 2
    with pytest.raises(ValueError):
        microformats.microformats(df, formats=("nothing",))


def test_html_tree():
    assert ht.serialize(ht.parse("<ul><li>a<li>b<br>c</ul><p>x<p>y")) == "<ul><li>a</li><li>b<br>c</li></ul><p>x</p><p>y</p>"
    assert ht.sanitize('<p onclick="x">a<script>1</script><a href="java\nscript:x" title="t">b</a><foo>c</foo></p>') == '<p>a<a title="t">b</a>c</p>'
    assert ht.text_of(ht.parse("<p>a <b>b</b></p><p>c</p>"), lines=True) == "a b\nc"
    assert "duplicate-id a" in ht.problems("<p id=a><p id=a><label for=z>")
    assert 'value="7"' in ht.fill_form('<input name="n"><input type=checkbox name=c value=1>', {"n": "7", "c": "1"})
    assert ht.with_charset("<head></head>") == '<head><meta charset="utf-8"></head>'
    assert ht.collapse("<p>a  b<pre>c  d</pre>") == "<p>a b</p><pre>c  d</pre>"
    assert ht.resolve_links('<a href="x">a</a>', "http://h/p/") == '<a href="http://h/p/x">a</a>'


RSS = '<rss version="2.0"><channel><title>T</title><item><title>A &amp; b</title><link>http://x/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate><author>a@b.c (Ann)</author><category>k</category></item></channel></rss>'


def test_strict_and_loose_feeds_agree():
    strict, loose = feeds.parse_feed(RSS), feeds.parse_feed(RSS.replace("&amp;", "&"))
    assert (strict["bozo"], loose["bozo"]) == (False, True)
    assert strict["entries"] == loose["entries"] and strict["version"] == "rss20"
    assert strict["entries"][0]["updated"] == "2024-01-02T02:04:05Z" and strict["entries"][0]["author_email"] == "a@b.c"
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>R</title></channel><item rdf:about="http://i"><title>t</title><dc:creator>C</dc:creator><dc:date>2024-01-02</dc:date></item></rdf:RDF>'
    found = feeds.parse_feed(rdf)
    assert found["version"] == "rss10" and found["entries"][0]["link"] == "http://i" and found["entries"][0]["author"] == "C"
    cdf = '<channel href="http://c" title="C"><item href="http://c/1"><title>one</title><abstract>a</abstract></item></channel>'
    assert feeds.parse_feed(cdf)["entries"][0]["summary"] == "a" and feeds.parse_feed("")["entries"] == []


def test_tables_and_texts():
    assert tables.table_rows("a,,b\n,x,\n1,2,3\n\n4,5\n", (0, 1)) == [{"a": "1", "x": "2", "b": "3"}, {"a": "4", "x": "5"}]
    assert tables.table_rows("1,2\n3,4\n", None, skip=1) == [{"C0": "3", "C1": "4"}]
    assert tables.contact_rows("Ann Lee,a@b.c\n") == [{"fn": "Ann Lee", "email": "a@b.c"}]
    assert tables.statements('set a:1 b:"x; y" # c\n; say t:"""hi""";') == [{"command": "set", "arguments": '{"a": 1, "b": "x; y"}'}, {"command": "say", "arguments": '{"t": "hi"}'}]
    assert tables.outline("<opml><body><outline text='a'><outline text='b' xmlUrl='u'/></outline></body></opml>", leaves_only=True) == [{"title": "b", "uri": "u", "feed": "u", "tags": ["a"], "depth": 1, "children": 0}]
    assert tables.decoded("é".encode("latin-1")) == "é" and tables.decoded("﻿é".encode()) == "é" and tables.decoded("é".encode("utf-16")) == "é"


def test_objects():
    assert objects.xml_object('<a xmlns="u" x="1"><b>1</b><b>2</b>t</a>') == {"a": {"@x": "1", "b": ["1", "2"], "@": "t"}}
    assert objects.json_object('cb({"A -b":1,"e":""});') == {"A_b": 1}
    assert objects.html_object("<p class=x>a<b>c</b></p>")["p"]["b"] == "c"
    assert objects.xml_text({"@x": 1, "b": [1, 2], "m:z": "q"}, "a", {"m": "urn:m"}).endswith('<a xmlns:m="urn:m" x="1"><b>1</b><b>2</b><m:z>q</m:z></a>')
    assert connectors.page_uri("http://x", {"q": "a b", "n": None, "l": [1, 2]}, "search.web", 3) == "http://x?v=1.0&rsz=large&q=a+b&l=1%2C2&start=24"
    assert connectors.page_uri("http://x?a=1", {}, "products", 1).startswith("http://x?a=1&Sort=") and "ItemPage" not in connectors.page_uri("http://x", {}, "products", 1)
    assert connectors.missing({"q": None}, "search.news") == ["q"] and connectors.missing({}, "music.info") == []
    assert objects.without_hidden({"@@Page": 1, "a": [{"@@x": 1, "b": 2}]}) == {"a": [{"b": 2}]}
    assert objects.separate({"a": 1, "b": 2}, {"a"}) == ({"a": 1}, {"b": 2})


def test_unreadable_objects_are_null(spark):
    df = spark.createDataFrame([("<a>",), ("<a>1</a>",), (None,)], "x string")
    assert [json.loads(r.object) if r.object else None for r in objects.objects(df, "x", "xml").collect()] == [None, {"a": "1"}, None]


PODCAST = """<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:cc="http://web.resource.org/cc/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
<channel><title>P</title><copyright>all</copyright><generator>g 1.0</generator><ttl>60</ttl><webMaster>w@h (W)</webMaster><itunes:owner><itunes:name>Own</itunes:name><itunes:email>o@h</itunes:email></itunes:owner><itunes:explicit>no</itunes:explicit>
<itunes:image href="http://h/i.png"/><itunes:category text="Arts"><itunes:category text="Food"/></itunes:category><cloud domain="d" port="80"/><textInput><title>Search</title><name>q</name><link>http://h/s</link></textInput>
<item><title>E</title><comments>http://h/c</comments><itunes:duration>1:02:03</itunes:duration><itunes:explicit>yes</itunes:explicit><itunes:keywords>a b, a</itunes:keywords><category domain="http://x">c</category><dc:subject>s</dc:subject><dc:rights>mine</dc:rights>
<cc:license rdf:resource="http://cc/by"/><enclosure url="http://h/1.mp3" type="audio/mpeg" length="123"/><enclosure url="http://h/2" length="many"/><created>2024-01-02</created></item></channel></rss>"""


def test_details_of_feeds_and_entries(spark):
    (row,) = feeds.feeds(spark.createDataFrame([(PODCAST,)], "x string"), "x").collect()
    f, e = row.feed, row.feed.entries[0]
    assert (f.rights, f.generator, f.ttl, f.publisher, f.author, f.author_email, f.explicit, f.block, f.image) == ("all", "g 1.0", 60, "w@h (W)", "Own", "o@h", False, None, "http://h/i.png")
    assert [(t.term, t.scheme) for t in f.tags] == [("Arts", feeds.PODCAST), ("Food", feeds.PODCAST)]
    assert f.cloud == {"domain": "d", "port": "80"} and (f.textinput.title, f.textinput.name, f.textinput.link) == ("Search", "q", "http://h/s")
    assert (e.comments, e.duration, e.explicit, e.rights, e.license, e.created) == ("http://h/c", "1:02:03", True, "mine", "http://cc/by", "2024-01-02T00:00:00Z")
    assert [(t.term, t.scheme) for t in e.tags] == [("a", feeds.PODCAST), ("b", feeds.PODCAST), ("c", "http://x"), ("s", None)]
    assert [(m.href, m.type, m.length) for m in e.media] == [("http://h/1.mp3", "audio/mpeg", 123), ("http://h/2", None, None)]
