from pyspark.sql import functions as F

from inkstream.sources import xml_rows

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>T</title><link>http://h/</link>
<item><title>A &amp; b</title><link>http://h/1</link><guid isPermaLink="false">g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><dc:creator>Ann</dc:creator><category>x</category><category>y</category><content:encoded><![CDATA[<p>c</p>]]></content:encoded></item>
<item><link>http://h/2</link></item></channel></rss>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>R</title></channel><item><title>only</title><link>http://r/1</link><dc:date>2024-01-02T03:04:05Z</dc:date></item></rdf:RDF>"""


def test_feeds_by_schema(spark):
    docs = spark.createDataFrame([(1, RSS), (2, RDF), (3, "<rss><channel>"), (4, "no"), (5, None), (6, ""), (7, "<rss><channel><title>none</title></channel></rss>")], "k int, t string")
    found = xml_rows.rss_entries(docs, "t", ["k"])
    got = {(r.k, r.pos): (r.id, r.title, r.link, r.content, r.author, r.updated, r.tags, r.feed.title) for r in found.collect()}
    assert got == {
        (1, 0): ("g1", "A & b", "http://h/1", "<p>c</p>", "Ann", "2024-01-01T10:00:00Z", ["x", "y"], "T"),
        (1, 1): ("http://h/2", None, "http://h/2", None, None, None, None, "T"),
        (2, 0): ("http://r/1", "only", "http://r/1", None, None, "2024-01-02T03:04:05Z", None, "R"),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_one_large_feed_is_split(spark, tmp_path):
    item = "<item a='1'>\n<title>t%d</title><link>http://h/%d</link><dc:creator>Ann</dc:creator>\n<category>c</category></item>"
    (tmp_path / "f.xml").write_text("<rss xmlns:dc=\"urn:dc\"><channel><title>T</title>\n<items/>" + "".join(item % (i, i) for i in range(30_000)) + "</channel></rss>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        found = xml_rows.read_rss(spark, str(tmp_path / "f.xml"))
        assert found.rdd.getNumPartitions() > 4
        assert found.agg(F.count("*"), F.countDistinct("link"), F.count("category"), F.max("creator")).first()[:] == (30_000, 30_000, 30_000, "Ann")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_schema_of_an_example(spark):
    schema = xml_rows.infer(spark, '<c a="1"><n>x</n><n>y</n></c>')
    row = spark.range(1).select(xml_rows.parse(F.lit('<c a="5"><n>z</n></c>'), schema).alias("o")).first().o
    assert row["@a"] == 5 and row.n == ["z"]
