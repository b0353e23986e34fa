"""Values that no parser expects leave the other rows of a table alone; deep trees and part files are read."""

from pyspark.sql import functions as F

from inkstream.functions import coerce
from inkstream.sources import html_tree, microformats, tables
from inkstream.streaming import crawl


def one_column(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").coalesce(1)


def rows(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_long_cells(spark):
    long = "x" * 200_000
    df = one_column(spark, [f"a,b\n{long},2\n", None, "a\n1\n"])
    got = rows(tables.read_tables(df, "v"), "rows")
    assert got == [[{"a": long, "b": "2"}], None, [{"a": "1"}]]
    assert rows(tables.read_contacts(one_column(spark, [f"Name,Email\n{long},e@x"]), "v"), "contacts")[0][0]["fn"] == long


def test_mail_in_an_unknown_charset(spark):
    text = "Subject: s\nContent-Type: text/plain; charset=x-nobody-knows\n\nhello"
    got = rows(tables.read_mail(one_column(spark, [text, "Subject: t\n\nbody", None]), "v"), "mail")
    assert [m and (m["subject"], m["text"]) for m in got] == [("s", "hello"), ("t", "body"), None]


def test_bytes_that_name_no_charset(spark):
    got = rows(tables.decode_bytes(one_column(spark, [b"<meta charset=undefined>\xc3\xa9", b"a", None], "binary"), "v"), "decoded")
    assert got == ["<meta charset=undefined>\u00e9", "a", None]


def test_statements_that_cannot_be_read(spark):
    df = tables.read_statements(one_column(spark, ['go to:"x" ;', 'go to:"x ;', None]), "v", error="why")
    assert [x and x[0]["command"] for x in rows(df, "statements")] == ["go", None, None]
    assert [x is not None for x in rows(df, "why")] == [False, True, False]


def test_deep_pages(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_tree.sanitize(deep) == html_tree.serialize(html_tree.parse(deep)) == deep
    assert html_tree.text_of(html_tree.parse(deep)) == "x" and html_tree.collapse(deep) == deep
    assert len(list(html_tree.tokens(html_tree.parse(deep)))) == 10_001
    assert html_tree.serialize(html_tree.copy(html_tree.parse(deep))) == deep
    page = '<div class="vcard"><span class="fn">Ann</span></div>'
    got = microformats.records(one_column(spark, [deep + page, page]).withColumnRenamed("v", "html"), "hcard", ["i"])
    assert got.filter("i = 1").count() == 1


def test_serialised_markup():
    text = '<p>a &amp; b<br><img src="x"><script>1 < 2</script></p>'
    tree = html_tree.parse(text)
    assert html_tree.serialize(tree) == text
    assert html_tree.serialize(tree.children[0], outer=False) == text[3:-4]
    assert html_tree.sanitize('<p onclick="x">a<script>b</script><blink>c</blink><a href="javascript:x" title="t">d</a></p>') == '<p>ac<a title="t">d</a></p>'
    assert html_tree.collapse("<p> a  b <pre> c  d </pre></p>") == html_tree.serialize(html_tree.parse("<p> a b <pre> c  d </pre></p>"))


def test_paths_by_type(spark):
    df = spark.sql("select named_struct('list', array(named_struct('name', 'a'), named_struct('name', 'b')), 'one', named_struct('name', 'c'), 'm', map('k', array(7, 8))) v")
    wanted = {"v.list.name": "a", "v.list[1].name": "b", "v.list[5].name": None, "v.one[0].name": "c", "v.one[1].name": None, "v.m.k[1]": 8, "v.m.x": None, "v.one.name": "c", "v.none": None, "w": None}
    for path, value in wanted.items():
        assert df.select(coerce.extract(df, path)).first()[0] == value, path


def test_streams_read_folders_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, t string")
    df.repartition(3).write.parquet(f"{tmp_path}/folder.parquet")
    df.toPandas().to_parquet(f"{tmp_path}/file.parquet")
    for name in ("folder", "file"):
        stream = crawl.read_stream(spark, f"{tmp_path}/{name}.parquet", "id long, t string", 1 if name == "folder" else None)
        crawl.finish(stream, f"{tmp_path}/{name}-marks", crawl.upsert_into(f"{tmp_path}/{name}-out", ["id"], ["t"]))
        assert spark.read.parquet(f"{tmp_path}/{name}-out").select("id").distinct().count() == 6


def test_batches_append_what_is_new(spark, tmp_path):
    write = crawl.upsert_into(str(tmp_path / "t"), ["id"], ["t"])
    batch = lambda *rows: spark.createDataFrame(rows, "id long, t string")
    write(batch((1, "b"), (1, "a")), 0)
    write(batch((1, "0"), (2, "x")), 1)
    write(batch((2, "y"), (3, "z")), 2)
    write(batch((1, "0"), (2, "x")), 1)
    assert sorted((r.id, r.t) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "x"), (3, "z")]


def test_no_column_is_lost_beside_a_null(spark):
    df = one_column(spark, ["a\n1", None]).withColumn("more", F.lit("m"))
    assert tables.read_tables(df, "v").columns == ["i", "v", "more", "rows"]
