import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstream.functions import coerce, dates, expression, template, urls
from inkstream.functions import text as tx

VALUES = [None, "", " ", "3.9", "abc", "yes", "N", "7", "0", "-2", "[]", "x--y", "ÄÖ é", "aabb", "<p>a<b>c</b>\n<i\n>d</p>"]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string").cache()


def column(values, c):
    return [r[0] for r in values.orderBy("i").select(c).collect()]


def test_coercion(values):
    v = F.col("v")
    assert column(values, coerce.to_int(v, -1)) == [-1, -1, -1, 3, -1, -1, -1, 7, 0, -2, -1, -1, -1, -1, -1]
    assert column(values, coerce.to_float(v, -1.0)) == [-1, -1, -1, 3.9, -1, -1, -1, 7, 0, -2, -1, -1, -1, -1, -1]
    assert column(values, coerce.to_bool(v))[:10] == [False, False, False, True, True, True, False, True, False, True]
    assert column(values, coerce.to_list(F.lit("a, b"), ","))[0] == ["a", " b"]


def test_strings(values):
    v = F.col("v")
    assert column(values, tx.slug(v))[11] == "x-y" and column(values, tx.jslug(v))[11] == "x_y"
    assert column(values, tx.cut(v, "ab"))[13] == "" and column(values, tx.cut(v, "a"))[13] == "bb"
    assert column(values, tx.strip_tags(v))[14] == "ac\n<i\n>d"
    assert column(values, tx.scrub_html(v))[14] == "ac d"
    assert column(values, tx.escape_js(F.lit('a"b\n')))[0] == 'a\\"b\\n'
    assert column(values, tx.to_entities(v))[12] == "&#196;&#214; &#233;"
    assert column(values, tx.default(v, F.lit("d")))[:2] == ["d", ""] and column(values, tx.otherwise(v, F.lit("d")))[:2] == ["d", "d"]
    assert column(values, tx.contains_all(F.lit(""), v)) == [True] * len(VALUES)
    assert column(values, tx.contains_all(F.lit("A B"), v, F.lit("b")))[4] is True


URLS = {
    "http://www.Example.com:80/a//b/./index.html?q=1#f": ("http://example.com/a/b/?q=1", "example.com:80/a//b", "http"),
    "HTTPS://user@host.org:8080/x.RSS": ("https://user@host.org:8080/x.RSS", "HTTPS://user@host.org:8080/x.RSS", "https"),
}


CANONICAL = {
    "http://h/x?id=1": "http://h/x?id=1", "http://h": "http://h", "http://h/": "http://h", "http://h/index.html": "http://h/", "http://h/a/../../b/": "http://h/b", "http://h//a": "http://h//a",
    "http://h///a//b": "http://h/a/b", "mailto:A@B": "mailto:A@B", "http://h/a;x=1/b;y=2?q#f": "http://h/a;x=1/b?q", "http://h/..": "http://h", "HTTP://H:80?x": "http://h?x", "http://h/a\\b": "http://h/a/b",
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    u = F.col("u")
    got = {r[0]: r for r in df.select("u", urls.canonical(u), urls.host(u), urls.extension(u), urls.scheme(u)).collect()}
    for link, (canonical, _, scheme) in URLS.items():
        assert got[link][1].lower() == canonical.lower() and got[link][4] == scheme
    assert got["HTTPS://user@host.org:8080/x.RSS"][2:4] == ("user@host.org", "rss")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(urls.absolutise(F.lit("/x"), F.lit("https://h/p"))) == "http://h/x"
    assert one(urls.absolutise(F.lit("https://o/"), F.lit("http://h/"))) == "http://h/https://o/"
    assert one(urls.absolutise(F.lit(None).cast("string"), F.lit("http://h/"))) == "http://h/"
    assert one(urls.host(F.lit("http://rss.Example.co.uk:81/x"), True)) == "Example.co.uk" and one(urls.host(F.lit("http://rss.Example.co.uk"), True, True)) == "Example.co"
    assert one(urls.trim(F.lit(" http://www.h/a/index.SHTML/./?"))) == "h/a/index.SHTML/./?" and one(urls.trim(F.lit("h/a?b#c/"), False, False)) == "h/a"
    assert one(urls.fingerprint(F.lit("http://h/x?id=1"))) != one(urls.fingerprint(F.lit("http://h/x?id=2")))
    for link, shown in CANONICAL.items():
        assert one(urls.canonical(F.lit(link))) == shown, link
    assert one(urls.unquote(F.lit("a%2520b+c"))) == "a b+c"
    assert one(urls.normalize(F.lit(" feed://H.com:80/x "))) == "http://h.com/x"
    assert one(urls.tag_name(F.lit("http://t/foo%20bar/"))) == "foo bar"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(r"https?://(www\.)?[a-z]{1,5}\.com(:80)?(/[a-z.]{0,6}){0,3}(/index\.html)?", fullmatch=True), min_size=1, max_size=20), st.lists(st.text(max_size=20), min_size=1, max_size=10))
def test_idempotent(spark, links, words):
    for c, found in ((urls.trim, links), (tx.slug, words), (tx.collapse_spaces, words)):
        df = spark.createDataFrame([(x,) for x in found], "x string").select(c(F.col("x")).alias("once"))
        assert df.filter(~c(F.col("once")).eqNullSafe(F.col("once"))).count() == 0


DATES = {"2009": "2009", "2009-05": "2009-05", "20090506": "2009-05-06", "2009-05-06T07:08": "2009-05-06T07:08", "2024/01/02": "2024-01-02", "2024-01-02T10": "2024-01-02T10", "2009-05-06 and later": "2009-05-06", "2009-05-06 07:08:09.5+00:00": "2009-05-06T07:08:09Z", "2009-05-06T07:08:09+0530": "2009-05-06T07:08:09+05:30", "soon": "", "": ""}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "d string")
    assert {r[0]: r[1] for r in df.select("d", dates.normalize(F.col("d"))).collect()} == DATES
    one = lambda c: spark.range(1).select(c).first()[0]
    ts = lambda s: F.lit(s).cast("timestamp")
    assert str(one(dates.add_months(ts("2024-01-31 10:00:00"), F.lit(1)))) == "2024-02-28 10:00:00"
    assert str(one(dates.add_months(ts("2024-01-31 10:00:00"), F.lit(3)))) == "2024-04-30 10:00:00"
    assert one(dates.duration(ts("2024-01-01 00:00:00"), ts("2024-01-03 01:02:03"))) == "49:02:03"
    assert [one(dates.time_of_day(F.lit(w))) for w in ("Noon", "9:05", "23:59:58", "later")] == ["12:00:00", "09:05:00", "23:59:58", None]
    for text in ("2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 03:04:05 +0000", "2024/01/02 03:04:05"):
        assert str(one(dates.parse(F.lit(text)))) == "2024-01-02 03:04:05"


EXPRESSIONS = {
    "a + b ! 1": None, "a + b * 2 == 5": True, "1 + 2 == 3": True, "not (a > 1) or b < 0": True, "c + '!' == 'text!'": True, "int('3.9') - 1 == 2": True,
    "a == 1 and b == 2 and not false": True, "-a < 0": True, "bool('no') or null": False, "float(a) >= 1.0": True, "x.e.y[1] == 5": True,
}


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expressions(spark, text):
    df = spark.sql("select 1 a, 2 b, 'text' c, named_struct('e', named_struct('y', array(4, 5))) x")
    if EXPRESSIONS[text] is None:
        with pytest.raises(expression.ExpressionError):
            expression.compile_expression(text)
    else:
        assert df.select(expression.compile_expression(text, lambda n: coerce.field(F.col(n.split(".")[0]), n.partition(".")[2]))).first()[0] == EXPRESSIONS[text]


def test_scopes(spark):
    df = spark.sql("select cast(null as string) inner_a, 'out' outer_a")
    resolve = expression.scoped(lambda n: F.col(f"inner_{n}"), lambda n: F.col(f"outer_{n}"))
    assert df.select(expression.compile_expression("a == 'out'", resolve)).first()[0] is True


def test_templates(spark):
    from inkstream.functions import template

    df = spark.sql("select 'a <b>' t, array('x', 'y') l, 2 n, cast(null as string) z")
    one = lambda text, **k: df.select(template.compile_template(text, **k)).first()[0]
    assert one("{{ t }}|{{ t|safe }}|{{ z }}|{{ t|upper|cut:\"<\" }}") == "a &lt;b&gt;|a <b>||A B&gt;"
    assert one("{% for x in l %}{{ forloop.revcounter0 }}{{ x }}{% if forloop.first %}-{% endif %}{% endfor %}") == "1x-0y"
    assert one("{% if n > 1 and not z %}yes{% else %}no{% endif %}") == "yes"
    assert one("{% autoescape off %}{{ t }}{% endautoescape %}{% asis %}{{ t }}{% endasis %}") == "a <b>{{ t }}"
    assert one("plain") == "plain" and one("") == ""
    template.register("twice", lambda c, a: F.concat(c, c))
    assert one("{{ 'q'|twice }}") == "qq"
    for bad in ("{% if n %}", "{% nothing %}", "{{ t|nothing }}", "{% for x %}{% endfor %}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)


def test_zones_go_from_west_to_east(spark):
    offsets = [r.offset_minutes for r in dates.zones(spark).collect()]
    assert offsets == sorted(offsets) and len(offsets) > 300


def test_formats_and_blocks_can_be_added(spark, monkeypatch):
    monkeypatch.setattr(dates, "FORMATS", dates.FORMATS)
    df = spark.createDataFrame([("7~2024~01",)], "v string")
    assert df.select(dates.parse(F.col("v"))).first()[0] is None
    dates.register("d~yyyy~MM")
    assert str(df.select(dates.parse(F.col("v"))).first()[0]) == "2024-01-07 00:00:00"
    monkeypatch.setattr(template, "BLOCKS", {})
    with pytest.raises(template.TemplateError):
        template.compile_template("{% twice x:v %}")
    template.register_block("twice", lambda resolve, x: F.concat(x, x))
    assert df.select(template.compile_template('{% twice x:v %}{% twice x:"a b" %}')).first()[0] == "7~2024~017~2024~01a ba b"
    with pytest.raises(template.TemplateError):
        template.compile_template("{% twice x %}")


def test_character_references(spark):
    cases = {"": "", "a": "a", "&": "&", "&amp;lt;": "&lt;", "&#x1F600;!": "\U0001f600!", "&#0;&#55296;&#9999999;": "&#0;&#55296;&#9999999;", "x&eacute;&nope;&eacute": "xé&nope;&eacute", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r[0]: r[1] for r in df.select("v", tx.unescape_html(F.col("v"))).collect()} == cases


def test_links_are_joined_as_the_library_does(spark):
    from urllib.parse import urljoin

    bases = ["http://h/a/b?q=1#f", "http://h", "https://h:8/a/", "http://h/a/../b/c"]
    links = ["", "x", "./x", "../x", "../../../x", "/x/./y", "//o/z", "?n=1", "#g", "http://o/a/../b", "x/..", "x/.", ".", "..", "a/b/../c?d=../e#f", "mailto:a@b"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, l string")
    wrong = [(r.b, r.l, r.j, urljoin(r.b, r.l)) for r in df.select("b", "l", urls.join(F.col("b"), F.col("l")).alias("j")).collect() if r.j != urljoin(r.b, r.l)]
    assert not wrong


def test_homes(spark):
    cases = {"http://h/~ann/x/y?z": "http://h/~ann", "http://h/a/archives/2001": "http://h/a", "http://h/archives": "http://h/", "http://h/": None, "http://h/a": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r[0]: r[1] for r in df.select("v", urls.home(F.col("v"))).collect()} == cases


def test_templates_as_data(spark, monkeypatch):
    rows = [
        (1, "a{{ n }}b", "x&y"), (2, "c{{ n }}d", "z"), (3, "{% if k == 3 %}three {% asis %}{{ n }} as {% is %}{% endasis %}{% endif %}!", "n"), (4, "no tags {", "n"), (5, None, "n"),
        (6, "{% wrong %}", "n"), (7, "", "n"), (8, "{{ n|upper }}{{ n }}", "q"), (9, "{% if k == 9 %}open", "n"), (10, "{{ t }}", "n"),
    ]
    df = spark.createDataFrame(rows, "k int, t string, n string")
    want = {1: "ax&amp;yb", 2: "czd", 3: "three {{ n }} as {% is %}!", 4: "no tags {", 5: None, 6: None, 7: "", 8: "Qq", 9: None, 10: "{{ t }}"}
    for most in (100, 2):
        monkeypatch.setattr(template, "SHAPES", most)
        assert {r.k: r.o for r in template.render_values(df, "t", "o").collect()} == want
    two = spark.createDataFrame([("{{ b }}", "{{ c }}", "end")], "a string, b string, c string")
    assert [template.render(two, t, "o").first().o for t in ("<{{ a }}>", "<{{ *a }}>", "<{{ **a|upper }}>", "<{{ ***a }} {{ c }}>", "<{{ *a }}{{ *b }}>")] == ["<{{ b }}>", "<{{ c }}>", "<END>", "<end end>", "<{{ c }}end>"]


def test_normalized_addresses(spark):
    cases = {"http://H.example": "http://h.example", "example.com/a": "example.com/a", "feed://http//x/y": "http://x/y", "feed://https//x/y": "http://x/y", "feed:http://X:80/y": "http:http://X:80/y", "FTP://A:80": "ftp://a", "//H:80/Q?": "//h/Q", "": "", "http://h:8080/#": "http://h:8080/"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.n for r in df.select("u", urls.normalize(F.col("u")).alias("n")).collect()} == cases


@pytest.mark.parametrize(
    "text",
    [
        "2 + 3 * 4 ** 2 // 5 - -7 % 3", "-2 ** 2", "2 ** 3 ** 2", "7 // -2", "-7 % 3", "7 / 2", "~5 & 6 | 8 ^ 3", "1 << 4 >> 2", "3 in [1, 2, 3]", "4 not in [1, 2]", "1 if 2 > 1 else 0", "0 if 2 < 1 else 5 if 3 <> 3 else 9",
        "1 + 1 == 2 and not 3 > 4 or false", "none is none", "1 is not 2", "'b' in 'abc'", "2 * (3 + 4) - 1", "1 if 'x' in [] else 2",
    ],
)
def test_all_operators_bind_as_in_python(spark, text):
    from inkstream.functions.expression import compile_expression

    python = text.replace("<>", "!=").replace("false", "False").replace("none", "None")
    got = spark.range(1).select(compile_expression(text).alias("x")).first().x
    want = eval(python, {"__builtins__": {}})  # noqa: S307
    assert (float(got) if not isinstance(got, bool | str) else got) == want


def test_division_by_zero_columns_and_errors(spark):
    from inkstream.functions.expression import ExpressionError, compile_expression

    df = spark.createDataFrame([("7", 2, ["a", "b"])], "s string, i int, l array<string>")
    one = lambda t: df.select(compile_expression(t).alias("x")).first().x
    assert [one(t) for t in ("i / 0", "i // 0", "s * i", "'a' in l", "'z' not in l", "i | 1", "s if i > 5 else i")] == [None, None, 14.0, True, True, 3, "2"]
    for bad in ("1 if 2", "3 not 4", "[1, 2", "1 **", "* 2"):
        with pytest.raises(ExpressionError):
            compile_expression(bad)


def test_dates_of_feeds(spark):
    cases = {
        "Thu, 01 Jan 2004 19:48:21 GMT": "2004-01-01 19:48:21", "1 January 04 19:48 PST": "2004-01-02 03:48:00", "01 Jan 2004": "2004-01-01 00:00:00", "2003-12-31T10:14:55.5-08:00": "2003-12-31 18:14:55",
        "2003-335": "2003-12-01 00:00:00", "2004-július-13T9:15-05:00": "2004-07-13 14:15:00", "Κυρ, 11 Ιούλ 2004 12:00:00 EST": "2004-07-11 17:00:00", "2004-07-08 23:56:58.0": "2004-07-08 14:56:58",
        "2004-05-25 오후 11:23:17": "2004-05-25 14:23:17", "2004년 05월 28일  01:31:15": "2004-05-27 16:31:15", "2004-05-25 오후 12:00:00": "2004-05-25 15:00:00", "2004": "2004-01-01 00:00:00", "Xyz, 11 Ιούλ 2004 12:00:00 EST": None,
        "2004-foo-13T9:15-05:00": None, "": None, "31 Feb 2004 00:00:00 GMT": None, "01 Foo 2004": None, "01 Jan 2004 10:00:00 XYZ": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r.d: r.t for r in df.select("d", dates.parse_feed(F.col("d")).cast("string").alias("t")).collect()} == cases
