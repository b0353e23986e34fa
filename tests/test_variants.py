import json

from pyspark.sql import functions as F

from inkstream.functions import variants as va
from inkstream.sources.objects import slug_key


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(va.parse(F.col("t"))).alias("x")).first().x


def test_parse_json_and_calls(spark):
    show = lambda t: one(spark, t, F.to_json)
    assert [show(t) for t in ('{"a":1}', ' cb.x$ ({"a": 1} ) ; ', "f(1)", "[]", "{", "", None)] == ['{"a":1}', '{"a":1}', "1", "[]", None, None, None]


def test_slugs_are_those_of_the_reader(spark):
    keys = ["Event Type", "a--b", "_x_", "dc:title", "ü", "", "a_b c", "__", "9"]
    assert [r.x for r in spark.createDataFrame([(k,) for k in keys], "k string").select(va.slug(F.col("k")).alias("x")).collect()] == [slug_key(k) for k in keys]


def test_fields_paths_and_elements(spark):
    t = json.dumps({"a b": 1, "a-b": 2, "Empty": "", "Null": None, "List": [{"x": {"y": "z"}}, {"x": 3}], "o": {"p q": "r"}})
    assert one(spark, t, lambda v: va.text(va.at(v, "a_b"))) == "2"
    assert one(spark, t, lambda v: F.map_keys(va.fields(v))) == ["List", "Null", "a_b", "o"]
    assert [one(spark, t, lambda v, p=p: va.text(va.at(v, p))) for p in ("List.x.y", "o.p_q", "o.none", "a_b.c", "o")] == ["z", "r", None, None, '{"p q":"r"}']
    assert [one(spark, t, lambda v, p=p: F.size(va.elements(va.at(v, p)))) for p in ("List", "o", "none", "Null", "")] == [2, 1, 0, 0, 1]
    assert one(spark, "[1]", va.fields) is None


def test_items_are_numbered_over_pages(spark):
    rows = [(1, 2, '{"r":[5]}'), (1, 1, '{"r":[{"n":"a"},{"n":"b"}]}'), (1, 3, "broken"), (1, 4, '{"r":[9]}'), (2, 1, 'cb({"r":{"n":"c"}})'), (2, 2, None)]
    found = va.items(spark.createDataFrame(rows, "k int, page int, t string"), "t", ["k"], "page", "r", 3)
    assert sorted((r.k, r.page, r["index"], r.i) for r in found.withColumn("i", F.to_json("item")).collect()) == [(1, 1, 0, '{"n":"a"}'), (1, 1, 1, '{"n":"b"}'), (1, 2, 2, "5"), (2, 1, 0, '{"n":"c"}')]
    assert va.items(spark.createDataFrame(rows, "k int, page int, t string"), "t", ["k"], "page", "r", -1, 2).count() == 3
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_references_and_groups(spark):
    t = json.dumps({"u:1": {"_typeGroup": "entities", "name": "A", "home": "u:2"}, "u:2": {"_typeGroup": "entities", "name": "B", "home": "u:1"}, "doc": {"info": "u:9"}})
    assert json.loads(one(spark, t, lambda v: F.to_json(va.inlined(v)))) == {
        "u:1": {"_typeGroup": "entities", "name": "A", "home": {"_typeGroup": "entities", "name": "B", "home": "u:1"}},
        "u:2": {"_typeGroup": "entities", "name": "B", "home": {"_typeGroup": "entities", "name": "A", "home": "u:2"}},
        "doc": {"info": "u:9"},
    }
    assert [(g.group, g.id) for g in one(spark, t, lambda v: F.transform(va.by_group(v), lambda e: F.named_struct(F.lit("group"), e["group"], F.lit("id"), e["id"])))] == [("entities", "u:1"), ("entities", "u:2")]
