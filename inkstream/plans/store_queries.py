"""Queries over the relational side: store, bridges, runs, lookups, entities, triples. Driver tables stand for articles
(orders), authors (customers), names (suppliers) and places (nations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.operators import entities, graph, lookup, runs, store
from inkstream.plans.base import NOW, query, read


@query(f"""SELECT event_id, user_id, ts + INTERVAL (CAST(user_id % 7 AS INTEGER) * 120) MINUTE AS refresh_at FROM events
WHERE event_type <> 'error' AND ts + INTERVAL (CAST(user_id % 7 AS INTEGER) * 120) MINUTE < TIMESTAMP '2024-01-15 00:00:00'""")
def due_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a refresh time are not due."""
    later = F.col("ts") + F.make_dt_interval(mins=(F.col("user_id") % 7 * 120).cast("int"))
    pages = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", later).alias("refresh_at"))
    return store.due_pages(pages, F.lit("2024-01-15 00:00:00").cast("timestamp"))


@query(f"""SELECT event_id, TIMESTAMP '{NOW}' AS updated_at, TIMESTAMP '{NOW}' + INTERVAL (CAST(user_id % 5 + 1 AS INTEGER) * 60) MINUTE AS refresh_at FROM events""")
def scheduled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I82."""
    pages = read(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 5 + 1) * 60).alias("refresh_minutes"))
    return store.schedule(pages, F.lit(NOW).cast("timestamp")).drop("refresh_minutes")


@query("""WITH m AS (SELECT user_id, ts, event_id, nullif(event_type, 'error') AS k FROM events), n AS (SELECT *, CASE WHEN lag(k) OVER w IS NOT DISTINCT FROM k THEN 0 ELSE 1 END AS b FROM m WHERE k IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM n) SELECT user_id, run, k AS event_type, list(event_id ORDER BY ts, event_id) AS items FROM r GROUP BY user_id, run, k""")
def regroup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user of equal type."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.nullif("event_type", F.lit("error")).alias("event_type"))
    return runs.regroup(e, "event_type", ["user_id"], ["ts", "event_id"], "event_id")


@query("""SELECT conv_id, turn, CAST(row_number() OVER w AS INTEGER) AS counter, CAST(row_number() OVER w - 1 AS INTEGER) AS counter0, CAST(row_number() OVER v AS INTEGER) AS revcounter, CAST(row_number() OVER v - 1 AS INTEGER) AS revcounter0,
row_number() OVER w = 1 AS first, row_number() OVER v = 1 AS last, 'turn.' || lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') AS name FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text), v AS (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC)""")
def loop_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F3, F4."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in runs.loop_counters(w, back).items()], runs.repeating_name("turn", w).alias("name"))


@query("""SELECT event_id, coalesce(strftime(ts, '%Y-%m-%d') <> lag(strftime(ts, '%Y-%m-%d')) OVER w, true) AS day_changed, coalesce(strftime(ts, '%Y-%m') <> lag(strftime(ts, '%Y-%m')) OVER w, true) AS month_changed,
coalesce(strftime(ts, '%Y') <> lag(strftime(ts, '%Y')) OVER w, true) AS year_changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in runs.changes(F.col("ts"), w).items()])


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9, J12."""
    return runs.first_wins(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_custkey"], ["o_orderkey"])


@query("""WITH s AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'), f AS (SELECT o_custkey AS id, 'new' || CAST(min(o_orderkey) AS VARCHAR) AS name FROM orders GROUP BY o_custkey)
SELECT * FROM s UNION ALL SELECT * FROM f WHERE id NOT IN (SELECT id FROM s)""")
def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5."""
    stored = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    found = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("new"), "o_orderkey").alias("name"), "o_orderkey")
    return store.get_or_create(found, stored, ["id"], ["o_orderkey"])


@query("""WITH f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'upd' END AS name, c_mktsegment AS seg FROM customer WHERE c_acctbal < 5000), s AS (SELECT c_custkey AS id, c_name AS name, 'old' AS seg FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT coalesce(f.id, s.id) AS id, coalesce(f.name, s.name) AS name, coalesce(f.seg, s.seg) AS seg FROM s FULL JOIN f ON f.id = s.id""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, D5."""
    c = read(spark, sf_dir, "customer")
    found = c.filter("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "upd").alias("name"), F.col("c_mktsegment").alias("seg"))
    stored = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("seg"))
    return store.upsert(found, stored, ["id"])


@query("""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS t, CAST(event_id AS VARCHAR) AS i FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS t, CAST(event_id AS VARCHAR) AS i FROM events WHERE event_type = 'view')
SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(coalesce(a.pos, b.pos) AS INTEGER) AS pos, coalesce(b.t, a.t) AS t, a.i AS a_id, b.i AS b_id FROM a FULL JOIN b ON a.user_id = b.user_id AND a.pos = b.pos""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3, H3: two lists of records side by side, the right one's values winning."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")

    def side(kind: str, name: str) -> DataFrame:
        e = read(spark, sf_dir, "events").filter(F.col("event_type") == kind)
        return e.select("user_id", F.row_number().over(w).alias("pos"), F.create_map(F.lit("t"), "event_type", F.lit(name), F.col("event_id").cast("string")).alias("fields"))

    zipped = runs.zip_positions(side("click", "a_id"), side("view", "b_id"), ["user_id", "pos"])
    return zipped.select("user_id", "pos", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("t", "a_id", "b_id")])


@query("""SELECT conv_id, lower(string_agg(role, ',' ORDER BY turn, role)) AS tags, array_to_string(list_sort(list_distinct(list(role))), ' ') AS parents FROM conversations GROUP BY conv_id""")
def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, E5, E10."""
    c = read(spark, sf_dir, "conversations").withColumn("o", F.struct("turn", "role"))
    classes = c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), " ").alias("parents"))
    return store.tag_text(c, ["conv_id"], "role", "o").join(classes, "conv_id")


@query("""SELECT o_custkey AS author_url, o_orderpriority AS fn, count(DISTINCT o_orderkey) AS n_articles FROM orders GROUP BY ALL""")
def author_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15."""
    return store.author_names(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author_url"), F.col("o_orderpriority").alias("fn"), F.col("o_orderkey").alias("bookmark")))


@query("""WITH l AS (SELECT o_orderkey AS article_id, CASE o_orderkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'place' ELSE 'organisation' END AS entity_type, CAST(o_custkey % 25 AS INTEGER) AS entity_id FROM orders)
SELECT article_id, entity_id, n_name AS name FROM l JOIN nation ON n_nationkey = entity_id WHERE entity_type = 'place'""")
def article_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3, D1, D2."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "person").when(F.col("o_orderkey") % 3 == 1, "place").otherwise("organisation")
    links = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), kind.alias("entity_type"), (F.col("o_custkey") % 25).cast("int").alias("entity_id"))
    places = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    return entities.of_article(links, places, "place").select("article_id", "entity_id", "name")


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Person' WHEN 1 THEN 'City' WHEN 2 THEN 'Company' WHEN 3 THEN 'Region' WHEN 4 THEN 'Organization' ELSE 'Currency' END AS ty, (event_id % 100) / 100.0 AS relevance FROM events)
SELECT event_id, CASE WHEN ty = 'Person' THEN 'person' WHEN ty IN ('City', 'Country', 'Continent', 'Facility', 'Region') THEN 'place' WHEN ty IN ('Organization', 'Company') THEN 'organisation' END AS kind FROM t WHERE relevance >= 0.2 AND ty <> 'Currency'""")
def entity_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, C9."""
    m = F.col("event_id") % 6
    kind = F.when(m == 0, "Person").when(m == 1, "City").when(m == 2, "Company").when(m == 3, "Region").when(m == 4, "Organization").otherwise("Currency")
    found = read(spark, sf_dir, "events").select("event_id", kind.alias("_type"), (F.col("event_id") % 100 / 100).alias("relevance"))
    return entities.relevant(found).select("event_id", entities.kind_of(F.col("_type")).alias("kind")).filter("kind is not null")


@query("""SELECT r_name AS "group", list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def grouped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A42, E6."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return entities.group_by_type(n.select(F.col("r_name").alias("group"), F.col("n_name").alias("name")), "group")


@query("""SELECT c_custkey, lower(n_name) AS country, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes looked up step by step."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    one = lookup.code_names(c, read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name"), "c_nationkey", "k", "n_name", "country")
    side = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return lookup.code_names(one, side, "country", "n_name", "r_name", "region").select("c_custkey", F.lower("country").alias("country"), "region")


@query("""WITH d(prefix, place) AS (VALUES ('1', 'one'), ('12', 'twelve'), ('20', 'twenty'), ('3', 'three'), ('345', 'long'))
SELECT o_orderkey, (SELECT min_by(place, length(prefix)) FROM d WHERE starts_with(CAST(o_orderkey AS VARCHAR), prefix)) AS shortest, (SELECT max_by(place, length(prefix)) FROM d WHERE starts_with(CAST(o_orderkey AS VARCHAR), prefix)) AS longest FROM orders""")
def prefix_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9, D15."""
    rows = [("1", "one"), ("12", "twelve"), ("20", "twenty"), ("3", "three"), ("345", "long")]
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("v"))
    return lookup.prefix_matches(o, spark.createDataFrame(rows, "prefix string, place string"), "v", "prefix", "place").select("o_orderkey", "shortest", "longest")


@query("""WITH d AS (SELECT left(url, CAST(12 + page_id % 23 AS INTEGER)) AS prefix, min(page_id) AS owner FROM pages WHERE page_id % 3 <> 0 GROUP BY 1),
m AS (SELECT page_id, min_by(owner, length(prefix)) AS shortest, max_by(owner, length(prefix)) AS longest FROM pages JOIN d ON starts_with(url, prefix) GROUP BY page_id)
SELECT page_id, shortest, longest FROM pages LEFT JOIN m USING (page_id)""")
def owners_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses looked up by prefixes of many lengths, that repeat and lie within each other."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    dim = p.filter("page_id % 3 <> 0").select(F.expr("left(url, cast(12 + page_id % 23 as int))").alias("prefix"), F.col("page_id").alias("owner"))
    return lookup.prefix_matches(p, dim, "url", "prefix", "owner").select("page_id", "shortest", "longest")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS s, c_name AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer""")
def triple_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What triples say of each subject."""
    c = read(spark, sf_dir, "customer")
    say = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    said = F.array(say("name", F.col("c_name")), say("segment", F.col("c_mktsegment")), say("nation", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string"))))
    triples = c.select(F.col("c_custkey").cast("string").alias("s"), F.inline(said)).filter("o is not null")
    return graph.profile(triples, {"name": "name", "segment": "segment", "nation": "nation"})


@query("""WITH k AS (SELECT s_suppkey, 'n' || CAST(s_nationkey AS VARCHAR) AS contact, s_nationkey FROM supplier)
SELECT 's' || CAST(s_suppkey AS VARCHAR) AS s, contact, r_name AS see_also, CASE WHEN n_name < 'K' THEN n_name END AS name FROM k JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def triple_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7."""
    k = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("s"), F.lit("knows").alias("p"), F.concat(F.lit("n"), "s_nationkey").alias("o"))
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    more = n.select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.lit("seeAlso").alias("p"), F.col("r_name").alias("o"))
    names = n.filter("n_name < 'K'").select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.lit("name").alias("p"), F.col("n_name").alias("o"))
    return graph.contacts(k.unionByName(more).unionByName(names), "knows", "seeAlso", "name")


@query("""WITH RECURSIVE n AS (SELECT CAST(n_nationkey AS INTEGER) AS id, CASE WHEN n_nationkey >= 3 THEN CAST(n_nationkey // 3 AS INTEGER) END AS parent, n_name AS title FROM nation),
t AS (SELECT id, 0 AS depth, title AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.title FROM n JOIN t ON n.parent = t.id) SELECT * FROM t""")
def flattened_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of nations, flattened with paths."""
    n = read(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("int").alias("id"), F.expr("case when n_nationkey >= 3 then cast(n_nationkey div 3 as int) end").alias("parent"), F.col("n_name").alias("title"))
    return graph.flatten_tree(nodes).select("id", F.col("depth").cast("int").alias("depth"), "path")


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, c_mktsegment AS title, CASE WHEN c_custkey % 31 = 1 THEN NULL WHEN c_custkey % 29 = 0 THEN -c_custkey WHEN c_custkey % 37 = 5 THEN c_custkey + 1 WHEN c_custkey % 37 = 6 THEN c_custkey - 1 ELSE c_custkey // 3 END AS parent FROM customer),
w AS (SELECT id, id AS place, parent, [id] AS way, title AS path FROM n UNION ALL SELECT w.id, n.id, n.parent, list_append(w.way, n.id), n.title || '/' || w.path FROM w JOIN n ON n.id = w.parent WHERE NOT list_contains(w.way, w.parent)),
e AS (SELECT id, place, parent, way, path, parent IS NOT NULL AND list_contains(way, parent) AS again FROM w WHERE parent IS NULL OR list_contains(way, parent) OR parent NOT IN (SELECT id FROM n))
SELECT id, CASE WHEN again THEN 'cycle' WHEN parent IS NULL THEN 'root' ELSE 'orphan' END AS kind, CASE WHEN NOT again THEN CAST(len(way) - 1 AS BIGINT) END AS depth,
  CASE WHEN again THEN list_min(way[list_position(way, parent):]) WHEN parent IS NULL THEN place ELSE parent END AS top, CASE WHEN NOT again THEN path END AS path FROM e""")
def outline_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its end: roots, parents that are not there, cycles."""
    k = F.col("c_custkey")
    parent = F.when(k % 31 == 1, None).when(k % 29 == 0, -k).when(k % 37 == 5, k + 1).when(k % 37 == 6, k - 1).otherwise(F.floor(k / 3))
    nodes = read(spark, sf_dir, "customer").select(k.cast("long").alias("id"), parent.cast("long").alias("parent"), F.col("c_mktsegment").alias("title"))
    return graph.flatten_tree(nodes)


@query("""WITH RECURSIVE l AS (SELECT CAST(n_nationkey AS INTEGER) AS src, CAST((n_nationkey * 7 + 3) % 25 AS INTEGER) AS dst FROM nation), r(page, hops) AS (SELECT 0, 0 UNION SELECT dst, hops + 1 FROM r JOIN l ON src = page WHERE hops < 16)
SELECT page, min(hops) AS hops FROM r GROUP BY page""")
def next_link_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full crawl along next links, each page once."""
    links = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("int").alias("dst"))
    return graph.follow_next(spark.range(1).select(F.lit(0).alias("page")), links)


@query("""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'tel.work' ELSE 'tel' END AS a, c_name AS v, c_mktsegment AS w FROM customer) SELECT c_custkey, v AS tel, w AS home FROM k""")
def shortest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of dotted keys that have the wanted parts the shortest."""
    from inkstream.functions.coerce import find_key

    m = F.create_map(F.when(F.col("c_custkey") % 2 == 0, "tel.work").otherwise("tel"), "c_name", F.lit("tel.home.cell"), "c_mktsegment")
    return read(spark, sf_dir, "customer").select("c_custkey", find_key(m, "tel").alias("tel"), find_key(m, "home").alias("home"))


@query("""SELECT s_suppkey, '{"name":"' || s_name || '","balance":' || CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) || '}' AS json FROM supplier""")
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3, B7, I4."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"), F.round("s_acctbal").cast("long").alias("balance"))).alias("json"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1 Main Street North' WHEN 1 THEN '22 Oak Avenue' ELSE '3 Rue' END AS street_address, CASE c_custkey % 3 WHEN 1 THEN 'Apt 5' END AS extended_address,
CASE c_custkey % 4 WHEN 0 THEN 'California' WHEN 1 THEN 'Ontario' WHEN 2 THEN 'Bavaria' ELSE 'British Columbia' END AS region, CASE c_custkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 3 THEN 'CA' END AS country,
CASE WHEN c_custkey % 2 = 0 THEN 'one' ELSE 'forty-four' END AS calling, CASE WHEN c_custkey % 2 = 0 THEN 'Toronto' END AS locality FROM customer""")
def scrubbed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8, D9, I95, I96, I98."""
    from inkstream.operators import contacts

    k = F.col("c_custkey")
    found = contacts.address(
        {
            "street-address": F.when(k % 3 == 0, "1 Main St. N").when(k % 3 == 1, "22 Oak Ave\n Apt 5").otherwise("3 Rue"),
            "region": F.when(k % 4 == 0, "ca").when(k % 4 == 2, "Bavaria").otherwise(""),
            "postal-code": F.when(k % 4 == 1, "m5v 1a1").when(k % 4 == 3, "V6B 1A1").otherwise("90210"),
            "country-name": F.lit(""),
        }
    )
    c = read(spark, sf_dir, "customer").select("c_custkey", *[v.alias(n) for n, v in found.items() if n != "postal_code"], F.when(k % 2 == 0, "+1 (416) 555-0000").otherwise("+44 20 7946 0000").alias("phone"))
    calling = spark.createDataFrame([("1", "one"), ("44", "forty-four")], "code string, country string")
    areas = spark.createDataFrame([("416", "Toronto")], "code string, locality string")
    return contacts.phone_places(c.withColumnRenamed("country", "_country"), calling, areas, "phone").withColumnsRenamed({"country": "calling", "_country": "country"}).drop("phone")


@query("""SELECT s_suppkey, '{"pk":' || s_suppkey || ',"model":"crawl.site","fields":{"name":"' || s_name || '","nation":' || CASE WHEN s_nationkey > 12 THEN CAST(s_nationkey AS VARCHAR) ELSE 'null' END || '}}' AS json FROM supplier""")
def serialized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a list of them is handed out."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.when(F.col("s_nationkey") > 12, F.col("s_nationkey")).alias("nation"))
    return store.serialized(s, "crawl.site", "s_suppkey")


@query("""SELECT '[' || string_agg('{"pk":' || c_custkey || ',"model":"crawl.author","fields":{"segment":"' || c_mktsegment || '","nation":' || c_nationkey || '}}', ',' ORDER BY '{"pk":' || c_custkey) || ']' AS json FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'""")
def record_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of one slug as JSON."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return store.detail_json(c, "crawl.author", "c_custkey", nation=7, segment="BUILDING")
