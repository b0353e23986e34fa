"""Queries over the scalar functions: texts, dates, coercion, expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import coerce, dates, expression, template
from inkstream.functions import text as tx
from inkstream.operators import lookup
from inkstream.plans.base import NOW, query, read

_CAP = "array_to_string(list_transform(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


@query(r"""SELECT p_partkey, lower(trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS slug,
  lower(trim(regexp_replace(p_type, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS jslug FROM part""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3, I22."""
    return read(spark, sf_dir, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"), tx.jslug(F.col("p_type")).alias("jslug"))


@query(f"SELECT s_suppkey, {_CAP.format('s_name')} AS name, upper(s_name) AS up, lower(s_name) AS low FROM supplier")
def capitalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8, I19."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", tx.capwords(F.col("s_name")).alias("name"), F.upper("s_name").alias("up"), F.lower("s_name").alias("low"))


@query("""SELECT p_partkey, trim(p_brand, '#Bd') AS both_ends, ltrim(p_brand, 'Brand#') AS left_end, rtrim(p_brand, '0123456789') AS right_end,
  replace(p_brand, '#', '') AS cut FROM part""")
def stripped_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5, I10."""
    b = F.col("p_brand")
    return read(spark, sf_dir, "part").select("p_partkey", tx.strip(b, "#Bd").alias("both_ends"), tx.lstrip(b, "Brand#").alias("left_end"), tx.rstrip(b, "0123456789").alias("right_end"), tx.cut(b, "#").alias("cut"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w) AS n_words, w[1] AS first_word, w[len(w)] AS last_word, w[3] AS third, w[len(w) - 1] AS before_last,
  CASE WHEN len(w) > 0 THEN array_to_string(w[1:5], '|') END AS opening FROM w""")
def word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I6, I7, I15, I16, I17."""
    w = F.col("w")
    return (
        read(spark, sf_dir, "documents")
        .select("doc_id", F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != "").alias("w"))
        .select("doc_id", F.size(w).cast("long").alias("n_words"), tx.at_index(w, 0).alias("first_word"), tx.at_index(w, -1).alias("last_word"), tx.at_index(w, 2).alias("third"), tx.at_index(w, -2).alias("before_last"), tx.join(F.slice(w, 1, 5), "|").alias("opening"))
    )


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(l_linenumber AS BIGINT) + CAST(l_quantity AS BIGINT) AS VARCHAR) AS added,
  l_orderkey % 3 = 0 AS by_three, CASE WHEN l_linenumber = 1 THEN '' ELSE 's' END AS plural, CASE WHEN l_linenumber = 1 THEN 'y' ELSE 'ies' END AS plural_y,
  length(l_returnflag) = 1 AS one_long FROM lineitem""")
def number_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9, I14, I17, I20."""
    n = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", tx.add(n.cast("string"), F.col("l_quantity").cast("bigint").cast("string")).alias("added"), tx.divisible_by(F.col("l_orderkey"), 3).alias("by_three"),
        tx.pluralize(n).alias("plural"), tx.pluralize(n, "y,ies").alias("plural_y"), tx.length_is(F.col("l_returnflag"), 1).alias("one_long"),
    )


@query("""WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN 'False' ELSE event_type END AS v FROM events)
SELECT event_id, CASE WHEN v = '' THEN '' WHEN v IS NULL OR lower(v) IN ('0', 'false') THEN 'none' ELSE v END AS defaulted,
  CASE WHEN v IS NULL OR lower(v) IN ('', '0', 'false') THEN 'none' ELSE v END AS otherwise, coalesce(v, 'none') AS if_none FROM v""")
def default_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I11, I12, I13."""
    m = F.col("event_id") % 5
    v = F.when(m == 1, "").when(m == 2, "0").when(m == 3, "False").when(m == 4, F.col("event_type"))
    other = F.lit("none")
    return read(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", tx.default(F.col("v"), other).alias("defaulted"), tx.otherwise(F.col("v"), other).alias("otherwise"), tx.default_if_none(F.col("v"), other).alias("if_none"))


@query("""SELECT page_id, url_encode(url) AS quoted, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '"', '&quot;') AS escaped FROM pages""")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I23, I24."""
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", tx.url_quote(u).alias("quoted"), tx.escape_html(u).alias("escaped"))


@query(r"""SELECT conv_id, turn, '<p>' || replace(regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '"', '&quot;'), '\n\n+', '</p><p>', 'g'), chr(10), '<br />') || '</p>' AS html,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS one_line FROM conversations""")
def line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I18, I31."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.line_breaks(F.col("text")).alias("html"), tx.collapse_spaces(F.col("text")).alias("one_line"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(regexp_replace(json_extract_string(props, '$.k'), '[.].*$', '') AS BIGINT) AS k_int,
  coalesce(try_cast(event_type AS DOUBLE), -1.0) AS none_float, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind FROM events""")
def coerced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13, I90, I91."""
    k = coerce.json_path(F.col("props"), "k")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), coerce.to_int(k, None).alias("k_int"), coerce.to_float(F.col("event_type"), -1.0).alias("none_float"), coerce.to_enum(F.col("event_type"), ["click", "view"], "other").alias("kind"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'N' WHEN 2 THEN '3.9' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'abc' WHEN 6 THEN '7' ELSE '0' END AS v FROM events)
SELECT event_id, coalesce(try_cast(trim(regexp_replace(v, '[.].*$', '')) AS BIGINT), 0) AS as_int, coalesce(try_cast(v AS DOUBLE), 0.0) AS as_float,
  CASE WHEN v IS NULL OR v = '' THEN false WHEN lower(v) IN ('t','true','y','yes','1') THEN true WHEN lower(v) IN ('f','false','n','no','0') THEN false
       WHEN try_cast(v AS BIGINT) IS NOT NULL AND v NOT LIKE '%.%' THEN try_cast(v AS BIGINT) <> 0 ELSE true END AS as_bool FROM v""")
def coerced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I90."""
    m = F.col("event_id") % 8
    v = F.when(m == 0, "yes").when(m == 1, "N").when(m == 2, "3.9").when(m == 3, "").when(m == 5, "abc").when(m == 6, "7").when(m == 7, "0")
    return read(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", coerce.to_int(F.col("v")).alias("as_int"), coerce.to_float(F.col("v")).alias("as_float"), coerce.to_bool(F.col("v")).alias("as_bool"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%B') AS month_name, strftime(o_orderdate, '%b') AS month_abbr, strftime(o_orderdate, '%A') AS weekday,
  strftime(o_orderdate, '%d') AS day, strftime(o_orderdate, '%H') AS hour24, strftime(o_orderdate, '%p') AS ampm, CAST(month(o_orderdate) AS INTEGER) AS n_month,
  strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS rfc822 FROM orders""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I73, I75, I81."""
    ts = F.col("o_orderdate")
    p = dates.parts(ts)
    return read(spark, sf_dir, "orders").select("o_orderkey", *[p[k].alias(k) for k in ("year", "month_name", "month_abbr", "weekday", "day", "hour24", "ampm", "n_month")], dates.iso_date(ts).alias("iso"), dates.rfc822(ts).alias("rfc822"))


@query(f"""WITH t AS (SELECT o_orderkey, o_orderdate AS d, date_trunc('month', o_orderdate) + INTERVAL (CAST(o_orderkey % 14 AS INTEGER)) MONTH AS m FROM orders),
u AS (SELECT o_orderkey, d, m, CAST(day(last_day(m)) AS INTEGER) AS top FROM t)
SELECT o_orderkey, CAST(strftime(m, '%Y-%m-') || lpad(CAST(CASE WHEN day(d) <= top THEN day(d) WHEN top >= 30 THEN 30 ELSE 28 END AS VARCHAR), 2, '0') || strftime(d, ' %H:%M:%S') AS TIMESTAMP) AS later,
  CAST(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(d))) / 86400) AS BIGINT) AS age_days, CAST(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(d))) / 60) AS BIGINT) AS age_minutes FROM u""")
def date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I74, I76."""
    ts, now = F.col("o_orderdate"), F.lit(NOW).cast("timestamp")
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.add_months(ts, (F.col("o_orderkey") % 14).cast("int")).alias("later"), dates.age_in_days(ts, now).alias("age_days"), dates.age_in_minutes(ts, now).alias("age_minutes"))


_DATE_FORMS = (
    "yyyy", "yyyy-MM", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd'T'HH:mm:ss'.250Z'", "yyyy-MM-dd HH:mm'+05:30'", "'soon'", "yyyy/MM/dd", "yyyy-MM-dd'T'HH",
    "yyyyMMdd'T'HHmmss'-0400'", "yyyy-MM-dd'T'HH:mm' or so'", "yyyyMM", "' 'yyyy",
)


@query("""SELECT event_id, CASE event_id % 13 WHEN 0 THEN strftime(ts, '%Y') WHEN 1 THEN strftime(ts, '%Y-%m') WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
  WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M+05:30') WHEN 6 THEN '' WHEN 7 THEN strftime(ts, '%Y-%m-%d') WHEN 8 THEN strftime(ts, '%Y-%m-%dT%H') WHEN 9 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S-04:00')
  WHEN 10 THEN strftime(ts, '%Y-%m-%dT%H:%M') WHEN 11 THEN strftime(ts, '%Y-%m') ELSE '' END AS normal FROM events""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is given stays, nothing is added, what follows is passed over."""
    v = F.element_at(F.array(*[F.date_format("ts", f) for f in _DATE_FORMS]), (F.col("event_id") % len(_DATE_FORMS) + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", dates.normalize(F.col("v")).alias("normal"))


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 2 THEN date_trunc('second', ts) END AS parsed,
  CASE event_id % 3 WHEN 0 THEN TIMESTAMP '{NOW}' WHEN 1 THEN date_trunc('second', ts) - INTERVAL 1 HOUR END AS utc FROM events""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I70, I72, I80."""
    m, f = F.col("event_id") % 4, lambda p: F.date_format("ts", p)
    v = F.when(m == 0, f("yyyy-MM-dd'T'HH:mm:ss")).when(m == 1, f("dd MMM yyyy")).when(m == 2, f("EEE, dd MMM yyyy HH:mm:ss Z")).otherwise("no date")
    n = F.col("event_id") % 3
    given = F.when(n == 1, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))).when(n == 2, "no date")
    return read(spark, sf_dir, "events").select("event_id", dates.parse(v).alias("parsed"), dates.to_utc(given, F.lit(NOW).cast("timestamp")).alias("utc"))


@query("""WITH p AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) - floor(epoch(before)) AS BIGINT) AS s FROM p WHERE before IS NOT NULL)
SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS gap FROM s""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since the user's event before."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w)).filter("before is not null").select("event_id", dates.duration(F.col("before"), F.col("ts")).alias("gap"))


@query("""SELECT o_orderkey, (o_totalprice > 100000 AND o_orderstatus = 'F') OR o_orderkey < 100 AS big, o_orderstatus || '-' || o_orderpriority AS joined,
  CAST(o_totalprice AS BIGINT) IS NOT NULL AND NOT (o_orderstatus = 'O') AS not_open, o_totalprice - 10 >= 200000 AS less_ten FROM orders""")
def compiled_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6, C7, C18."""
    c = expression.compile_expression
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", c("o_totalprice > 100000 and o_orderstatus == 'F' or o_orderkey < 100").alias("big"), c("o_orderstatus + '-' + o_orderpriority").alias("joined"),
        c("true and not o_orderstatus == 'O'").alias("not_open"), c("o_totalprice - 10 >= 200000").alias("less_ten"),
    )


@query(r"""SELECT doc_id, regexp_extract(text, '([a-z]+)ing ([a-z]+)', 1) AS stem, regexp_extract(text, '([a-z]+)ing ([a-z]+)', 2) AS next_word, regexp_matches(text, '(token|password)') AS found,
  len(regexp_extract_all(text, '[0-9]+')) AS n_numbers FROM documents""")
def regex_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C19."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(t, "([a-z]+)ing ([a-z]+)", 1).alias("stem"), F.regexp_extract(t, "([a-z]+)ing ([a-z]+)", 2).alias("next_word"), t.rlike("(token|password)").alias("found"), F.size(F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1))).cast("long").alias("n_numbers"))


_FULL_NAMES = ("Dr. Ann {seg} Lee Jr", "Lee, Bob", "Cher", "Ms Ann {seg}, Lee", "MADAM {seg}", "Sir Tim, Q. Lee, III, Esq", "Lee,", " ")


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Dr.' WHEN 4 THEN 'MADAM' WHEN 5 THEN 'Sir' END AS honorific_prefix,
  CASE c_custkey % 8 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' WHEN 2 THEN 'Cher' WHEN 3 THEN 'Ms' WHEN 4 THEN c_mktsegment WHEN 5 THEN 'Tim' WHEN 6 THEN 'Lee' END AS given_name,
  CASE c_custkey % 8 WHEN 0 THEN c_mktsegment WHEN 3 THEN 'Ann' WHEN 5 THEN 'Q.' END AS additional_name,
  CASE c_custkey % 8 WHEN 0 THEN 'Lee' WHEN 1 THEN 'Lee' WHEN 3 THEN c_mktsegment WHEN 5 THEN 'Lee' END AS family_name,
  CASE c_custkey % 8 WHEN 0 THEN 'Jr' WHEN 3 THEN 'Lee' WHEN 5 THEN 'III' END AS honorific_suffix FROM customer""")
def implied_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with their points, a first word with a comma goes last, third and fourth words."""
    fn = F.replace(F.element_at(F.array(*map(F.lit, _FULL_NAMES)), (F.col("c_custkey") % len(_FULL_NAMES) + 1).cast("int")), F.lit("{seg}"), F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", fn.alias("fn"), "c_mktsegment").select("c_custkey", *[v.alias(k) for k, v in lookup.split_name(F.col("fn")).items()])


_SHOWN_NAMES = ("Ronald McDonald", "'o''brien'", '"bob lee" (work)', "", "ann.lee+x@Example.com", "mary (home) van der BERG", "@")


@query("""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Ronald McDonald' WHEN 1 THEN 'O' || chr(39) || chr(39) || 'brien' WHEN 2 THEN '"bob Lee"' WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN upper(substr(c_name, 1, 1)) || substr(c_name, 2) ELSE 'Some Body' END
  WHEN 4 THEN 'Ann Lee X' WHEN 5 THEN 'Mary Van Der BERG' ELSE 'No Name' END AS shown FROM customer""")
def scrubbed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes around go, comments go, words open with a capital and keep their case; of an address its local part."""
    fn = F.element_at(F.array(*map(F.lit, _SHOWN_NAMES)), (F.col("c_custkey") % len(_SHOWN_NAMES) + 1).cast("int"))
    org, mail = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(""), F.lit("some.body@example.com")
    return read(spark, sf_dir, "customer").select("c_custkey", lookup.scrub_name(fn, org, mail).alias("shown"))


@query("""SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@example.com' AS email, NOT (c_custkey % 3 = 0) AS uri_ok FROM customer""")
def scrubbed_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I47, I94."""
    mail = F.concat(F.lit(" mailto:"), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.com?subject=x"))
    uri = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ftp://"), "c_name")).otherwise(F.concat(F.lit("http://example.com/"), F.replace("c_name", F.lit("#"), F.lit("-"))))
    return read(spark, sf_dir, "customer").select("c_custkey", lookup.scrub_email(mail).alias("email"), lookup.valid_uri(uri).alias("uri_ok"))


@query("""WITH t AS (SELECT conv_id, list(role ORDER BY turn, role) AS roles, min(role) AS first_role FROM conversations GROUP BY conv_id)
SELECT conv_id, '<b>' || upper(first_role) || '</b> ' || CASE WHEN conv_id > 20 THEN 'late &amp; ' || CAST(conv_id AS VARCHAR) ELSE 'early' END || ': ' || array_to_string(list_transform(roles, lambda r, i: CAST(i AS VARCHAR) || '=' || r || CASE WHEN i = len(roles) THEN '.' ELSE ', ' END), '') || ' {{ raw }}' AS html FROM t""")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template with a condition, a loop and filters, compiled to one Column."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"), F.min("role").alias("first_role"), F.lit("late & ").alias("late"))
    text = "<b>{{ first_role|upper }}</b> {% if conv_id > 20 %}{{ late }}{{ conv_id }}{% else %}early{% endif %}: {% for r in roles %}{{ forloop.counter }}={{ r }}{% if forloop.last %}.{% else %}, {% endif %}{% endfor %} {% asis %}{{ raw }}{% endasis %}"
    return c.select("conv_id", template.compile_template(text).alias("html"))


@query("""SELECT c_custkey, c_name AS tel, c_mktsegment AS tel_work, 'x' AS tel_1, 3 AS n_all, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_known FROM customer""")
def record_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15, C16, C17, H3, H4."""
    from inkstream.functions import records

    m = F.create_map(F.lit("tel"), "c_name", F.lit("@hidden"), F.lit("h"))
    m = records.united(records.without_marks(m), F.create_map(F.lit("tel"), F.lit("lost"), F.lit("tel.work"), "c_mktsegment"))
    df = read(spark, sf_dir, "customer").select("c_custkey", records.add(m, "tel", F.lit("x")).alias("m"))
    known, _ = records.parted(F.col("m"), ["tel", "tel.work"])
    at = lambda k: F.try_element_at("m", F.lit(k))
    return df.select("c_custkey", at("tel").alias("tel"), at("tel.work").alias("tel_work"), at("tel.1").alias("tel_1"), F.size("m").alias("n_all"), F.when(F.col("c_custkey") % 2 == 0, F.size(known)).otherwise(F.size(records.with_parts(known, "work"))).alias("n_known"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'No. ' || c_custkey || ' in ' || lower(c_mktsegment) || '!' WHEN 1 THEN 'To ' || c_mktsegment || ': ' || CASE WHEN c_nationkey > 10 THEN 'far' ELSE 'near' END || ' from ' || c_custkey ELSE '' END AS line,
  CASE WHEN c_custkey % 3 <> 2 THEN 'say: ' || CASE c_custkey % 3 WHEN 0 THEN 'No. ' || c_custkey || ' in ' || lower(c_mktsegment) || '!' ELSE 'To ' || c_mktsegment || ': ' || CASE WHEN c_nationkey > 10 THEN 'far' ELSE 'near' END || ' from ' || c_custkey END ELSE 'say: ' END AS said FROM customer""")
def indirect_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row has a template of its own, and one that another template names."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    own = F.when(k % 3 == 0, F.concat(F.lit("No. "), k, F.lit(" in {{ c_mktsegment|lower }}!"))).when(k % 3 == 1, F.concat(F.lit("To {{ c_mktsegment }}: {% if c_nationkey > 10 %}far{% else %}near{% endif %} from "), k))
    rows = template.render(c.withColumn("own", own), "{{ *own }}", "line")
    twice = template.render(rows.withColumn("name", F.lit("say: {{ own|safe }}")), "{{ **name }}", "said")
    return twice.select("c_custkey", "line", "said")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 3) AND o_orderpriority <> '5-LOW' THEN CAST(o_custkey * 2 + 1 AS VARCHAR) ELSE o_orderpriority END AS pick,
  CAST((o_orderkey & 6) | (o_custkey << 3) AS BIGINT) AS bits, (3 - (o_orderkey % 7)) - floor((3 - (o_orderkey % 7)) / 4.0) * 4 AS turn, CAST(floor(o_custkey / 3.0) AS BIGINT) AS third FROM orders""")
def full_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators by their binding powers."""
    of = expression.compile_expression
    picked = of("o_custkey * 2 + 1 if o_orderkey % 5 in [1.0, 3.0] and not o_orderpriority == '5-LOW' else o_orderpriority")
    return read(spark, sf_dir, "orders").withColumns({"o_custkey": F.col("o_custkey").cast("long"), "o_orderkey": F.col("o_orderkey").cast("long")}).select(
        "o_orderkey", F.regexp_replace(picked, r"\.0$", "").alias("pick"), of("o_orderkey & 6 | o_custkey << 3").alias("bits"), of("(3 - o_orderkey % 7) % 4").cast("double").alias("turn"), of("o_custkey // 3").cast("long").alias("third"),
    )


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN date_trunc('second', ts) + INTERVAL 5 HOUR WHEN 1 THEN date_trunc('second', ts) - INTERVAL 90 MINUTE WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('minute', ts) - INTERVAL 1 HOUR
  WHEN 4 THEN date_trunc('second', ts) + INTERVAL 4 HOUR WHEN 5 THEN date_trunc('second', ts) - INTERVAL 9 HOUR WHEN 6 THEN date_trunc('second', ts) - INTERVAL 9 HOUR WHEN 7 THEN date_trunc('second', ts) - INTERVAL 9 HOUR END AS parsed FROM events""")
def feed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as feeds of nine kinds write them."""
    f, k = lambda p: F.date_format("ts", p), F.col("event_id") % 9
    hour, pm = F.hour("ts"), F.hour("ts") >= 12
    half = F.concat(F.when(pm, dates.KOREAN["pm"]).otherwise(dates.KOREAN["am"]), F.lit(" "), F.when(pm, hour - 12).otherwise(hour).cast("string"))
    month = lambda table: F.element_at(F.create_map(*[x for name, n in reversed(table.items()) for x in (F.lit(n), F.lit(name))]), F.month("ts"))
    hungarian = F.concat(f("yyyy-"), month(dates.HUNGARIAN_MONTHS), f("-dd'T'H:mm"), F.lit("+01:00"))
    greek = F.concat(F.element_at(F.array(*map(F.lit, dates.GREEK_DAYS)), F.dayofweek("ts")), f(", dd "), month({n: i for n, i in dates.GREEK_MONTHS.items() if n not in ("Μαώ", "Μαϊ", "Μαι", "Ιον", "Ιολ", "Αυγ", "Νοε")}), f(" yyyy HH:mm:ss"), F.lit(" EDT"))
    korean = F.concat(f("yyyy"), F.lit(dates.KOREAN["year"]), f(" MM"), F.lit(dates.KOREAN["month"]), f(" dd"), F.lit(dates.KOREAN["day"]), f(" HH:mm:ss"))
    v = (
        F.when(k == 0, F.concat(f("EEE, d MMM yy HH:mm:ss"), F.lit(" ET"))).when(k == 1, F.concat(f("yyyyMMdd'T'HHmmss"), F.lit("+0130"))).when(k == 2, f("yyyy-DDD")).when(k == 3, hungarian).when(k == 4, greek)
        .when(k == 5, f("yyyy-MM-dd HH:mm:ss.SSS")).when(k == 6, F.concat(f("yyyy-MM-dd "), half, f(":m:s"))).when(k == 7, korean).otherwise("no date")
    )
    return read(spark, sf_dir, "events").select("event_id", dates.parse_feed(v).alias("parsed"))
