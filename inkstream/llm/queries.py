"""The registered queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import alignment, archives, byte_pairs, decontaminate, fill_middle, media, pieces, quality, repeats, secrets, shards, simhash, token_counts

#: Byte limit of a shard.
SHARD_BYTES = 1 << 20

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the package is looked up, never imported into the library."""
    spec = importlib.util.find_spec("public_tokenizers")
    root = spec.submodule_search_locations[0] if spec else "/opt/tokenizers"
    return f"{root}/{name}"


def op1_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_media(read(spark, sf_dir, "documents"))
    return media.read_media(stored, n_bytes="n_bytes")


def op2_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(read(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    back = archives.read_archives(archives.write_archives(pages, least=0))
    return back.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = token_counts.RULES
    found = token_counts.section_tokens(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), rules=rules)
    counts = {r: F.col(f"sections.{r}") for r in rules}
    digests = [F.sha2(F.array_join(c.cast("array<string>"), ","), 256).alias(f"{r}_sha256") for r, c in counts.items()]
    return found.select("doc_id", "n_tokens", F.size("sections").cast("long").alias("n_sections"), "n_crossing", F.array_max(counts["first"]).alias("most_tokens"), *digests)


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"), length=200)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(read(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.byte_digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_in_middle(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_media_jpeg": op1_media_jpeg,
    "op2_extendible_hashing": op2_extendible_hashing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_arc_to_warc": op4_arc_to_warc,
    "op5_section_tokens": op5_section_tokens,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_token_alignment": op11_token_alignment,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: SQL for the queries that it can express on whole tables. The others are held against brute force in tests: JPEG
#: coding, merges of pieces and XXH64 have no SQL form, byte windows of whole texts are too slow there.
ORACLE_SQL: dict[str, str] = {
    "op2_extendible_hashing": f"""
WITH h AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(source, '')), 1, 4) AS BIGINT)), 16, '0') || lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT)), 40, '0') AS bits FROM documents),
p AS (SELECT doc_id, n_bytes, d, substr(bits, 1, d) AS shard FROM h, (SELECT unnest(generate_series(0, 56)) AS d)),
s AS (SELECT d, shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY d, shard),
f AS (SELECT p.*, shard_bytes, shard_rows FROM p JOIN s USING (d, shard) WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1 OR d = 56 QUALIFY d = min(d) OVER (PARTITION BY doc_id))
SELECT doc_id, n_bytes, shard, CAST(d AS BIGINT) AS depth, shard_bytes, shard_rows, shard_bytes <= {SHARD_BYTES} AS fits FROM f""",
    "op4_arc_to_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages), h AS (SELECT *, sha1(html) AS h FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, i // 4 * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM h""",
    "op7_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bo AS (SELECT item, n, o, array_to_string(w[o:o + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS o FROM (SELECT item, w, least(len(w), 10) AS n FROM b) WHERE n > 0)),
bw AS (SELECT DISTINCT item, n, win FROM bo),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, n, item FROM dw JOIN bw USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS pos FROM m) GROUP BY doc_id),
isles AS (SELECT doc_id, item, n, k - o AS shift, k - row_number() OVER (PARTITION BY doc_id, item, n, k - o ORDER BY k) AS isle FROM dw JOIN bo USING (n, win)),
far AS (SELECT doc_id, max(words) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS words FROM isles GROUP BY doc_id, item, n, shift, isle) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN far USING (doc_id)""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS draws FROM d),
c AS (SELECT *, len(units) AS n, least(draws[1] % (len(units) + 1), draws[2] % (len(units) + 1)) AS low, greatest(draws[1] % (len(units) + 1), draws[2] % (len(units) + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN draws[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, CAST(n AS BIGINT) AS n, form, text, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
