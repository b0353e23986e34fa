"""A full-text index kept as tables beside the documents: ranked queries read the postings of their words only.

Under a folder lie, for each batch of changed documents (`gen`, counted up):

* `postings/gen=/bucket=`: a row for each term and cell of documents. A cell is a range of 4,096 document numbers, so a row
  is bounded however frequent its term is, and the cells of all terms line up. It holds the sorted numbers, how often the
  term occurs and how long the documents are, and beside these its count, the highest frequency and the least length,
  which bound what any document of the cell can score. Rows are sorted by term and cell in files bucketed by the term's
  hash; the second version of Parquet's pages stores sorted numbers as differences.
* `docs/gen=`: number and length of the batch's documents.
* `dead/gen=`: documents whose earlier postings no longer count, as they were changed or deleted.
* `totals/gen=`: changes in the number of documents and words. Written last: a batch without totals does not exist, and is
  written anew when it is repeated.

Words are runs of letters and digits in lower case. Null and empty texts are documents without words, null numbers are
left out. A number that a batch repeats counts once, with its greatest text.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkstream.operators.search import BM25_B, BM25_K1, query_words, words_of

#: Document numbers of a cell, as a power of two.
CELL_BITS = 12
BUCKETS = 64
#: Cells that an early-stopping query scores before it rules out others.
FIRST_CELLS = 16
#: Parts of a bucket's cells when postings are written.
PARTS = 8
#: Rows, of two numbers each, up to which dead documents are broadcast; beyond it the entries of postings are shuffled.
BROADCAST_ROWS = 1_000_000
_SCHEMAS = {
    "postings": "term string, cell long, n int, most int, least int, docs array<long>, tfs array<int>, sizes array<int>, gen long, bucket int",
    "docs": "doc long, size int, gen long",
    "dead": "doc long, gen long",
    "totals": "n_docs long, n_words long, since long, gen long",
}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def batches(spark: SparkSession, path: str) -> list[int]:
    """The finished batches that count, those before the last merge left out. A row for each batch is read."""
    if not _exists(spark, f"{path}/totals"):
        return []
    rows = _table(spark, path, "totals").select("gen", "since").collect()
    since = max((r.since for r in rows), default=0)
    return sorted(r.gen for r in rows if r.gen >= since)


def _live(spark: SparkSession, path: str, name: str, gens: list[int]) -> DataFrame:
    return _table(spark, path, name).filter(F.col("gen").isin(gens))


def _cell() -> Column:
    return F.shiftright("doc", CELL_BITS).alias("cell")


def _postings(tokens: DataFrame) -> DataFrame:
    """(doc, size, w) as rows of the postings: counted within documents, then gathered by term and cell. Nothing is shuffled
    if the tokens have their cell beside them and are dealt by it."""
    words = tokens.select("doc", "size", "cell" if "cell" in tokens.columns else _cell(), F.explode("w").alias("term"))
    return _cells(words.groupBy("term", "cell", "doc", "size").agg(F.count(F.lit(1)).cast("int").alias("tf")))


def _cells(entries: DataFrame) -> DataFrame:
    """Entries (term, cell, doc, tf, size), dealt by cell, gathered by term and cell: 4,096 at most in each."""
    entry = F.struct("doc", "tf", "size")
    cells = entries.groupBy("term", "cell").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    each = lambda name: F.transform("e", lambda x: x[name])
    return cells.select(
        "term", "cell", F.size("e").alias("n"), F.array_max(each("tf")).alias("most"), F.array_min(each("size")).alias("least"),
        each("doc").alias("docs"), each("tf").alias("tfs"), each("size").alias("sizes"),
    )


def _write_postings(rows: DataFrame, path: str, gen: int) -> None:
    """In files by bucket, sorted by term and cell; a bucket spreads over several tasks and files by its cells, so one with
    a frequent term does too. Dealt by hash: ranges would make the rows twice, once to sample them."""
    at = rows.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int"))
    sorted_rows = at.repartition("bucket", F.pmod("cell", F.lit(PARTS))).sortWithinPartitions("bucket", "term", "cell")
    sorted_rows.write.mode("overwrite").option("parquet.writer.version", "v2").partitionBy("bucket").parquet(f"{path}/postings/gen={gen}")


def append(path: str, changed: DataFrame, key: str, field: str, deleted: DataFrame | None = None, gen: int | None = None) -> int:
    """Adds a batch of new or changed documents and takes out deleted ones (a table with the key). Returns its number.

    A batch that is repeated under its number replaces itself. Only the keys and lengths of earlier batches are read.
    """
    spark = changed.sparkSession
    known = batches(spark, path)
    gen = max(known, default=-1) + 1 if gen is None else gen
    earlier = [g for g in known if g < gen]
    docs = changed.select(F.col(key).cast("long").alias("doc"), F.col(field).alias("text")).filter("doc is not null")
    if not docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # reads numbers alone; texts are shuffled only if some repeat
        docs = docs.groupBy("doc").agg(F.max("text").alias("text"))
    tokens = docs.select("doc", F.size(words_of(F.col("text"))).alias("size"))
    # Texts are dealt by cell, some thousand documents each, instead of their words by term.
    dealt = docs.select("doc", _cell(), "text").repartition("cell").select("doc", "cell", words_of(F.col("text")).alias("w"))
    _write_postings(_postings(dealt.select("doc", "cell", F.size("w").alias("size"), "w")), path, gen)
    tokens.write.mode("overwrite").parquet(f"{path}/docs/gen={gen}")
    written = spark.read.schema("doc long, size int").parquet(f"{path}/docs/gen={gen}")
    touched = written.select("doc")
    if deleted is not None:
        touched = touched.union(deleted.select(F.col(key).cast("long").alias("doc")).filter("doc is not null")).distinct()
    before = current(spark, path, earlier).join(touched, "doc", "left_semi") if earlier else spark.createDataFrame([], "doc long, size int")
    before.select("doc").write.mode("overwrite").parquet(f"{path}/dead/gen={gen}")
    gone = spark.read.schema("doc long").parquet(f"{path}/dead/gen={gen}")
    lost = current(spark, path, earlier).join(gone, "doc", "left_semi").select((-F.lit(1)).alias("n"), (-F.col("size")).alias("words")) if earlier else None
    change = written.select(F.lit(1).alias("n"), F.col("size").alias("words"))
    change = change if lost is None else change.union(lost)
    totals = change.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("n_words"))
    totals.withColumn("since", F.lit(min([*earlier, gen])).cast("long")).write.mode("overwrite").parquet(f"{path}/totals/gen={gen}")
    return gen


def current(spark: SparkSession, path: str, gens: list[int] | None = None) -> DataFrame:
    """(doc, size) of the documents that count: those that no later batch changed or deleted."""
    gens = batches(spark, path) if gens is None else gens
    docs = _live(spark, path, "docs", gens)
    return _without_dead(docs, _live(spark, path, "dead", gens)).select("doc", "size")


def _without_dead(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows (doc, gen) that no later batch took out; dead documents are broadcast if they are found to be few."""
    last = dead.groupBy("doc").agg(F.max("gen").alias("_dead"))
    last = F.broadcast(last) if dead.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else last
    return rows.join(last, "doc", "left").filter(F.col("_dead").isNull() | (F.col("gen") >= F.col("_dead"))).drop("_dead")


def merge(path: str, spark: SparkSession) -> int:
    """All batches as one, without what is dead; later queries read that alone. Returns its number."""
    gens = batches(spark, path)
    gen = max(gens) + 1
    blocks = _live(spark, path, "postings", gens).select("term", "gen", "cell", "docs", "tfs", "sizes").repartition("cell")  # as they are, not by entry
    hits = _without_dead(_entries(blocks, "cell"), _live(spark, path, "dead", gens))
    _write_postings(_cells(hits), path, gen)
    current(spark, path, gens).write.mode("overwrite").parquet(f"{path}/docs/gen={gen}")
    spark.createDataFrame([], "doc long").write.mode("overwrite").parquet(f"{path}/dead/gen={gen}")
    totals = _totals(spark, path, gens)
    totals.withColumn("since", F.lit(gen).cast("long")).write.mode("overwrite").parquet(f"{path}/totals/gen={gen}")
    return gen


def _totals(spark: SparkSession, path: str, gens: list[int]) -> DataFrame:
    return _live(spark, path, "totals", gens).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))


def _blocks(spark: SparkSession, path: str, words: list[str], gens: list[int]) -> DataFrame:
    """The rows of the words' postings: their buckets are partitions, terms and cells are pushed to the scan."""
    buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
    return _live(spark, path, "postings", gens).filter(F.col("bucket").isin(buckets) & F.col("term").isin(words))


def _entries(blocks: DataFrame, *more: str) -> DataFrame:
    """(term, gen, doc, tf, size) of blocks, and more of their columns."""
    zipped = F.explode(F.arrays_zip("docs", "tfs", "sizes")).alias("e")
    return blocks.select("term", "gen", *more, zipped).select("term", "gen", *more, F.col("e.docs").alias("doc"), F.col("e.tfs").alias("tf"), F.col("e.sizes").alias("size"))


def _weight(tf, size, average):
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * size / average))


def _scores(hits: DataFrame, idf: dict[str, float], average: float, key: str) -> DataFrame:
    """Scores of documents, from hits (term, doc, tf, size)."""
    table = F.create_map(*[x for w, v in idf.items() for x in (F.lit(w), F.lit(v))])
    each = F.element_at(table, F.col("term")) * _weight(F.col("tf"), F.col("size"), F.lit(average))
    return hits.groupBy(F.col("doc").alias(key)).agg(F.sum(each).alias("score"))


def _weights(spark: SparkSession, path: str, words: list[str], gens: list[int]) -> tuple[dict[str, float], float]:
    """The words' inverse document frequencies and the average length: a row for each word, from the counts of blocks; only
    blocks that hold dead documents are opened."""
    blocks = _blocks(spark, path, words, gens)
    dead = _live(spark, path, "dead", gens)
    counts = blocks.groupBy("term").agg(F.sum("n").alias("n"))
    spoilt = blocks.join(dead.select(F.shiftright("doc", CELL_BITS).alias("cell")).distinct(), "cell", "left_semi")
    hits = _entries(spoilt)
    lost = hits.join(_without_dead(hits, dead).select("term", "gen", "doc"), ["term", "gen", "doc"], "left_anti").groupBy("term").agg((-F.count(F.lit(1))).alias("n"))
    df = counts.union(lost).groupBy("term").agg(F.sum("n").alias("n"))
    total = F.broadcast(_totals(spark, path, gens))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    rows = df.crossJoin(total).select("term", idf.alias("idf"), (F.col("n_words") / F.col("n_docs")).alias("average")).collect()
    return {r.term: r.idf for r in rows}, max((r.average for r in rows), default=0.0)


def ranked(spark: SparkSession, path: str, query: str, key: str = "doc") -> DataFrame:
    """(key, score) of all documents that hold any word of the query; an empty query matches all, at nought."""
    gens, words = batches(spark, path), query_words(query)
    if not words:
        return current(spark, path, gens).select(F.col("doc").alias(key), F.lit(0.0).alias("score"))
    idf, average = _weights(spark, path, words, gens)
    if not idf:
        return spark.createDataFrame([], f"{key} long, score double")
    hits = _without_dead(_entries(_blocks(spark, path, list(idf), gens)), _live(spark, path, "dead", gens))
    return _scores(hits, idf, average, key)


def top(spark: SparkSession, path: str, query: str, k: int, key: str = "doc") -> DataFrame:
    """The k best of `ranked`, ties by number; cells that cannot hold one of them are not opened.

    What a cell's blocks can score at most is summed over the words. The most promising cells are scored first; the k-th
    score among their documents then rules out every cell whose bound is below it.
    """
    gens, words = batches(spark, path), query_words(query)
    best = [F.desc("score"), F.col(key)]
    if not words:
        return ranked(spark, path, query, key).orderBy(*best).limit(k)
    idf, average = _weights(spark, path, words, gens)
    if not idf:
        return spark.createDataFrame([], f"{key} long, score double")
    blocks = _blocks(spark, path, list(idf), gens)
    dead = _live(spark, path, "dead", gens)
    table = F.create_map(*[x for w, v in idf.items() for x in (F.lit(w), F.lit(v))])
    bound = F.element_at(table, F.col("term")) * _weight(F.col("most"), F.col("least"), F.lit(average))
    # A document is live in one batch at most, so of several batches' blocks the highest bound holds.
    bounds = blocks.groupBy("cell", "term").agg(F.max(bound).alias("b")).groupBy("cell").agg(F.sum("b").alias("bound"))
    first = [r.cell for r in bounds.orderBy(F.desc("bound"), "cell").limit(FIRST_CELLS).collect()]
    score = lambda rows: _scores(_without_dead(_entries(rows), dead), idf, average, key)
    opened = score(blocks.filter(F.col("cell").isin(first))).orderBy(*best).limit(k).collect()
    if len(opened) < k:
        return score(blocks).orderBy(*best).limit(k)
    # Sums of doubles may differ in the last digits by their order, so a bound that close is not ruled out.
    rest = bounds.filter((F.col("bound") >= opened[-1].score * (1 - 1e-9)) & ~F.col("cell").isin(first)).select("cell")
    more = score(blocks.join(rest, "cell", "left_semi"))
    kind = T.StructType([T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame(opened, kind).unionByName(more).orderBy(*best).limit(k)
