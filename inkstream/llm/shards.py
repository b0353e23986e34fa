"""Operator 2, sharding by extendible hashing.

A row's hash has GROUP_BITS bits of its group's digest, KEY_BITS of its key's digest and ROW_BITS of its own number,
so rows of a group stay together as long as they fit, a group that holds a third of all rows still splits, and so do
rows of one repeated key. The directory is indexed by hash-prefix bits; a bucket over the byte limit splits on its next
bit, the others stay as they are. Each round looks STEP bits ahead at once, for the rows of oversized buckets only.

Null and empty texts have 0 bytes and get a shard like any other; null groups and keys hash as the empty text. A row
over the limit is a shard of its own, with `fits` false; texts of any length are read for their lengths only. Repeated
rows are rows of their own. An empty table has no shards. Further columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import column_at, project, settle

GROUP_BITS, KEY_BITS, ROW_BITS = 16, 40, 32
#: Bits of group and key, which make one number, and all bits.
HEAD, BITS = GROUP_BITS + KEY_BITS, GROUP_BITS + KEY_BITS + ROW_BITS
STEP = 8
#: Directory rows (some 100 bytes each) that may be broadcast; larger directories are joined by shuffling.
BROADCAST_ROWS = 20_000


def _digest_bits(value: Column, bits: int) -> Column:
    hexed = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(hexed, 1, bits // 4), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    """The first bits of a row's hash as text."""
    head = F.expr(f"lpad(bin(shiftright(hash, {max(0, HEAD - bits)})), {min(bits, HEAD)}, '0')")
    return head if bits <= HEAD else F.concat(head, F.expr(f"lpad(bin(shiftright(tail, {BITS - bits})), {bits - HEAD}, '0')"))


def _split(rows: DataFrame, base: int, limit: int) -> DataFrame:
    """Directory of one round: fine prefix of base + STEP bits -> shard (a prefix of it), its bytes and rows; shard is
    null where even the finest bucket is over the limit and more bits are left."""
    bits = base + STEP
    fine = rows.groupBy(_prefix(bits).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    depths = F.explode(F.sequence(F.lit(0 if base == 0 else base + 1), F.lit(bits))).alias("d")
    parts = fine.select("fine", "b", "n", depths).withColumn("shard", F.expr("substr(fine, 1, d)"))
    sums = parts.groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.length("shard") == BITS))
    first = parts.join(fits, "shard").groupBy("fine").agg(F.min_by(F.struct("shard", "shard_bytes", "shard_rows"), "d").alias("s"))
    return fine.select("fine").join(first, "fine", "left").select("fine", "s.shard", "s.shard_bytes", "s.shard_rows")


def _assigned(rows: DataFrame, limit: int) -> DataFrame:
    """rows (key, n_bytes, hash, tail, in the shared folder) with shard, shard_bytes and shard_rows."""
    left, done = rows, []
    for base in range(0, BITS, STEP):
        directory = settle(_split(left, base, limit), "shard-directory")
        side = F.broadcast(directory) if directory.count() <= BROADCAST_ROWS else directory
        met = left.withColumn("fine", _prefix(base + STEP)).join(side, "fine")
        done.append(met.filter("shard is not null").drop("fine"))
        if directory.filter("shard is null").isEmpty():
            break
        left = settle(met.filter("shard is null").select(*rows.columns), "shard-rows")
    return reduce(DataFrame.unionByName, done)


def _hashed(rows: DataFrame) -> DataFrame:
    """key, n_bytes, hash and tail (bits of the row's number) of rows with key, text, grouped and _row."""
    whole = _digest_bits(F.col("grouped"), GROUP_BITS) * (1 << KEY_BITS) + _digest_bits(F.col("key"), KEY_BITS)
    tail = F.xxhash64("_row").bitwiseAND((1 << ROW_BITS) - 1)
    return rows.select("key", "_row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), whole.alias("hash"), tail.alias("tail"))


def assign_shards(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text", group: str = "source") -> DataFrame:
    """key, n_bytes, shard (its hash-prefix bits as text), depth, shard_bytes, shard_rows, fits.

    Texts are read once, for their lengths; rounds work on (key, hash, length) rows in the shared folder.
    """
    rows = project(df, key=key, text=text, grouped=group).withColumn("_row", F.monotonically_increasing_id())
    every = _assigned(settle(_hashed(rows), "shard-rows"), limit)
    return every.select(F.col("key").alias(key), "n_bytes", "shard", F.length("shard").cast("long").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))


def write_shards(df: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text", group: str = "source") -> str:
    """Writes every row once, as partitions of a Parquet table by its shard; the name of the partitions' column.

    Rows are numbered and written to the shared folder first, so repeated and null ids neither double nor lose rows.
    Columns keep their names, other than those that repeat an earlier one but for the case, which get a number; the
    partitions' column is `shard`, with as many _ as it takes not to be one of them.
    """
    names: list[str] = []
    for c in df.columns:
        taken, n, out = {x.lower() for x in names}, 2, c
        while out.lower() in taken:
            out, n = f"{c}_{n}", n + 1
        names.append(out)
    name = "shard"
    while name in {x.lower() for x in names}:
        name += "_"
    wanted = {k: column_at(df.columns, v) for k, v in (("key", key), ("text", text), ("grouped", group))}
    flat = settle(df.toDF(*[f"_c{i}" for i in range(len(names))]).withColumn("_row", F.monotonically_increasing_id()), "shard-texts")
    hashed = settle(_hashed(flat.select("_row", *[F.col(f"_c{i}").alias(k) for k, i in wanted.items()])), "shard-rows")
    # the directory of a shard without bits has the empty name, which a partition cannot have
    told = _assigned(hashed, limit).select("_row", F.concat(F.lit("s"), "shard").alias("_shard"))
    dealt = flat.join(told, "_row").drop("_row").repartition("_shard").toDF(*names, name)
    dealt.write.partitionBy(name).parquet(path)
    return name
