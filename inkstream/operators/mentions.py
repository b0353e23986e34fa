"""Mentions of known names in texts, by an Aho-Corasick automaton: every text is read once for all names of a block.

A mention is a name that stands between word bounds (letters, digits and underscores make words). Of names that begin at
one place the longest counts, and of mentions that overlap the one further left. The gazetteer is read in blocks of at most
BLOCK_BYTES of names; each block is sent to the executors, who build its automaton once in each Python worker, and is one
pass over the texts. What several blocks find is brought together by text, where the rule for overlaps is applied anew: a
mention that loses within its block loses against the same mention in all, so blocks change nothing.

Null texts have no mentions; null and empty names name nothing. A name of several kinds has all of them, in order. Texts of
any length are read whole. Repeated rows give repeated rows. Further columns may have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.shared import settled
from inkstream.shipping import ship
from inkstream.sources.arrow import slices

#: Bytes of names in one block; their automaton takes some 60 times that in each Python worker.
BLOCK_BYTES = 2 << 20
_MENTION = "array<struct<offset:int,length:int,name:string,kinds:array<string>>>"


def folded(text: str) -> str:
    """In lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Names:
    """The automaton of a block of names with their kinds."""

    def __init__(self, names: list[tuple[str, list[str]]], fold: bool):
        import ahocorasick

        self.fold, self.names = fold, names
        self.automaton = ahocorasick.Automaton()
        at: dict[str, int] = {}
        for i, (name, _) in enumerate(names):
            at.setdefault(folded(name) if fold else name, i)
        for form, i in at.items():
            self.automaton.add_word(form, (len(form), i))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(offset, length, name) of the longest name at every place where one begins, overlaps left in."""
        if not len(self.automaton):
            return []
        body = folded(text) if self.fold else text
        n, best = len(body), {}
        word = lambda i: body[i].isalnum() or body[i] == "_"
        for last, (size, i) in self.automaton.iter(body):
            start = last + 1 - size
            if (last + 1 < n and word(last) and word(last + 1)) or (start and word(start) and word(start - 1)):
                continue
            if start not in best or size > best[start][0]:
                best[start] = size, i
        return [(s, *best[s]) for s in sorted(best)]


def leftmost(found: list[tuple]) -> list[tuple]:
    """Of (offset, length, ...) by offset those that no earlier one overlaps."""
    out, end = [], 0
    for m in found:
        if m[0] >= end:
            out.append(m)
            end = m[0] + m[1]
    return out


def _undisputed(batches: Iterator) -> Iterator:
    """(_row, mentions by offset, longest first at a place) without overlaps."""
    import pyarrow as pa

    for batch in (part for whole in batches for part in slices(whole, 1, 64)):
        kept = [leftmost([(m["offset"], m["length"], m) for m in found]) for found in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[m for _, _, m in x] for x in kept], batch.schema.field(1).type)], schema=batch.schema)


_BUILT: dict[str, Names] = {}


def _blocks(gazetteer: DataFrame, name: str, kind: str, limit: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Names with their kinds, a bounded block at a time."""
    names = gazetteer.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(F.col(name).alias("n")).agg(F.sort_array(F.collect_set(kind)).alias("k"))
    block: list[tuple[str, list[str]]] = []
    size = 0
    for r in names.toLocalIterator():
        block.append((r.n, list(r.k)))
        size += len(r.n.encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_mentions(docs: DataFrame, gazetteer: DataFrame, key: str, text: str, name: str = "name", kind: str = "kind", fold: bool = False, limit: int = BLOCK_BYTES) -> DataFrame:
    """key and mentions: array of (offset, length, name, kinds) in characters, in order. One block takes no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    todo = _blocks(gazetteer, name, kind, limit)
    block, following = next(todo, []), next(todo, None)
    if following is None:
        return _pass(rows, block, fold, ["key"], True).withColumnRenamed("key", key)
    rows = settled(rows.withColumn("_row", F.monotonically_increasing_id()), "mention-rows")
    found = []
    while block:
        found.append(settled(_pass(rows, block, fold, ["_row"], False).filter(F.size("mentions") > 0), "mentions"))
        block, following = following, next(todo, None)
    by_place = lambda a, b: F.when(a["offset"] != b["offset"], a["offset"] - b["offset"]).otherwise(b["length"] - a["length"])
    every = reduce(DataFrame.unionByName, found).groupBy("_row").agg(F.flatten(F.collect_list("mentions")).alias("m"))
    best = every.select("_row", F.array_sort("m", by_place).alias("mentions")).mapInArrow(_undisputed, f"_row long, mentions {_MENTION}")
    return rows.join(best, "_row", "left").select(F.col("key").alias(key), F.coalesce("mentions", F.array().cast(_MENTION)).alias("mentions"))


def _pass(rows: DataFrame, block: list[tuple[str, list[str]]], fold: bool, kept: list[str], settle_overlaps: bool) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    sent, mark = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    schema = StructType([*rows.select(*kept).schema.fields, *_parse_datatype_string(f"mentions {_MENTION}").fields])
    arrow = to_arrow_schema(schema)
    listed = arrow.field("mentions").type
    item = listed.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _BUILT:
            _BUILT.clear()
            _BUILT[mark] = Names(sent.value, fold)
        known = _BUILT[mark]
        for batch in (part for whole in batches for part in slices(whole, "text")):
            flat, ends = [], [0]
            for t in batch.column("text").to_pylist():
                found = known.find(t) if t else []
                flat += leftmost(found) if settle_overlaps else found
                ends.append(len(flat))
            offsets, lengths, which = zip(*flat, strict=True) if flat else ((), (), ())
            kinds = [known.names[i][1] for i in which]
            columns = [pa.array(offsets, pa.int32()), pa.array(lengths, pa.int32()), pa.array([known.names[i][0] for i in which], pa.string()), pa.array(kinds, item.field("kinds").type)]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(item)), type=listed)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], schema=arrow)

    return rows.select(*kept, "text").mapInArrow(run, schema)


def entities(found: DataFrame, key: str) -> DataFrame:
    """(key, kind, name, n): what each text mentions and how often, as rows for the store of entities."""
    flat = found.select(key, F.explode("mentions").alias("m")).select(key, "m.name", F.explode("m.kinds").alias("kind"))
    return flat.groupBy(key, "kind", "name").agg(F.count(F.lit(1)).alias("n"))
