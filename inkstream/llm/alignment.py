"""Operator 11, cross-tokenizer alignment by union-find over the graph of overlapping tokens.

Each text is encoded by two vocabularies, A (byte-level pairs, a space put ahead) and B (SentencePiece, which puts one
ahead itself), so that both spell the same bytes. Tokens are the nodes of a bipartite graph, with an edge where an A and
a B token overlap: one for each stretch of bytes between neighbouring token ends. Union-find joins them, all edges of a
slice at once: every root takes the least root it has an edge to, then all nodes are pointed at their roots, until no
edge joins two roots; the number of rounds grows as the logarithm of a component's size. The connected components are
exactly the minimal groups of tokens that cover the same bytes. Members of a component are expanded to links (an A and a
B token of one group), and id pairs are counted over all documents by Spark.

A document's links are handed to Spark as distinct id pairs with how often each occurs, so a pair's row count is the
number of documents that hold it. Groups of many tokens (runs of one letter that two vocabularies cut unevenly) are
reduced to distinct ids before they are expanded: work and memory follow the distinct pairs of a document, which are the
result. Pairs that many documents hold are looked up in a broadcast table of bounded size, all others by a shuffle; so no
frequent pair meets in one task, and every pair is counted.

Texts that are null or empty, or that the tokens of A or B do not spell (SentencePiece turns U+2581 into a space), have
no tokens, groups and links. Texts of any length are read whole. Each row is a document of its own, repeated rows and
null keys too. An empty table gives none. Further columns may have any names.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm import byte_pairs, pieces
from inkstream.llm.common import BROADCAST_ROWS, map_slices, project, settle, strings

#: Links of a group above which its distinct ids are expanded instead of its tokens.
GROUP_LINKS = 256
_BETWEEN, _SIDES, _GROUPS, _NONE = range(4)


def union_find(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of size nodes, the least node of its component; left and right are the ends of all edges."""
    parent = np.arange(size)
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


class Aligned:
    """The tokens of several texts one after another, with the groups they form.

    a, b: ids; a_at, b_at: the n + 1 places where texts start; a_end, b_end: bytes at which tokens end, counted through all
    texts; a_group, b_group: groups, numbered through all texts in order.
    """

    def __init__(self, texts: list[str], first: byte_pairs.BytePairs, second: pieces.Pieces):
        self.first, self.second = first, second
        a, a_at = first.encode([" " + t if t else "" for t in texts])
        b, b_at = second.encode(texts)
        a_raw, a_byte = first.decode(a), np.concatenate([[0], np.cumsum(first.spelt_len[a])])[a_at]
        b_raw, b_byte = second.spell(b), np.concatenate([[0], np.cumsum(second.spelt_len[b])])[b_at]
        same = np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            if t:
                raw = (" " + t).encode()
                same[i] = a_raw[a_byte[i] : a_byte[i + 1]].tobytes() == raw == b_raw[b_byte[i] : b_byte[i + 1]].tobytes()
        self.a, self.a_at = self._kept(a, a_at, same)
        self.b, self.b_at = self._kept(b, b_at, same)
        self.a_end, self.b_end = np.cumsum(first.spelt_len[self.a]), np.cumsum(second.spelt_len[self.b])
        self._group()

    @staticmethod
    def _kept(ids: np.ndarray, at: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(at)
        return ids[np.repeat(same, size)], np.concatenate([[0], np.cumsum(np.where(same, size, 0))])

    def _group(self) -> None:
        ends = np.sort(np.concatenate([self.a_end, self.b_end]), kind="stable")
        ends = ends[np.diff(ends, prepend=0) > 0]
        n = len(self.a)
        left, right = np.searchsorted(self.a_end, ends), np.searchsorted(self.b_end, ends)
        root = union_find(n + len(self.b), left, n + right)
        number = np.cumsum(root[:n] == np.arange(n)) - 1
        self.a_group, self.b_group = number[root[:n]], number[root[n:]]
        groups = int(number[-1]) + 1 if n else 0
        self.a_size, self.b_size = np.bincount(self.a_group, minlength=groups), np.bincount(self.b_group, minlength=groups)
        self.group_at = np.append(self.a_group, groups)[self.a_at]  # the first group of each text, and where they end

    def links(self) -> np.ndarray:
        """Links of each text."""
        total = np.concatenate([[0], np.cumsum(self.a_size * self.b_size)])
        return np.diff(total[self.group_at])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, A id, B id and number of links, for each distinct id pair of each text, in this order."""
        text = np.repeat(np.arange(len(self.group_at) - 1), np.diff(self.group_at))
        a_first, b_first = np.cumsum(self.a_size) - self.a_size, np.cumsum(self.b_size) - self.b_size
        count = self.a_size * self.b_size
        wide = len(self.second.spelt_len)
        base = len(self.first.spelt_len) * wide
        few = np.flatnonzero(count <= GROUP_LINKS)
        n = count[few]
        group = np.repeat(few, n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        across = self.b_size[group]
        a, b = self.a[a_first[group] + k // across], self.b[b_first[group] + k % across]
        keys, weights = [text[group] * base + a.astype(np.int64) * wide + b], [np.ones(len(k), np.int64)]
        for g in np.flatnonzero(count > GROUP_LINKS).tolist():
            a, m = np.unique(self.a[a_first[g] : a_first[g] + self.a_size[g]], return_counts=True)
            b, n = np.unique(self.b[b_first[g] : b_first[g] + self.b_size[g]], return_counts=True)
            keys.append((text[g] * base + a.astype(np.int64)[:, None] * wide + b).ravel())
            weights.append((m[:, None] * n).ravel())
        key, weight = np.concatenate(keys), np.concatenate(weights)
        if not len(key):
            return key, key, key, weight
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, weight = key[first], np.add.reduceat(weight[order], first)
        return key // base, key % base // wide, key % wide, weight

    def spelt(self) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`; nothing for a text without tokens."""
        sizes = (len(self.first.spelt_len), len(self.second.spelt_len))
        most = max(sizes)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.diff(self.a_group, append=-1) != 0, np.diff(self.b_group, append=-1) != 0
        sep_b = np.where(last_b, _GROUPS, _BETWEEN)
        sep_b[self.b_at[1:][np.diff(self.b_at) > 0] - 1] = _NONE
        a_before, b_before = np.cumsum(self.a_size), np.cumsum(self.b_size) - self.b_size
        code[np.arange(len(self.a)) + b_before[self.a_group]] = self.a + np.where(last_a, _SIDES, _BETWEEN) * most
        code[np.arange(len(self.b)) + a_before[self.b_group]] = self.b + sep_b * most
        names = list(map(_names(most).__getitem__, code.tolist()))
        return ["".join(names[i:j]) for i, j in itertools.pairwise((self.a_at + self.b_at).tolist())]


_NAMES: dict[int, list[str]] = {}


def _names(most: int) -> list[str]:
    """Decimal ids with what follows them: a comma, a bar, a semicolon, nothing."""
    if most not in _NAMES:
        _NAMES[most] = [f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(most)]
    return _NAMES[most]


def align_tokens(df: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, and for the tokens of A and of B in order: ids, the byte of space + text at which each ends, and its group.

    vocabulary: a byte-level vocabulary (JSON or rank file), model: a SentencePiece model. No shuffle.
    """
    rows = project(df, key=key, text=text)

    def kernel(batch: pa.RecordBatch) -> dict:
        found = Aligned(strings(batch.column("text")), byte_pairs.load(vocabulary), pieces.load(model))
        out: dict = {"key": batch.column("key")}
        for side, ids, at, end, group in (("a", found.a, found.a_at, found.a_end, found.a_group), ("b", found.b, found.b_at, found.b_end, found.b_group)):
            size = np.diff(at)
            start = np.concatenate([[0], end])[at[:-1]]
            where = pa.array(at.astype(np.int32))
            out[f"{side}_ids"] = pa.ListArray.from_arrays(where, pa.array(ids.astype(np.int32)))
            out[f"{side}_ends"] = pa.ListArray.from_arrays(where, pa.array((end - np.repeat(start, size)).astype(np.int32)))
            out[f"{side}_groups"] = pa.ListArray.from_arrays(where, pa.array((group - np.repeat(found.group_at[:-1], size)).astype(np.int32)))
        return out

    sides = ", ".join(f"{s}_{c} array<int>" for s in "ab" for c in ("ids", "ends", "groups"))
    return map_slices(rows, kernel, f"key {dict(rows.dtypes)['key']}, {sides}").withColumnRenamed("key", key)


def linked_texts(df: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_row (a number of its own for each row), key, n_a, n_b, n_groups, n_links, groups_sha256 and pairs: array of
    (a, b, n), the distinct id pairs of the text with their links. Written to the shared folder."""
    rows = project(df, key=key, text=text).withColumn("_row", F.monotonically_increasing_id())

    def kernel(batch: pa.RecordBatch) -> dict:
        found = Aligned(strings(batch.column("text")), byte_pairs.load(vocabulary), pieces.load(model))
        of, a, b, n = found.pairs()
        at = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
        structs = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)], ["a", "b", "n"])
        return {
            "_row": batch.column("_row"),
            "key": batch.column("key"),
            "n_a": np.diff(found.a_at),
            "n_b": np.diff(found.b_at),
            "n_groups": np.diff(found.group_at),
            "n_links": found.links(),
            "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in found.spelt()],
            "pairs": pa.ListArray.from_arrays(at, structs),
        }

    schema = f"_row long, key {dict(rows.dtypes)['key']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:long>>"
    return settle(map_slices(rows, kernel, schema), "aligned")


def count_pairs(linked: DataFrame) -> DataFrame:
    """a, b, documents (that hold the pair linked) and best: whether no pair of the same A id is held by more. Written to
    the shared folder."""
    pairs = linked.select(F.explode("pairs").alias("p")).select("p.a", "p.b")
    counts = settle(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents")), "pairs")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))  # a row for each id of A at most
    return settle(counts.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best")), "counts")


def weigh_links(linked: DataFrame, counts: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """_row, n_best (links whose pair is best for its A id) and count_sum (documents, summed over links) of the texts that
    have links. Up to `most` of the most frequent pairs are broadcast; the others are joined by a shuffle."""
    step = _frequent(counts, most)
    often, rare = counts.filter(F.col("documents") >= step), counts.filter(F.col("documents") < step)
    links = linked.select("_row", F.explode("pairs").alias("p")).select("_row", "p.a", "p.b", "p.n")
    # Which side a link takes is known from the broadcast table alone: a pair that is not in it is rare.
    looked = links.join(F.broadcast(often), ["a", "b"], "left")
    own = looked.filter(F.col("documents").isNotNull())
    rest = looked.filter(F.col("documents").isNull()).select("_row", "a", "b", "n").join(rare, ["a", "b"])
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("documents")).alias("count_sum")]
    found = [x.select("_row", "n", "documents", "best") for x in ([own, rest] if step > 1 else [own])]
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.groupBy("_row").agg(*sums)


def _frequent(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most so many pairs are held by that many documents or more."""
    power = F.floor(F.log2(F.col("documents"))).cast("int")
    sizes = {r.power: r.n for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    total, step = 0, max(sizes, default=-1) + 1
    while step > 0 and total + sizes.get(step - 1, 0) <= most:
        step -= 1
        total += sizes.get(step, 0)
    return 1 << step


def link_digests(df: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each text."""
    linked = linked_texts(df, vocabulary, model, key, text)
    weighed = weigh_links(linked, count_pairs(linked))
    none = F.lit(0).cast("long")
    rows = linked.drop("pairs").join(weighed, "_row", "left")
    return rows.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
