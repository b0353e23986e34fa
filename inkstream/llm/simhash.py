"""Operator 8, SimHash near-duplicates found with vantage-point trees.

Every text gets a 64-bit fingerprint over its word shingles. Distinct fingerprints go down a vantage-point tree: a
node's vantage point and radius part them into an inner and an outer side by Hamming distance, and by the triangle
inequality only outer points within `bits` of the radius can have partners inside, so those are copied to the inner
side as well. Leaves are shards; in each the same is done with a local tree down to small blocks, which are compared
in full. So all pairs of at most `bits` differing bits are found, without comparing all with all. The driver grows the
top tree from a sample of bounded size; shards that are too large even so are parted by trees grown in tasks.

A shard returns a spanning forest of its links, not all pairs; connected components are then taken over all shards.

A radius of `bits` finds copies with small changes. At a similarity of 0.8 fingerprints differ in about 10 of 64 bits,
which is within the spread of unrelated ones (32 +- 4) as far as the triangle bounds go: trees then prune nothing and
compare all with all. So `similar_documents` adds a second source of candidates for that, MinHash bands over the same
shingle hashes, and compares what trees and bands bring together by the exact similarity of the shingle sets: close or
equal fingerprints alone link no texts, as one shingle repeated often enough fixes all bits.

Null and empty texts have the fingerprint zero, which is linked like any other. Fewer words than a shingle has count
as one shingle; texts of any length are read whole. Repeated rows share a fingerprint, with whatever ids; null ids never
become a component's name. Of similar texts that share an id every row but one goes. An empty table gives none; further
columns may have any names.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import column_at, encoded, map_slices, prepare, project, settle, sized, with_row_key
from inkstream.llm.components import stars

#: Fingerprints the top tree is built from, those with the smallest hashes; this bounds what the driver holds.
SAMPLE = 16_384
#: Distinct fingerprints meant for one shard, and sampled ones that a leaf needs at least.
SHARD, SAMPLED_LEAF = 4_096, 16
#: Leaves of one tree at most (below 1 << LEAF_BITS), and times SHARD beyond which a shard gets a tree of its own.
LEAVES, LEAF_BITS, OVERFULL = 1_024, 20, 4
#: Points compared in full.
BLOCK = 512
#: Bytes of shingle sets in a block of a cluster, and distinct shingles counted side by side.
BLOCK_BYTES, COLUMNS = 16 << 20, 4_096
#: MinHash values, and how many of them make a band: at similarity 0.8 all bands miss with probability 0.002.
BINS, BAND = 126, 6


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of every run of so many words, A-Z lower-cased, joined by spaces; of all if there are fewer."""
    split = text.lower().split()
    if not split:
        return []
    line = b" ".join(split)
    if len(split) <= words:
        return [xxhash.xxh64_intdigest(line, 42)]
    ends = list(itertools.accumulate(len(w) + 1 for w in split))
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    return [h(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def fingerprints_of(texts: list[bytes], words: int) -> np.ndarray:
    """SimHash of each text."""
    return fold([shingle_hashes(t, words) for t in texts])


def fold(lists: list[list[int]]) -> np.ndarray:
    """SimHash of each list of hashes: a bit is 1 if set in over half of them."""
    size = np.array([len(x) for x in lists], np.int64)
    out = np.zeros((len(lists), 64), np.uint8)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint64, int(size.sum()))
        first = (np.cumsum(size) - size)[full]
        step = max(1, (1 << 22) // 64)
        counts = np.zeros((len(full), 64), np.int64)
        owner = np.searchsorted(first, np.arange(0, len(flat), step), "right") - 1
        for k, a in enumerate(range(0, len(flat), step)):  # a bounded piece of the bit matrix at a time
            piece = flat[a : a + step]
            bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inner = first[(first > a) & (first < a + len(piece))] - a
            cut = np.concatenate([[0], inner])
            counts[owner[k] : owner[k] + len(cut)] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        out[full] = counts * 2 > size[full][:, None]
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """key, fp long (the fingerprint's bits as a signed number). No shuffle."""
    rows = project(df, key=key, text=text)
    kernel = lambda b: {"key": b.column("key"), "fp": fingerprints_of(encoded(b.column("text")), words).view(np.int64)}
    return map_slices(rows, kernel, f"key {dict(rows.dtypes)['key']}, fp long", limit=1 << 20)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def _vantage(points: np.ndarray, bits: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius, of a few tried, that leave the smaller larger side; None if none parts them well."""
    best, score = None, 0.9 * len(points)
    tried = points[:: max(1, len(points) // 8)][:8]
    seen = points[:: max(1, len(points) // 4096)]
    scale = len(points) / len(seen)
    for v in tried:
        have = np.bincount(_distance(seen, v), minlength=65 + bits + 1)
        upto = np.cumsum(have)
        for mu in range(64):
            inner, outer = upto[min(mu + bits, 64)] * scale, (len(seen) - upto[mu]) * scale
            if outer and max(inner, outer) + 0.25 * min(inner, outer) < score and upto[mu]:
                best, score = (v, mu), max(inner, outer) + 0.25 * min(inner, outer)
    return best


class Tree:
    """The top tree as flat arrays: vantage points, radii, and the children's numbers, or -1 - shard for a leaf."""

    def __init__(self, sample: np.ndarray, shards: int, bits: int):
        self.bits = bits
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.child: list[list[int]] = []
        self.shards = 0
        leaf = max(SAMPLED_LEAF, len(sample) // max(1, shards))
        self.root = self._grow(sample, leaf)
        self.vantages = np.array(self.vantage or [0], np.uint64)
        self.radii = np.array(self.radius or [0], np.int64)
        self.children = np.array(self.child or [[-1, -1]], np.int64)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        found = _vantage(points, self.bits) if len(points) > leaf else None
        if found is None:
            self.shards += 1
            return -self.shards
        me = len(self.vantage)
        self.vantage.append(int(found[0]))
        self.radius.append(found[1])
        self.child.append([0, 0])
        d = _distance(points, found[0])
        self.child[me] = [self._grow(points[d <= found[1]], leaf), self._grow(points[d > found[1]], leaf)]
        return me

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, index of the point): all shards where a point may meet a partner."""
        index = np.arange(len(points))
        node = np.full(len(points), self.root, np.int64)
        done = []
        while True:
            leaf = node < 0
            done.append((-1 - node[leaf], index[leaf]))
            index, node = index[~leaf], node[~leaf]
            if not len(index):
                break
            d = _distance(points[index], self.vantages[node])
            outer = d > self.radii[node]
            inner = d <= self.radii[node] + self.bits
            index, node = np.concatenate([index[inner], index[outer]]), np.concatenate([self.children[node[inner], 0], self.children[node[outer], 1]])
        return np.concatenate([s for s, _ in done]), np.concatenate([i for _, i in done])


class Forest:
    """Joins of linked points; each point's root is the smallest index joined to it."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up


def link(points: np.ndarray, bits: int) -> np.ndarray:
    """Of each of the distinct points, the smallest index that links of at most `bits` bits reach."""
    forest = Forest(len(points))
    todo = [np.arange(len(points))]
    while todo:
        here = todo.pop()
        found = _vantage(points[here], bits) if len(here) > BLOCK else None
        if found is None:
            for a in range(0, len(here), BLOCK):
                own, rest = here[a : a + BLOCK], here[a:]
                for b in range(0, len(rest), 4096):
                    other = rest[b : b + 4096]
                    i, j = np.nonzero(np.bitwise_count(points[own][:, None] ^ points[other][None, :]) <= bits)
                    forest.join(own[i], other[j])
            continue
        d = _distance(points[here], found[0])
        todo += [here[d <= found[1] + bits], here[d > found[1]]]
    return forest.root


def _sampled(nodes: DataFrame, most: int) -> np.ndarray:
    rows = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(most).collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


def _routed(tree: Tree, points: np.ndarray, shard: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows (shard, fp) of where a tree deals points; shard is the one they come from, whose leaves are numbered on."""
    for a in range(0, len(points), 1 << 16):
        leaf, index = tree.route(points[a : a + (1 << 16)])
        yield pa.RecordBatch.from_pydict({"shard": pa.array((shard << LEAF_BITS) + leaf, pa.int64()), "fp": pa.array(points[a + index].view(np.int64))})


def _deal(nodes: DataFrame, bits: int) -> DataFrame:
    """(shard, fp): every fingerprint in all shards where it may meet a partner.

    The driver's tree has LEAVES leaves at most. Where that leaves shards too large, each of them gets a tree of its own,
    grown in a task from a sample of its points; the driver holds LEAVES such trees of LEAVES leaves at most.
    """
    total = nodes.count()
    points = _sampled(nodes, SAMPLE)
    tree = Tree(points, min(-(-total // SHARD), LEAVES, len(points) // SAMPLED_LEAF), bits)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _routed(tree, batch.column("fp").to_numpy().view(np.uint64))

    dealt = nodes.select("fp").mapInArrow(first, "shard long, fp long")
    if total <= OVERFULL * SHARD * tree.shards:
        return dealt
    dealt = settle(dealt, "fingerprint-shards")
    large = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > OVERFULL * SHARD)
    sample = dealt.join(F.broadcast(large), "shard").filter(F.pmod(F.xxhash64("fp", F.lit(1)), F.greatest(F.col("n").cast("double") / SAMPLE, F.lit(1.0)).cast("long")) == 0)

    def grow(shard: int, points: np.ndarray) -> pa.RecordBatch:
        own = Tree(np.sort(points).view(np.uint64), min(-(-len(points) // SAMPLED_LEAF), LEAVES), bits)
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "tree": pa.array([pickle.dumps(own)], pa.binary())})

    grown = sample.select("shard", "fp").repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it: _by_shard(it, grow), "shard long, tree binary")
    trees = {r.shard: r.tree for r in grown.collect()}

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Tree] = {}
        for batch in batches:
            shards, points = batch.column("shard").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            order = np.argsort(shards, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
                if not len(part):
                    continue
                shard = int(shards[part[0]])
                if shard not in trees:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(part), shard << LEAF_BITS)), "fp": pa.array(points[part].view(np.int64))})
                    continue
                if shard not in ready:
                    ready[shard] = pickle.loads(trees[shard])
                yield from _routed(ready[shard], points[part], shard)

    return dealt.mapInArrow(second, "shard long, fp long")


def _by_shard(batches: Iterator[pa.RecordBatch], make: Callable[[int, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """make(shard, fingerprints) for every shard of rows sorted by shard."""
    shard, held = None, []
    for batch in batches:
        numbers, points = batch.column("shard").to_numpy(), batch.column("fp").to_numpy()
        cut = np.flatnonzero(np.diff(numbers)) + 1
        for part, first in zip(np.split(points, cut), np.concatenate([[0], cut]), strict=True):
            if not len(part):
                continue
            if held and numbers[first] != shard:
                yield make(int(shard), np.concatenate(held))
                held = []
            shard = numbers[first]
            held.append(part)
    if held:
        yield make(int(shard), np.concatenate(held))


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that join all pairs of at most `bits` differing bits."""
    prepare(nodes.sparkSession)

    def one(_: int, points: np.ndarray) -> pa.RecordBatch:
        points = np.sort(points).view(np.uint64)
        root = link(points, bits)
        own = np.flatnonzero(root != np.arange(len(points)))
        return pa.RecordBatch.from_pydict({"u": pa.array(points[own].view(np.int64)), "v": pa.array(points[root[own]].view(np.int64))})

    return _deal(nodes, bits).repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it: _by_shard(it, one), "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """key, fp long, component: the smallest key that links of at most `bits` differing bits reach, itself included."""
    prints = settle(fingerprints(df, key, text, words), "fingerprints")
    nodes = settle(prints.groupBy("fp").agg(F.min("key").alias("least")), "fingerprint-nodes")
    star = stars(links(nodes, bits), "fingerprint-links")
    named = nodes.join(star, nodes["fp"] == star["u"], "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = settle(named.join(least, "root").select("fp", "component"), "fingerprint-classes")
    return prints.join(classes, "fp").select(F.col("key").alias(key), "fp", "component")


def sketches(lists: list[list[int]]) -> np.ndarray:
    """One-permutation MinHash of each list of hashes: BINS values, empty bins filled from the next full one."""
    size = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint64, int(size.sum()))
    spread = flat * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    owner = np.repeat(np.arange(len(lists)), size) * BINS
    out = np.full(len(lists) * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, owner + (spread % np.uint64(BINS)).astype(np.int64), spread)
    out = out.reshape(-1, BINS)
    twice = np.concatenate([out, out], axis=1)
    full = twice != np.iinfo(np.uint64).max
    place = np.where(full, np.arange(2 * BINS), 4 * BINS)
    nearest = np.minimum(np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BINS], 2 * BINS - 1)
    away = (nearest - np.arange(BINS)).astype(np.uint64)
    return np.take_along_axis(twice, nearest, axis=1) + away * np.uint64(0xBF58476D1CE4E5B9)


def _band_keys(values: np.ndarray) -> np.ndarray:
    """One number for each band of each sketch."""
    parts = values.reshape(len(values), BINS // BAND, BAND)
    keys = np.broadcast_to(np.arange(BINS // BAND, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND):
        keys = (keys ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _described(rows: DataFrame, words: int) -> DataFrame:
    """_row, copy (a digest of the words in order), fp and band keys."""

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = encoded(batch.column("text"))
        lists = [shingle_hashes(t, words) for t in texts]
        return {
            "_row": batch.column("_row"),
            "copy": [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts],
            "fp": fold(lists).view(np.int64),
            "bands": list(_band_keys(sketches(lists)).view(np.int64)),
        }

    return map_slices(rows, kernel, "_row long, copy binary, fp long, bands array<long>", limit=1 << 20)


def similar_pairs(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i > j) of sets of hashes that are similar enough, by exact counts of what they share."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1 if len(flat) else np.zeros(0, bool)
    keep = often[number] if len(flat) else new
    column, owner = (np.cumsum(often) - 1)[number[keep]] if len(flat) else number, owner[keep]
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(often.sum()), COLUMNS):  # what is in one set only is shared by no two
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((n, min(COLUMNS, int(often.sum()) - a)), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    i, j = np.nonzero(np.tril(both >= similarity * (size[:, None] + size[None] - both) - 1e-3, -1) & (both > 0))
    exact = both[i, j].astype(np.int64)
    good = exact >= similarity * (size[i] + size[j] - exact)
    return i[good], j[good]


def _compared(clusters: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): links that join all pairs similar enough within each cluster; clusters has _row and cluster.

    A cluster is compared all with all, in tasks of at most two of its blocks; only spanning forests leave a task.
    """

    def sets(batch: pa.RecordBatch) -> dict:
        lists = [np.unique(np.array(shingle_hashes(t, words), np.uint64)).tobytes() for t in encoded(batch.column("text"))]
        return {"_row": batch.column("_row"), "hashes": lists}

    asked = clusters.select("_row")
    known = settle(map_slices(rows.join(sized(asked), "_row", "left_semi").select("_row", "text"), sets, "_row long, hashes binary", limit=1 << 20), "shingle-sets")
    told = clusters.join(known.select("_row", F.octet_length("hashes").alias("n")), "_row")
    blocks = told.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = clusters.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("_row", "cluster", "own", other).select("_row", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    met = known.join(dealt, "_row").select("task", "_row", "hashes")

    def one(ids: list[int], hashes: list[bytes]) -> pa.RecordBatch:
        i, j = similar_pairs([np.frombuffer(h, np.uint64) for h in hashes], similarity)
        forest = Forest(len(ids))
        forest.join(i, j)
        row = np.array(ids, np.int64)
        own = np.flatnonzero(forest.root != np.arange(len(ids)))
        return pa.RecordBatch.from_pydict({"u": pa.array(row[own]), "v": pa.array(row[forest.root[own]])})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, hashes = None, [], []
        for batch in batches:
            for t, row, h in zip(*(batch.column(c).to_pylist() for c in ("task", "_row", "hashes")), strict=True):
                if t != task and ids:
                    yield one(ids, hashes)
                    ids, hashes = [], []
                task = t
                ids.append(row)
                hashes.append(h)
        if ids:
            yield one(ids, hashes)

    return met.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "u long, v long")


def similar_documents(rows: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """(_row, least): each row in a group of similar ones, but its smallest, with that smallest; rows has _row and text.

    Copies count once. Texts that fingerprints of at most `bits` differing bits or shared bands connect form clusters.
    Each cluster is compared all with all in blocks; only pairs of at least the similarity are links, and only spanning
    forests of the links leave a task, so no group emits its pairs.
    """
    told = settle(_described(rows, words), "near-described")
    texts = settle(told.groupBy("copy").agg(F.min("_row").alias("one"), F.first("fp").alias("fp"), F.min_by("bands", "_row").alias("bands")), "near-texts")
    by_print = texts.groupBy("fp").agg(F.min("one").alias("one"))
    tree = links(settle(by_print, "near-prints"), bits)
    prints = by_print.select("fp", "one")
    near = tree.join(prints.select(F.col("fp").alias("u"), F.col("one").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("one").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = texts.join(prints.select("fp", F.col("one").alias("v")), "fp").select(F.col("one").alias("u"), "v").filter("u <> v")
    banded = texts.select("one", F.explode("bands").alias("band"))
    first = settle(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("one").alias("v")).filter("n > 1").select("band", "v"), "near-bands")
    pairs = banded.join(first, "band").filter("one <> v").select(F.col("one").alias("u"), "v").distinct()
    heads = stars(pairs.unionByName(near).unionByName(same), "near-clusters")
    clusters = heads.select(F.col("u").alias("_row"), F.col("v").alias("cluster")).unionByName(heads.select(F.col("v").alias("_row"), F.col("v").alias("cluster")).distinct())
    good = _compared(settle(clusters, "near-clusters"), rows, words, similarity)
    copies = told.join(texts.select("copy", F.col("one").alias("v")), "copy").select(F.col("_row").alias("u"), "v").filter("u <> v")
    star = stars(good, "near-links")
    moved = copies.join(star.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").select(F.col("u").alias("_row"), F.coalesce("root", "v").alias("least"))
    return moved.unionByName(star.select(F.col("u").alias("_row"), F.col("v").alias("least")))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """The rows without all but the smallest of each group of similar texts; columns as given."""
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    rows = with_row_key(flat, f"_c{column_at(names, key)}")
    found = similar_documents(rows.select("_row", F.col(f"_c{column_at(names, text)}").alias("text")), words, similarity, bits)
    return rows.join(sized(settle(found.select("_row"), "near-removed")), "_row", "left_anti").drop("_row").toDF(*names)
