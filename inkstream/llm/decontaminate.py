"""Operator 7, benchmark decontamination with suffix arrays of the training texts.

Each bounded slice of documents is a shard: its words become numbers, and a suffix array orders the shard's suffixes
by up to WINDOW words (prefix doubling, so ranks at depths 1, 2, 4, 8 and 10). Suffixes that open with no two
neighbouring words of a test text can match no test window and are left out of the array. Every test suffix is then
looked up by binary search, at growing depths up to WINDOW words. Equal windows are looked up once; what a window finds
is a range of the suffix array, so hits are marked by ranges, and no (window, place) pairs are made however often words
repeat on both sides. Items are told by the sets of items that windows belong to.

From each place where a window occurs the match is then followed as far as it goes in any item, by doubled steps and
binary search in a suffix array of the tests. Of these, `matches` has those that are not part of the one a word before:
(place, words, item, its word, times), with one of the test places where it occurs and how many there are.

The benchmark is a stated query set. It is read in blocks of at most BLOCK_BYTES; each block is one pass over the
documents, of which only what it found is written (not texts), and passes follow one another, so memory does not grow
with the benchmark. Null and empty texts have no words; items without words have no windows; texts of any length are
read whole. An empty benchmark leaves every document clean, an empty table gives none. Repeated documents, also with
repeated or null ids, give repeated rows. Further columns may have any names.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm.common import column_at, encoded, map_slices, prepare, project, settle, sized, text_slices, with_row_key

WINDOW = 10
#: Bytes of test texts in one pass; this bounds what is broadcast, and what a worker holds of them (about 45 times that).
BLOCK_BYTES = 4 << 20
#: Words over UTF-8: every byte of a character beyond ASCII belongs to a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case."""
    return WORD(text.lower())


class TestSet:
    """The words of a block of items as numbers, one array with a 0 behind each item, and its distinct windows.

    A window has WINDOW words; a shorter item is one window. All is kept in arrays of as many numbers as there are words.
    """

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        known = self.vocabulary
        parts, sizes = [np.zeros(0, np.int32)], []
        for _, text in items:
            split = words_of(text.encode())
            parts += [np.fromiter((known.setdefault(w, len(known) + 1) for w in split), np.int32, len(split)), np.zeros(1, np.int32)]
            sizes.append(len(split))
        self.size = len(known) + 1
        self.text = np.concatenate([*parts, np.zeros(WINDOW, np.int32)])
        size = np.array(sizes, np.int64)
        self.starts = np.cumsum(size + 1) - size - 1
        pair = self.text[:-1].astype(np.int64) * self.size + self.text[1:]
        self.heads = np.unique(pair[(self.text[:-1] > 0) & (self.text[1:] > 0)])
        self.levels = [self.text]
        self.keys: list[tuple[np.ndarray, int]] = []
        self.sorted_at, self.sorted = -1, np.zeros(0, np.int32)
        #: By length: a place of each distinct window, the set of items that it belongs to, and how often it occurs.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.sets: list[np.ndarray] = [np.array([i]) for i in range(len(items))]
        more: dict[bytes, int] = {}
        length = np.minimum(size, WINDOW)
        for n in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == n)
            count = size[own] - n + 1
            place = np.repeat(self.starts[own], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            item = np.repeat(own, count)
            level = n.bit_length() - 1
            self._grow(level)
            low = self.levels[level][place + n - (1 << level)].astype(np.int64)
            key = self.levels[level][place].astype(np.int64) * (int(low.max()) + 1) + low
            order = np.lexsort((item, key))
            key, item, place = key[order], item[order], place[order]
            opens = np.flatnonzero(np.diff(key, prepend=-1))
            ends = np.append(opens[1:], len(key))
            of = item[opens].astype(np.int32)
            for w in np.flatnonzero(item[ends - 1] != item[opens]).tolist():  # sorted, so one item stands at both ends
                held = np.unique(item[opens[w] : ends[w]])
                of[w] = more.setdefault(held.tobytes(), len(self.sets))
                if of[w] == len(self.sets):
                    self.sets.append(held)
            self.windows[n] = place[opens].astype(np.int32), of, (ends - opens).astype(np.int32)
        self.single = np.unique(self.text[self.windows[1][0]]) if 1 in self.windows else np.zeros(0, np.int32)

    def _grow(self, level: int) -> None:
        """Ranks of the tests' stretches of 2 ** level words, or of fewer where an item ends, in their order; 0 behind items."""
        while len(self.levels) <= level:
            step = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            ahead = np.zeros_like(last)
            ahead[:-step] = last[step:] if step < len(last) else 0
            live = np.flatnonzero(last > 0)
            rank = np.zeros(len(last), np.int32)
            factor = int(ahead.max(initial=0)) + 1
            keys, found = np.unique(last[live].astype(np.int64) * factor + ahead[live], return_inverse=True)
            rank[live] = found + 1
            self.levels.append(rank)
            self.keys.append((keys, factor))

    def follow(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the places in ids (test word numbers or 0, with zeros at the end): the number of words from there
        on that some item has in a row, a place in the tests where it has, and how many there are."""
        found = [ids]
        while True:
            step = 1 << (len(found) - 1)
            if step >= len(ids):
                break
            self._grow(len(found))
            keys, factor = self.keys[len(found) - 1]
            last = found[-1]
            live = np.flatnonzero((last[:-step] > 0) & (last[step:] > 0) & (last[step:] < factor))
            want = last[live].astype(np.int64) * factor + last[live + step]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
            hit = keys[at] == want if len(keys) else np.zeros(0, bool)
            if not hit.any():
                break
            nxt = np.zeros(len(ids), np.int32)
            nxt[live[hit]] = at[hit] + 1
            found.append(nxt)
        order = self._suffixes(len(found))
        size = np.zeros(len(places), np.int64)
        lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(order), np.int64)
        for k in range(len(found) - 1, -1, -1):
            want = found[k][np.minimum(places + size, len(ids) - 1)]
            some = np.flatnonzero(want > 0)
            low = self._bound(order, k, size[some], want[some], lo[some], hi[some], "left")
            high = self._bound(order, k, size[some], want[some], low, hi[some], "right")
            good = high > low
            some = some[good]
            lo[some], hi[some] = low[good], high[good]
            size[some] += 1 << k
        return size, order[np.minimum(lo, len(order) - 1)].astype(np.int64), hi - lo

    def _suffixes(self, level: int) -> np.ndarray:
        """Places of the tests sorted by their first 2 ** level words and more; kept for the highest level asked for."""
        if self.sorted_at < level:
            self._grow(level)
            self.sorted_at, self.sorted = level, np.argsort(self.levels[level], kind="stable").astype(np.int32)
        return self.sorted

    def _bound(self, order: np.ndarray, level: int, ahead: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: str) -> np.ndarray:
        """Binary search of each want among the ranks, `ahead` words on, of the suffixes in its range."""
        rank, last = self.levels[level], len(self.text) - 1
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = rank[np.minimum(order[np.minimum(mid, last)] + ahead, last)]
            less = at < want if side == "left" else at <= want
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo


def _dense(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ranks (from 1) of pairs in their order, the sorted pair keys, and the factor of the keys."""
    factor = int(low.max(initial=0)) + 2
    keys, rank = np.unique(high * factor + low, return_inverse=True)
    return rank + 1, keys, factor


def _find(high: np.ndarray, low: np.ndarray, keys: np.ndarray, factor: int) -> np.ndarray:
    """Ranks of test pairs among the sorted keys by binary search; 0 where the shard has no such pair."""
    out = np.zeros(len(high), np.int32)
    live = np.flatnonzero((high > 0) & (low > 0) & (low < factor))
    want = high[live].astype(np.int64) * factor + low[live]
    at = np.searchsorted(keys, want)
    known = at < len(keys)
    known[known] &= keys[at[known]] == want[known]
    out[live[known]] = at[known] + 1
    return out


class Shard:
    """A suffix array over the numbered words of some documents, where 0 is any word that no test text has."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, tests: TestSet):
        """ends: for each word, the place after its document's last word."""
        n = len(ids)
        room = ends - np.arange(n)
        follow = np.zeros(n, np.int64)
        follow[:-1] = np.where(room[:-1] > 1, ids[1:], 0)
        pair = ids * tests.size + follow
        at = np.minimum(np.searchsorted(tests.heads, pair), len(tests.heads) - 1)
        self.two = np.flatnonzero((ids > 0) & (follow > 0) & (tests.heads[at] == pair)) if len(tests.heads) else np.zeros(0, np.int64)
        self.one = np.flatnonzero(np.isin(ids, tests.single)) if len(tests.single) else np.zeros(0, np.int64)
        self.ids, self.ends = ids, ends

    def ranges(self, tests: TestSet) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, windows, lo, hi, order): the distinct windows of n words that occur, each at the places order[lo:hi]."""
        if 1 in tests.windows:
            order = self.one[np.argsort(self.ids[self.one], kind="stable")]
            yield 1, *_ranges(self.ids[order], tests.text[tests.windows[1][0]]), order
        rank = np.zeros(len(self.ids) + WINDOW + 1, np.int64)
        rank[: len(self.ids)] = self.ids
        levels = {1: rank}
        test = {1: tests.text}
        lengths = sorted(n for n in tests.windows if n > 1)
        suffixes = self.two
        depth = 1
        while lengths and depth < WINDOW and len(suffixes):
            step = min(depth, WINDOW - depth)
            for n in [n for n in lengths if depth < n < depth + step]:
                yield n, *self._between(levels, test, depth, n, suffixes, tests.windows[n][0])
            low = levels[step][suffixes + depth]
            room = self.ends[suffixes] - suffixes >= depth + step
            live = (levels[depth][suffixes] > 0) & (low > 0) & room
            suffixes, low = suffixes[live], low[live]
            fresh, keys, factor = _dense(levels[depth][suffixes], low)
            nxt = np.zeros_like(rank)
            nxt[suffixes] = fresh
            test[depth + step] = _find(test[depth], _ahead(test[step], depth), keys, factor)
            levels[depth + step] = nxt
            depth += step
            if depth in tests.windows:
                order = suffixes[np.argsort(nxt[suffixes], kind="stable")]
                yield depth, *_ranges(nxt[order], test[depth][tests.windows[depth][0]]), order
            lengths = [n for n in lengths if n > depth]

    def _between(self, levels: dict, test: dict, depth: int, n: int, suffixes: np.ndarray, places: np.ndarray) -> tuple:
        """Windows whose length lies between two depths: by their two overlapping parts of depth words."""
        low = levels[depth][suffixes + n - depth]
        live = (levels[depth][suffixes] > 0) & (low > 0) & (self.ends[suffixes] - suffixes >= n)
        some, low = suffixes[live], low[live]
        rank, keys, factor = _dense(levels[depth][some], low)
        order = np.argsort(rank, kind="stable")
        return *_ranges(rank[order], _find(test[depth][places], test[depth][places + n - depth], keys, factor)), some[order]


def _ahead(a: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([a[by:], np.zeros(by, a.dtype)])


def _ranges(ranks: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the wanted ranks those that occur among the sorted ranks, and where: lo to hi."""
    some = np.flatnonzero(want > 0)
    lo, hi = np.searchsorted(ranks, want[some], "left"), np.searchsorted(ranks, want[some], "right")
    there = hi > lo
    return some[there], lo[there], hi[there]


class Found:
    """What a text shares with the tests: hit word runs (first, after last), indices of items with occurring windows,
    matches (place, words, item's index, its word, times), and the text's number of words."""

    __slots__ = ("items", "matches", "runs", "words")

    def __init__(self, words: int):
        self.runs: list[tuple[int, int]] = []
        self.items: set[int] = set()
        self.matches: list[tuple[int, int, int, int, int]] = []
        self.words = words


def longest_matches(texts: list[bytes], tests: TestSet, follow: bool = True) -> list[Found]:
    """What each text shares with the tests, by the suffix array of all texts; matches only if they are to be followed."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    out = [Found(n) for n in sizes.tolist()]
    edge = np.cumsum(sizes)
    ids = np.fromiter(map(tests.vocabulary.get, itertools.chain.from_iterable(split), itertools.repeat(0)), np.int64, int(sizes.sum()))
    del split
    if not len(ids):
        return out
    hit = np.zeros(len(ids) + 1, np.int64)
    least = np.zeros((3, len(ids)), np.int64)  # at a place: words of the longest window, where the tests have it, how often
    width = len(tests.sets)
    told: list[np.ndarray] = []
    for n, window, lo, hi, order in Shard(ids, np.repeat(edge, sizes), tests).ranges(tests):
        size = hi - lo  # ranges of distinct windows do not overlap
        place = order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        hit[place] += 1
        hit[place + n] -= 1
        longer = n > least[0, place]
        least[:, place[longer]] = [np.full(int(longer.sum()), n), *(np.repeat(tests.windows[n][c][window], size)[longer] for c in (0, 2))]
        owner = np.searchsorted(edge, place, "right")
        told.append(np.unique(owner * width + np.repeat(tests.windows[n][1][window], size)))
    if not told or not sum(map(len, told)):
        return out
    start = edge - sizes
    for d, k in ((int(x) // width, int(x) % width) for x in np.unique(np.concatenate(told)).tolist()):
        out[d].items.update(tests.sets[k].tolist())
    covered = np.cumsum(hit[:-1]) > 0
    opens = covered & np.concatenate([[True], ~covered[:-1]])
    opens[start[sizes > 0]] = covered[start[sizes > 0]]
    closes = covered & np.concatenate([~covered[1:], [True]])
    closes[edge[sizes > 0] - 1] = covered[edge[sizes > 0] - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = np.searchsorted(edge, first, "right")
    for d, x, y in zip(owner.tolist(), (first - start[owner]).tolist(), (last - start[owner]).tolist(), strict=True):
        out[d].runs.append((x, y))
    if follow:
        _follow(out, ids, covered, least, edge, start, tests)
    return out


def _follow(out: list[Found], ids: np.ndarray, covered: np.ndarray, least: np.ndarray, edge: np.ndarray, start: np.ndarray, tests: TestSet) -> None:
    """Puts the matches of all texts into out. Only hit words can be part of one, so only those are followed, text by text
    in one array with a 0 behind each."""
    at = np.flatnonzero(covered)
    owner = np.searchsorted(edge, at, "right")
    breaks = np.concatenate([[False], (np.diff(at) > 1) | (np.diff(owner) > 0)])
    moved = np.arange(len(at)) + np.cumsum(breaks)
    words = np.zeros(int(moved[-1]) + 2, np.int32)
    words[moved] = ids[at]
    opens = np.flatnonzero(least[0, at] > 0)
    place, owner = at[opens], owner[opens]
    size, where, times = least[:, place]
    far = np.flatnonzero(size == WINDOW)  # shorter windows are whole items and go no further
    size[far], where[far], times[far] = tests.follow(words, moved[opens][far])
    inner = np.concatenate([[False], (np.diff(place) == 1) & (owner[1:] == owner[:-1]) & (size[1:] < size[:-1])])
    item = np.searchsorted(tests.starts, where, "right") - 1
    rows = np.stack([place - start[owner], size, item, where - tests.starts[item], times], 1)[~inner]
    for d, match in zip(owner[~inner].tolist(), map(tuple, rows.tolist()), strict=True):
        out[d].matches.append(match)


def blocks(benchmark: DataFrame, item: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Items of the benchmark, a bounded block at a time."""
    block: list[tuple[str, str]] = []
    size = 0
    for name, body in project(benchmark, item=item, text=text).select(F.col("item").cast("string"), "text").toLocalIterator():
        block.append((name if name is not None else "", body or ""))
        size += len(block[-1][1].encode()) + 64
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


_RUNS = "runs array<struct<a:int,b:int>>, items array<string>, matches array<struct<place:int,words:int,item:string,at:int,times:int>>"


def _told(found: list[Found], names: list[str]) -> dict:
    return {
        "runs": [[{"a": a, "b": b} for a, b in x.runs] for x in found],
        "items": [sorted({names[i] for i in x.items}) for x in found],
        "matches": [[{"place": place, "words": n, "item": names[i], "at": at, "times": times} for place, n, i, at, times in x.matches] for x in found],
    }


def _send(spark: SparkSession, block: list[tuple[str, str]]) -> tuple[Broadcast, str]:
    return spark.sparkContext.broadcast(block), uuid.uuid4().hex


def _hits(rows: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
    """_row, runs, items and matches of the rows (with _row and text) that one block hits, in the shared folder."""
    sent, mark = _send(rows.sparkSession, block)

    def kernel(batch: pa.RecordBatch) -> dict:
        tests = _test_set(sent, mark)
        found = longest_matches(encoded(batch.column("text")), tests)
        some = [i for i, x in enumerate(found) if x.runs]
        return {"_row": batch.column("_row").take(pa.array(some, pa.int64()))} | _told([found[i] for i in some], tests.names)

    out = settle(map_slices(rows.select("_row", "text"), kernel, f"_row long, {_RUNS}"), "decontaminate")
    sent.destroy()
    return out


def _whole(rows: DataFrame, block: list[tuple[str, str]], kept: list[str]) -> DataFrame:
    """Every row's kept columns with n_words, runs, items and matches of one block."""
    sent, mark = _send(rows.sparkSession, block)
    kinds = dict(rows.dtypes)

    def kernel(batch: pa.RecordBatch) -> dict:
        tests = _test_set(sent, mark)
        found = longest_matches(encoded(batch.column("text")), tests)
        return {c: batch.column(c) for c in kept} | {"n_words": [x.words for x in found]} | _told(found, tests.names)

    return map_slices(rows.select(*kept, "text"), kernel, ", ".join(f"{c} {kinds[c]}" for c in kept) + f", n_words long, {_RUNS}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, runs (hit word runs), items (names of items with occurring windows, sorted as strings) and matches
    (place, words, item, its word, times; each as long as it goes, and none that is part of the one before it). Of several
    blocks each gives its own matches.

    One pass over the documents for each block of the benchmark. A benchmark of one block takes no shuffle; what
    further ones hit is settled, and joined by row.
    """
    rows = project(docs, key=key, text=text)
    todo = blocks(benchmark, item, item_text, limit)
    block, following = next(todo, []), next(todo, None)
    if following is None:
        return _whole(rows, block, ["key"]).withColumnRenamed("key", key)
    rows = with_row_key(rows, "key")
    hits = []
    while following is not None:
        hits.append(_hits(rows, block))
        block, following = following, next(todo, None)
    last = _whole(rows, block, ["key", "_row"])
    every = reduce(DataFrame.unionByName, hits).groupBy("_row").agg(*[F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("runs", "items", "matches")])
    met = last.join(every, "_row", "left")
    both = {c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"_{c}")) for c in ("runs", "items", "matches")}
    united = F.aggregate(F.array_sort(both["runs"]), F.array().cast("array<struct<a:int,b:int>>"), _with_run)
    return met.select(F.col("key").alias(key), "n_words", united.alias("runs"), F.array_sort(F.array_distinct(both["items"])).alias("items"), F.array_sort(both["matches"]).alias("matches"))


def _with_run(runs: Column, run: Column) -> Column:
    """Sorted disjoint runs with a further one, which opens no earlier than the last."""
    last = F.try_element_at(runs, F.lit(-1))
    longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], run["b"]).alias("b"))
    joined = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))
    return F.when((F.size(runs) > 0) & (run["a"] <= last["b"]), joined).otherwise(F.concat(runs, F.array(run)))


_SETS: dict[str, TestSet] = {}


def _test_set(sent: Broadcast, mark: str) -> TestSet:
    """The block's windows, once in each Python worker."""
    if mark not in _SETS:
        _SETS.clear()
        _SETS[mark] = TestSet(sent.value)
    return _SETS[mark]


def digest(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated and the longest match's words from find_contamination's rows,
    all in Catalyst."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    rest = [c for c in found.columns if c not in ("n_words", "runs", "items", "matches")]
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).cast("long")
    return found.select(*rest, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), longest.alias("longest_match"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """The documents of which no word is in an occurrence of a test window; columns as given.

    A benchmark of one block is one pass without a shuffle; each block of a larger one is a pass of its own, whose hits
    are settled as row numbers.
    """
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    body = f"_c{column_at(names, text)}"
    spark = docs.sparkSession
    prepare(spark)
    todo = blocks(benchmark, "item_id", "text", limit)
    block, following = next(todo, []), next(todo, None)
    if following is None:
        sent, mark = _send(spark, block)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, body):
                found = longest_matches(encoded(batch.column(body)), _test_set(sent, mark), follow=False)
                yield batch.filter(pa.array([not x.runs for x in found]))

        return flat.mapInArrow(clean, flat.schema).toDF(*names)
    rows = settle(flat.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")
    hits = [_hits(rows.select("_row", F.col(body).alias("text")), b).select("_row") for b in itertools.chain([block, following], todo)]
    hit = settle(reduce(DataFrame.unionByName, hits).distinct(), "decontaminate-hits")
    return rows.join(sized(hit), "_row", "left_anti").drop("_row").toDF(*names)
