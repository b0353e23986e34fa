"""Operator 6, removal of repeated byte strings: suffixes at anchors of windows, ordered by radix passes to the depth of the
threshold only.

A window is a string of `length` bytes. Sorting every suffix of a corpus would move each byte `length` times over, so
suffixes enter the passes at anchors: each window's anchor is the place of its least PREFIX-byte hash (the leftmost of
equals), which depends on the window's bytes alone. Equal windows stand alike to equal anchors. The passes, most
significant digit first; hashes only deal rows out to buckets, equality is always that of bytes:

1. Digit: the PREFIX bytes at the anchor, as a bucket number. Buckets of one are done (no window there repeats).
2. Digit: all bytes that the windows of an anchor cover, compared as bytes by the aggregate. In groups of two and more
   every window repeats. Only one row of each group goes on.
3. Digit: eight bytes of the window at a time, up to `length`: windows of a bucket are split by each digit in turn,
   windows left alone drop out, and what is still together after the last digit is equal.

Passes 1 and 2 aggregate, so a passage in every document makes no large group. In pass 3 buckets have one row for each
different surrounding of an anchor. A bucket of more than HOT rows takes a digit in between: its windows are dealt out
by their distance to the anchor, SPREAD distances together, and by the bytes that all windows of such a part share;
equal bytes meet in an aggregate as in pass 2. Parts of more than HOT rows even then (one passage in very many
surroundings) are counted window by window, as aggregates.

Null and empty texts, and texts shorter than the window, have nothing to remove; an empty table gives an empty result.
Repeated rows, with whatever ids, are texts of their own and so repeat each other; null ids stay null. Matches never
cross rows. Long texts are cut into pieces that overlap by a window. Columns besides key and text may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from inkstream.llm.common import map_slices, prepare, project, settle, sized, text_slices, utf8, with_row_key

PREFIX = 64
#: Bytes handled side by side, and the longest piece of one text (pieces overlap by a window).
STEP_BYTES, PIECE_BYTES = 1 << 18, 1 << 22
#: Rows of a bucket of pass 3 beyond which it is dealt out further, and how many distances to the anchor go together.
HOT, SPREAD = 256, 16
#: Rows of pass 3 handled side by side, and rows of bytes that leave Python at once.
FINE_ROWS, CUT_ROWS = 4_096, 8_192
#: Repeated windows (some 220 bytes each) that may be broadcast.
BROADCAST_WINDOWS = 20_000
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> None:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, STEP_BYTES + PIECE_BYTES // 8)
        with np.errstate(over="ignore"):
            for name, base in (("_POWERS", _BASE), ("_INVERSE", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.cumprod(steps)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every string of `size` bytes, by its start."""
    n = len(raw)
    _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(raw * _POWERS[:n], out=sums[1:])
    out = sums[size:] - sums[: n + 1 - size]
    out *= _INVERSE[: len(out)]
    return _mix(out)


def anchors(raw: np.ndarray, at: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor, in texts that lie one after another: (text, first window, last window,
    anchor, hash at the anchor), all places counted in raw."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    hashes = rolling(raw, prefix)
    width = length - prefix + 1
    low = np.uint64(24)
    least = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    size = np.diff(at)
    inside = np.repeat(size, size)[: len(place)] - (np.arange(len(place)) - np.repeat(at[:-1], size)[: len(place)]) >= length
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none, none, none, np.zeros(0, np.uint64)
    place = place[start]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, a = start[first], start[last], place[first]
    return np.searchsorted(at, lo, "right") - 1, lo, hi, a, hashes[a]


def _pieces(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, text numbers, offsets in the text): whole texts together, or pieces of one long text."""
    if at[-1] <= PIECE_BYTES or len(at) > 2:
        yield raw, at, np.arange(len(at) - 1), np.zeros(len(at) - 1, np.int64)
        return
    for a in range(0, len(raw), PIECE_BYTES):
        piece = raw[a : a + PIECE_BYTES + length - 1]
        if len(piece) >= length:
            yield piece, np.array([0, len(piece)]), np.zeros(1, np.int64), np.array([a])


def _rows_of(batch: pa.RecordBatch, length: int, prefix: int, places: bool) -> dict:
    out: dict[str, list] = {"key": [], "_row": [], "at": []}
    raw, at = utf8(batch.column("text"))
    rows = batch.column("_row").to_numpy()
    for piece, bounds, numbers, offsets in _pieces(raw, at, length):
        text, lo, hi, a, key = anchors(piece, bounds, length, prefix)
        out["key"].append(key.view(np.int64))
        if places:
            out["_row"].append(rows[numbers[text]])
            out["at"].append(((lo - bounds[text] + offsets[text]) << 16) | ((a - lo) << 8) | (hi - lo))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


#: A run of windows that share an anchor: its bucket, how many texts hold its bytes, one of them, the place there.
_KIND = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("_row", pa.int64()), ("at", pa.int64()), ("content", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for in each text."""
    for batch in (piece for b in batches for piece in text_slices([b], "text")):
        raw, bounds = utf8(batch.column("text"))
        whole, asked = raw.tobytes(), batch.column("asked")
        owner = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
        flat = asked.flatten()
        keys, at = flat.field("key").to_numpy(), flat.field("at").to_numpy()
        rows = batch.column("_row").to_numpy()[owner]
        start = bounds[owner] + (at >> 16)
        stop = start + (at & 255) + length
        for i in range(0, len(at), CUT_ROWS):
            part = slice(i, i + CUT_ROWS)
            content = pa.array([whole[x:y] for x, y in zip(start[part].tolist(), stop[part].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict({"key": keys[part], "_row": rows[part], "at": at[part], "content": content})


def _windows(at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some runs: (run, place after the run's first, place in the bytes, distance to the anchor)."""
    run = (at & 255) + 1
    which = np.repeat(np.arange(len(at)), run)
    step = np.arange(len(which)) - np.repeat(np.cumsum(run) - run, run)
    return which, step, base[which] + step, ((at >> 8) & 255)[which] - step


def equal_windows(raw: np.ndarray, place: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether each window (its place in raw) equals another one of its group: radix passes over eight bytes at a time,
    each of which splits the groups by their next digit and lets windows that are left alone go."""
    short = np.ndarray((max(0, len(raw) - 7),), ">u8", np.ascontiguousarray(raw).data, strides=(1,)) if len(raw) > 7 else np.zeros(0, ">u8")
    order = np.argsort(group, kind="stable")
    group = group[order]
    depths = [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])] if length >= 8 else []
    digits = [(short, d) for d in depths] or [(raw, d) for d in range(length)]
    for k in range(len(digits) + 1):
        new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        alone = new & np.append(new[1:], True)[: len(new)]
        order, group, new = order[~alone], group[~alone], new[~alone]
        if k == len(digits) or not len(order):
            break
        words, depth = digits[k]
        digit = words[place[order] + depth].astype(np.uint64)
        number = np.cumsum(new) - 1
        if (digit == digit[np.flatnonzero(new)][number]).all():
            continue
        again = np.lexsort((digit, number))
        order, digit, number = order[again], digit[again], number[again]
        group = np.cumsum(np.concatenate([[False], (number[1:] != number[:-1]) | (digit[1:] != digit[:-1])]))
    out = np.zeros(len(place), bool)
    out[order] = True
    return out


def _fine(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pass 3 over rows sorted by key: windows of rows with n = 1 that occur in another row of the key."""

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        key, n = table["key"].to_numpy(), table["n"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        some = np.repeat((size > 1) & (np.minimum.reduceat(n, first) == 1), size)
        if not some.any():
            return _runs(np.zeros(0, np.int64), np.zeros(0, np.int64), length)
        table = table.filter(pa.array(some)).combine_chunks()
        key, n, row, at = (table[c].to_numpy() for c in ("key", "n", "_row", "at"))
        raw, base = utf8(table["content"].chunk(0))
        which, step, place, away = _windows(at, base[:-1])
        h = _mix(rolling(raw, length)[place] + _mix(key.view(np.uint64)[which] + away.view(np.uint64) * np.uint64(_BASE)))
        kind, count = np.unique(h, return_inverse=True, return_counts=True)[1:]
        often = np.flatnonzero(count[kind] > 1)
        often = often[equal_windows(raw, place[often], kind[often], length)]
        often = often[n[which[often]] == 1]
        return _runs(row[which[often]], (at >> 16)[which[often]] + step[often], length)

    held: list[pa.RecordBatch] = []
    many, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        if many >= FINE_ROWS and len(own := np.flatnonzero(keys != last)):
            yield one([*held, batch.slice(0, own[0])])
            batch, held, many = batch.slice(own[0]), [], 0
        held.append(batch)
        many, last = many + batch.num_rows, keys[-1]
    if held:
        yield one(held)


_ITEM = pa.schema([("_row", pa.int64()), ("item", pa.int64())])


def _runs(row: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Neighbouring windows as one stretch: items (first byte, bytes) of kind 2."""
    if not len(row):
        return pa.RecordBatch.from_pydict({"_row": [], "item": []}, schema=_ITEM)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    item = (((start[first] << 16) | (start[last] - start[first] + length)) << 2) | 2
    return pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(item)], schema=_ITEM)


def covered(items: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal stretches that the items cover: runs of windows of kind 0 that are not among those of kind 1, and
    stretches of kind 2."""
    kind, value = items & 3, items >> 2
    runs = np.setdiff1d(value[kind == 0], value[kind == 1])
    fine = value[kind == 2]
    start = np.concatenate([runs >> 16, fine >> 16])
    stop = np.concatenate([(runs >> 16) + (runs & 255) + length, (fine >> 16) + (fine & 0xFFFF)])
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.concatenate([[True], start[1:] > stop[:-1]])
    at = np.flatnonzero(first)
    return list(zip(start[at].tolist(), stop[np.append(at[1:], len(start)) - 1].tolist(), strict=True))


def find_repeats(rows: DataFrame, length: int = 200, prefix: int = PREFIX) -> DataFrame:
    """(_row, item) for every text with repeated windows; rows has columns _row and text."""
    if not 0 < prefix <= length or length - prefix > 255:
        raise ValueError("the window may be up to 255 bytes longer than the prefix")
    keys = map_slices(rows, lambda b: _rows_of(b, length, prefix, False), "key long", limit=STEP_BYTES)
    repeated = settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "repeat-keys")
    runs = map_slices(rows, lambda b: _rows_of(b, length, prefix, True), "key long, _row long, at long", limit=STEP_BYTES)
    runs = settle(runs.join(repeated, "key", "left_semi"), "repeat-runs")
    asked = runs.groupBy("_row").agg(F.collect_list(F.struct("key", "at")).alias("asked"))
    prepare(rows.sparkSession)
    content = rows.select("_row", "text").join(asked, "_row").mapInArrow(lambda it: _cut(it, length), "key long, _row long, at long, content binary")
    # _row and at matter where n is 1 only: plain maxima keep the aggregate's buffers flat
    kinds = content.groupBy("key", F.expr("shiftright(at, 8) & 255").alias("rel"), "content").agg(F.count(F.lit(1)).alias("n"), F.max("_row").alias("_row"), F.max("at").alias("at"))
    kinds = settle(kinds.select(*_KIND.names), "repeat-kinds")
    hot = settle(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > HOT).select("key"), "repeat-hot")
    items = [
        runs.select("_row", F.expr("shiftleft(at, 2)").alias("item")),
        kinds.filter("n = 1").select("_row", F.expr("shiftleft(at, 2) + 1").alias("item")),
    ]
    if hot.isEmpty():
        items.append(_passed(kinds, length))
    else:
        items += [_passed(kinds.join(sized(hot), "key", "left_anti"), length), *_dealt(kinds.join(sized(hot), "key", "left_semi"), length, prefix)]
    out = items[0]
    for more in items[1:]:
        out = out.unionByName(more)
    return out


def _passed(kinds: DataFrame, length: int) -> DataFrame:
    """Pass 3 for buckets of bounded size."""
    return kinds.select(*_KIND.names).repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _fine(it, length), from_arrow_schema(_ITEM))


def _dealt(kinds: DataFrame, length: int, prefix: int) -> list[DataFrame]:
    """Pass 3 for large buckets: a further digit, then parts of bounded size as usual, and others by single windows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, row, at = (batch.column(c).to_numpy() for c in ("key", "n", "_row", "at"))
            raw, base = utf8(batch.column("content"))
            whole = raw.tobytes()
            rel, low = (at >> 8) & 255, ((at >> 8) & 255) - (at & 255)
            which, part = np.nonzero((low[:, None] // SPREAD <= np.arange((length - prefix) // SPREAD + 1)) & (rel[:, None] // SPREAD >= np.arange((length - prefix) // SPREAD + 1)))
            far, near = np.minimum(rel[which], part * SPREAD + SPREAD - 1), np.maximum(low[which], part * SPREAD)
            anchor, first = base[:-1][which] + rel[which], base[:-1][which] + rel[which] - far
            core = [whole[a:b] for a, b in zip((anchor - part * SPREAD).tolist(), (anchor + length - np.minimum(part * SPREAD + SPREAD - 1, length - prefix)).tolist(), strict=True)]
            digit = np.fromiter(map(xxhash.xxh64_intdigest, core), np.uint64, len(core))
            bucket = _mix(digit + _mix(keys[which].view(np.uint64) + part.astype(np.uint64) * np.uint64(_BASE)))
            place = ((at >> 16)[which] + rel[which] - far) << 16 | far << 8 | (far - near)
            content = [whole[a:b] for a, b in zip(first.tolist(), (first + far - near + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(n[which]), pa.array(row[which]), pa.array(place), pa.array(content, pa.binary())], schema=_KIND)

    dealt = settle(kinds.select(*_KIND.names).mapInArrow(parts, from_arrow_schema(_KIND)).withColumn("rel", F.expr("shiftright(at, 8) & 255")), "repeat-parts")
    digits = ["key", "rel", "content"]
    again = dealt.groupBy(*digits).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.max("_row").alias("_row"), F.max("at").alias("at"))
    again = settle(again, "repeat-part-kinds")
    # what several rows share in full is known to repeat; one of them goes on
    shared = sized(again.filter("c > 1").select(*digits), BROADCAST_WINDOWS)
    out = [dealt.filter("n = 1").join(shared, digits, "left_semi").select("_row", F.expr("shiftleft(shiftleft(shiftright(at, 16), 16) + octet_length(content), 2) + 2").alias("item"))]
    sizes = settle(again.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "repeat-part-sizes")
    known = again.join(sized(sizes), "key")
    out.append(_passed(known.filter(F.col("rows") <= HOT), length))
    if not sizes.filter(F.col("rows") > HOT).isEmpty():
        out.append(_counted(known.filter(F.col("rows") > HOT), length))
    return out


def _counted(kinds: DataFrame, length: int) -> DataFrame:
    """Pass 3 for what stays together in large numbers: one row for each window, counted by its bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, row, at = (batch.column(c).to_numpy() for c in ("key", "n", "_row", "at"))
            raw, base = utf8(batch.column("content"))
            whole = raw.tobytes()
            which, step, place, away = _windows(at, base[:-1])
            item = ((((at >> 16)[which] + step) << 16 | length) << 2) | 2
            window = [whole[a : a + length] for a in place.tolist()]
            yield pa.RecordBatch.from_pydict({"key": keys[which], "away": away, "window": pa.array(window, pa.binary()), "n": n[which], "_row": row[which], "item": item})

    windows = kinds.select(*_KIND.names).mapInArrow(each, "key long, away long, window binary, n long, _row long, item long")
    digits = ["key", "away", "window"]
    repeated = settle(windows.groupBy(*digits).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*digits), "repeat-windows")
    return windows.filter("n = 1").join(sized(repeated, BROADCAST_WINDOWS), digits, "left_semi").select("_row", "item")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, prefix: int = PREFIX) -> DataFrame:
    """key, n_bytes, spans: array of removed (start, stop) in bytes, and kept: the remaining bytes."""
    rows = with_row_key(project(df, key=key, text=text), "key")
    kind = dict(rows.dtypes)["key"]
    items = find_repeats(rows.select("_row", "text"), length, prefix).groupBy("_row").agg(F.collect_list("item").alias("items"))
    met = rows.join(items, "_row", "left").select("key", "text", "items")

    def kernel(batch: pa.RecordBatch) -> dict:
        raw, at = utf8(batch.column("text"))
        whole, at = raw.tobytes(), at.tolist()
        out: dict = {"key": batch.column("key"), "n_bytes": np.diff(at), "spans": [], "kept": []}
        for i, items in enumerate(batch.column("items")):
            text = whole[at[i] : at[i + 1]]
            spans = covered(items.values.to_numpy(), length) if items.is_valid else []
            edges = [0, *(e for s in spans for e in s), len(text)]
            out["kept"].append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            out["spans"].append([{"start": a, "stop": b} for a, b in spans])
        return out

    return map_slices(met, kernel, f"key {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary").withColumnRenamed("key", key)
