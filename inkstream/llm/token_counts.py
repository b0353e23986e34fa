"""Operator 5, token counts by offset-mapped attribution.

A whole document is encoded once, so counts add up to what a model sees. Byte-level pieces spell their own bytes,
which gives every token's span; the spans are interval-joined to the document's sections by binary search in the
sections' bounds. A token that crosses bounds goes to one section by an explicit rule:

* `first`: the section that holds its first byte,
* `last`: the section that holds its last byte,
* `most`: the section that holds most of its bytes, the earliest of equals.

Sections are lines with their line break, spans of characters in a column of their own (`spans`), or whole columns
that make up the document (`field_tokens`). Spans may come in any order and leave gaps: they are taken by start, cut at
the text's ends, and where two overlap the earlier one keeps the characters; tokens of gaps are counted as outside. Null
spans, like lines of null and empty texts, are one section of the whole text. Null fields are empty ones. Texts of any
length are encoded whole. Repeated rows give repeated rows, an empty table none; further columns may have any names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import map_slices, project, strings

#: The split pattern that belongs to the rank file (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")


class Encoder:
    """Byte-level BPE with the length in bytes of every token."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)

    def ends(self, text: str) -> np.ndarray:
        """For each token of the text, the byte after its last."""
        return np.cumsum(self.size[np.array(self.encoding.encode_ordinary(text), np.int64)])


_LOADED: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def line_bounds(raw: bytes) -> np.ndarray:
    """Byte ends of a text's lines, each with its line break; at least one section."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return breaks if len(breaks) and breaks[-1] == len(raw) else np.append(breaks, len(raw))


def attribute(token_ends: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and of those the ones that cross a bound."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, token_ends, "left")
    cross = first != last
    to = last if rule == "last" else first.copy()
    if rule == "most" and cross.any():
        some = np.flatnonzero(cross)
        best, most = first[some], bounds[first[some]] - starts[some]
        for step in range(1, int((last - first).max()) + 1):
            here = np.minimum(first[some] + step, last[some])
            own = np.minimum(bounds[here], token_ends[some]) - bounds[here - 1]
            better = (here == first[some] + step) & (own > most)
            best, most = np.where(better, here, best), np.where(better, own, most)
        to[some] = best
    return np.bincount(to, minlength=len(bounds)), np.bincount(to[cross], minlength=len(bounds))


def span_bounds(spans: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends, in characters, of spans and the gaps around them from the first character on, and which of them are spans;
    spans are sorted, within the text, and do not overlap any more."""
    ends, given, at = [], [], 0
    for start, stop in sorted(spans):
        start, stop = max(at, min(start, size)), max(at, min(stop, size))
        stop = max(start, stop)
        if start > at:
            ends.append(start)
            given.append(False)
        ends.append(stop)
        given.append(True)
        at = stop
    if at < size or not ends:
        ends.append(size)
        given.append(False)
    return np.array(ends, np.int64), np.array(given, bool)


def _byte_at(text: str, raw: bytes) -> np.ndarray | None:
    """The byte at which each character starts, and the length; None where characters are bytes."""
    if len(raw) == len(text):
        return None
    return np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


def _counted(token_ends: np.ndarray, bounds: np.ndarray, rules: tuple[str, ...]) -> tuple[list[np.ndarray], int]:
    """Tokens of each section by every rule, and how many tokens cross a bound. Empty sections get none."""
    full = np.flatnonzero(np.diff(bounds, prepend=0) > 0)
    out, cross = [], 0
    for rule in rules:
        counts = np.zeros(len(bounds), np.int64)
        if len(full):
            counts[full], crossing = attribute(token_ends, bounds[full], rule)
            cross = int(crossing.sum())
        out.append(counts)
    return out, cross


def section_tokens(df: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", rules: tuple[str, ...] = ("first",), spans: str | None = None) -> DataFrame:
    """key, n_tokens, n_crossing, n_outside (tokens of gaps by the first rule) and sections: array of (start, stop) in
    characters with the tokens by every rule under its name. spans names a column of arrays of (start, stop); without
    it sections are lines. No shuffle."""
    _known(rules)
    rows = project(df, key=key, text=text, **({"spans": spans} if spans else {}))

    def kernel(batch: pa.RecordBatch) -> dict:
        encoder = load(ranks)
        out: dict = {"key": batch.column("key"), "n_tokens": [], "n_crossing": [], "n_outside": [], "sections": []}
        told = batch.column("spans").to_pylist() if spans else [None] * batch.num_rows
        for t, said in zip(strings(batch.column("text")), told, strict=True):
            raw, ends = t.encode(), encoder.ends(t)
            at = _byte_at(t, raw)
            if said is None:
                bounds = line_bounds(raw) if not spans else np.array([len(raw)])
                stops = bounds if at is None else np.searchsorted(at, bounds)
                given = np.ones(len(bounds), bool)
            else:
                pairs = [tuple(s.values())[:2] for s in said if s is not None]
                stops, given = span_bounds([(a, b) for a, b in pairs if a is not None and b is not None], len(t))
                bounds = stops if at is None else at[stops]
            counts, cross = _counted(ends, bounds, rules)
            out["n_tokens"].append(len(ends))
            out["n_crossing"].append(cross)
            out["n_outside"].append(int(counts[0][~given].sum()))
            starts = np.concatenate([[0], stops[:-1]])
            own = [stops[given].tolist(), *(c[given].tolist() for c in counts)]
            out["sections"].append([dict(zip(("start", "stop", *rules), x, strict=True)) for x in zip(starts[given].tolist(), *own, strict=True)])
        return out

    names = "".join(f",{r}:long" for r in rules)
    schema = f"key {dict(rows.dtypes)['key']}, n_tokens long, n_crossing long, n_outside long, sections array<struct<start:long,stop:long{names}>>"
    return map_slices(rows, kernel, schema).withColumnRenamed("key", key)


def _known(rules: tuple[str, ...]) -> None:
    if not rules or set(rules) - set(RULES):
        raise ValueError(f"rules {rules!r} are not some of {RULES}")


def field_tokens(df: DataFrame, ranks: str, fields: tuple[str, ...], key: str = "doc_id", separator: str = "\n\n", rule: str = "first") -> DataFrame:
    """key, n_tokens, n_crossing, and for each field, in order, its tokens in the array `tokens`.

    The document is the fields with a separator behind each but the last, which counts to the field before it; it is
    encoded once, as a model would see it.
    """
    _known((rule,))
    rows = project(df, key=key, **{f"f{i}": f for i, f in enumerate(fields)})
    parts = [F.coalesce(F.col(f"f{i}").cast("string"), F.lit("")) for i in range(len(fields))]
    parts = [F.concat(p, F.lit(separator)) for p in parts[:-1]] + parts[-1:]
    rows = rows.select("key", F.concat(*parts).alias("text"), F.array(*[F.octet_length(p).cast("long") for p in parts]).alias("sizes"))

    def kernel(batch: pa.RecordBatch) -> dict:
        encoder = load(ranks)
        out: dict = {"key": batch.column("key"), "n_tokens": [], "n_crossing": [], "tokens": []}
        for t, sizes in zip(strings(batch.column("text")), batch.column("sizes").to_pylist(), strict=True):
            ends = encoder.ends(t)
            (counts,), cross = _counted(ends, np.cumsum(sizes), (rule,))
            out["n_tokens"].append(len(ends))
            out["n_crossing"].append(cross)
            out["tokens"].append(counts.tolist())
        return out

    schema = f"key {dict(rows.dtypes)['key']}, n_tokens long, n_crossing long, tokens array<long>"
    return map_slices(rows, kernel, schema).withColumnRenamed("key", key)
