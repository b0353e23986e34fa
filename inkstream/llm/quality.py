"""Operator 10, quality classifier: a generalised additive model with pairwise interactions.

Each text gives a vector of shares and ratios over its whole length. Boosting goes round the features in turn and
fits a shallow tree to one feature's bins; the trees of a feature add up to one lookup table. Then pairs of features
get tables of their own on coarser bins (every feature's own cuts, thinned out), in the same way: those pairs whose
cells explain most of what is left beyond what rows and columns of cells explain alone. Features with one bin only
take part in neither. A score is the sum of looked-up bin values.

Labels come from at most LABELS rows (those with the smallest hashes of the id), so fitting takes the driver bounded
memory: should ids of documents repeat, at most TEXTS texts for each label on average. Everything else covers all rows.
Null and empty texts have all features zero and are scored like any other; texts of any length are read whole.
Without labels, or with one class only, all scores are the share of ones (0.5 without labels). Repeated label rows
count as often as they come; null labels and ids are left out. A null id is in no held-out fold. Repeated documents
give repeated rows, an empty table none. Further columns may have any names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import column_at, encoded, map_slices, project, utf8

#: Most labelled rows the model is fitted on.
LABELS = 6_000
#: Texts for each label, should several rows have its id.
TEXTS = 4
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 60, 0.15, 3
_MARKS = b"!#$%&*|<>{}[]()/\\_=+-:;,.?\"'"
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "space", "line_break", "beyond_ascii", "control",
    *(f"mark_{m}" for m in _MARKS),
    "word_bytes", "long_words", "one_byte_words", "distinct_words", "commonest_word", "distinct_lines", "line_bytes",
    "capital_words", "words_with_marks", "repeated_neighbours",
)
_CLASSES = np.zeros((256, 7 + len(_MARKS)), np.float64)
for _b in range(256):
    _CLASSES[_b, 0] = 97 <= _b < 123
    _CLASSES[_b, 1] = 65 <= _b < 91
    _CLASSES[_b, 2] = 48 <= _b < 58
    _CLASSES[_b, 3] = _b in (9, 32)
    _CLASSES[_b, 4] = _b == 10
    _CLASSES[_b, 5] = _b >= 128
    _CLASSES[_b, 6] = _b < 32 and _b not in (9, 10, 13)
for _k, _b in enumerate(_MARKS):
    _CLASSES[_b, 7 + _k] = 1


def features(array: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    raw, at = utf8(array)
    n = len(array)
    size = np.diff(at)
    out = np.zeros((n, len(FEATURES)))
    for a in range(0, n, 64):
        b = min(n, a + 64)
        owner = np.repeat(np.arange(b - a) * 256, size[a:b])
        counts = np.bincount(owner + raw[at[a] : at[b]], minlength=(b - a) * 256).reshape(b - a, 256)
        out[a:b, 1 : 1 + _CLASSES.shape[1]] = counts @ _CLASSES / np.maximum(size[a:b], 1)[:, None]
    out[:, 0] = np.log1p(size)
    k = 1 + _CLASSES.shape[1]
    for i, text in enumerate(encoded(array)):
        words = text.split()
        m = len(words)
        if not m:
            continue
        kinds: dict[bytes, int] = {}
        for w in words:
            kinds[w] = kinds.get(w, 0) + 1
        lengths = list(map(len, words))
        lines = text.split(b"\n")
        out[i, k:] = (
            sum(lengths) / m,
            sum(x > 15 for x in lengths) / m,
            lengths.count(1) / m,
            len(kinds) / m,
            max(kinds.values()) / m,
            len(set(lines)) / len(lines),
            len(text) / len(lines),
            sum(map(bytes.istitle, words)) / m,
            1 - sum(map(bytes.isalnum, words)) / m,
            sum(map(bytes.__eq__, words, words[1:])) / m,
        )
    return out


def _thinned(cuts: int) -> np.ndarray:
    """Coarse bin of each bin of a feature with so many cuts, of which PAIR_BINS - 1 at most are kept, evenly spread."""
    kept = np.unique(np.linspace(0, cuts - 1, min(cuts, PAIR_BINS - 1)).round().astype(np.int64)) if cuts else np.zeros(0, np.int64)
    return np.searchsorted(kept, np.arange(BINS), "left")


class Additive:
    """Lookup tables by feature and by pair of features; score() adds them up. coarse has a pair table's bin by feature
    and bin."""

    def __init__(self, start: float, cuts: list[np.ndarray], tables: np.ndarray, pairs: list[tuple[int, int]], pair_tables: np.ndarray):
        self.start, self.cuts, self.tables, self.pairs, self.pair_tables = start, cuts, tables, pairs, pair_tables
        self.coarse = np.stack([_thinned(len(c)) for c in cuts])

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.start)
        for k, table in enumerate(self.tables):
            total += table[at[:, k]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[self.coarse[i][at[:, i]], self.coarse[j][at[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree with so many leaves at most: greedy cuts of the bins' gradient and weight sums."""
    edges = [(0, len(gradient))]
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    while len(edges) < leaves:
        best, cut = 1e-9, None
        for e, (a, b) in enumerate(edges):
            inner = np.arange(a + 1, b)
            if not len(inner):
                continue
            gain = (g[inner] - g[a]) ** 2 / (w[inner] - w[a] + 1.0) + (g[b] - g[inner]) ** 2 / (w[b] - w[inner] + 1.0) - worth(a, b)
            if gain.max() > best:
                best, cut = gain.max(), (e, int(inner[gain.argmax()]))
        if cut is None:
            break
        a, b = edges.pop(cut[0])
        edges += [(a, cut[1]), (cut[1], b)]
    out = np.zeros(len(gradient))
    for a, b in edges:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model for features x and labels y of 0 and 1; the same rows in the same order give the same model."""
    width = x.shape[1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) if len(y) else np.zeros(0) for k in range(width)]
    model = Additive(start, cuts, np.zeros((width, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    if not len(y) or y.min() == y.max():
        return model
    at = model.bins(x)
    total = np.full(len(y), start)
    # classes count alike, as quality is judged on both
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(ROUNDS):
        for k in range(width):
            if not len(cuts[k]):
                continue
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(at[:, k], weight * (y - p), BINS), np.bincount(at[:, k], weight * p * (1 - p), BINS), LEAVES)
            model.tables[k] += step
            total += step[at[:, k]]
    coarse = np.stack([model.coarse[k][at[:, k]] for k in range(width)], 1)
    p = 1 / (1 + np.exp(-total))
    cell = lambda i, j: coarse[:, i] * PAIR_BINS + coarse[:, j]
    cells = PAIR_BINS**2
    explained = lambda g, w: float((g**2 / (w + 1.0)).sum())
    gains = []
    for i, j in itertools.combinations([k for k in range(width) if len(cuts[k])], 2):
        g, w = np.bincount(cell(i, j), weight * (y - p), cells).reshape(PAIR_BINS, -1), np.bincount(cell(i, j), weight * p * (1 - p), cells).reshape(PAIR_BINS, -1)
        beyond = explained(g, w) - explained(g.sum(0), w.sum(0)) - explained(g.sum(1), w.sum(1))
        gains.append((-beyond, i, j))
    model.pairs = [(i, j) for gain, i, j in sorted(gains)[:PAIRS] if gain < 0]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for q, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            at_cell = cell(i, j)
            g, w = np.bincount(at_cell, weight * (y - p), cells).reshape(PAIR_BINS, -1), np.bincount(at_cell, weight * p * (1 - p), cells).reshape(PAIR_BINS, -1)
            # a shallow tree: the best cut of one feature, then one of the other on each side
            best, step = -1.0, np.zeros((PAIR_BINS, PAIR_BINS))
            for cut in range(1, PAIR_BINS):
                low, high = _tree(g[:cut].sum(0), w[:cut].sum(0), 2), _tree(g[cut:].sum(0), w[cut:].sum(0), 2)
                worth = float((low * g[:cut].sum(0)).sum() + (high * g[cut:].sum(0)).sum())
                if worth > best:
                    best, step = worth, np.concatenate([np.tile(low, (cut, 1)), np.tile(high, (PAIR_BINS - cut, 1))])
            model.pair_tables[q] += RATE * step
            total += RATE * step.reshape(-1)[at_cell]
    return model


def in_fold(key: Column) -> Column:
    """The held-out fold: crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELS) -> Additive:
    """The model from the labelled rows outside the held-out fold, at most `most` of them (and TEXTS x most texts)."""
    known = project(labels, key=key, label=label).dropna()
    sample = known.filter(~in_fold(F.col("key"))).orderBy(F.xxhash64(F.col("key").cast("string")), "key", "label").limit(most)
    rows = project(docs, key=key, text=text).join(F.broadcast(sample), "key")
    kernel = lambda b: {"key": b.column("key"), "label": b.column("label"), "x": list(features(b.column("text")))}
    kinds = dict(rows.dtypes)
    seen = map_slices(rows.select("key", "label", "text"), kernel, f"key {kinds['key']}, label {kinds['label']}, x array<double>")
    got = seen.orderBy("key", "label", "x").limit(TEXTS * most).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Additive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1). The model's tables go along with the task; no shuffle."""
    rows = project(docs, key=key, text=text)
    kernel = lambda b: {"key": b.column("key"), "score": model.score(features(b.column("text")))}
    return map_slices(rows, kernel, f"key {dict(rows.dtypes)['key']}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Additive, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text scores `least` or more; columns as given."""
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    body = f"_c{column_at(names, text)}"

    def kernel(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in batch.schema.names} | {"keep": model.score(features(batch.column(body))) >= least}

    schema = ", ".join(f"`{n}` {t}" for n, t in flat.dtypes)
    return map_slices(flat, kernel, f"{schema}, keep boolean", text=body).filter("keep").drop("keep").toDF(*names)
