"""Operator 12, byte-level BPE encoding and decoding in length-bucketed, padded matrices.

Texts are split by the pattern that belongs to the vocabulary; distinct parts of like length are the rows of one padded
matrix of symbols, beside it a matrix of the ranks of neighbouring pairs. In every round each row merges its leftmost
pair of least rank, which is the library's own order of merges: argmin finds it, the merged symbol's two new pairs are
looked up in a hash table, and all that stands behind moves up by one, so that the matrix narrows by a column each round.
Rows without a pair leave the matrix. Parts that are in the vocabulary as a whole are taken as they are, as the library
does.

A part of n bytes takes up to n rounds over n columns, so long ones are first cut where no merge can ever cross: between
bytes that no token holds side by side. What is still longer than the widest bucket (junk of one part) is merged by a
queue of pairs instead, in the same order, at a cost that grows as n log n.

Null and empty texts have no tokens and decode to nothing. Texts of any length are read whole. Repeated rows give
repeated rows, an empty table none. Further columns may have any names. No shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstream.llm.common import map_slices, project, strings
from inkstream.llm.words import KnownWords

#: The split pattern that belongs to the vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Widths of the buckets; parts longer than the last go to the queue.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
#: Bytes up to which a part is not worth cutting.
UNCUT = 48
#: Cells of one matrix.
CELLS = 1 << 20
#: Text bytes of one step.
STEP_BYTES = 4 << 20
_FAR = np.iinfo(np.int32).max
_SLOT_BITS = 20


class PairRanks:
    """Hash table from pairs of symbols to their ranks: open addressing, all lookups of an array at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, symbols: int):
        self.base = symbols + 1  # the last symbol pads
        bits = max(_SLOT_BITS, int(len(rank) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, _FAR, np.int32)
        key = left.astype(np.int64) * self.base + right
        at, left_over = self._spot(key), np.arange(len(key))
        while len(left_over):
            spot = at[left_over]
            free = np.flatnonzero(self.slot_key[spot] < 0)
            taken, first = np.unique(spot[free], return_index=True)
            put = left_over[free[first]]
            self.slot_key[taken], self.slot_rank[taken] = key[put], rank[put]
            left_over = np.setdiff1d(left_over, put, assume_unique=True)
            at[left_over] = (at[left_over] + 1) & self.mask

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = self._spot(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_rank[at], _FAR)
        more = np.nonzero((held != key) & (held >= 0))
        while len(more[0]):
            spot = (at[more] + 1) & self.mask
            at[more] = spot
            held = self.slot_key[spot]
            same = held == key[more]
            out[tuple(x[same] for x in more)] = self.slot_rank[spot[same]]
            go = ~same & (held >= 0)
            more = tuple(x[go] for x in more)
        return out


class BytePairs:
    """Encoder and decoder of one vocabulary.

    spelt: the bytes of every id (none for ids that are not in use); pairs: (left id, right id, merged id) by rank; whole:
    ids of parts that are taken without merging; split: the library's own splitter, asked once which characters it knows.
    """

    def __init__(self, spelt: list[bytes], pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], whole: dict[str, int], knows: Callable[[str], bool]):
        import regex

        left, right, rank, to = pairs
        ids = {s: i for i, s in enumerate(spelt) if s}
        missing = [b for b in range(256) if bytes([b]) not in ids]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.size, self.whole = len(spelt), whole
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self.ranks = PairRanks(left, right, rank, self.size)
        self.to = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.to[rank] = to
        self.pairs = dict(zip((left.astype(np.int64) * self.ranks.base + right).tolist(), rank.tolist(), strict=True))
        self.beside = np.zeros(1 << 16, bool)
        for s in ids:
            if len(s) > 1:
                raw = np.frombuffer(s, np.uint8).astype(np.int64)
                self.beside[raw[:-1] * 256 + raw[1:]] = True
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_len = np.array([len(s) for s in spelt], np.int64)
        self.spelt_at = np.cumsum(self.spelt_len) - self.spelt_len
        self.decimal = [str(i) for i in range(self.size)]
        self._split = regex.compile(PATTERN).findall
        every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
        #: Letters and digits of this pattern library that the tokenizer's, of an older standard, counts as other.
        self.later = frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if not knows(c))
        held = "".join(f"\\U{ord(c):08x}" for c in sorted(self.later)) or r"\U0010ffff"
        exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{held}])")
        for kind in (r"\p{L}", r"\p{N}"):
            exact = exact.replace(f"?{kind}+", f"?[{kind}--[{held}]]+")
        self._split_exactly = regex.compile(exact, regex.V1).findall
        self.words = KnownWords(self.encode_parts)

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.later.isdisjoint(text):
            return self._split(text)
        return self._split_exactly(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n + 1 places where texts start."""
        return self.words.ids([self.split(t) for t in texts])

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and how many each has."""
        count = np.ones(len(parts), np.int64)
        known = [self.whole.get(p, -1) for p in parts]
        ids = np.array(known, np.int32)
        rest = np.flatnonzero(ids < 0)
        if not len(rest):
            return ids, count
        pieces: list[bytes] = []
        width = np.ones(len(rest), np.int64)
        for k, i in enumerate(rest.tolist()):
            raw = parts[i].encode()
            if len(raw) <= UNCUT:
                pieces.append(raw)
            else:
                cut = self.cut(raw)
                width[k] = len(cut)
                pieces += cut
        flat, sizes = self.merge(pieces)
        owner = np.cumsum(width) - width
        count[rest] = np.add.reduceat(sizes, owner)
        starts = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        sure = np.flatnonzero(ids >= 0)
        out[starts[sure]] = ids[sure]
        out[np.repeat(starts[rest] - (np.cumsum(count[rest]) - count[rest]), count[rest]) + np.arange(len(flat))] = flat
        return out, count

    def cut(self, raw: bytes) -> list[bytes]:
        """The bytes in parts that no merge can join: no token holds the bytes at a cut side by side."""
        code = np.frombuffer(raw, np.uint8).astype(np.int64)
        edges = [0, *(np.flatnonzero(~self.beside[code[:-1] * 256 + code[1:]]) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in itertools.pairwise(edges)]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of every piece after all merges, one after another, and how many each has."""
        size = np.array([len(p) for p in pieces], np.int64)
        bucket = np.searchsorted(WIDTHS, size, "left")
        count = np.zeros(len(pieces), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for b in np.unique(bucket).tolist():
            index = np.flatnonzero(bucket == b)
            if b == len(WIDTHS):
                for i in index.tolist():
                    own = self.merge_queue(pieces[i])
                    count[i] = len(own)
                    found.append((np.array([i]), own))
                continue
            step = max(1, CELLS // WIDTHS[b])
            for k in range(0, len(index), step):
                rows = index[k : k + step]
                for row, n, symbols in self.merge_matrix([pieces[i] for i in rows.tolist()], WIDTHS[b]):
                    count[rows[row]] = n
                    found.append((rows[row], symbols))
        starts = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for rows, symbols in found:
            n = count[rows]
            out[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(len(symbols))] = symbols
        return out, count

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, symbols left in each, those symbols one after another) for the rows that ended in each round."""
        size = np.array([len(p) for p in pieces], np.int64)
        grid = np.full((len(pieces), width), self.size, np.int32)
        grid[np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), _FAR, np.int32)  # of each column and the next; the last column stays far
        rank[:, :-1] = self.ranks.of(grid[:, :-1], grid[:, 1:])
        row, done = np.arange(len(pieces)), []
        while True:
            lines = np.arange(len(row))
            best = rank.argmin(1)
            low = rank[lines, best]
            over = low == _FAR
            if over.any():
                done.append((row[over], size[over], grid[over][np.arange(grid.shape[1]) < size[over][:, None]]))
                live = ~over
                grid, rank, row, size, best, low = grid[live], rank[live], row[live], size[live], best[live], low[live]
                if not len(row):
                    return done
                lines = np.arange(len(row))
            behind = np.arange(grid.shape[1] - 1) > best[:, None]
            grid = np.where(behind, grid[:, 1:], grid[:, :-1])
            rank = np.where(behind, rank[:, 1:], rank[:, :-1])
            grid[lines, best] = self.to[low]
            size = size - 1
            ahead = np.flatnonzero(best > 0)
            rank[ahead, best[ahead] - 1] = self.ranks.of(grid[ahead, best[ahead] - 1], grid[ahead, best[ahead]])
            rank[lines, best] = _FAR
            more = np.flatnonzero(best < size - 1)
            rank[more, best[more]] = self.ranks.of(grid[more, best[more]], grid[more, best[more] + 1])

    def merge_queue(self, piece: bytes) -> np.ndarray:
        """Symbols of a long piece after merging its leftmost pair of least rank, one at a time."""
        symbol: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        base, pairs, to = self.ranks.base, self.pairs, self.to.tolist()
        n = len(symbol)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := pairs.get(symbol[i] * base + symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = right[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = to[rank], -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := pairs.get(symbol[i] * base + symbol[k])) is not None:
                    heapq.heappush(queue, (r, i, symbol[i], symbol[k]))
            if (h := left[i]) >= 0 and (r := pairs.get(symbol[h] * base + symbol[i])) is not None:
                heapq.heappush(queue, (r, h, symbol[h], symbol[i]))
        return np.array([s for s in symbol if s >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids spell, one after another."""
        size = self.spelt_len[ids]
        ends = np.cumsum(size)
        return self.spelt[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.spelt_at[ids] - ends + size, size)]


def _as_text(spelt: dict[bytes, int]) -> dict[str, int]:
    """The tokens that are texts of their own: only those can be a whole part."""
    out = {}
    for raw, i in spelt.items():
        try:
            out[raw.decode()] = i
        except UnicodeDecodeError:
            continue
    return out


def from_ranks(path: str) -> BytePairs:
    """A file of base64 tokens and ranks: a pair's rank is that of the token it spells, which is also its id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    spelt = [b""] * (max(ranks.values()) + 1)
    pairs = []
    for raw, i in ranks.items():
        spelt[i] = raw
        for k in range(1, len(raw)):
            a, b = ranks.get(raw[:k]), ranks.get(raw[k:])
            if a is not None and b is not None:
                pairs.append((a, b, i))
    left, right, to = np.array(pairs, np.int32).reshape(-1, 3).T
    # Tokens of a letter or digit and the first byte of a character: used where the splitter keeps both in one part.
    probe = {bytes([b]): b for b in range(256)} | {a + bytes([b]): 256 * (k + 1) + b for k, a in enumerate((b"a", b"1")) for b in range(256)}
    library = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=probe, special_tokens={})
    return BytePairs(spelt, (left, right, to, to), _as_text(ranks), lambda c: library.encode_ordinary("a" + c)[0] > 255 or library.encode_ordinary("1" + c)[0] > 255)


def byte_of_char() -> dict[str, int]:
    """The character that stands for each byte in vocabularies kept as JSON: itself where it is visible, else the next one
    from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


def from_merges(path: str) -> BytePairs:
    """A tokenizer kept as JSON with a byte-level vocabulary and a list of merges, whose order is their rank."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back, vocab = byte_of_char(), model["vocab"]
    if model.get("ignore_merges"):
        raise ValueError("this vocabulary takes known parts without merging")
    spelt = [b""] * (max(vocab.values()) + 1)
    for name, i in vocab.items():
        if all(c in back for c in name):
            spelt[i] = bytes(back[c] for c in name)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right, to = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int32).reshape(-1, 3).T
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    return BytePairs(spelt, (left, right, np.arange(len(to), dtype=np.int32), to), {}, lambda c: len(split("a" + c)) == 1 or len(split("1" + c)) == 1)


_LOADED: dict[str, BytePairs] = {}


def load(path: str) -> BytePairs:
    """The vocabulary of a path, once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = from_merges(path) if path.endswith(".json") else from_ranks(path)
    return _LOADED[path]


def encode_bytes(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, decoded binary: each text's ids, and the bytes that those ids spell. No shuffle."""
    rows = project(df, key=key, text=text)

    def kernel(batch: pa.RecordBatch) -> dict:
        m = load(vocabulary)
        ids, at = m.encode(strings(batch.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
        return {"key": batch.column("key"), "ids": lists, "decoded": [m.decode(ids[a:b]).tobytes() for a, b in itertools.pairwise(at.tolist())]}

    return map_slices(rows, kernel, f"key {dict(rows.dtypes)['key']}, ids array<int>, decoded binary", limit=STEP_BYTES).withColumnRenamed("key", key)


def byte_digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (of the decoded bytes). No shuffle."""
    rows = project(df, key=key, text=text)

    def kernel(batch: pa.RecordBatch) -> dict:
        m = load(vocabulary)
        flat, at = m.encode(strings(batch.column("text")))
        spans = list(itertools.pairwise(at.tolist()))
        names = list(map(m.decimal.__getitem__, flat.tolist()))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return {
            "key": batch.column("key"),
            "n_tokens": np.diff(at),
            "ids_sha256": [sha(",".join(names[a:b]).encode()) for a, b in spans],
            "decoded_sha256": [sha(m.decode(flat[a:b]).tobytes()) for a, b in spans],
        }

    return map_slices(rows, kernel, f"key {dict(rows.dtypes)['key']}, n_tokens long, ids_sha256 string, decoded_sha256 string", limit=STEP_BYTES).withColumnRenamed("key", key)
