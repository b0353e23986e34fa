"""Operator 3, SentencePiece encoding and decoding by vectorised merge rounds.

Words (runs of the space mark with what follows, which no piece of the model crosses) are encoded together: flat
symbol arrays, the segmented minimum of the pair ranks of each word, all leftmost occurrences of that pair merged at
once, compaction of the arrays, until no pair remains. This gives the library's order of merges as long as a round
never makes a pair that ranks before the one just merged, and no two pieces share the score. Both are checked in
every round; only the words concerned go to a queue that merges one pair at a time.

Long runs without a blank (scripts that write none, or junk) would take a round for each of their distinct pairs, with
all words waiting, so they are cut first where no merge can ever cross: between neighbouring symbols that no piece of
the model holds side by side. The parts are encoded as words of their own; the rounds of words are run in groups of
like length, so that long words do not hold up short ones.

Null and empty texts have no tokens and decode to the empty text. Texts of any length are read whole. Repeated rows give
repeated rows, an empty table none. Further columns may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstream.llm.common import map_slices, project, strings
from inkstream.llm.words import KnownWords

SPACE = "▁"
#: Words longer than this (in symbols) are cut where no piece crosses, and go through rounds of their own.
LONG_WORD = 256
#: Ends of the groups of lengths whose rounds run together; what has no cut for longer than the last (junk) is merged
#: by the queue, whose cost grows as n log n.
LENGTHS = (256, 1_024, 4_096)
_FAR = np.iinfo(np.int64).max


def _spread(key: np.ndarray) -> np.ndarray:
    return key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Encoder and decoder for a BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        special = np.array([lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)])
        names = [lib.id_to_piece(i) for i in range(n)]
        ids = {names[i]: i for i in np.flatnonzero(~special).tolist()}
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece of this model crosses words")
        if lib.decode(lib.encode("a  b ")) != "a  b ":
            raise ValueError("this model normalises texts")
        if any("\n" in p for p in ids):
            raise ValueError("a piece of this model holds a line break")
        self._words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        self.words = KnownWords(self.encode_words)

        chars = sorted({c for p in ids for c in p} - ids.keys())
        self.symbols = ids | {c: n + k for k, c in enumerate(chars)}  # n and more: no piece of its own, but part of pieces
        self.known = n + len(chars)
        self.char = np.full(0x110000, -1, np.int64)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.beside = np.unique([self.symbols[a] * self.known + self.symbols[b] for p in ids for a, b in itertools.pairwise(p)])
        self.scores = np.array([lib.get_score(i) for i in range(n)])
        order = np.unique(-self.scores, return_inverse=True)[1]
        shared = np.bincount(order[sorted(ids.values())], minlength=order.max() + 1) > 1
        keys, to = [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.known + b)
                    to.append(i)
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[at]
        self.pair_to = np.array(to, np.int64)[at]
        self.pair_rank = np.append(order[self.pair_to], _FAR)
        self.slot_shift = np.uint64(64 - 18)
        self.slot = np.zeros(1 << 18, np.int64)
        self.slot_full = np.zeros(len(keys), bool)
        spot = _spread(self.pair_keys) >> self.slot_shift
        self.slot[spot] = np.arange(len(keys))
        crowd = np.bincount(spot.astype(np.int64), minlength=1 << 18)
        self.slot_full[self.slot[np.flatnonzero(crowd > 1)]] = True
        self.slot_keys = self.pair_keys
        self.shared_rank = shared
        self.pairs = dict(zip(self.pair_keys.tolist(), self.pair_to.tolist(), strict=True))

        spelt = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.spelt_len = np.array([len(x) for x in spelt], np.int64)
        self.spelt_at = np.concatenate([[0], np.cumsum(self.spelt_len)])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.opens = np.array([p.startswith(SPACE) for p in names]) & ~special
        self.plain = ~special
        self.plain[self.byte_ids] = True
        self.decimal = [str(i) for i in range(n)]

    def _symbols_of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        out = self.char[points]
        odd = out < 0
        out[odd] = self.known + points[odd]
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the model's pairs, or -1."""
        key = np.where((left < self.known) & (right < self.known), left * self.known + right, -1)
        at = self.slot[_spread(key) >> self.slot_shift]
        out = np.where(self.slot_keys[at] == key, at, -1)
        more = np.flatnonzero(self.slot_full[at] & (out < 0))  # pairs whose slot another one took
        if len(more):
            k = np.minimum(np.searchsorted(self.pair_keys, key[more]), len(self.pair_keys) - 1)
            out[more] = np.where(self.pair_keys[k] == key[more], k, -1)
        return out

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols left in all words after all merges, how many each word has, and whether its order of merges must
        be followed one by one instead (then it has none)."""
        size = np.array([len(w) for w in words], np.int64)
        symbol = self._symbols_of("".join(words))
        word = np.arange(len(words))
        before = np.full(len(words), -1, np.int64)
        odd = np.zeros(len(words), bool)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edge = np.cumsum(size) - 1
        pair = np.full(len(symbol), -1, np.int64)
        inside = np.ones(len(symbol), bool)
        inside[edge] = False
        at = np.flatnonzero(inside)
        pair[at] = self._lookup(symbol[at], symbol[at + 1])
        while len(symbol):
            rank = self.pair_rank[pair]  # the last entry, for -1, is far
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, first)
            over = best == _FAR
            bad = ~over & ((best <= before) | self.shared_rank[np.where(over, 0, best)])
            odd[word[bad]] = True
            ended = over | bad
            if ended.any():
                gone = np.repeat(ended, size)
                put = np.repeat(over, size)
                done.append((word[over], size[over], symbol[put]))
                stay = ~gone
                symbol, pair, rank = symbol[stay], pair[stay], rank[stay]
                live = ~ended
                word, size, best = word[live], size[live], best[live]
                if not len(symbol):
                    break
            before = best
            take = rank == np.repeat(best, size)
            hit = np.flatnonzero(take)
            if len(hit) > 1 and (follow := np.diff(hit) == 1).any():  # overlapping occurrences: from the left
                follow = np.concatenate([[False], follow])
                index = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(follow, 0, index))
                hit = hit[(index - run) % 2 == 0]
            symbol[hit] = self.pair_to[pair[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            pair[hit] = pair[hit + 1]  # -1 at a word's end, else it is found anew
            new = hit - np.arange(len(hit))
            owner = np.searchsorted(np.cumsum(size), hit, "right")
            symbol, pair = symbol[keep], pair[keep]
            size = size - np.bincount(owner, minlength=len(size))
            first, last = np.cumsum(size) - size, np.cumsum(size) - 1
            right = new[new < last[owner]]
            pair[new[new == last[owner]]] = -1
            pair[right] = self._lookup(symbol[right], symbol[right + 1])
            back = new[new > first[owner]] - 1
            pair[back] = self._lookup(symbol[back], symbol[back + 1])
        count = np.zeros(len(words), np.int64)
        for w, n, _ in done:
            count[w] = n
        starts = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int64)
        for w, n, s in done:
            flat[np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(len(s))] = s
        return flat, count, odd

    def merge_queue(self, word: str) -> list[int]:
        """Symbols of a word after merging the best pair, leftmost first, one at a time."""
        symbol: list[int] = self._symbols_of(word).tolist()
        n = len(symbol)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            a, b = symbol[i], symbol[j]
            if a < self.known and b < self.known and (to := self.pairs.get(a * self.known + b)) is not None:
                heapq.heappush(queue, (-self.scores[to], i, a, b, to))

        for i in range(n - 1):
            push(i, i + 1)
        while queue:
            _, i, a, b, to = heapq.heappop(queue)
            j = right[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = to, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                push(i, right[j])
            if left[i] >= 0:
                push(left[i], i)
        return [s for s in symbol if s >= 0]

    def _ids(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, where what is no piece becomes the pieces of its bytes."""
        odd = np.flatnonzero(symbols >= self.scores.size)
        if not len(odd):
            return symbols.astype(np.int32), count
        back = {v: k for k, v in self.symbols.items() if v >= self.scores.size}
        spelt = [self.byte_ids[list((back.get(s) or chr(s - self.known)).encode())] for s in symbols[odd].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(x) for x in spelt]
        out = np.repeat(symbols, width).astype(np.int32)
        start = (np.cumsum(width) - width)[odd]
        out[np.repeat(start - (np.cumsum(width[odd]) - width[odd]), width[odd]) + np.arange(int(width[odd].sum()))] = np.concatenate(spelt)
        ends = np.concatenate([[0], np.cumsum(width)])
        edge = np.cumsum(count)
        return out, ends[edge] - ends[edge - count]

    def cut(self, word: str) -> list[str]:
        """The word in parts that no merge can join: no piece holds the symbols at a cut side by side."""
        symbol = self._symbols_of(word)
        left, right = symbol[:-1], symbol[1:]
        key = np.where((left < self.known) & (right < self.known), left * self.known + right, -1)
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        edges = [0, *(np.flatnonzero(self.beside[at] != key) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in itertools.pairwise(edges)]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left in all words, and how many each has; words are of like length."""
        flat, count, odd = self.merge_rounds(words)
        if odd.any():
            edge = np.cumsum(count)
            parts, k = [], 0
            for i in np.flatnonzero(odd).tolist():
                own = np.array(self.merge_queue(words[i]), np.int64)
                parts += [flat[k : edge[i] - count[i]], own]
                k, count[i] = edge[i], len(own)
            flat = np.concatenate([*parts, flat[k:]])
        return flat, count

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        cuts = {i: self.cut(w) for i, w in enumerate(words) if len(w) > LONG_WORD}
        parts = words if not cuts else [p for i, w in enumerate(words) for p in cuts.get(i, (w,))]
        group = np.searchsorted(LENGTHS, [len(p) for p in parts], "left")
        count = np.zeros(len(parts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for g in np.unique(group).tolist():
            index = np.flatnonzero(group == g)
            if g == len(LENGTHS):
                own = [self.merge_queue(parts[i]) for i in index.tolist()]
                symbol, n = np.array(list(itertools.chain.from_iterable(own)), np.int64), np.array([len(x) for x in own], np.int64)
            else:
                symbol, n = self._merged([parts[i] for i in index.tolist()] if len(index) < len(parts) else parts)
            count[index] = n
            found.append((index, n, symbol))
        if len(found) == 1:
            flat = found[0][2]
        else:
            starts = np.cumsum(count) - count
            flat = np.empty(int(count.sum()), np.int64)
            for index, n, symbol in found:
                flat[np.repeat(starts[index] - (np.cumsum(n) - n), n) + np.arange(len(symbol))] = symbol
        ids, count = self._ids(flat, count)
        if cuts:
            width = np.ones(len(words), np.int64)
            width[list(cuts)] = [len(x) for x in cuts.values()]
            count = np.add.reduceat(count, np.cumsum(width) - width)
        return ids, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, as the library's encode gives them, and the n + 1 places where texts start."""
        return self.words.ids([self._words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids one after another; the space mark is a space, and control ids have none."""
        size = self.spelt_len[ids]
        ends = np.cumsum(size)
        return self.spelt[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.spelt_at[ids] - ends + size, size)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode gives it."""
        if not len(ids):
            return ""
        if not self.opens[ids[0]] or not self.plain[ids].all():
            return self.library.decode(ids.tolist())
        try:
            return self.spell(ids)[1:].tobytes().decode()
        except UnicodeDecodeError:  # bytes that make no character
            return self.library.decode(ids.tolist())


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model of a path, once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_pieces(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, decoded string: each text's SentencePiece ids, and what decoding those ids gives. No shuffle."""
    rows = project(df, key=key, text=text)

    def kernel(batch: pa.RecordBatch) -> dict:
        m = load(model)
        ids, at = m.encode(strings(batch.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
        return {"key": batch.column("key"), "ids": lists, "decoded": [m.decode(ids[a:b]) for a, b in itertools.pairwise(at.tolist())]}

    return map_slices(rows, kernel, f"key {dict(rows.dtypes)['key']}, ids array<int>, decoded string").withColumnRenamed("key", key)


def piece_digests(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of each text. No shuffle."""
    rows = project(df, key=key, text=text)

    def kernel(batch: pa.RecordBatch) -> dict:
        m = load(model)
        flat, at = m.encode(strings(batch.column("text")))
        ids = [flat[a:b] for a, b in itertools.pairwise(at.tolist())]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return {
            "key": batch.column("key"),
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [sha(",".join(map(m.decimal.__getitem__, x.tolist()))) for x in ids],
            "decoded_sha256": [sha(m.decode(x)) for x in ids],
        }

    return map_slices(rows, kernel, f"key {dict(rows.dtypes)['key']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
