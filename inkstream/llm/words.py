"""Words that a Python worker has already encoded, with their ids, in bounded memory."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Callable

import numpy as np

#: Bytes of words, ids and places that one worker keeps; what one slice of texts adds comes on top.
KEPT_BYTES = 64 << 20
#: Bytes that a word's entries take besides its characters and ids.
_ENTRY = 120


class _Places(dict):
    """Words by the order in which they were first met; new: those not encoded yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = place = len(self)
        return place


class _Chunks:
    """An array that grows at its end, in steps that double."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1024, kind), 0

    def append(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(max(need, 2 * len(self.data)) - self.size, self.data.dtype)])
        self.data[self.size : need] = more
        self.size = need


class KnownWords:
    """encode: distinct words -> the ids of all of them one after another, and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = KEPT_BYTES):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self._places, self._ids, self._start, self._count, self.kept = _Places(), _Chunks(np.int32), _Chunks(np.int64), _Chunks(np.int64), 0

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as their words, one after another, and the n + 1 places where texts start."""
        place = np.fromiter(map(self._places.__getitem__, itertools.chain.from_iterable(texts)), np.int64)
        if new := self._places.new:
            found, count = self.encode(new)
            self._start.append(self._ids.size + np.cumsum(count) - count)
            self._ids.append(found)
            self._count.append(count)
            self.kept += sum(map(sys.getsizeof, new)) + 4 * len(found) + _ENTRY * len(new)
            self._places.new = []
        size, start = self._count.data[place], self._start.data[place]
        ends = np.cumsum(size)
        ids = self._ids.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)]
        words = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        if self.kept > self.most:
            self.forget()
        return ids, np.concatenate([[0], ends])[words]
