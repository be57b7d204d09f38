"""Words of Arrow texts as byte ranges: found, hashed and told apart by numpy, a batch at a time."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes, A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words longer than so many bytes are hashed one by one.
LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def inside(*outside: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to words: all but those in the given ranges (first, last)."""
    table = np.ones(256, bool)
    for lo, hi in outside:
        table[lo : hi + 1] = False
    return table


class Words:
    """The words of all texts of an array, in order: raw[starts : starts + lengths] are their bytes, A-Z lowered; rows are the
    numbers of their texts. Null texts have none."""

    def __init__(self, texts: pa.Array, word: np.ndarray) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body is not None and len(edges) > 1 else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        self.raw = np.zeros(len(data) + 8, np.uint8)
        np.take(LOWER, data, out=self.raw[: len(data)])
        mark = np.take(word, data)
        step = np.zeros(len(data) + 1, bool)  # whether a word may begin or end before this byte
        step[1:-1] = mark[1:] != mark[:-1]
        step[edges] = True
        at = np.flatnonzero(step)
        first = at[:-1][mark[at[:-1]]] if len(at) > 1 else np.zeros(0, np.int64)
        self.starts = first
        self.lengths = at[1:][mark[at[:-1]]] - first if len(at) > 1 else np.zeros(0, np.int64)
        self.counts = np.diff(np.searchsorted(first, edges))
        self.rows = np.repeat(np.arange(len(texts)), self.counts)

    @staticmethod
    def of(names: pa.Array) -> Words:
        """Given words, as they are, in the place of those of texts."""
        names = names.cast(pa.large_string())
        edges = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
        out = object.__new__(Words)
        out.raw = np.concatenate([np.frombuffer(names.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], np.zeros(8, np.uint8)])
        out.starts, out.lengths, out.rows, out.counts = edges[:-1] - edges[0], np.diff(edges), None, None
        return out

    def take(self, keep: np.ndarray) -> Words:
        """Some of the words."""
        out = object.__new__(Words)
        out.raw, out.starts, out.lengths, out.rows, out.counts = self.raw, self.starts[keep], self.lengths[keep], self.rows[keep], None
        return out

    def hashed(self, most: int | None = None, seed: np.ndarray | int = 0, which: int = 0) -> np.ndarray:
        """64-bit hashes of the words, or of their first `most` bytes."""
        lengths = self.lengths if most is None else np.minimum(self.lengths, most)
        window = np.ndarray((len(self.raw) - 7,), "<u8", buffer=self.raw, strides=(1,))
        h = np.full(len(lengths), 0x51ED270B, np.uint64) ^ np.asarray(seed, np.uint64)
        with np.errstate(over="ignore"):
            todo, size, k = slice(None), lengths, 0
            while len(size):
                part = h[todo] ^ (window[self.starts[todo] + 8 * k] & _KEEP[np.minimum(size - 8 * k, 8)])
                part *= _ODD[which]
                h[todo] = part ^ (part >> np.uint64(31))
                k += 1
                todo = np.flatnonzero((lengths > 8 * k) & (lengths <= LONG))
                size = lengths[todo]
            for i in np.flatnonzero(lengths > LONG):
                s = self.starts[i]
                h[i] ^= np.uint64(int.from_bytes(blake2b(self.raw[s : s + lengths[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little"))
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word among the different ones, a word for each number). Words are told apart by 128 bits of hash; where
        the first 64 are alike and the others aren't, by their bytes."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number, first = numbered(self.hashed())
        second = self.hashed(which=1)
        if (second != second[first][number]).any():
            names: dict[bytes, int] = {}
            number = np.array([names.setdefault(self.raw[s : s + n].tobytes(), len(names)) for s, n in zip(self.starts, self.lengths, strict=True)])
            first = _firsts(number, len(names))
        return number, first

    def texts(self, which: np.ndarray) -> pa.Array:
        """The words of these numbers, as strings."""
        starts, lengths = self.starts[which], self.lengths[which]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        data = self.raw[np.repeat(starts - edges[:-1], lengths) + np.arange(edges[-1])]
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _firsts(number: np.ndarray, n: int) -> np.ndarray:
    first = np.empty(n, np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return first


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key among the different ones, the place of each number's first key)."""
    code = pa.array(keys).dictionary_encode()
    number = code.indices.to_numpy()
    return number, _firsts(number, len(code.dictionary))
