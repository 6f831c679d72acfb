"""Words of whole Arrow text columns as 64-bit hashes, worked out with numpy on the bytes.

A byte b counts as a random number T[b]; a word is the polynomial of these
numbers in an odd base, modulo 2^64, read off running sums, and then mixed.
A-Z count as a-z.  Equal words have equal hashes; unequal ones differ except with
a probability near 2^-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15  # odd
PIECE = 1 << 19  # bytes hashed at once, unless one text is longer


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more than texts); null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Hasher:
    """``separators``: the byte values that stand between words."""

    def __init__(self, separators: bytes) -> None:
        self.table = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, np.uint64)
        self.table[65:91] = self.table[97:123]
        self.in_word = np.ones(256, bool)
        self.in_word[list(separators)] = False
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))

            def series(base: int) -> np.ndarray:
                out = np.full(n, base % 2**64, np.uint64)
                out[0] = 1
                return np.cumprod(out)

            self.powers, self.inverse = series(BASE), series(pow(BASE, -1, 2**64))

    def spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins and ends (one past its last byte); none crosses two texts."""
        inside = self.in_word[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = at[:-1][at[1:] > at[:-1]]  # where texts with bytes begin
        before[full] = False
        after[full[1:] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums that the hash of any stretch is read off: (sums[end] - sums[begin]) * inverse[begin]."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def words(
        self, data: np.ndarray, at: np.ndarray, heads: tuple[int, ...] = ()
    ) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and where the words of each text begin.

        With ``heads`` the hashes have a column for the word and one for each of its
        beginnings of so many bytes (the word, if shorter); the columns differ even then.
        """
        if not len(data):
            shape = (0, 1 + len(heads)) if heads else 0
            return np.zeros(shape, np.uint64), np.zeros(len(at), np.int64)
        first, last = self.spans(data, at)
        sums = self.sums(data)
        hashes = mixed((sums[last] - sums[first]) * self.inverse[first])
        bounds = np.searchsorted(first, at)
        if heads:
            short = [
                mixed((sums[np.minimum(first + k, last)] - sums[first]) * self.inverse[first] + np.uint64(k))
                for k in heads
            ]
            hashes = np.stack([hashes, *short], axis=1)
        return hashes, bounds

    def pieces(
        self, texts: pa.Array, heads: tuple[int, ...] = ()
    ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end, hashes, word bounds of each text) of runs of texts of about
        ``PIECE`` bytes, so that memory is bounded by the longest text."""
        data, at = utf8(texts)
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
            hashes, bounds = self.words(data[at[i] : at[j]], at[i : j + 1] - at[i], heads)
            yield i, j, hashes, bounds
            i = j


def spaced() -> Hasher:
    """Words as runs of anything but the six ASCII white-space characters."""
    return Hasher(b"\x20\x09\x0a\x0b\x0c\x0d")


def lettered() -> Hasher:
    """Words as runs of ASCII letters and digits and of all beyond ASCII."""
    return Hasher(bytes(b for b in range(128) if not chr(b).isalnum()))
