"""Words, windows and hashes of many texts at once, over their UTF-8 bytes, with numpy.

Separators of words are ASCII bytes, so whole texts are cut without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end a word: 0x20 and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are taken in blocks of about so many bytes, a longer text alone.
BLOCK_BYTES = 1 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of ODD (up) or of its inverse modulo 2**64 (down), n of them at least."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, BLOCK_BYTES), ODD if kind == "up" else INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


class Block:
    """A run of texts: `data` holds their bytes, text i from offsets[i] to offsets[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
        self.data, self.offsets = data, offsets
        blank = separator[data]
        before = np.ones(len(data), bool)
        before[1:] = blank[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = blank[1:]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[first] = True
        after[first[1:] - 1] = True
        self.blank = blank
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(~blank & after) + 1
        #: Words of text i: word_offsets[i] to word_offsets[i + 1].
        self.word_offsets = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of data[start:end] for each pair."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[self.data] * _power("up", n)[:n], out=sums[1:])
        spans = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
        return mix(spans ^ (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each `size`-word window; none spans two texts."""
        hashes = self.word_hashes() if hashes is None else hashes
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(self)), self.n_words)
        at = np.flatnonzero(text[:n] == text[size - 1 :])
        total = np.zeros(len(at), np.uint64)
        for j in range(size):
            total = mix(total * ODD + hashes[at + j])
        return at, total

    def shingle_sets(self, size: int) -> Iterator[np.ndarray]:
        """For each text its sorted distinct `size`-word shingles.

        With fewer words the whole sequence is the one shingle; without words none.
        """
        hashes = self.word_hashes()
        at, found = self.windows(size, hashes)
        cuts = np.searchsorted(at, self.word_offsets)
        for i in range(len(self)):
            first, last = self.word_offsets[i], self.word_offsets[i + 1]
            if last - first >= size or first == last:
                yield np.unique(found[cuts[i] : cuts[i + 1]])
            else:
                total = np.full(1, size * 8 + (last - first), np.uint64)
                for h in hashes[first:last]:
                    total = mix(total * ODD + h)
                yield total


def blocks(texts: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Iterator[tuple[int, Block]]:
    """(row of the first text, Block) over an Arrow column of strings; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, where, data = texts.buffers()
    ends = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + BLOCK_BYTES, "right")) - 1)
        part = data[ends[row] : ends[last]]
        yield row, Block(LOWER[part] if lower else part, ends[row : last + 1] - ends[row], separator)
        row = last
