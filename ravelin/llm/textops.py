"""Whole-batch text primitives shared by the document operators.

Texts stay in the Arrow buffer they arrive in; words, word hashes and shingle
hashes are numpy arrays over that buffer, so no Python object is made per word.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that separate words.
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: 0x20 alone.
SPACE = np.arange(256) == 0x20

_SEGMENT = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
#: Words beyond so many bytes are hashed one by one.
_LONG = 256
#: Masks of the first 0 .. 8 bytes of a lane.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (spreads every input bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """A column of texts as one byte buffer and offsets; nulls are empty texts."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        self.size = len(column)
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.size + 1] if self.size else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def groups(self, most: int = 1 << 20):
        """(first, end) ranges of texts of about ``most`` bytes; a longer text stands alone."""
        first = 0
        while first < self.size:
            end = int(np.searchsorted(self.offsets, self.offsets[first] + most, "right")) - 1
            end = min(max(end, first + 1), self.size)
            yield first, end
            first = end

    def words(self, first: int, end: int, separators: np.ndarray = _SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of texts first..end in the buffer, and for each text the index of its first word (one more at the end)."""
        lo, hi = int(self.offsets[first]), int(self.offsets[end])
        inside = np.zeros(hi - lo + 2, bool)
        inside[1:-1] = ~separators[self.data[lo:hi]]
        edge = inside[1:] != inside[:-1]
        at = np.flatnonzero(edge)
        starts, ends = at[::2], at[1::2]
        bounds = np.unique(self.offsets[first : end + 1] - lo)[1:-1]
        if len(bounds):  # a word that runs on into the next text is cut there
            cut = bounds[inside[bounds] & inside[bounds + 1]]
            if len(cut):
                starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        starts, ends = starts + lo, ends + lo
        return starts, ends, np.searchsorted(starts, self.offsets[first : end + 1])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes from a on and from b on are the same, ``size`` of them each."""
        out = np.ones(len(a), bool)
        if not len(a):
            return out
        lo, hi = int(min(a.min(), b.min())), int(max((a + size).max(), (b + size).max()))
        padded = np.zeros(hi - lo + 16, np.uint8)
        padded[: hi - lo] = self.data[lo:hi]
        eight = np.ndarray((hi - lo + 9,), "<u8", buffer=padded, strides=(1,))
        left, step = np.flatnonzero(size > 0), 0
        while len(left):
            masks = _FIRST[np.minimum(size[left] - step, 8)]
            unlike = ((eight[a[left] - lo + step] ^ eight[b[left] - lo + step]) & masks) != 0
            out[left[unlike]] = False
            step += 8
            left = left[~unlike & (size[left] > step)]
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever it stands: its length and then its lanes of eight bytes, each spread over all bits."""
        return self.lanes(starts, ends)[0]

    def lanes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first eight bytes, next eight bytes) of each word, short ones filled up with zeros."""
        out, one, two = (np.zeros(len(starts), np.uint64) for _ in range(3))
        i, n = 0, len(starts)
        while i < n:
            lo = int(starts[i])
            j = max(int(np.searchsorted(ends, lo + _SEGMENT, "right")), i + 1)
            hi = int(ends[j - 1])
            padded = np.zeros(hi - lo + 16, np.uint8)
            padded[: hi - lo] = self.data[lo:hi]
            eight = np.ndarray((hi - lo + 9,), "<u8", buffer=padded, strides=(1,))
            at, size = starts[i:j] - lo, ends[i:j] - starts[i:j]
            one[i:j] = eight[at] & _FIRST[np.minimum(size, 8)]
            two[i:j] = eight[np.minimum(at + 8, hi - lo)] & _FIRST[np.clip(size - 8, 0, 8)]
            h = mix(mix(size.astype(np.uint64) + np.uint64(_ODD)) ^ one[i:j])
            left = np.flatnonzero((size > 8) & (size <= _LONG))
            step = 8
            while len(left):
                lane = eight[at[left] + step] & _FIRST[np.minimum(size[left] - step, 8)]
                h[left] = mix(h[left] * np.uint64(_ODD) ^ lane)
                step += 8
                left = left[size[left] > step]
            for k in np.flatnonzero(size > _LONG).tolist():
                h[k] = xxhash.xxh64_intdigest(self.data[int(starts[i + k]) : int(ends[i + k])].tobytes(), 7)
            out[i:j] = h
            i = j
        return out, one, two


def _beside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a ^ (a >> np.uint64(29))
    out *= np.uint64(_ODD)
    out += b
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; entry i starts at word i. Runs may cross texts: the caller masks those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, done = words, 1, None, 0  # runs of 1, 2, 4 .. words; k is a sum of some of these
    while True:
        if k & size:
            part = power[done : done + n]
            out = part if out is None else _beside(out, part)
            done += size
        if 2 * size > k:
            return mix(out)
        power, size = _beside(power[:-size], power[size:]), 2 * size


def within(first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that start a run of k words of one text, and the text of each."""
    counts = np.maximum(np.diff(first_word) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    skipped = np.cumsum(counts) - counts
    at = np.arange(len(text)) - skipped[text] + first_word[:-1][text]
    return at, text
