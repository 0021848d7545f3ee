"""Tokenizing by independent pieces, each distinct piece once.

The tokenizers used here never join characters across a boundary between a
non-space character and a single space, so a text's ids are the ids of its
space-separated pieces in order. A worker keeps what it has made of a piece, up to a
number of bytes, and hands only new pieces to the library. A piece that is found by its hash
is compared with the one that is kept, byte for byte.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from . import textops

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Table:
    """What ``make_many`` makes of pieces (lists of whole numbers), by the pieces' hashes in sorted arrays: some 50 bytes a piece."""

    #: Bytes held at most (beyond it the table starts anew: memory, not results), pieces that wait to be sorted in
    #: among the others, and bytes of a piece beyond which it is made anew each time.
    MOST, RECENT, LONGEST = 128 << 20, 60_000, 256

    def __init__(self, make_many):
        self.make_many = make_many
        self._empty()

    def _empty(self) -> None:
        kinds = (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int32)  # hash, two lanes, length, place, number
        self.sorted = self.recent = tuple(np.zeros(0, k) for k in kinds)
        self.flat, self.tails, self.tail_bytes = array("I"), {}, 0

    def held(self) -> int:
        """Bytes, about."""
        return 52 * (len(self.sorted[0]) + len(self.recent[0])) + 4 * len(self.flat) + self.tail_bytes + 150 * len(self.tails)

    @staticmethod
    def _with(known: tuple, more: tuple) -> tuple:
        order = np.argsort(np.concatenate([known[0], more[0]]), kind="stable")
        return tuple(np.concatenate([a, b])[order] for a, b in zip(known, more, strict=True))

    def of(self, texts: textops.Texts, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the results of all pieces starts .. ends of texts one behind the other, how many each has).

        kinds: 0 for pieces as they stand, 1 for those that are made together with the byte before them, which is the same
        for all. Equal bytes of one kind give equal results.
        """
        if self.held() > self.MOST:
            self._empty()
        hashes, one, two = texts.lanes(starts, ends)
        size = ends - starts
        if kinds is not None:
            hashes, size = np.where(kinds > 0, textops.mix(hashes + np.uint64(1)), hashes), size * 2 + kinds
        else:
            size = size * 2
        lo = max(int(starts[0]) - 1, 0) if len(starts) else 0
        blob = texts.data[lo : int(ends[-1])].tobytes() if len(starts) else b""
        begin = (starts - lo if kinds is None else starts - lo - kinds).tolist()
        until = (ends - lo).tolist()
        piece = lambda i: blob[begin[i] : until[i]].decode("utf-8", "replace")
        # of equal hashes the first stands for all that have its bytes
        _, rep, back = np.unique(hashes, return_index=True, return_inverse=True)
        alike = (size == size[rep][back]) & (one == one[rep][back]) & (two == two[rep][back])
        long = np.flatnonzero(alike & (size > 33))
        if len(long):
            theirs = rep[back[long]]
            alike[long] = texts.same(starts[long] + 16, starts[theirs] + 16, ends[long] - starts[long] - 16)
        at, n = np.zeros(len(rep), np.int64), np.full(len(rep), -1, np.int32)
        keep = size[rep] <= 2 * self.LONGEST + 1
        for _ in range(2):  # what is known, then with the new ones
            for known in (self.sorted, self.recent):
                left = np.flatnonzero((n < 0) & keep)
                if len(known[0]) and len(left):
                    which = rep[left]
                    place = np.minimum(np.searchsorted(known[0], hashes[which]), len(known[0]) - 1)
                    same = (known[0][place] == hashes[which]) & (known[1][place] == one[which]) & (known[2][place] == two[which]) & (known[3][place] == size[which])
                    for i in np.flatnonzero(same & (size[which] > 33)).tolist():  # beyond the lanes
                        x = which[i]
                        same[i] = self.tails[int(known[4][place[i]])] == texts.data[starts[x] + 16 : ends[x]].tobytes()
                    at[left[same]], n[left[same]] = known[4][place[same]], known[5][place[same]]
            new = rep[(n < 0) & keep]
            for known in (self.sorted, self.recent):  # a hash that another piece has already: made anew each time
                if len(known[0]) and len(new):
                    new = new[known[0][np.minimum(np.searchsorted(known[0], hashes[new]), len(known[0]) - 1)] != hashes[new]]
            if not len(new):
                break
            self._learn(texts, starts, ends, new, hashes, one, two, size, piece)
        at, n = at[back], np.where(alike, n[back], -1)
        own = np.flatnonzero(n < 0)
        flat = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        if len(own):  # long ones, and those that share the hash of another
            made = [np.array(x, np.uint32) for a in range(0, len(own), 1000) for x in self.make_many([piece(i) for i in own[a : a + 1000].tolist()])]
            n[own] = [len(x) for x in made]
            at[own] = len(flat) + np.cumsum(n[own], dtype=np.int64) - n[own]
            flat = np.concatenate([flat, *made])
        return joined(flat, at, n.astype(np.int64)).copy(), n.astype(np.int64)

    def _learn(self, texts, starts, ends, which, hashes, one, two, size, piece) -> None:
        for a in range(0, len(which), 20_000):
            some = which[a : a + 20_000]
            begin, sizes = len(self.flat), []
            for made in self.make_many([piece(i) for i in some.tolist()]):
                sizes.append(len(made))
                self.flat.extend(made)
            n = np.array(sizes, np.int32)
            place = begin + np.cumsum(n, dtype=np.int64) - n
            for i, p in zip(some[size[some] > 33].tolist(), place[size[some] > 33].tolist(), strict=True):
                self.tails[p] = texts.data[starts[i] + 16 : ends[i]].tobytes()
                self.tail_bytes += int(ends[i] - starts[i])
            self.recent = self._with(self.recent, (hashes[some], one[some], two[some], size[some], place, n))
        if len(self.recent[0]) > self.RECENT:
            self.sorted, self.recent = self._with(self.sorted, self.recent), tuple(x[:0] for x in self.recent)


def joined(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[at : at + n] of all, one behind the other."""
    total = np.cumsum(n)
    if not len(n) or not total[-1]:
        return flat[:0]
    return flat[np.arange(total[-1]) + np.repeat(at - (total - n), n)]


_LOADED: dict = {}


def once(key, make):
    """What ``make()`` returns, made once in each worker process."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]
