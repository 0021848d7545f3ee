"""The prefix dynamic program of byte-pair encoding over many short words at a time.

Tokens are numbered so that a merge has a higher number than what it merges and than earlier
merges. Two neighbours are left apart if, while their merges are taken back from the latest to
the earliest, the two tokens that face each other never have a merge of their own that comes
before the one taken back.
"""

from __future__ import annotations

import numpy as np

from . import textops

#: Bytes of a word at most.
LONGEST = 16


class Slots:
    """Whole numbers to values: a table by hash, in which a key stands at most ``probes`` places behind its own."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.full(size + 64, -1, np.int32)
        self.probes = 1
        free = np.ones(size + 64, bool)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):  # all that find their place free take it, one of each place; the others go on
            _, first = np.unique(at[left], return_index=True)
            take = first[free[at[left[first]]]]
            won = left[take]
            self.keys[at[won]], self.values[at[won]], free[at[won]] = keys[won], values[won], False
            left = np.delete(left, take)
            if len(left):
                at[left] += 1
                self.probes += 1
        assert self.probes < 64

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that aren't there."""
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        left = np.flatnonzero((out < 0) & (self.keys[at] >= 0))
        for k in range(1, self.probes):
            if not len(left):
                break
            there = self.keys[at[left] + k]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]] + k]
            left = left[~hit & (there >= 0)]
        return out


def _ending(last: np.ndarray) -> np.ndarray:
    return (last * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


class Merges:
    """vocab: strings of units (one character a byte), merges: pairs of such strings by rank, mark: what ends a word's last token."""

    def __init__(self, vocab: list[str], merges: list[tuple[str, str]], mark: str, byte_of: dict[str, int]):
        made = {a + b for a, b in merges}
        names = [t for t in vocab if t not in made] + [a + b for a, b in merges]
        self.number = {t: i for i, t in enumerate(names)}
        self.sound = len(self.number) == len(names)  # each merge makes a token of its own
        n = self.n = len(names)
        self.left, self.right = np.arange(n), np.arange(n)
        first = n - len(merges)
        for i, (a, b) in enumerate(merges):
            self.left[first + i], self.right[first + i] = self.number[a], self.number[b]
        keys = self.left[first:] * n + self.right[first:]
        self.made = Slots(keys, first + np.arange(len(keys)))
        self.alone = np.ones(n, bool)  # whether a token's own units make it
        for i in range(first, n):
            self.alone[i] = self.alone[self.left[i]] and self.alone[self.right[i]]
        merged = np.arange(first, n)
        self.alone[first:] &= self.apart(self.left[first:], self.right[first:], merged)
        # tokens by length and bytes, without and with the mark
        self.tables: list[dict[int, tuple]] = []
        self.most: list[np.ndarray] = []  # by the hash of the last four bytes, the longest token that ends with them
        for marked in (False, True):
            by_size: dict[int, list[tuple[bytes, int]]] = {}
            most = np.full(1 << 16, 3, np.int8)
            for t, i in self.number.items():
                body = t[: len(t) - len(mark)] if marked and mark and t.endswith(mark) else t
                if bool(mark and t.endswith(mark)) == marked and 0 < len(body) <= LONGEST and all(c in byte_of for c in body):
                    by_size.setdefault(len(body), []).append((bytes(byte_of[c] for c in body), i))
            table = {}
            for size, tokens in by_size.items():
                lanes = np.array([np.frombuffer(t.ljust(16, b"\0"), "<u8") for t, _ in tokens])
                key = lanes[:, 0] if size <= 8 else textops.mix(lanes[:, 0]) ^ lanes[:, 1]
                if len(np.unique(key)) < len(key):
                    self.sound = False
                    continue
                number = np.array([i for _, i in tokens])
                table[size] = (Slots(key.view(np.int64), np.arange(len(key))), lanes, number)
                if size >= 4:
                    last = np.array([int.from_bytes(t[-4:], "little") for t, _ in tokens], np.uint64)
                    np.maximum.at(most, _ending(last), size)
            self.tables.append(table)
            self.most.append(most)
        if not mark:
            self.tables[1], self.most[1] = self.tables[0], self.most[0]

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges leave the neighbours a[i], b[i] as they are (up to the merge ``limit``, exclusive)."""
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 2 * self.n) if limit is None else limit.copy()
        while len(left):
            made = self.made.of(a * self.n + b)
            sooner = (made >= 0) & (made < limit)
            out[left[sooner]] = False
            # the later of the two is taken back, of equals the right one; one that is no merge stays
            inner_a, inner_b = self.right[a], self.left[b]
            can_a, can_b = inner_a != a, inner_b != b
            take_a = can_a & ((a > b) | ~can_b)
            take_b = can_b & ~take_a
            limit = np.where(take_a, a, np.where(take_b, b + 1, limit))
            a, b = np.where(take_a, inner_a, a), np.where(take_b, inner_b, b)
            go = ~sooner & (take_a | take_b)
            left, a, b, limit = left[go], a[go], b[go], limit[go]
        return out

    def _found(self, table: dict, size: int, eight: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
        """Number of the token of ``size`` bytes from ``at`` on in each of the words ``rows``, or -1."""
        if size not in table:
            return np.full(len(rows), -1)
        slots, lanes, number = table[size]
        one = eight[rows, at] & textops._FIRST[min(size, 8)]
        if size <= 8:
            place = slots.of(one.view(np.int64))
            return np.where(place >= 0, number[place], -1)
        two = eight[rows, at + 8] & textops._FIRST[size - 8]
        place = slots.of((textops.mix(one) ^ two).view(np.int64))
        return np.where((place >= 0) & (lanes[place, 0] == one) & (lanes[place, 1] == two), number[place], -1)

    def along(self, words: list[bytes]) -> np.ndarray:
        """(words, LONGEST) tokens of the first 1, 2 .. bytes of each word as a word by itself (0 where that cuts a character)."""
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(LONGEST + 16, b"\0") for w in words), np.uint8).reshape(len(words), LONGEST + 16)
        eight = np.lib.stride_tricks.as_strided(flat, (len(words), LONGEST + 9, 8), (flat.strides[0], 1, 1)).copy().view("<u8")[:, :, 0]
        out = np.zeros((len(words), LONGEST), np.int64)
        count = np.zeros((len(words), LONGEST + 1), np.int64)
        last = np.full((len(words), LONGEST + 1), -1)
        for i in range(1, int(size.max(initial=0)) + 1):
            for marked in (False, True):
                words_ = np.flatnonzero(size >= i if marked else size > i)
                most = self.most[marked][_ending(eight[words_, i - 4] & textops._FIRST[4])] if i >= 4 else np.full(len(words_), i, np.int8)
                for n in range(min(i, int(most.max(initial=0))), 0, -1):
                    still = np.flatnonzero(most >= n)  # those that have their token are at 0
                    rows = words_[still]
                    if not len(rows):
                        continue
                    token = self._found(self.tables[marked], n, eight, rows, i - n)
                    some = np.flatnonzero((token >= 0) & ((last[rows, i - n] >= 0) if i > n else True))
                    fits = self.apart(last[rows[some], i - n], token[some]) if i > n else self.alone[token[some]]
                    good = some[fits]
                    done = rows[good]
                    if marked:
                        out[done, i - 1] = count[done, i - n] + 1
                    else:
                        count[done, i], last[done, i] = count[done, i - n] + 1, token[good]
                    most[still[good]] = 0
        return out
