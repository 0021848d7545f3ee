"""Token counts at every prefix of a text, without encoding a text twice.

Prefix dynamic programming. The last token of a prefix's encoding fits the last token of what
stands before it, and what stands before it is encoded as if it stood alone. So along the
characters of a word, count(prefix) = count(prefix without its last token) + 1, where the last
token is the one that ends there and that merges leave apart from the last token before it.
Words are independent of one another, so the counts of a text are those of its words, shifted
by what came before. The table of these counts, one for each code point, answers how many
tokens any prefix has and how much of a text fits a budget.

Words end with a mark of their own in the vocabulary: a prefix that ends within a word ends
with a marked token. Two rows are therefore kept along a word, one without a mark, which later
tokens build on, and one with it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe, textops
from .pieces import Table, once

#: Characters that the tokenizer's notion of white space may not share with Python's.
_DOUBTFUL = re.compile("[\x1c-\x1f\x85᠎​⁠﻿]")
#: The pattern of words of the known vocabulary, and what it finds in lower-case ASCII without white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Latin letters, and marks behind them that are a word of their own.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?)]*)")
#: Pairs of tokens and words that a worker remembers at most (memory, not results).
MOST_PAIRS, MOST_WORDS = 400_000, 200_000
#: Code points of a word up to which other endings are put to the library.
SHORT = 48


def _kind(c: str) -> str:
    """Letters, digits and others make words of their own."""
    kind = unicodedata.category(c)[0]
    return kind if kind in "LN" else "O"


class PrefixCounts:
    """Exact token counts of every prefix of texts, for a ``tokenizers`` file of byte-level
    BPE whose pre-tokenizer drops white space and never spans it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self._pattern = PATTERN in [x.get("pattern", {}).get("Regex") for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self._mark = model["end_of_word_suffix"] or ""
        mark = len(self._mark)
        self._marked = {t[: len(t) - mark] for t in model["vocab"] if t.endswith(self._mark)}
        self._vocab = {t for t in model["vocab"] if not mark or not t.endswith(self._mark)}
        self._rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self._longest = max(map(len, self._vocab | self._marked))
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._cut = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        # a byte that prints stands for itself, the others for the characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        known = set(plain)
        other = [b for b in range(256) if b not in known]
        self._char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self._fits: dict[tuple[str, str, bool], bool] = {}
        self._words: dict[str, bytes] = {}
        self._merges = bpe.Merges(list(model["vocab"]), list(self._rank), self._mark, {c: b for b, c in self._char.items()})
        self._table = Table(self._pieces)

    def _tokens(self, units: list[str]) -> list[str]:
        """The model's merges on a few units."""
        units, rank = list(units), self._rank
        while True:
            best, at = 1 << 60, -1
            for i in range(len(units) - 1):
                now = rank.get((units[i], units[i + 1]), 1 << 60)
                if now < best:
                    best, at = now, i
            if at < 0:
                return units
            units[at : at + 2] = [units[at] + units[at + 1]]

    def _fit(self, key: tuple[str, str, bool]) -> bool:
        """Whether the merges leave two neighbours as they are, the second with a mark or not; with nothing before, whether they make it."""
        before, token, marked = key
        if len(self._fits) >= MOST_PAIRS:
            self._fits.clear()
        mark = self._mark if marked else ""
        made = self._tokens([*before, *token[:-1], token[-1] + mark])
        self._fits[key] = fit = made == ([before, token + mark] if before else [token + mark])
        return fit

    def _along(self, word: str) -> bytes | list[int]:
        """Tokens of the first 1 .. n code points of one word."""
        if word in self._words:
            return self._words[word]
        return self._slowly(word)

    def _slowly(self, word: str) -> bytes | list[int]:
        """One word by itself, of any length."""
        if word.isascii():
            text, ends = word, None
        else:
            text, ends = "".join(self._char[b] for b in word.encode()), set(np.cumsum([len(c.encode()) for c in word]).tolist())
        fits, inner, marked = self._fits, self._vocab, self._marked
        count, last, out = [0], [""], []
        for i in range(1, len(text) + 1):
            n, found, tail = 0, 0, ""
            ended = ends is None or i in ends
            for j in range(i - self._longest if i > self._longest else 0, i):
                token, before = text[j:i], last[j]
                if not found and token in inner:
                    fit = fits.get((before, token, False))
                    if fit or fit is None and self._fit((before, token, False)):
                        found, tail = count[j] + 1, token
                if ended and not n and token in marked:
                    fit = fits.get((before, token, True))
                    if fit or fit is None and self._fit((before, token, True)):
                        n = count[j] + 1
                if found and (n or not ended):
                    break
            count.append(found)
            last.append(tail)
            if ended:
                out.append(n)
        if len(word) <= 64:
            if len(self._words) >= MOST_WORDS:
                self._words.clear()
            out = self._words[word] = bytes(out)
        return out

    def _prepare(self, words: set[str]) -> None:
        """Short words all at once."""
        if not self._merges.sound:
            return
        if len(self._words) + len(words) > MOST_WORDS:
            self._words.clear()
        new = [(w, b) for w in words if w not in self._words and len(b := w.encode()) <= bpe.LONGEST]
        if len(new) > 50:
            found = self._merges.along([b for _, b in new]).astype(np.uint8).tobytes()
            for at, (w, b) in zip(range(0, len(found), bpe.LONGEST), new, strict=True):
                if len(w) == len(b):
                    self._words[w] = found[at : at + len(b)]
                else:
                    self._words[w] = bytes(found[at + e - 1] for e in accumulate(len(c.encode()) for c in w))

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        plain = [_PLAIN.fullmatch(p) for p in pieces]
        low = [m and m[1].lower() for m in plain]
        words = set(filter(None, low))
        for p, m in zip(pieces, plain, strict=True):
            if not m:
                words.update(_LETTERS.findall(p.lower()))
        self._prepare(words)
        known, out = self._words, []
        for p, m, w in zip(pieces, plain, low, strict=True):
            if w in known and len(w) == len(m[1]):
                made = [0, *known[w]]
                if m[2]:
                    made += [made[-1] + n for n in self._along(m[2])]
                out.append(made)
            else:
                out.append(self.piece(p))
        return out

    def _encoded(self, text: str) -> int:
        return len(self._library.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> list[int]:
        """Tokens of the first 0 .. n code points of a text without spaces."""
        out = [0]
        for no, part in enumerate(self._cut.split(piece) if self._cut else [piece]):
            if no % 2:  # a special token; before its end its characters are ordinary ones
                before = len(out) - 1 - behind  # noqa: F821
                start = out[before]
                for k in range(1, len(part)):
                    out.append(start + self._encoded(ordinary + part[:k]))  # noqa: F821
                out.append(out[before + behind] + 1)  # noqa: F821
                continue
            ordinary, behind = part, len(part)
            for gap in re.findall(r"\s+|\S+", part):
                out += [out[-1]] * len(gap) if gap.isspace() and not _DOUBTFUL.search(gap) else self._ordinary(gap, out[-1])
        return out

    def _ordinary(self, text: str, base: int) -> list[int]:
        low = "".join(map(str.lower, text))
        if len(low) != len(text) or _DOUBTFUL.search(text) or not unicodedata.is_normalized("NFC", text):
            return self._changing(text, base)
        out: list[int] = []
        words = _ASCII.findall(low) if self._pattern and low.isascii() else [low[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(low)]
        for word in words:
            before = out[-1] if out else base
            if word.isascii() and word.isalnum() and word in self._words:
                out += [before + n for n in self._words[word]]
            elif len(word) > 2 and word[0] == "'" and word[1].isalpha():  # 'll is a word, 'l is two
                out += [before + self._encoded(word[:k]) for k in range(1, len(word) + 1)]
            else:
                out += [before + n for n in self._along(word)]
        return out

    def _changing(self, text: str, base: int) -> list[int]:
        """As _ordinary, of characters that change one another or become several.

        The text is cut into clusters, each of which changes by itself: a prefix that ends with a cluster is a prefix of
        the changed text, and is counted along its words. One that ends inside a cluster ends in other letters, which
        go on from the states of the word before them, so nothing before them is encoded again.
        """
        made, bounds = self._clusters(text)
        whole = "".join(made)
        if not self._pattern or not self._library.normalizer or self._library.normalizer.normalize_str(text) != whole:
            return [base + self._encoded(text[:k]) for k in range(1, len(text) + 1)]  # white space that is no space to all
        counts, words = [base], []  # counts: of each prefix of the changed text; words: where each begins, its states
        for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(whole):
            counts += [counts[-1]] * (a + 1 - len(counts))  # what isn't in a word counts nothing
            word, before = whole[a:b], counts[-1]
            if len(word) > 2 and word[0] == "'" and word[1].isalpha():
                states, along = None, [self._encoded(word[:k]) for k in range(1, len(word) + 1)]
            else:
                states, along = self._stated(word)
            words.append((a, before, states))
            counts += [before + n for n in along]
        counts += [counts[-1]] * (len(whole) + 1 - len(counts))
        out, at, of = [], 0, -1
        for k, cluster in enumerate(made):
            own = text[bounds[k] : bounds[k + 1]]
            while of + 1 < len(words) and words[of + 1][0] < at:
                of += 1
            for n in range(1, len(own)):  # before the cluster's end
                out.append(self._ending(whole, at, self._normal(own[:n]), words[of] if of >= 0 else (0, base, None)))
            at += len(cluster)
            out.append(counts[at])
        return out

    def _normal(self, text: str) -> str:
        return self._library.normalizer.normalize_str(text) if self._library.normalizer else text

    def _clusters(self, text: str) -> tuple[list[str], list[int]]:
        """The changed text of each cluster, and where each begins (and the last one ends)."""
        made, bounds, now = [], [0], text[:1]
        for i, c in enumerate(text[1:], 1):
            if not unicodedata.combining(c) and self._normal(now[-8:] + c) == self._normal(now[-8:]) + self._normal(c):
                made.append(self._normal(now))
                bounds.append(i)
                now = c
            else:
                now += c
        return [*made, self._normal(now)], [*bounds, len(text)]

    def _stated(self, word: str) -> tuple[tuple, list[int]]:
        """(the states along a word, tokens of its first 1 .. n code points)."""
        units = [self._char[b] for b in word.encode()]
        ends = np.cumsum([len(c.encode()) for c in word]).tolist()
        count, last = [0], [""]
        found = self._on("".join(units), count, last, set(ends))
        return (units, [0, *ends], count, last), found

    def _on(self, text: str, count: list[int], last: list[str], ends: set[int]) -> list[int]:
        """Goes on along text from the states of its beginning; tokens of what ends at each of ``ends``."""
        out = []
        for i in range(len(count), len(text) + 1):
            inner, tail, n = 0, "", 0
            for j in range(max(0, i - self._longest), i):
                token, before = text[j:i], last[j]
                if not inner and token in self._vocab and self._known((before, token, False)):
                    inner, tail = count[j] + 1, token
                if i in ends and not n and token in self._marked and self._known((before, token, True)):
                    n = count[j] + 1
                if inner and (n or i not in ends):
                    break
            count.append(inner)
            last.append(tail)
            if i in ends:
                out.append(n)
        return out

    def _known(self, key: tuple[str, str, bool]) -> bool:
        fit = self._fits.get(key)
        return self._fit(key) if fit is None else fit

    def _ending(self, whole: str, at: int, other: str, word: tuple) -> int:
        """Tokens of whole[:at] with other letters behind it; word: the one that letter at - 1 is in, or the last before it."""
        begin, before, states = word
        if at - begin <= SHORT or states is None:
            return before + self._encoded(whole[begin:at] + other)
        units, ends, count, last = states
        end = at - begin
        if end >= len(ends):  # behind the word, and what isn't in one
            return before + self._encoded_word(states) + self._encoded(whole[begin + len(ends) - 1 : at] + other)
        kind, same = _kind(whole[at - 1]), 0
        while same < len(other) and _kind(other[same]) == kind:
            same += 1
        more = "".join(self._char[b] for b in other[:same].encode())
        low, high = max(0, ends[end] - self._longest), ends[end]
        text = "".join(units[low:high]) + more
        tail = self._on(text, count[low : high + 1], last[low : high + 1], {len(text)}) if same else [self._at(states, end)]
        return before + tail[0] + (self._encoded(other[same:]) if same < len(other) else 0)

    def _at(self, states: tuple, end: int) -> int:
        """Tokens of the first ``end`` code points of a word."""
        units, ends, count, last = states
        low, high = max(0, ends[end] - self._longest), ends[end]
        return self._on("".join(units[low:high]), count[low:high], last[low:high], {high - low})[0]

    def _encoded_word(self, states: tuple) -> int:
        return self._at(states, len(states[1]) - 1)

    def table(self, texts: textops.Texts, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of every prefix of texts first .. end, from 0 code points to all, one text behind the other; where each begins, and one more)."""
        starts, ends, _ = texts.words(first, end, textops.SPACE)
        counts, n = self._table.of(texts, starts, ends)
        lo, hi = int(texts.offsets[first]), int(texts.offsets[end])
        chars = np.zeros(hi - lo + 1, np.int64)
        np.cumsum((texts.data[lo:hi] & 0xC0) != 0x80, out=chars[1:])
        bounds = chars[texts.offsets[first : end + 1] - lo] + np.arange(end - first + 1)
        text = np.searchsorted(texts.offsets[first : end + 1], starts, "right") - 1
        total = np.append(0, np.cumsum(counts[np.cumsum(n) - 1].astype(np.int64))) if len(n) else np.zeros(1, np.int64)
        of = np.searchsorted(text, np.arange(end - first + 1))  # first piece of each text
        out = np.zeros(int(bounds[-1]), np.int64)
        known = np.zeros(len(out), bool)
        known[bounds[:-1]] = True
        if len(n):
            place = np.arange(n.sum()) + np.repeat(chars[starts - lo] + text - (np.cumsum(n) - n), n)
            out[place] = counts + np.repeat(total[:-1] - total[of[text]], n)
            known[place] = True
        return out[np.maximum.accumulate(np.where(known, np.arange(len(out)), 0))], bounds  # a space adds nothing

    def counts(self, text: str) -> np.ndarray:
        """Tokens of the first 0 .. n code points of one text."""
        return self.table(textops.Texts(pa.array([text])), 0, 1)[0]


def fitting(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def _each(df: DataFrame, path: str, columns: list[str], schema, row) -> DataFrame:
    """A row for each row of df: its columns, and row(text's bytes, its prefix counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = once(("prefix counts", path), lambda: PrefixCounts(path))
        for batch in batches:
            texts = textops.Texts(batch.column(batch.num_columns - 1))
            for first, end in texts.groups(2 << 20):
                counts, bounds = prefix.table(texts, first, end)
                made = [row(int(texts.offsets[first + i + 1] - texts.offsets[first + i]), counts[bounds[i] : bounds[i + 1]]) for i in range(end - first)]
                own = batch.slice(first, end - first)
                cols = [own.column(i) for i in range(batch.num_columns - 1)]
                new = [pa.array(x, k) for x, (_, k) in zip(zip(*made, strict=True), columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, *new], [*batch.schema.names[:-1], *(c for c, _ in columns)])

    return df.mapInArrow(run, schema)


def prefix_counts(df: DataFrame, path: str, text: str = "text", to: str = "prefix_tokens") -> DataFrame:
    """df with ``to`` array<int>: the tokens of the first 0 .. n code points of the text (null text: [0]).

    Any number of budgets and truncations are answered from it by ``element_at`` and
    ``filter``, without the tokenizer. A column of that name is replaced.
    """
    kept = df.drop(to)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])
    return _each(kept.select("*", kept[text].alias("__text")), path, [(to, pa.list_(pa.int32()))], schema, lambda _, counts: (counts.astype(np.int32),))


def count_tokens(df: DataFrame, path: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit), fit_chars (code points of the longest prefix of at most ``limit`` tokens).

    Null text is empty text: 0 tokens. Repeated rows and null ids are kept as they are; an empty table gives no row;
    other columns of df are not read. Special-token strings inside a text are handled as
    the library does by default. Very long texts need memory in proportion to themselves.
    """
    kinds = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())]
    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"

    def row(size: int, counts: np.ndarray) -> tuple:
        n = int(counts[-1])
        return size, n, n > limit, len(counts) - 1 if n <= limit else fitting(counts, limit)

    return _each(df.select(df[doc_id].alias("doc_id"), df[text].alias("text")), path, kinds, schema, row)
