"""Language of documents by cross-parsing entropy.

For each language a suffix automaton of labelled text tells the longest match from any
place of another text. A document is parsed greedily: each phrase is the longest match, the
next one starts behind it. A language whose text resembles the document needs few phrases;
phrases times log2(length of its text) over the document's letters is the cross entropy,
and the language of the least wins.

The automata are laid out as one transition table in which a failing step leads to where
the next phrase starts and is marked, so many texts are parsed side by side with one table
look-up a letter. The commonest letters of all languages have a column each; the steps of any
other letter are looked up in a sorted list, so that scripts of thousands of letters need no
wide table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textops
from .pieces import once

#: Letters parsed in a stretch; a longer text is parsed stretch by stretch and its phrases add up.
BLOCK = 1024
#: Letters with a column in the table.
COLUMNS = 96
NONE = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    alphabet: str  # all letters, the commonest first; letter i is of class i + 1, 0 is everything that is no letter
    width: int  # columns: no letter, the commonest letters, padding
    table: np.ndarray  # next * width * 2 + (1 if a new phrase starts)
    keys: np.ndarray  # state * rare letters + letter, ascending, of the steps by other letters
    steps: np.ndarray  # where they lead, as in the table
    roots: np.ndarray
    scale: np.ndarray  # log2 of each language's text length

    @property
    def rare(self) -> int:
        """Letters without a column, and one that stands for all that no language has."""
        return len(self.alphabet) + 1 - (self.width - 2)


def classes(alphabet: str) -> np.ndarray:
    """Class of every code point: 0 no letter, 1.. the alphabet in either case, the next one any other letter."""
    out = np.zeros(0x110000, np.int32)
    known = {c: i + 1 for i, c in enumerate(alphabet)}
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = known.get(low if len(low) == 1 else c, len(alphabet) + 1)
    return out


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return steps


def learn(samples: dict[str, str]) -> Model:
    """A model from one text for each language."""
    languages = tuple(sorted(samples))
    letters: dict[str, int] = {}
    for text in samples.values():
        for c in text.lower():
            if c.isalpha():
                letters[c] = letters.get(c, 0) + 1
    alphabet = "".join(sorted(letters, key=lambda c: (-letters[c], c)))
    known = {c: i + 1 for i, c in enumerate(alphabet)}
    common = min(len(alphabet), COLUMNS)
    width, rare = common + 2, len(alphabet) + 1 - common
    pad, parts, roots, scale, base = width - 1, [], [], [], 0
    keys, leads = [], []
    for language in languages:
        seq = np.array([known.get(c, len(alphabet) + 1) if c.isalpha() else 0 for c in samples[language].lower()], np.int32)
        seq = _single_gaps(seq) if len(seq) else seq
        steps = suffix_automaton(seq)
        n = len(steps)
        root = np.full(width, base, np.int64)
        for c, to in steps[0].items():
            if c <= common:
                root[c] = base + to
        part = np.tile(root * 2 * width + 1, (n, 1))
        for s, out in enumerate(steps):
            for c, to in out.items():
                if c <= common:
                    part[s, c] = (base + to) * 2 * width
                else:
                    keys.append((base + s) * rare + c - common - 1)
                    leads.append((base + to) * 2 * width)
        part[:, pad] = (base + np.arange(n)) * 2 * width
        parts.append(part)
        roots.append(base * 2 * width)
        scale.append(math.log2(max(2, len(seq))))
        base += n
    kind = np.int32 if 2 * width * base < 2**31 else np.int64
    table = np.concatenate(parts).ravel().astype(kind) if parts else np.zeros(0, np.int32)
    order = np.argsort(np.array(keys, np.int64))
    return Model(languages, alphabet, width, table, np.array(keys, np.int64)[order], np.array(leads, kind)[order], np.array(roots, kind), np.array(scale))


def _by_rare(model: Model, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """(languages, texts): the steps by letters that have no column. A letter that doesn't follow starts a new phrase, one never seen is a phrase of its own."""
    if not len(model.keys):
        return np.repeat(model.roots[:, None] + 1, state.shape[1], 1)
    place = 2 * model.width

    def found(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = at.astype(np.int64) // place * model.rare + letter[None, :]
        i = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
        return model.keys[i] == key, model.steps[i]

    on, to = found(state)
    fresh, first = found(np.repeat(model.roots[:, None], state.shape[1], 1))
    return np.where(on, to, np.where(fresh, first, model.roots[:, None]) + 1)


def _single_gaps(seq: np.ndarray) -> np.ndarray:
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
    return seq[keep]


def phrases(model: Model, texts: textops.Texts, first: int, end: int, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that each language needs for each text (languages x texts), and the letters of each text."""
    lo, hi = int(texts.offsets[first]), int(texts.offsets[end])
    raw = texts.data[lo:hi]
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.zeros(hi - lo + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=begins[1:])
    edge = begins[texts.offsets[first : end + 1] - lo]
    kind = kinds[chars]
    keep = np.ones(len(kind), bool)
    if len(kind):
        keep[1:] = (kind[1:] != 0) | (kind[:-1] != 0)
        keep[edge[:-1][edge[:-1] < len(kind)]] = True
    place = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    start, kind = place[edge], kind[keep]
    letters = np.add.reduceat(np.append(kind != 0, False).astype(np.int64), np.minimum(start[:-1], len(kind))) * (np.diff(start) > 0)
    blocks = -(-np.diff(start) // BLOCK)
    owner = np.repeat(np.arange(end - first), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = start[:-1][owner] + nth * BLOCK
    size = np.minimum(start[1:][owner] - begin, BLOCK)
    steps = int(size.max()) if len(size) else 0
    at = begin[None, :] + np.arange(steps)[:, None]
    grid = np.where(np.arange(steps)[:, None] < size[None, :], kind[np.minimum(at, max(len(kind) - 1, 0))], -1) if steps else np.zeros((0, len(owner)), np.int32)
    state = np.repeat(model.roots[:, None], len(owner), 1)
    count = np.zeros(state.shape, np.int32)
    index, bit = np.empty_like(state), np.empty_like(state)
    last = model.width - 2
    other = (grid > last).any(1) if steps else np.zeros(0, bool)
    grid_columns = np.where(grid < 0, model.width - 1, np.minimum(grid, last)).astype(state.dtype)
    for row, letters_, some in zip(grid_columns, grid, other, strict=True):
        if some:
            rare = np.flatnonzero(letters_ > last)
            before = state[:, rare] & ~np.array(1, state.dtype)
        np.right_shift(state, 1, out=index)
        index += row
        np.take(model.table, index, out=state, mode="clip")
        if some:
            state[:, rare] = _by_rare(model, before, letters_[rare] - last - 1)
        np.bitwise_and(state, 1, out=bit)
        count += bit
    count += size > 0
    total = np.stack([np.bincount(owner, c, end - first) for c in count]) if len(model.languages) else np.zeros((0, end - first))
    return total, letters


#: Stretches that stand for a text too long to learn from whole.
STRETCHES = 16


def fit(spark: SparkSession, docs: DataFrame, most_rows: int = 64, most_chars: int = 24_000) -> Model:
    """Learn from a bounded sample of the documents of each non-null lang; held-out rows, null texts and null langs are not used.

    The sample: of the ``most_rows`` documents of smallest hash of their id, those of ``most_chars`` / 4 code points or
    fewer first, as many as have ``most_chars`` in all, or the first one if that is longer. A document in
    it is used whole. Of more than 16 languages each has its part of 16 * ``most_chars``.
    """
    known = docs.where(~common.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sized = known.select("doc_id", "lang", F.char_length("text").alias("n"))
    long = F.when(F.col("n") > most_chars // 4, F.col("n")).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(long, F.xxhash64("doc_id"), "doc_id"))
    ranked = sized.withColumn("rank", rank).where(F.col("rank") <= most_rows).toArrow().to_pylist()  # ids and lengths, most_rows of a language
    languages = {r["lang"] for r in ranked}
    share = min(most_chars, 16 * most_chars // max(1, len(languages)))
    chosen, so_far = [], dict.fromkeys(languages, 0)
    for r in sorted(ranked, key=lambda r: (r["lang"], r["rank"])):
        if r["rank"] == 1 or so_far[r["lang"]] + r["n"] <= share:
            so_far[r["lang"]] += min(r["n"], share)
            chosen.append((r["doc_id"], r["lang"], r["rank"]))
    schema = T.StructType([known.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("rank", T.IntegerType())])
    picked = F.broadcast(spark.createDataFrame(chosen, schema))
    n, each = F.char_length("text"), max(1, share // STRETCHES)
    step = (n - each) / (STRETCHES - 1)
    stretches = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring("text", (i * step).cast("int") + 1, F.lit(each))), " ")
    rows = known.join(picked, ["doc_id", "lang"]).select("lang", "rank", F.when(n > share, stretches).otherwise(F.col("text")).alias("text")).distinct().collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"], r["text"])):
        samples[r["lang"]] = samples.get(r["lang"], "") + " " + r["text"]
    return learn(samples)


def predict(spark: SparkSession, df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred string and score double (1 - least cross entropy / next one; 1 if there is but one language).

    ``und`` with score 0 where the text is null or has no letter, or the model knows no
    language. Ties go to the first language by name. Only the text is read; columns of
    these names in df are replaced, other columns and repeated rows stay; an empty table gives no row. Texts are parsed whole, in stretches.
    """
    kept = df.drop("lang_pred", "score")
    at = kept.columns.index(text)
    known = spark.sparkContext.broadcast(model)  # at most 2 * most_chars states for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        kinds = once(("letter classes", model.alphabet), lambda: classes(model.alphabet))
        names = np.array([*model.languages, NONE], object)
        for batch in batches:
            texts = textops.Texts(batch.column(at))
            best, score = [], []
            for first, end in texts.groups(2 << 20):
                count, letters = phrases(model, texts, first, end, kinds)
                if not len(model.languages):
                    best.append(np.zeros(end - first, int))
                    score.append(np.zeros(end - first))
                    continue
                cost = count * model.scale[:, None]
                order = np.argsort(cost, 0, kind="stable")
                none = letters == 0
                low = np.take_along_axis(cost, order[:1], 0)[0]
                high = np.take_along_axis(cost, order[1:2], 0)[0] if len(order) > 1 else np.full(len(low), np.inf)
                best.append(np.where(none, len(model.languages), order[0]))
                score.append(np.where(none, 0.0, 1 - low / np.maximum(high, 1e-9)))
            pred = names[np.concatenate(best)] if best else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
