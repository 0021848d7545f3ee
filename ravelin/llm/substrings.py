"""Duplicate passages by relative Lempel-Ziv parsing.

The corpus is cut into reference blocks, ranges of ascending doc_id. A document is parsed
against the blocks up to its own: from a place on, the longest match in a block's words is a
factor, the next one is sought from k - 1 words before its end, so that a match across the
border of two factors is found too; a word without a match is a literal. Factors of k words or
more are duplicate spans, compared with the block's words byte for byte. The first document
that holds a passage keeps it.

No document is laid beside a block it shares nothing with. An index of all blocks' runs of k
words, dealt by hash, tells each block which of its runs stand in an earlier one, and in which
first. The block asks that one for them and gets the passages that hold them, and nothing
else, as reference text to parse against. The index only routes: what is removed comes from
the factors alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textops

WORDS = 13
#: Places of a run in one block from which a match is extended; the longest one counts.
PLACES = 4
#: Runs asked of one block beyond which the asking ones are dealt over several copies of it.
ASKED = 4_000_000
_KEEP = np.uint64((1 << 56) - 1)
_OTHER = np.uint64(0x5851F42D4C957F2D)


def _pack(values: np.ndarray, width: int) -> bytes:
    """Whole numbers by byte planes: the planes that repeat take no room."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _joined(parts: list, kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class Words:
    """Words and runs of k words of texts: about 40 bytes a word."""

    def __init__(self, texts: textops.Texts, k: int):
        self.texts, self.k = texts, k
        begin, end, words, first, base = [], [], [], [np.zeros(1, np.int64)], 0
        for a, b in texts.groups():
            starts, ends, first_word = texts.words(a, b)
            begin.append(starts)
            end.append(ends)
            words.append(texts.hashes(starts, ends))
            first.append(first_word[1:] + base)
            base += len(starts)
        self.begin, self.end, self.words = _joined(begin, np.int64), _joined(end, np.int64), _joined(words, np.uint64)
        self.first = np.concatenate(first)  # of each text, and one more at the end
        counts = np.diff(self.first)
        runs = np.maximum(counts - k + 1, 0)
        #: Word at which each run starts.
        self.at = np.arange(runs.sum()) + np.repeat(self.first[:-1] - (np.cumsum(runs) - runs), runs)
        self.run = textops.shingles(self.words, k)[self.at] & _KEEP if len(self.at) else np.zeros(0, np.uint64)

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1

    def plain(self, a: int, b: int) -> bytes:
        """The words a .. b of one text, joined by one space."""
        return b" ".join(self.texts.data[self.begin[a] : self.end[b - 1]].tobytes().split()) if a < b else b""

    def sorted(self) -> np.ndarray:
        """Numbers of the runs by hash, those of one hash by place."""
        return np.argsort(self.run, kind="stable")


class Block(Words):
    """The documents of a range, ascending by doc_id, null last."""

    def __init__(self, group: pa.Table, k: int):
        ids, text = group["__id"], group["__text"]
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy()
        self.order = np.lexsort((value, ~known))
        self.shard = group["__shard"][0].as_py() if group.num_rows else 0
        super().__init__(textops.Texts(text.take(pa.array(self.order))), k)
        new = np.ones(len(self.order), np.int64)
        if len(new):
            a, b = value[self.order], known[self.order]
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.rank = np.cumsum(new)  # rows of one doc_id are no references to one another

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, run) of the distinct runs, ascending. The bucket comes from another hash of the words."""
        other = textops.shingles(textops.mix(self.words + _OTHER), self.k)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        bucket = ((other >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        by = np.lexsort((self.run, bucket))
        run, bucket = self.run[by], bucket[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])
        return bucket[fresh], run[fresh]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    bounds = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[a]), a, b


def _index(k: int, buckets: int):
    def index(group: pa.Table) -> pa.Table:
        block = Block(group, k)
        bucket, run = block.distinct(buckets)
        rows = [(no, _pack(run[a:b], 7)) for no, a, b in _by_bucket(bucket)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "shard": pa.array([block.shard] * len(rows), pa.int32()), "runs": pa.array([r[1] for r in rows], pa.binary())})

    return common.trimmed(index)


class Held:
    """Runs of several blocks, or spans of blocks, in one bucket: which are the same, and the first block that holds each."""

    def __init__(self, group: pa.Table, ranges: int):
        group = group.combine_chunks().sort_by("shard")
        self.shard, self.bucket = group["shard"].to_numpy(), group["bucket"].to_numpy()
        known = [_unpack(x.as_py(), 7) for x in group["runs"]]
        sizes = np.array([len(x) for x in known], np.int64)
        self.ends = np.cumsum(sizes)
        self.runs = _joined(known, np.uint64)
        del known
        if "firsts" in group.column_names:
            self.own = _joined([_unpack(x.as_py(), 4).astype(np.int32) for x in group["firsts"]], np.int32)
        else:  # documents without an id are behind all others, and no reference
            self.own = np.repeat(np.minimum(self.shard, ranges).astype(np.int32), sizes)
        order = np.argsort(self.runs, kind="stable")  # blocks ascending within a run
        fresh = np.ones(len(order), bool)
        fresh[1:] = self.runs[order][1:] != self.runs[order][:-1]
        self.distinct, self.first = self.runs[order][fresh], self.own[order][fresh]
        self.named = np.empty(len(order), np.int32)
        self.named[order] = np.cumsum(fresh) - 1

    def parts(self, fan: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(order of the distinct runs by finer bucket, that bucket of each), from another hash at each level."""
        mixed = textops.mix(self.distinct + np.uint64(int(_OTHER) * (level + 1) % 2**64))
        part = ((mixed >> np.uint64(32)) * np.uint64(fan) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, part[order]

    def answers(self) -> pa.Table:
        """For each row a bit for those of its runs that an earlier block holds too, and the first such block."""
        first, out = self.first[self.named], []
        seen = first < self.own
        for i, (a, b) in enumerate(zip([0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=True)):
            if seen[a:b].any():
                out.append((int(self.shard[i]), int(self.bucket[i]), np.packbits(seen[a:b]).tobytes(), _pack(first[a:b][seen[a:b]].astype(np.uint64), 4)))
        kinds = {"shard": pa.int32(), "bucket": pa.int64(), "bits": pa.binary(), "blocks": pa.binary()}
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds.items())})


def _first_blocks(ranges: int):
    return common.trimmed(lambda group: Held(group, ranges).answers())


def _raised(ranges: int, fan: int, level: int):
    def raised(group: pa.Table) -> pa.Table:
        """The distinct runs of a span of rows of one bucket, cut into finer buckets."""
        held = Held(group, ranges)
        order, part = held.parts(fan, level)
        runs, first = held.distinct[order], held.first[order].astype(np.uint64)
        span, bucket = int(held.shard[0]) // fan, int(held.bucket[0]) * fan
        rows = [(bucket + no, span, _pack(runs[a:b], 7), _pack(first[a:b], 4)) for no, a, b in _by_bucket(part)]
        kinds = {"bucket": pa.int64(), "shard": pa.int32(), "runs": pa.binary(), "firsts": pa.binary()}
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})

    return common.trimmed(raised)


def _lowered(ranges: int, fan: int, level: int):
    def lowered(group: pa.Table, answers: pa.Table) -> pa.Table:
        """What the finer buckets answered a span, told to each of its rows."""
        held = Held(group, ranges)
        order, part = held.parts(fan, level)
        bounds = {no: (a, b) for no, a, b in _by_bucket(part)}
        for bucket, bits, blocks in zip(answers["bucket"].to_pylist(), answers["bits"], answers["blocks"], strict=True):
            a, b = bounds[bucket % fan]
            seen = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=b - a).astype(bool)
            held.first[order[a:b][seen]] = _unpack(blocks.as_py(), 4).astype(np.int32)
        return held.answers()

    return common.trimmed(lowered, 2)


#: Buckets that a block's runs are cut into at most, bytes of the corpus that a bucket holds
#: in the end, and the blocks of a span, which is also the number of finer buckets of a bucket.
BUCKETS, BUCKET_BYTES, FAN = 8192, 8 << 20, 2048


def index_levels(spark: SparkSession, blocks, k: int, size: int, ranges: int) -> tuple[list[DataFrame], int]:
    """(the levels of the index, the buckets of the lowest): rows (bucket, shard, runs) of ``size`` bytes of text.

    The lowest level has a row for each block and bucket. Where BUCKETS are too few for buckets of
    BUCKET_BYTES, the rows of a bucket are merged in spans of FAN blocks and cut into FAN finer buckets,
    (bucket, span, runs, firsts: the first block of each), and so on until buckets are small. So blocks of
    16 MB have rows of 330 runs on the average at any size, and there is one more level from 64 GB and from 134 TB on.
    """
    wanted = max(16, int(size // BUCKET_BYTES))
    buckets = min(wanted, BUCKETS)
    levels = [blocks.applyInArrow(_index(k, buckets), "bucket bigint, shard int, runs binary")]
    reach = buckets
    while reach < wanted:
        levels[-1] = common.durable(spark, levels[-1], f"index-{len(levels)}")
        spans = levels[-1].groupBy("bucket", (F.col("shard") / FAN).cast("int").alias("span"))
        levels.append(spans.applyInArrow(_raised(ranges, FAN, len(levels)), "bucket bigint, shard int, runs binary, firsts binary"))
        reach *= FAN
    if len(levels) > 1:
        levels[-1] = common.durable(spark, levels[-1], f"index-{len(levels)}")
    return levels, buckets


def _answers(levels: list[DataFrame], ranges: int) -> DataFrame:
    """(shard, bucket, bits, blocks) for the rows of the lowest level of the index: asked at the highest, told downwards."""
    told = "shard int, bucket bigint, bits binary, blocks binary"
    answers = levels[-1].groupBy("bucket").applyInArrow(_first_blocks(ranges), told)
    for level in range(len(levels) - 1, 0, -1):
        rows = levels[level - 1].groupBy("bucket", (F.col("shard") / FAN).cast("int").alias("span"))
        above = answers.groupBy((F.col("bucket") / FAN).cast("bigint").alias("coarse"), F.col("shard").alias("span"))
        answers = rows.cogroup(above).applyInArrow(_lowered(ranges, FAN, level), told)
    return answers


def _requests(k: int, buckets: int):
    def requests(group: pa.Table, answers: pa.Table) -> pa.Table:
        """The runs that a block asks of each earlier one."""
        kinds = {"block": pa.int32(), "shard": pa.int32(), "n": pa.int64(), "runs": pa.binary()}
        if not answers.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        block = Block(group, k)
        bucket, run = block.distinct(buckets)
        place = {b: i for i, b in enumerate(answers["bucket"].to_pylist())}
        wanted, of = [], []
        for no, a, b in _by_bucket(bucket):
            if no in place:
                seen = np.unpackbits(np.frombuffer(answers["bits"][place[no]].as_py(), np.uint8), count=b - a).astype(bool)
                wanted.append(run[a:b][seen])
                of.append(_unpack(answers["blocks"][place[no]].as_py(), 4).astype(np.int32))
        wanted, of = np.concatenate(wanted), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        wanted, of = wanted[order], of[order]
        rows = [(no, block.shard, b - a, _pack(np.sort(wanted[a:b]), 7)) for no, a, b in _by_bucket(of)]
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})

    return common.trimmed(requests, 2)


def _passages(k: int):
    def passages(group: pa.Table, requests: pa.Table) -> pa.Table:
        """For each block that asks, the passages of this one that hold what it asks for: words joined by a space, passages by a line feed."""
        shards, texts = [], []
        if group.num_rows and requests.num_rows:
            block = Block(group, k)
            order = block.sorted()
            runs, at = block.run[order], block.at[order]
            for shard, packed in zip(requests["shard"].to_pylist(), requests["runs"], strict=True):
                wanted = _unpack(packed.as_py(), 7)
                place = np.minimum(np.searchsorted(runs, wanted), max(len(runs) - 1, 0))  # the first document that has it
                found = np.sort(at[place[runs[place] == wanted]]) if len(runs) else np.zeros(0, np.int64)
                cut = np.flatnonzero(np.diff(found) >= k)  # runs that overlap are one passage
                begin = found[np.append(0, cut + 1)] if len(found) else found
                end = found[np.append(cut, len(found) - 1)] + k if len(found) else found
                shards.append(shard)
                texts.append(b"\n".join(block.plain(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True)))
        own = group["__shard"][0].as_py() if group.num_rows else 0
        return pa.table({"shard": pa.array(shards, pa.int32()), "block": pa.array([own] * len(shards), pa.int32()), "passages": pa.array(texts, pa.binary())})

    return common.trimmed(passages, 2)


class Parse:
    """Factors of the documents of a block: (text, start in words, length, block), and the words they cover."""

    def __init__(self, block: Block):
        self.block = block
        self.factors: list[tuple[int, int, int, int]] = []
        self.change = np.zeros(len(block.words) + 1, np.int32)
        self.inside = np.zeros(len(block.words) + 1, np.int32)  # of runs that a factor holds
        self.order = block.sorted()
        run = block.run[self.order]
        fresh = np.append(True, run[1:] != run[:-1]) if len(run) else np.zeros(0, bool)
        self.heads = np.flatnonzero(fresh)  # of each distinct run, its first place in the order
        self.named = np.empty(len(run), np.int32)
        self.named[self.order] = np.cumsum(fresh) - 1
        self.distinct = run[self.heads]

    def against(self, reference: Words, sources: np.ndarray) -> None:
        """Parse against reference texts, of which ``sources`` tells the block. Of a run that several hold, the first one counts."""
        block = self.block
        order = reference.sorted()
        run, at = reference.run[order], reference.at[order]
        source = sources[reference.text_of(at)]
        low, high = np.searchsorted(run, self.distinct, "left"), np.searchsorted(run, self.distinct, "right")
        met = np.flatnonzero(high > low)
        first, place = np.full(len(low), -1, np.int64), np.zeros((len(low), PLACES), np.int64) - 1
        if len(met):
            first[met] = np.minimum.reduceat(np.append(source, 0), np.stack([low[met], high[met]], 1).ravel())[::2]
        own = np.repeat(met, (high - low)[met])  # of each place that is met, the run
        inner = np.arange(len(own)) + np.repeat(low[met] - (np.cumsum((high - low)[met]) - (high - low)[met]), (high - low)[met])
        good = source[inner] == first[own]
        own, inner = own[good], inner[good]
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        use = nth < PLACES
        place[own[use], nth[use]] = at[inner[use]]
        starts = np.flatnonzero(first[self.named] >= 0)
        number = first[self.named[starts]]
        by = np.argsort(number, kind="stable")  # by block, then by place
        starts, number = starts[by], number[by]
        bounds = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, int)
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(number)], strict=False):
            some = starts[a:b]
            self._greedy(reference, int(number[a]), block.at[some], place[self.named[some]])

    def against_own(self) -> None:
        """Parse what is left against the earlier documents of the block itself."""
        block = self.block
        left = np.cumsum(self.inside[:-1])[block.at] == 0 if len(block.at) else np.zeros(0, bool)
        place = np.full((len(self.heads), PLACES), -1, np.int64)
        ends = np.append(self.heads[1:], len(self.order))
        for nth in range(PLACES):
            has = self.heads + nth < ends
            place[has, nth] = block.at[self.order[self.heads[has] + nth]]
        rank = block.rank[block.text_of(block.at)]
        first = rank[self.order[self.heads]] if len(self.heads) else rank
        starts = np.flatnonzero(left & (first[self.named] < rank)) if len(rank) else np.zeros(0, int)
        self._greedy(block, block.shard, block.at[starts], place[self.named[starts]])

    def _greedy(self, reference: Words, number: int, start: np.ndarray, places: np.ndarray) -> None:
        """One pass over the documents against one block: places, ascending, at which a run begins that the block holds."""
        block, k, x = self.block, self.block.k, 0
        text = block.text_of(start)
        own = reference is block
        while x < len(start):
            at, best, i = int(start[x]), 0, int(text[x])
            for place in places[x].tolist():
                if place < 0:
                    break
                there = int(reference.text_of(place))
                if own and block.rank[there] >= block.rank[i]:
                    break
                most = int(min(block.first[i + 1] - at, reference.first[there + 1] - place))
                if most > best:
                    best = max(best, self._longest(reference, at, place, most))
            if best >= k:
                self.factors.append((i, at - int(block.first[i]), best, number))
                self.change[at] += 1
                self.change[at + best] -= 1
                self.inside[at] += 1
                self.inside[at + best - k + 1] -= 1
                x += int(np.searchsorted(start[x:], at + best - k + 1))
            else:
                x += 1

    def _longest(self, reference: Words, at: int, place: int, most: int) -> int:
        """Words from here on that are the same in both, by their bytes."""
        n, step = 0, 64
        while n < most:
            size = min(step, most - n)
            unlike = self.block.words[at + n : at + n + size] != reference.words[place + n : place + n + size]
            if unlike.any():
                n += int(unlike.argmax())
                break
            n, step = n + size, step * 4
        mine, theirs = self.block.plain(at, at + n), reference.plain(place, place + n)
        if mine == theirs:
            return n
        same = next(i for i, (a, b) in enumerate(zip(mine.split(), theirs.split(), strict=True)) if a != b)
        return same  # words of the same hash

    def removed(self) -> np.ndarray:
        return np.cumsum(self.change[:-1]) > 0


def _parse(k: int, ranges: int, columns: list[str], text: str):
    """columns: those of the result that the rows bring along."""

    def parse(group: pa.Table, passages: pa.Table) -> pa.Table:
        block = Block(group, k)
        group = group.take(pa.array(block.order))
        made = Parse(block)
        if passages.num_rows:
            lines = [x.as_py().split(b"\n") for x in passages["passages"]]
            numbers = passages["block"].to_numpy()
            numbers = np.repeat(numbers, [len(x) for x in lines])
            made.against(Words(textops.Texts(pa.array([y for x in lines for y in x], pa.large_binary())), k), numbers)
            del lines
        if block.shard < ranges:
            made.against_own()
        gone = made.removed()
        factors: dict[int, list] = {}
        for i, start, length, number in made.factors if "factors" in columns else []:
            factors.setdefault(i, []).append({"start": start, "length": length, "block": number})
        n_words, n_removed, marks, texts = np.diff(block.first), [], [], []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))) if len(gone) else np.zeros(0, int)
        spans = _in_texts(edges[::2], edges[1::2], block)
        for i in range(block.texts.size):
            a, b = int(block.first[i]), int(block.first[i + 1])
            out = spans.get(i, [])
            n_removed.append(sum(y - x for x, y in out))
            if "kept_sha256" in columns:
                kept, at = [], a
                for x, y in [*out, (b, b)]:
                    if x > at:
                        kept.append(block.plain(at, x))
                    at = y
                marks.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            if text in columns:
                raw, at, parts, shift = block.texts.bytes_of(i), 0, [], int(block.texts.offsets[i])
                for x, y in out:  # a removed word goes with the white space behind it
                    parts.append(raw[at : block.begin[x] - shift])
                    at = int(block.begin[y]) - shift if y < b else len(raw)
                texts.append(b"".join([*parts, raw[at:]]) if out else raw)
        null = group["__text"].is_null().to_numpy() if group.num_rows else np.zeros(0, bool)
        own = {
            text: lambda: pa.array([None if x else t.decode("utf-8", "replace") for x, t in zip(null, texts, strict=True)], pa.string()),
            "n_words": lambda: pa.array(n_words, pa.int64()),
            "n_removed": lambda: pa.array(n_removed, pa.int64()),
            "kept_sha256": lambda: pa.array(marks, pa.string()),
            "factors": lambda: pa.array([factors.get(i, []) for i in range(block.texts.size)], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("block", pa.int64())]))),
        }
        return pa.table({c: own[c]() if c in own else group[c] for c in columns})

    return common.trimmed(parse, 2)


def _in_texts(begin: np.ndarray, end: np.ndarray, block: Block) -> dict[int, list[tuple[int, int]]]:
    """Removed stretches of words by text; one that runs on into the next text is cut there."""
    out: dict[int, list] = {}
    for a, b, i in zip(begin.tolist(), end.tolist(), block.text_of(begin).tolist(), strict=True):
        while a < b:
            stop = min(b, int(block.first[i + 1]))
            if stop > a:
                out.setdefault(i, []).append((a, stop))
            a, i = max(a, stop), i + 1
    return out


FIELDS = {
    "n_words": T.LongType(),
    "n_removed": T.LongType(),
    "kept_sha256": T.StringType(),
    "factors": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("block", T.LongType())])),
}


def remove(spark: SparkSession, docs: DataFrame, k: int = WORDS, doc_id: str = "doc_id", text: str = "text", give: tuple[str, ...] = (), keep_text: bool = True) -> DataFrame:
    """docs without the passages of k words or more that a document of smaller doc_id holds.

    A row for each row of docs, with its columns and those asked for in ``give``: n_words,
    n_removed, kept_sha256 (kept words joined by one space), factors (start and length in
    words, reference block). Without ``keep_text`` the text is left out. Null text stays null and
    has no words; rows of one doc_id don't remove one another's passages; a null doc_id counts as larger than any, and such rows
    are no references. Columns that clash with those given are replaced; names that begin with
    __ are the operator's own. Texts without a duplicate passage come back unchanged; repeated rows are each a row, an empty table gives none.

    A task holds one range of documents (2 to 16 MB of text, or one longer text) at about ten
    bytes for a byte of text, with the passages that it asked for; a bucket of the index holds
    about 8 MB of the corpus, and the index is merged in as many levels as that takes, so that
    its rows stay a stated part of the text (``index_levels``). A block of which many runs are asked is copied, once for each
    ASKED of them. No pair of blocks becomes a row unless one holds a run of the other.
    """
    carried = docs.drop(*give)
    columns = [*(c for c in carried.columns if keep_text or c != text), *give]
    plain = carried.select("*", F.col(doc_id).cast("bigint").alias("__id"), F.col(text).alias("__text")).drop(text)
    dealt, size, ranges = common.in_ranges(spark, plain, "__id", "__text", spread=True)
    blocks = dealt.groupBy("__shard")
    levels, buckets = index_levels(spark, blocks, k, size, ranges)
    answers = _answers(levels, ranges)
    requests = blocks.cogroup(answers.groupBy("shard")).applyInArrow(_requests(k, buckets), "block int, shard int, n bigint, runs binary")
    requests = common.durable(spark, requests, "requests")
    given = "shard int, block int, passages binary"
    hot = requests.groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") > ASKED).select("block", F.ceil(F.col("n") / ASKED).cast("int").alias("copies"))
    if hot.isEmpty():
        found = blocks.cogroup(requests.groupBy("block")).applyInArrow(_passages(k), given)
    else:
        hot = common.durable(spark, hot, "hot-blocks", ranges)
        copy = F.pmod(F.xxhash64("shard"), F.col("copies")).cast("int")
        others = requests.join(hot.select("block"), "block", "left_anti")
        found = blocks.cogroup(others.groupBy("block")).applyInArrow(_passages(k), given)
        copies = dealt.join(hot, F.col("__shard") == F.col("block")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("__id", "__text", "__shard", "copy")
        asked = requests.join(hot, "block").withColumn("copy", copy)
        found = found.unionByName(copies.groupBy("__shard", "copy").cogroup(asked.groupBy("block", "copy")).applyInArrow(_passages(k), given))
    types = {f.name: f.dataType for f in carried.schema.fields} | FIELDS
    schema = T.StructType([T.StructField(c, types[c]) for c in columns])
    return blocks.cogroup(found.groupBy("shard")).applyInArrow(_parse(k, ranges, columns, text), schema)
