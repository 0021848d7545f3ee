"""Mixture-controlled packing of tokenized documents into fixed windows.

Every source is a queue of tokens. Deficit round-robin deals the windows out: each window
adds to a source's deficit its share of the window, the source of the largest deficit is
served next, and what it has been given too little or too much it carries on. The deficits
at every FRAME-th window follow from the totals alone (the divisor rule over all queues,
in whole numbers), so frames are packed apart from one another, on any partition, and the
carried deficits are those of one long run. When a queue is empty the others go on in their
proportions. The last window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textops
from .pieces import Table, once

#: Windows in a frame.
FRAME = 64
#: A served piece is no shorter, unless a window, a quota or a document ends.
LEAST = 128
#: Queues of a source of its own at most, and queues that the documents of all other sources are dealt to.
MOST_QUEUES, SHARED_QUEUES = 1024, 64
_ONE = 1 << 64


class Encoder:
    """Ids of texts by a byte-level BPE file whose pre-tokenizer joins at most one space to what follows.

    So a border of pre-tokens lies before every space that stands between two characters
    that are no white space, and each piece from one such space to the next is encoded once.
    Other texts, and those with strings of special
    tokens, are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ranked = _by_rank(path)
        self.table = Table(self._many)
        self.end = np.array([end_id], np.uint32)

    def _many(self, pieces: list[str]) -> list[list[int]]:
        if self.ranked:
            return list(map(self.ranked, pieces))
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _whole(self, text: str) -> np.ndarray:
        if self.ranked and not any(s in text for s in self.special):
            return np.array(self.ranked(text), np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: textops.Texts, first: int, end: int) -> list[np.ndarray]:
        """Ids of texts first .. end, the end id last."""
        raw = texts.data[texts.offsets[first] : texts.offsets[end]]
        odd = self._odd(texts, first, end, raw)
        starts, ends, first_word = texts.words(first, end, textops.SPACE)
        head = np.isin(starts, texts.offsets[first:end])
        use = np.ones(len(starts), bool)
        for i in np.flatnonzero(odd):
            use[first_word[i] : first_word[i + 1]] = False
        chosen = np.flatnonzero(use)
        flat, n = self.table.of(texts, starts[chosen], ends[chosen], (~head[chosen]).astype(np.int64))  # with the space before
        sizes = np.zeros(len(starts) + 1, np.int64)
        sizes[chosen + 1] = n
        cut = np.cumsum(sizes)[first_word]
        out = []
        for i in range(end - first):
            if odd[i]:
                own = self._whole(texts.bytes_of(first + i).decode("utf-8", "replace"))
            else:
                own = flat[cut[i] : cut[i + 1]]
            out.append(np.concatenate([own, self.end]))
        return out

    def _odd(self, texts: textops.Texts, first: int, end: int, raw: np.ndarray) -> np.ndarray:
        """Texts in which a space stands at the end or beside other white space, or that may hold a special token."""
        out = np.zeros(end - first, bool)
        if not len(raw):
            return out
        space, white = raw == 0x20, _WHITE[raw]
        hit = np.zeros(len(raw), bool)
        hit[:-1] = (space[:-1] & white[1:]) | (white[:-1] & space[1:])
        bounds = texts.offsets[first : end + 1] - texts.offsets[first]
        hit[np.maximum(bounds[1:-1] - 1, 0)] = False  # what stands beside the next text's start isn't beside it
        filled = np.flatnonzero(np.diff(bounds) > 0)
        hit[bounds[filled + 1] - 1] |= space[bounds[filled + 1] - 1]
        out[np.searchsorted(bounds, np.flatnonzero(hit), "right") - 1] = True
        marks = [s.encode() for s in self.special]
        blob = raw.tobytes()
        if any(m in blob for m in marks):
            for i in np.flatnonzero(~out):
                own = blob[bounds[i] : bounds[i + 1]]
                out[i] = any(m in own for m in marks)
        rare = np.flatnonzero(_RARE[raw])
        for i in np.unique(np.searchsorted(bounds, rare, "right") - 1):
            out[i] |= _TIGHT.search(blob[bounds[i] : bounds[i + 1]].decode("utf-8", "replace")) is not None
        return out


#: Bytes of ASCII white space, and first bytes of other white space (which many letters share).
_WHITE = np.isin(np.arange(256), [*range(9, 14), *range(0x1C, 0x20), 0x20])
_RARE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_TIGHT = re.compile(r" \s|\s ")

#: The pattern of pre-tokens of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_rank(path: str):
    """A faster encoder of ordinary text for files whose ids are the ranks of their merges; None for any other."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, before = made["model"], made["pre_tokenizer"] or {}
    if made["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    vocab, first = model["vocab"], 256
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or any(vocab[m] != first + i for i, m in enumerate(merged)):
        return None
    # a byte that prints stands for itself, the others for the characters from 256 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"] for t in made["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Schedule:
    """Which tokens of which queue go where.

    totals: tokens in each queue; weights: target proportions (those of the totals if None).
    """

    def __init__(self, totals: list[int], window: int, weights: list[int] | None = None):
        self.totals, self.window = totals, window
        self.weights = weights or totals
        self.all = sum(totals)
        self.frame_tokens = FRAME * window
        self.frames = -(-self.all // self.frame_tokens)
        self.served = lru_cache(4096)(self._served)
        self.layout = lru_cache(512)(self._layout)
        top = max((-(-t // max(w, 1)) for t, w in zip(totals, self.weights, strict=True)), default=1)
        self.last = (top + 1) * _ONE  # virtual time by which all queues are empty

    def _at(self, time: int) -> list[int]:
        """Tokens of each queue due at a virtual time: the j-th of a queue of weight w at (j + 1/2) / w."""
        return [min(t, (2 * max(w, 1) * time + _ONE) // (2 * _ONE)) for t, w in zip(self.totals, self.weights, strict=True)]

    def _served(self, frame: int) -> tuple[int, ...]:
        """Tokens of each queue in the frames before this one; their sum is that of the frames."""
        return self._first(min(frame * self.frame_tokens, self.all))

    def _first(self, n: int) -> tuple[int, ...]:
        """Tokens of each queue among the first n."""
        low, high = 0, self.last
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(self._at(mid)) <= n else (low, mid)
        due, after = self._at(low), self._at(low + 1)
        left = n - sum(due)
        for s in range(len(due)):  # those due at the same time, in the order of the queues
            more = min(left, after[s] - due[s])
            due[s] += more
            left -= more
        return tuple(due)

    def _layout(self, frame: int) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """For each queue its stretches in this frame: their starts in the queue, and (place in the frame, length)."""
        begin, end = self.served(frame), self.served(frame + 1)
        quota = np.array(end, np.int64) - np.array(begin, np.int64)
        size = int(quota.sum())
        given = np.zeros(len(quota), np.int64)
        ends = any(b < t <= e for b, e, t in zip(begin, end, self.totals, strict=True))  # a queue runs out: the proportions change on the way
        out: list[tuple[list[int], list[tuple[int, int]]]] = [([], []) for _ in quota]
        place = 0
        while place < size:
            room = min(self.window, size - place)
            if ends:  # deficits with this window's shares
                due = np.array(self._first(frame * self.frame_tokens + place + room), np.float64) - begin - given
            else:
                due = quota * ((place + room) / size) - given
            due[given >= quota] = -np.inf
            while room:
                s = int(due.argmax())
                there = int(given[s])
                take = min(room, int(quota[s]) - there, max(LEAST, round(float(due[s]))))
                starts, places = out[s]
                starts.append(begin[s] + there)
                places.append((place, take))
                given[s] = there + take
                due[s] = due[s] - take if there + take < quota[s] else -np.inf
                place += take
                room -= take
        return out

    def pieces(self, queue: int, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the queue, length, sequence_id, offset) of the stretches that hold tokens begin..end of a queue."""
        low, high = 0, max(self.frames - 1, 0)
        while low < high:  # the frame that holds begin
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.served(mid)[queue] <= begin else (low, mid - 1)
        frame = low
        while begin < end:
            starts, places = self.layout(frame)[queue]
            i = max(bisect_right(starts, begin) - 1, 0)
            for start, (place, length) in zip(starts[i:], places[i:], strict=True):
                if begin >= end or begin < start:
                    break
                until = min(end, start + length)
                yield from self._sequences(begin, until, frame * self.frame_tokens + place + begin - start)
                begin = until
            frame += 1

    def _sequences(self, begin: int, end: int, place: int) -> Iterator[tuple[int, int, int, int]]:
        """The places of one stretch: it lies in one window, which may be the last, cut one."""
        whole = self.all // self.window
        while begin < end:
            sequence, offset = divmod(place, self.window)
            if sequence < whole:
                size = self.window
            else:  # the rest is cut into its powers of two, the largest first
                left, size = self.all - whole * self.window, 1 << (self.all - whole * self.window).bit_length() - 1
                while offset >= size:
                    offset, left, sequence = offset - size, left - size, sequence + 1
                    size = 1 << left.bit_length() - 1
            n = min(end - begin, size - offset)
            yield begin, n, sequence, offset
            begin, place = begin + n, place + n


def pack(spark: SparkSession, docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, mix: dict[str, int] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, source.

    Every row of docs is packed, null text as the end id alone, null source as a queue of its
    own, repeated rows each for themselves. A document may be cut anywhere. mix: target
    tokens of each source (those not named: their own tokens). Beyond the MOST_QUEUES largest, sources share
    SHARED_QUEUES queues, each mixed in as one. An empty table gives no row; other columns are not read. Texts are encoded in groups of about
    1 MB or one longer text, so a task needs memory in proportion to its longest text.
    The documents are encoded once, into a table in the shared folder; queue places are sums
    over (task, source), so no document is shuffled.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("encoder", path, end_id), lambda: Encoder(path, end_id))
        part, so_far = TaskContext.get().partitionId(), {}
        for batch in batches:
            texts, sources = textops.Texts(batch.column(1)), batch.column(2).to_pylist()
            for first, end in texts.groups():
                own = batch.slice(first, end - first)
                ids = encoder(texts, first, end)
                before = []
                for s, x in zip(sources[first:end], ids, strict=True):
                    before.append(so_far.get(s, 0))
                    so_far[s] = before[-1] + len(x)
                # two bytes an id where all fit; the table's codec does the rest
                packed = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\0" + x.astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "source", "part", "before", "tokens", "ids"])

    made = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    made = common.durable(spark, made.mapInArrow(encode, f"doc_id {kind}, source string, part int, before bigint, tokens bigint, ids binary"), "tokens")
    sums = made.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    sums = common.durable(spark, sums, "token-sums")  # a row for each source and task
    # the largest sources (and all that mix names) have a queue each; a queue is named by a letter and the source
    own = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    largest = sums.groupBy("source").agg(F.sum("n").alias("t")).withColumn("named", F.coalesce(F.col("source").isin(list(mix or {})), F.lit(False)))
    largest = largest.orderBy(F.desc("named"), F.desc("t"), "source").limit(MOST_QUEUES + len(mix or {})).select(own.alias("queue"), F.lit(True).alias("large"))
    shared = F.concat(F.lit("z"), F.pmod(F.xxhash64("source"), F.lit(SHARED_QUEUES)).cast("string"))
    sums = sums.withColumn("queue", own).join(F.broadcast(largest), "queue", "left").select("source", "part", "n", F.when(F.col("large"), F.col("queue")).otherwise(shared).alias("queue"))
    queues = sorted((r["queue"], r["t"]) for r in sums.groupBy("queue").agg(F.sum("n").alias("t")).collect())  # MOST_QUEUES and a few
    numbers = {q: i for i, (q, _) in enumerate(queues)}
    totals = [t for _, t in queues]
    weights = [mix.get(q[1:], t) if q[0] == "s" else t for q, t in queues] if mix else None
    base = F.sum("n").over(Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("source", "part", "queue", F.coalesce(base, F.lit(0)).alias("base"))
    if sums.count() <= 100_000:  # rows of about 60 bytes
        bases = F.broadcast(bases)
    placed = made.alias("m").join(bases.alias("b"), F.col("m.source").eqNullSafe(F.col("b.source")) & (F.col("m.part") == F.col("b.part")))
    placed = placed.select("m.doc_id", "m.source", (F.col("base") + F.col("before")).alias("at"), "tokens", "ids", "queue")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(totals, window, weights)
        for batch in batches:
            rows: list[tuple] = []
            for i, (at, n, ids, queue) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                ids = np.frombuffer(ids, "<u2").astype("<u4") if len(ids) == 2 * n else np.frombuffer(ids, "<u4", offset=1)
                ids = ids.tobytes()
                for begin, length, sequence, offset in schedule.pieces(numbers[queue], at, at + n):
                    a = begin - at
                    rows.append((i, a, length, ids[4 * a : 4 * (a + length)], n, sequence, offset))
                if len(rows) >= 4096:
                    yield _rows(batch, rows)
                    rows = []
            yield _rows(batch, rows)

    return placed.mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, source string")


def _rows(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    at = pa.array(cols[0], pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    out = [batch.column(0).take(at), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)), batch.column(1).take(at)]
    return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source"])

