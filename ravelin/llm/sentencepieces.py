"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A segmentation is a path of pieces through the text. Its score is the sum of the weights of
its steps, for a BPE model 0 where the model leaves the two neighbouring pieces apart when
it merges them alone, and minus infinity where it would merge them otherwise: exactly one
path is left, the model's own. A chunk of a
giant document is a matrix from the piece that crosses its left border to the piece that
crosses its right one, in the max-plus semiring. Matrices are combined associatively, which
fixes the pieces at all borders, and every chunk is then traced back by itself.

Where white space begins, every path has a border and the next piece depends on nothing
before it, so a chunk with such a place has a matrix of rank one.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops
from .pieces import Table, once

#: Code points of a chunk; longer documents are split.
CHUNK = 1 << 15
#: Chunks whose matrices one task combines.
SPAN = 64
SPACE = "▁"
_NEVER = -np.inf

State = tuple[int, int]  # start and end of a piece


class Model:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        sp = self.library
        self.ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        kind = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto()).trainer_spec.model_type
        if kind != 2:
            raise ValueError("only BPE models are supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with white space inside are not supported")
        self.apart: dict[tuple[str, str], bool] = {}
        self.table = Table(self._many)

    def _many(self, words: list[str]) -> list[list[int]]:
        return self.library.encode(words, num_threads=1)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the model's merges: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = _NEVER, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1], _NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, a: str, b: str) -> float:
        """Of the step from piece a to piece b."""
        key = (a, b)
        if key not in self.apart:
            self.apart[key] = self.merged(a + b) == [a, b]
        return 0.0 if self.apart[key] else _NEVER

    def ids_of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def starting(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that start at a place; a character that is no piece is one by itself."""
        ends = [at + 1]
        ends += [e for e in range(at + 2, min(at + self.longest, len(text)) + 1) if text[at:e] in self.ids]
        return ends

    def crossing(self, text: str, cut: int) -> list[State]:
        """Pieces that start before a place and end at it or behind it."""
        out = []
        for s in range(max(0, cut - self.longest), cut):
            out += [(s, e) for e in self.starting(text, s) if e >= cut]
        return out


def border(text: str, at: int) -> bool:
    """Whether a run of white space starts here, behind another character."""
    return text[at] == SPACE and text[at - 1] != SPACE


class Chunk:
    """A chunk with some context on either side; places count from the start of the left context."""

    def __init__(self, model: Model, text: str, begin: int, end: int, first: bool, last: bool):
        self.model, self.text, self.begin, self.end = model, text, begin, end
        self.entries: list[State | None] = [None] if first else list(model.crossing(text, begin))
        self.exits = [x for x in model.crossing(text, end) if not last or x[1] == end]
        places = [i for i in range(begin + 1, end) if border(text, i)] if begin < end else []
        if not first and begin and border(text, begin):
            places = [begin, *places]
        self.left, self.right = (places[0], places[-1]) if places else (None, None)

    def paths(self, starts: list[State | None], until: int, begin: int) -> dict[State, np.ndarray]:
        """Best score of the paths from each start to each piece that ends at ``until`` or crosses it."""
        n = len(starts)
        at: dict[int, dict] = {}
        for i, s in enumerate(starts):
            score = np.full(n, _NEVER)
            score[i] = 0
            at.setdefault(begin if s is None else s[1], {})[s] = score
        done: dict[State, np.ndarray] = {}
        self.back: dict[State, list[tuple[State | None, float]]] = {}
        while at:
            place = min(at)
            reached = at.pop(place)
            if place >= until:
                for node, score in reached.items():
                    if node is not None:
                        done[node] = np.maximum(done[node], score) if node in done else score
                continue
            for e in self.model.starting(self.text, place):
                node, piece = (place, e), self.text[place:e]
                best = None
                for before, score in reached.items():
                    w = 0.0 if before is None else self.model.weight(self.text[before[0] : before[1]], piece)
                    if w == _NEVER and not (before is None):
                        continue
                    best = score + w if best is None else np.maximum(best, score + w)
                    self.back.setdefault(node, []).append((before, w))
                if best is not None and best.max() > _NEVER:
                    old = at.setdefault(e, {}).get(node)
                    at[e][node] = best if old is None else np.maximum(old, best)
        return done

    def matrix(self) -> dict:
        """Entries, exits and either the whole matrix or the two vectors of rank one."""
        exits = {x: j for j, x in enumerate(self.exits)}

        def columns(found: dict[State, np.ndarray], n: int) -> np.ndarray:
            out = np.full((n, len(exits)), _NEVER)
            for node, score in found.items():
                if node in exits:
                    out[:, exits[node]] = score
            return out

        shape = {"entries": self._named(self.entries, self.begin), "exits": self._named(self.exits, self.end)}
        if self.left is None:
            return shape | {"whole": columns(self.paths(self.entries, self.end, self.begin), len(self.entries))}
        into = np.full(len(self.entries), _NEVER)
        for (_, e), score in self.paths(self.entries, self.left, self.begin).items():
            if e == self.left:
                into = np.maximum(into, score)
        for i, s in enumerate(self.entries):
            if s is not None and s[1] == self.left:
                into[i] = 0
        if self.left == self.begin:
            into = np.array([0.0 if s is not None and s[1] == self.begin else _NEVER for s in self.entries])
        out = columns(self.paths([None], self.end, self.right), 1)[0]
        return shape | {"into": into, "out": out}

    @staticmethod
    def _named(states, cut: int) -> list:
        return [None if s is None else (s[0] - cut, s[1] - cut) for s in states]

    def ids(self, entry, leave) -> list[int]:
        """Ids of the pieces that start in this chunk, given the pieces at its borders (relative to them)."""
        entry = None if entry is None else (entry[0] + self.begin, entry[1] + self.begin)
        leave = (leave[0] + self.end, leave[1] + self.end)
        if self.left is None:
            return self._trace(entry, leave, self.end, self.begin)
        out: list[int] = []
        if self.left > self.begin and (entry is None or entry[1] < self.left):
            found = [x for x, s in self.paths([entry], self.left, self.begin).items() if x[1] == self.left and s[0] > _NEVER]
            out += self._trace(entry, found[0], self.left, self.begin)
        if self.right > self.left:
            out += self.model.library.encode(self.text[self.left + 1 : self.right].replace(SPACE, " "))
        return out + self._trace(None, leave, self.end, self.right)

    def _trace(self, entry, leave: State, until: int, begin: int) -> list[int]:
        """The best path, from its end back."""
        if entry == leave:
            return []
        scores: dict = {}
        self.paths([entry], until, begin)
        back = self.back

        def best(node) -> float:
            order = [node]
            while order:
                x = order[-1]
                if x in scores:
                    order.pop()
                    continue
                if x == entry:
                    scores[x] = 0.0
                    continue
                missing = [b for b, _ in back.get(x, []) if b not in scores]
                if missing:
                    order += missing
                else:
                    scores[x] = max((scores[b] + w for b, w in back.get(x, [])), default=_NEVER)
            return scores[node]

        best(leave)
        path, node = [], leave
        while node != entry and node is not None:
            path.append(node)
            node = max(back[node], key=lambda x: scores[x[0]] + x[1])[0]
        return [i for s, e in reversed(path) for i in self.model.ids_of(self.text[s:e])]


def combined(a: dict, b: dict) -> dict:
    """The matrix of two neighbouring chunks from theirs: the max-plus product, associative."""
    met = {s: i for i, s in enumerate(b["entries"])}
    shape = {"entries": a["entries"], "exits": b["exits"]}
    pick = [met.get(s, -1) for s in a["exits"]]
    if "whole" in b:
        rows = np.vstack([b["whole"], np.full((1, len(b["exits"])), _NEVER)])[pick]
        if "whole" in a:
            return shape | {"whole": (a["whole"][:, :, None] + rows[None, :, :]).max(1) if len(pick) else np.full((len(a["entries"]), len(b["exits"])), _NEVER)}
        return shape | {"into": a["into"], "out": (a["out"][:, None] + rows).max(0)}
    into = np.append(b["into"], _NEVER)[pick]
    if "whole" in a:
        return shape | {"into": (a["whole"] + into[None, :]).max(1), "out": b["out"]}
    return shape | {"into": a["into"] + (a["out"] + into).max(), "out": b["out"]}


def _value(m: dict, i: int, j: int) -> float:
    return m["whole"][i, j] if "whole" in m else m["into"][i] + m["out"][j]


def borders(matrices: list[dict], entry=None, leave=None) -> list[tuple]:
    """(entry, exit) of each chunk on the best path from ``entry`` (the start of the text if None) to ``leave`` (the best
    one if None): products of all prefixes, then from the last chunk back."""
    before = [matrices[0]]
    for m in matrices[1:]:
        before.append(combined(before[-1], m))
    first = matrices[0]["entries"].index(entry) if entry is not None else 0
    last = matrices[-1]["exits"]
    leave = last.index(leave) if leave is not None else max(range(len(last)), key=lambda j: _value(before[-1], first, j))
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        m = matrices[k]
        if k:
            prefix = before[k - 1]
            met = {s: i for i, s in enumerate(m["entries"])}
            able = [(_value(prefix, first, j) + _value(m, met[s], leave), j, met[s]) for j, s in enumerate(prefix["exits"]) if s in met]
            _, j, i = max(able, key=lambda x: x[0])
        else:
            i, j = first, -1
        out.append((m["entries"][i], m["exits"][leave]))
        leave = j
    return out[::-1]


def _plain(texts: textops.Texts, first: int, end: int) -> np.ndarray:
    """Texts whose words are parted by single spaces, with none at either end, and that have no space mark of their own."""
    raw = texts.data[texts.offsets[first] : texts.offsets[end]]
    bounds = texts.offsets[first : end + 1] - texts.offsets[first]
    ok = np.ones(end - first, bool)
    if not len(raw):
        return ok
    space = raw == 0x20
    begins = np.zeros(len(raw) + 1, bool)
    begins[bounds[:-1]] = True
    ends = np.zeros(len(raw) + 1, bool)
    ends[bounds[1:]] = True
    bad = space & (begins[:-1] | ends[1:])
    bad[:-1] |= space[:-1] & space[1:]
    mark = np.flatnonzero(raw == 0xE2)
    mark = mark[mark + 2 < len(raw)]
    bad[mark[(raw[mark + 1] == 0x96) & (raw[mark + 2] == 0x81)]] = True
    ok[np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1] = False
    return ok


def _short(model: Model, texts: textops.Texts, first: int, end: int) -> list[np.ndarray]:
    """Ids of texts that are no chunks: each distinct word once, odd texts whole."""
    plain = _plain(texts, first, end)
    starts, ends, first_word = texts.words(first, end, textops.SPACE)
    use = np.repeat(plain, np.diff(first_word))
    flat, n = model.table.of(texts, starts[use], ends[use])
    sizes = np.zeros(len(starts) + 1, np.int64)
    sizes[1:][use] = n
    cut = np.cumsum(sizes)[first_word]
    return [flat[cut[i] : cut[i + 1]] if plain[i] else np.array(model.library.encode(texts.bytes_of(first + i).decode("utf-8", "replace")), np.uint32) for i in range(end - first)]


def encode(spark: SparkSession, docs: DataFrame, path: str, chunk: int = CHUNK, span: int = SPAN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, text): a row for each row of docs, the ids that the library gives without begin and end.

    Null text stays null and has no ids, an empty one has none; repeated rows and null ids stay; an empty table gives no row; other
    columns are not read. Documents of more
    than ``chunk`` code points are encoded chunk by chunk on any number of tasks.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    giant = F.coalesce(F.char_length("text") > chunk, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("sentencepiece", path), lambda: Model(path))
        for batch in batches:
            texts = textops.Texts(batch.column(1))
            for first, end in texts.groups():
                ids = _short(model, texts, first, end)
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(ids, pa.list_(pa.int32())), own.column(1)], ["doc_id", "ids", "text"])

    small = named.where(~giant).mapInArrow(short, f"doc_id {kind}, ids array<int>, text string")

    context = 64  # at least twice the longest piece

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = once(("sentencepiece", path), lambda: Model(path)).longest
        wide = max(context, 2 * longest)
        for batch in batches:
            for i in range(batch.num_rows):
                whole = SPACE + batch.column(1)[i].as_py().replace(" ", SPACE)
                rows = []
                for no, at in enumerate(range(0, len(whole), chunk)):
                    if no and len(whole) - at < wide:  # no short last chunk: the one before takes it
                        break
                    end = len(whole) if len(whole) - at - chunk < wide else at + chunk
                    rows.append((no, whole[max(0, at - wide) : end + wide], at - max(0, at - wide), end - max(0, at - wide), at == 0, end == len(whole)))
                cols = list(zip(*rows, strict=True))
                n = len(rows)
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(2)[i].as_py()] * n, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["key", "no", "part", "begin", "end", "first", "last"])

    large = common.durable(spark, named.where(giant).withColumn("key", F.monotonically_increasing_id()), "giant-texts")
    chunks = common.durable(spark, large.mapInArrow(split, "key bigint, no int, part string, begin int, end int, first boolean, last boolean").repartition("key", "no"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("sentencepiece", path), lambda: Model(path))
        for batch in batches:
            made = [pickle.dumps(Chunk(model, r["part"], r["begin"], r["end"], r["first"], r["last"]).matrix()) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["key", "no", "matrix"])

    # the scan in three steps: the product of each SPAN of chunks, the pieces at the borders of the spans, those inside each
    def product(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("no")
        made = [pickle.loads(x.as_py()) for x in group["matrix"]]
        total = made[0]
        for m in made[1:]:
            total = combined(total, m)
        return pa.table({"key": group["key"][:1], "span": group["span"][:1], "matrix": pa.array([pickle.dumps(total)], pa.binary())})

    def scan(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("span")
        found = borders([pickle.loads(x.as_py()) for x in group["matrix"]])
        return pa.table({"key": group["key"], "span": group["span"], "ends": pa.array([pickle.dumps(x) for x in found], pa.binary())})

    def inside(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("no")
        found = borders([pickle.loads(x.as_py()) for x in group["matrix"]], *pickle.loads(group["ends"][0].as_py()))
        return pa.table({"key": group["key"], "no": group["no"], "states": pa.array([pickle.dumps(x) for x in found], pa.binary())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("sentencepiece", path), lambda: Model(path))
        for batch in batches:
            ids = []
            for r in batch.to_pylist():
                entry, leave = pickle.loads(r["states"])
                ids.append(Chunk(model, r["part"], r["begin"], r["end"], r["first"], r["last"]).ids(entry, leave))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["key", "no", "ids"])

    made = chunks.mapInArrow(matrices, "key bigint, no int, matrix binary").withColumn("span", F.floor(F.col("no") / span).cast("int"))
    made = common.durable(spark, made, "matrices")
    ends = made.groupBy("key", "span").applyInArrow(product, "key bigint, span int, matrix binary").groupBy("key").applyInArrow(scan, "key bigint, span int, ends binary")
    states = made.join(ends, ["key", "span"]).groupBy("key", "span").applyInArrow(inside, "key bigint, no int, states binary")
    traced = chunks.join(states, ["key", "no"]).select("key", "no", "part", "begin", "end", "first", "last", "states").mapInArrow(trace, "key bigint, no int, ids array<int>")
    whole = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts")).select("key", F.flatten("parts.ids").alias("ids"))
    return small.unionByName(large.join(whole, "key").select("doc_id", "ids", "text"))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded`` string: the text of the ids; null ids give null, a column of that name is replaced."""
    from pyspark.sql import types as T

    kept = df.drop("decoded")
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("sentencepiece", path), lambda: Model(path))
        for batch in batches:
            made = [None if x is None else model.library.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, exact) from the result of encode: what its ids are and whether they decode to the text."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("sentencepiece", path), lambda: Model(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x or [] for x in part.column(1).to_pylist()]
                marks = [hashlib.sha256(model.library.decode(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array(marks, pa.string()),
                        pa.array([a == b for a, b in zip(marks, part.column(2).to_pylist(), strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "exact"],
                )

    mark = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return df.select("doc_id", "ids", mark.alias("mark")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, exact boolean")
