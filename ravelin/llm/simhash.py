"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments, each with a table of its own. Fingerprints within 2 bits
are within 2 // segments bits in some segment, so every fingerprint is looked up in each table
under all values of that Hamming ball around its segment, and the complete distance of what it
meets there is verified. A value that many fingerprints share (near copies of one document) is
not looked up: its members are distinct fingerprints, so the other segments tell them apart,
and they meet under all their bits, with one bit changed, instead. At most 65 fingerprints meet
so, and each is tied to the smallest. Copies share a fingerprint and are never compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textops
from .components import connected, spanning

SEGMENTS = 2
#: Bits by which linked fingerprints may differ.
APART = 2
#: Members of a table value beyond which they meet under whole fingerprints.
HOT = 32
WORDS = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhashes(texts: textops.Texts, k: int = WORDS) -> np.ndarray:
    """Fingerprint of each text: bit b is set if over half of its shingles' XXH64 (seed 42) have it.

    Words are lower-cased in A-Z; a shingle is k words joined by a space; a text of fewer
    words is one shingle; a text without words has fingerprint 0.
    """
    out = np.zeros(texts.size, np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in range(texts.size):
        words = texts.bytes_of(i).translate(_LOWER).split()
        # bytes.split() parts at 0x20 and 0x09-0x0D only
        if not words:
            continue
        n = max(1, len(words) - k + 1)
        sums = np.zeros(64, np.int64)
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        starts, ends = (end - size)[:n].tolist(), end[min(k, len(words)) - 1 :].tolist()
        for a in range(0, n, 8192):
            hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts[a : a + 8192], ends[a : a + 8192], strict=True)], np.uint64)
            sums += _bit_sums(hashes)
        out[i] = np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(df: DataFrame, text: str = "text", k: int = WORDS) -> DataFrame:
    """df with ``simhash`` bigint (the 64 bits). Null and empty texts get 0; a column of that name is replaced.

    Other columns, whatever their names, and repeated rows stay as they are; an empty table gives no row. Texts are read whole, in groups of about
    1 MB or one longer text.
    """
    kept = df.drop("simhash")
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = simhashes(textops.Texts(batch.column(at)), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], [*batch.schema.names, "simhash"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("simhash", T.LongType())]))


def cuts(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, width) of the segments."""
    bounds = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def tables(prints: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(simhash, s, v): the value v of each segment s."""
    value = lambda at, width: F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit(_signed((1 << width) - 1)))
    return prints.select("simhash", F.posexplode(F.array(*[value(*c) for c in cuts(segments)])).alias("s", "v"))


def look_ups(members: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(x, s, v): each fingerprint under every value in the ball around its segment."""
    balls = []
    for _, width in cuts(segments):
        masks = [sum(1 << b for b in some) for r in range(APART // segments + 1) for some in itertools.combinations(range(width), r)]
        balls.append(F.array(*[F.col("v").bitwiseXOR(F.lit(_signed(m))) for m in masks]))
    return members.select(F.col("simhash").alias("x"), "s", F.explode(F.get(F.array(*balls), F.col("s"))).alias("v"))


def links(prints: DataFrame, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: edges that connect exactly the fingerprints connected by steps of 2 bits or fewer.

    prints: distinct non-null ``simhash``. Two fingerprints near each other in a segment: if either one's value there has
    ``hot`` members or fewer, the other's look-up finds it; else both meet under whole fingerprints.
    """
    members = tables(prints, segments)
    full = members.groupBy("s", "v").count().where(F.col("count") > hot).select("s", "v")
    members = members.join(full.withColumn("full", F.lit(True)), ["s", "v"], "left")
    few = members.where("full is null").select("s", "v", F.col("simhash").alias("y")).hint("shuffle_hash")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= APART
    found = look_ups(members, segments).join(few, ["s", "v"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    crowd = members.where("full").select("simhash").distinct()
    whole = F.array("simhash", *[F.col("simhash").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(64)])
    least = F.first("simhash").over(Window.partitionBy("key").orderBy("simhash"))  # of 65 at most
    met = crowd.select("simhash", F.explode(whole).alias("key")).select(least.alias("a"), F.col("simhash").alias("b"))
    return found.unionByName(met).where((F.col("a") != F.col("b")) & near).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, simhash, component_id) for a frame with ``simhash``; component_id is the smallest
    doc_id reachable by links. Null ids stay and count as larger than any other; repeated rows each stay; an empty table gives no row; other
    columns are not read."""
    named = df.select(F.col(doc_id).alias("doc_id"), "simhash")
    classes = named.groupBy("simhash").agg(F.min("doc_id").alias("least"))
    classes = common.durable(spark, classes, "fingerprints")
    groups = connected(spark, links(classes.select("simhash")), "simhash")
    of = classes.join(groups.select(F.col("node").alias("simhash"), "component"), "simhash", "left")
    of = of.select("simhash", "least", F.coalesce("component", "simhash").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("simhash", "component_id")
    return named.join(of, "simhash").select("doc_id", "simhash", "component_id")


#: Words of 63 bits that similarity is judged by, and the share of the pairs at the least similarity that must meet in a table.
WIDE, RECALL = 4, 0.99
_STREAMS = (0, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03)


def _shingle_sets(texts: textops.Texts, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's number and the sorted hashes of its distinct k-word shingles; fewer words are one shingle."""
    for first, end in texts.groups():
        starts, ends, first_word = texts.words(first, end)
        words = texts.hashes(starts, ends)
        runs = textops.shingles(words, k)
        for i in range(first, end):
            a, b = first_word[i - first], first_word[i - first + 1]
            own = runs[a : b - k + 1] if b - a >= k else textops.shingles(words[a:b], int(b - a)) if b > a else runs[:0]
            yield i, np.unique(own)


def wide(texts: textops.Texts, k: int) -> np.ndarray:
    """(texts, WIDE) words of 63 bits: SimHash over hashes of the distinct k-word shingles."""
    out = np.zeros((texts.size, WIDE), np.int64)
    for i, own in _shingle_sets(texts, k):
        if len(own):
            for word, add in enumerate(_STREAMS):
                hashes = textops.mix(own + np.uint64(add)) if add else own
                sums = sum(_bit_sums(hashes[x : x + 8192]) for x in range(0, len(hashes), 8192))
                bits = sums * 2 > len(hashes)
                bits[63] = False
                out[i, word] = np.packbits(bits, bitorder="little").view(np.int64)[0]
    return out


def recall(share: float, width: int, tables: int) -> float:
    """Part of the pairs that differ in ``share`` of the bits by expectation that some table of ``width`` bits has within one bit."""
    bits, apart = 63 * WIDE, range(63 * WIDE + 1)
    odds = np.array([math.comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in apart])
    met = np.array([sum(math.comb(d, x) * math.comb(bits - d, width - x) for x in range(2)) / math.comb(bits, width) for d in apart])
    return float((odds * (1 - (1 - met) ** tables)).sum())


def plan(n: int, share: float, target: float = RECALL) -> np.ndarray:
    """(tables, width) places of the bits in the words: so many bits that a value holds 32 to 64 random
    fingerprints, and as many tables as the target asks for at any n."""
    width = max(12, (n - 1).bit_length() - 6)
    tables = next(t for t in itertools.count(1) if recall(share, width, t) >= target)
    place = np.arange(63 * WIDE) // 63 * 64 + np.arange(63 * WIDE) % 63
    rng, cuts = np.random.default_rng(13), []
    while len(cuts) < tables:  # disjoint ones first, then of another order of the bits
        cuts += [place[a : a + width] for a in range(0, len(place) - width + 1, width)]
        place = rng.permutation(place)
    return np.array(cuts[:tables])


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id): documents whose sets of shingles of k words have a similarity
    (shared part of the union) of ``similarity`` or more are linked.

    For similarity s the cosine is 2s/(1+s) or more and the share of differing bits its angle
    over pi. Fingerprints with up to three standard deviations more are candidates (998 of
    1000 pairs at ``similarity``). A table holds some bits of the fingerprint; in each a
    fingerprint is looked up under the values within one bit of its own. There are as many
    tables as let 99 of 100 pairs of ``similarity`` meet, whatever the number of fingerprints.
    Within each component of candidates the shingles themselves decide which texts are linked.
    Null and empty texts are copies of one another; null ids are left out.
    """
    names = [f"w{i}" for i in range(WIDE)]
    typed = ", ".join(f"{w} bigint" for w in names)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = wide(textops.Texts(batch.column(1)), k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2, 3, 4)), *(pa.array(w) for w in np.ascontiguousarray(made.T))], ["doc_id", "t0", "t1", "size", *names])

    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    # a text is told apart by 128 bits
    prints = named.select("*", F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), "text").alias("t1"), F.octet_length("text").cast("bigint").alias("size"))
    prints = common.durable(spark, prints.mapInArrow(sketch, f"doc_id bigint, t0 bigint, t1 bigint, size bigint, {typed}"), "wide-simhash")
    texts = common.durable(spark, prints.groupBy("t0", "t1", *names).agg(F.min("doc_id").alias("id"), F.max("size").alias("size")), "wide-texts")
    classes = common.durable(spark, texts.groupBy(*names).agg(F.min("id").alias("id")), "wide-classes")
    n = max(2, classes.count())
    share, bits = np.arccos(2 * similarity / (1 + similarity)) / np.pi, 63 * WIDE
    most = int(share * bits + 3 * np.sqrt(share * (1 - share) * bits))
    edges = _candidates(spark, classes, plan(n, share), most)
    loose = connected(spark, edges, "near")
    of = classes.join(loose, F.col("id") == F.col("node"), "left").select(*names, F.coalesce("component", "id").alias("loose"))
    of = common.durable(spark, texts.join(of, names).select("id", "size", "loose"), "candidates", texts.count())
    edges = _verified(spark, named, of, k, similarity)
    found = connected(spark, edges.distinct(), "verified")
    known = texts.join(found, F.col("id") == F.col("node"), "left").select("t0", "t1", F.coalesce("component", "id").alias("component_id"))
    return prints.join(known, ["t0", "t1"]).select("doc_id", "component_id")


#: Texts and bytes of a component of candidates beyond which it is dealt out in chunks.
BLOCK_TEXTS, BLOCK_BYTES = 2000, 32 << 20


def _verified(spark: SparkSession, named: DataFrame, of: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b): edges that connect, within each component ``loose`` of candidates, just the texts connected by true similarities.

    named: (doc_id, text), of: (id, size, loose). A small component is one block. Of a larger one, every text is
    first compared with the component's first: near copies of one text are then done, in work that grows with
    their number. Only texts that are unlike the first one are compared with all others, in a block for
    each two chunks, which connects what they are like.
    """
    sizes = of.groupBy("loose").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).where("n > 1")
    sizes = sizes.select("loose", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("size") / BLOCK_BYTES)).cast("bigint").alias("chunks"))
    own = F.pmod(F.xxhash64("id"), F.col("chunks"))
    suspects = common.durable(spark, of.join(sizes, "loose").select("id", "loose", "chunks", own.alias("own")), "suspects", of.count())
    many = suspects.count()
    if not many:
        return spark.createDataFrame([], "a bigint, b bigint")
    texts = named.join(suspects, F.col("doc_id") == F.col("id")).select("id", "loose", "chunks", "own", "text")
    texts = common.durable(spark, texts, "suspect-texts")
    groups = max(8, many // BLOCK_TEXTS)

    def compared(rows: DataFrame) -> DataFrame:
        """rows: (id, text, loose, block, asks): of each block the texts that ask are compared with all, or, if none does, all with one another."""
        g = F.pmod(F.xxhash64("loose", "block"), F.lit(groups)).cast("int")
        return rows.withColumn("g", g).groupBy("g").applyInArrow(_blocks(k, similarity), "a bigint, b bigint")

    small = texts.where("chunks = 1").select("id", "text", "loose", F.lit(0).cast("bigint").alias("block"), F.lit(False).alias("asks"))
    large = texts.where("chunks > 1")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    # the first text goes to every chunk, and asks there
    first = large.where("id = loose").select("id", "text", "loose", each.alias("block"), F.lit(True).alias("asks"))
    others = large.where("id <> loose").select("id", "text", "loose", F.col("own").alias("block"), F.lit(False).alias("asks"))
    edges = common.durable(spark, compared(small.unionByName(first).unionByName(others)), "similar")
    left = large.where("id <> loose").join(edges.where("a <> b").select(F.col("b").alias("id"), F.col("a").alias("loose")), ["id", "loose"], "left_anti")
    left = common.durable(spark, left, "unlike-the-first")
    if left.isEmpty():
        return edges
    # each of these against every chunk
    parts = left.groupBy("loose").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("bigint").alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))
    asking = left.join(parts, "loose").select("id", "text", "loose", part.alias("part"), "chunks", "parts", each.alias("chunk"))
    asking = asking.select("id", "text", "loose", (F.col("part") * F.col("chunks") + F.col("chunk")).alias("block"), F.lit(True).alias("asks"))
    asked = large.join(parts, "loose").select("id", "text", "loose", "own", "chunks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    asked = asked.select("id", "text", "loose", (F.col("part") * F.col("chunks") + F.col("own")).alias("block"), F.lit(False).alias("asks"))
    groups = max(8, (asking.count() + asked.count()) // BLOCK_TEXTS)
    return edges.unionByName(compared(asking.unionByName(asked)))


def _blocks(k: int, similarity: float):
    def blocks(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        loose, block, ids = (group[c].to_numpy() for c in ("loose", "block", "id"))
        asks = group["asks"].to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, ~asks, block, loose))
        bounds = np.flatnonzero(np.append(True, (loose[order][1:] != loose[order][:-1]) | (block[order][1:] != block[order][:-1]))) if len(ids) else np.zeros(0, int)
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)], strict=False):
            rows = order[lo:hi]
            sets = [own for _, own in _shingle_sets(textops.Texts(group["text"].take(pa.array(rows))), k)]
            n = int(asks[rows].sum())
            for top, linked in _asked(sets, n, similarity) if n else _linked(sets, similarity):
                src.append(ids[rows[linked]])
                dst.append(np.full(len(linked), ids[rows[top]]))
        a, b = np.concatenate(src), np.concatenate(dst)
        root, node = spanning(a[a != b], b[a != b])
        return pa.table({"a": root, "b": node})

    return common.trimmed(blocks)


def _asked(sets: list[np.ndarray], n: int, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(number, numbers of the sets that share ``similarity`` of the union with it) for each of the first n sets."""
    size = np.array([len(x) for x in sets], np.int64)
    names, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), size)
    each = np.split(shingle, np.cumsum(size)[:-1])
    order = np.argsort(shingle, kind="stable")  # sets by shingle
    begin = np.searchsorted(shingle[order], np.arange(len(names) + 1))
    holders = of[order]
    for x in range(n):
        low, many = begin[each[x]], begin[each[x] + 1] - begin[each[x]]
        at = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        shared = np.bincount(holders[at], minlength=len(sets))
        yield x, np.flatnonzero(shared >= similarity * (size[x] + size - shared) - 1e-9)


def _linked(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(smallest number of a group, numbers newly connected with it) for sets that share ``similarity`` of their union."""
    size = np.array([len(x) for x in sets], np.int64)
    names, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), size)
    each = np.split(shingle, np.cumsum(size)[:-1])
    marked, alive = np.zeros(len(names), bool), np.ones(len(sets), bool)
    left = np.arange(len(sets))
    while len(left):
        top, queue, left = int(left[0]), [int(left[0])], left[1:]
        alive[top] = False
        while queue and len(left):
            x = queue.pop()
            marked[each[x]] = True
            shared = np.bincount(of[marked[shingle]], minlength=len(sets))[left]
            marked[each[x]] = False
            hit = shared >= similarity * (size[x] + size[left] - shared) - 1e-9
            if hit.any():
                yield top, left[hit]
                queue += left[hit].tolist()
                alive[left[hit]] = False
                left = left[~hit]
                rest = alive[of]
                of, shingle = of[rest], shingle[rest]


#: Members of a table value that are compared in one task, and rows of a group of values.
CHUNK, GROUP = 4096, 100_000


def _candidates(spark: SparkSession, classes: DataFrame, cuts: np.ndarray, most: int) -> DataFrame:
    """(a, b): edges between ids that connect the fingerprints of at most ``most`` differing bits that meet in a table.

    A value of more than CHUNK members is dealt out in chunks, which every look-up goes to: no pair is missed, and the
    work under such a value grows with the square of its members, spread over tasks. No pair becomes a row: a
    task gives a spanning forest of what it finds, an edge for each fingerprint at most.
    """
    n, (tables, width) = classes.count(), cuts.shape
    weight = 1 << np.arange(width, dtype=np.int64)
    names = [f"w{i}" for i in range(WIDE)]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                words = np.stack([batch.column(c).to_numpy() for c in range(WIDE)], 1)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                made = np.stack([bits[:, cut] @ weight for cut in cuts], 1)
                list_ = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, tables), pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, list_], [*batch.schema.names, "values"])

    held = classes.select(*names, "id").mapInArrow(values, ", ".join(f"{w} bigint" for w in names) + ", id bigint, values array<bigint>")
    held = common.durable(spark, held, "segment-values")
    row = ["id", *names, "s", "v"]
    members = held.select("id", *names, F.posexplode("values").alias("s", "v"))
    # values one bit apart have an even and an odd number of bits: the even one is looked up
    flips = F.array(*[F.col("v").bitwiseXOR(F.lit(1 << b)) for b in range(width)])
    looks = members.where(F.bit_count("v") % 2 == 0).select("id", *names, "s", F.explode(flips).alias("v"))
    hot = held.select(F.posexplode("values").alias("s", "v")).groupBy("s", "v").count().where(F.col("count") > CHUNK)
    hot = common.durable(spark, hot.select("s", "v", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "hot-values", n * tables // CHUNK)
    chunks = F.coalesce("chunks", F.lit(1))
    members = members.join(hot, ["s", "v"], "left").select(*row, F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"))
    # members of one chunk are compared among themselves, with those of later chunks by a look-up
    later = members.where(F.col("chunk") < F.col("chunks") - 1).select(*row, F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("member"))
    members = members.select(*row, "chunk", F.lit(True).alias("member"))
    looks = looks.join(hot, ["s", "v"], "left").select(*row, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(False).alias("member"))
    groups = max(8, n * tables * (width // 4 + 1) // GROUP)
    met = members.unionByName(later).unionByName(looks).withColumn("g", F.pmod(F.xxhash64("s", "v", "chunk"), F.lit(groups)).cast("int"))
    return met.groupBy("g").applyInArrow(_tied(most), "a bigint, b bigint").distinct()


def _tied(most: int):
    def tied(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        s, v, chunk, ids = (group[c].to_numpy() for c in ("s", "v", "chunk", "id"))
        member = group["member"].to_numpy(zero_copy_only=False)
        code = np.stack([group[f"w{i}"].to_numpy() for i in range(WIDE)], 1).view(np.uint64)
        order = np.lexsort((ids, ~member, chunk, v, s))
        s, v, chunk = s[order], v[order], chunk[order]
        fresh = np.append(True, (s[1:] != s[:-1]) | (v[1:] != v[:-1]) | (chunk[1:] != chunk[:-1])) if len(order) else np.zeros(0, bool)
        bounds = np.append(np.flatnonzero(fresh), len(order))
        held = np.add.reduceat(member[order].astype(int), bounds[:-1]) if len(order) else np.zeros(0, int)
        edges = [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero((held > 0) & (np.diff(bounds) > 1)).tolist():
            rows = order[bounds[i] : bounds[i + 1]]
            members, theirs = code[rows[: held[i]]].T.copy(), ids[rows[: held[i]]]
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                mine = code[part].T
                apart = sum(np.bitwise_count(mine[w][:, None] ^ members[w][None, :]).astype(np.int16) for w in range(WIDE))
                r, c = np.nonzero((apart <= most) & (ids[part][:, None] != theirs[None, :]))
                if len(r):  # the first that it meets, to which all others are tied
                    new = np.append(True, r[1:] != r[:-1])
                    first = c[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]
                    edges.append(np.stack([ids[part][r[new]], theirs[c[new]]], 1))
                    edges.append(np.unique(np.stack([theirs[c[~new]], theirs[first[~new]]], 1), axis=0))
        found = np.concatenate(edges)
        root, node = spanning(found[:, 0], found[:, 1])
        return pa.table({"a": root, "b": node})

    return tied


def deduplicate(spark: SparkSession, docs: DataFrame, k: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies: of each component the rows of its smallest doc_id stay; rows without an id all stay.

    Null and empty texts are copies of one another; repeated rows of an id stay or go together. An empty table gives no row, and other columns, whatever
    their names, are those of docs.
    """
    gone = near_duplicates(spark, docs, k, similarity, doc_id, text).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[doc_id].cast("bigint") == F.col("__gone"), "left_anti")
