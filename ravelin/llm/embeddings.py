"""Near-duplicate vectors by iterative quantisation.

A rotation of the centred principal components is learned so that the signs of the rotated
vector make a balanced binary code that keeps angles well; signs under further, random
rotations fill the code up to 128 bits. Each of several tables holds about log2(n) bits of
it; a vector is looked up in every table under all values within one bit of its own. There
are as many tables as the wanted recall at the least cosine asks for, however many vectors
there are. Codes that meet are compared whole, and what stays near is reranked by cosine of
the original vectors in double precision.

A pair counts in the first table in which it meets, so each is counted once. Equal vectors
are one entry. A value that very many codes share is dealt out in chunks, and no pair ever
becomes a row: a chunk gives each vector's number of links and a star for each group of
linked vectors. Of two values one bit apart, the one with an even number of bits is looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected

#: Entries of one table value that are compared in one go.
CHUNK = 4096
#: Rows of a group of table values.
GROUP = 100_000
#: Bits of a code, and the share of the pairs at the least cosine that must meet in a table.
BITS, RECALL = 128, 0.99
#: Beyond so many tables, values are made narrower instead.
MOST_TABLES = 64


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    project: np.ndarray  # (dim, BITS)
    spread: float  # squared length of a centred vector that nine of ten reach

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, BITS) bits and the same packed in (rows, BITS / 64) words."""
        bits = ((x - self.mean) @ self.project > 0).astype(np.uint8)
        return bits, np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def share(self, least: float) -> float:
        """Part of the bits in which two vectors of cosine ``least`` differ: their angle, seen from the mean, over pi."""
        return float(np.arccos(max(1 - (1 - least) / max(self.spread, 1e-9), 0.0)) / np.pi)


def learn(x: np.ndarray, rounds: int = 30, seed: int = 7, least: float = 0.95) -> Model:
    """x: rows of length 1. One rotation is learned, the others are random; each has as many bits as x has dimensions, 64 at most.

    The vectors are centred for balanced bits, unless many lie so near to their mean that it would cut apart what is linked:
    seen from it, links would have wide angles. Their angles at the origin never have.
    """
    bits = min(64, x.shape[1])
    mean = x.mean(0)
    if np.quantile(((x - mean) ** 2).sum(1), 0.1) < 4 * (1 - least):
        mean = np.zeros_like(mean)
    _, basis = np.linalg.eigh((x - mean).T @ (x - mean))
    basis = basis[:, ::-1][:, :bits]
    z = (x - mean) @ basis
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(z.T @ np.where(z @ turn > 0, 1.0, -1.0))
        turn = u @ v
    turns = [turn, *(np.linalg.qr(rng.normal(size=(bits, bits)))[0] for _ in range(-(-BITS // bits) - 1))]
    return Model(mean, (basis @ np.hstack(turns))[:, :BITS], float(np.quantile((z**2).sum(1), 0.1)))


def recall(share: float, width: int, tables: int) -> float:
    """Part of the pairs that differ in ``share`` of the bits by expectation that some table of ``width`` bits has within one bit."""
    apart = np.arange(BITS + 1)
    odds = np.array([math.comb(BITS, d) * share**d * (1 - share) ** (BITS - d) for d in apart.tolist()])
    met = [(math.comb(BITS - d, width) + d * math.comb(BITS - d, width - 1)) / math.comb(BITS, width) for d in apart.tolist()]
    return float((odds * (1 - (1 - np.array(met)) ** tables)).sum())


def plan(n: int, share: float, target: float = RECALL) -> np.ndarray:
    """(tables, width) bits of each table: about log2(n) bits, so that a value holds about one random code, and
    as many tables as the target asks for at any n."""
    width = max(16, math.ceil(math.log2(n + 1)))
    while width > 1 and recall(share, width, MOST_TABLES) < target:
        width -= 1
    tables = next((t for t in range(1, MOST_TABLES) if recall(share, width, t) >= target), MOST_TABLES)
    rng, cuts = np.random.default_rng(11), []
    while len(cuts) < tables:  # disjoint ones first, then of another order of the bits
        order = rng.permutation(BITS)
        cuts += [order[a : a + width] for a in range(0, BITS - width + 1, width)]
    return np.array(cuts[:tables])


def _unit(blobs: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs.to_pylist()), "<f8").reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(spark: SparkSession, vectors: DataFrame, dim: int, most_rows: int = 8192, least: float = 0.95) -> Model | None:
    """From at most ``most_rows`` vectors, those of smallest hash of their id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(most_rows).select("vector").toArrow()
    return learn(_unit(rows["vector"], dim), least=least) if rows.num_rows else None


def near(spark: SparkSession, df: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): the vectors linked directly with each by a cosine of
    ``least`` or more, and the smallest id reachable by links, itself included.

    A row for each row of df. Vectors that are null, zero or hold a null or a component that isn't finite link with
    nothing; vectors link with those of their own length. Rows without an id link with nothing and are kept. Other columns are not
    read. Equal vectors are one by their components, rows find theirs again by 128 bits of hash. Links that are missed are those of more than one bit's difference in every table, at
    the least cosine about 1 - RECALL of them, of few vectors as of many. An empty table gives no row. Equal vectors, however many
    rows have them, are one entry; of equal ids each row counts.
    """
    raw = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    fine = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    sound = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    key = [F.xxhash64("e").alias("h0"), F.xxhash64(F.lit(1), "e").alias("h1")]
    classes = raw.where(sound).groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("id")).select("id", "n", "e", *key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.asarray(batch.column(2)[i].values, "<f8") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 3, 4)), pa.array([len(v) for v in made], pa.int32()), pa.array([v.tobytes() for v in made], pa.binary())], ["id", "n", "h0", "h1", "dim", "vector"])

    vectors = common.durable(spark, classes.mapInArrow(pack, "id bigint, n bigint, h0 bigint, h1 bigint, dim int, vector binary"), "vectors")
    sizes = vectors.groupBy("dim").count().where("count > 1").orderBy("dim").collect()  # a row for each length that two vectors or more have
    found = spark.createDataFrame([], "id bigint, links bigint, root bigint")
    for r in sizes:
        found = found.unionByName(_links(spark, vectors.where(F.col("dim") == r["dim"]).select("id", "n", "vector"), r["dim"], least))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    groups = connected(spark, edges, "vectors")
    of = vectors.select("id", "n", "h0", "h1").join(counted.withColumnRenamed("id", "x"), F.col("id") == F.col("x"), "left")
    of = of.join(groups, F.col("id") == F.col("node"), "left").select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # each row's class by the hash of its vector; a vector that a third of the rows share is one row on the other side
    out = raw.where(sound).select("vec_id", *key).join(of, ["h0", "h1"], "left").select("vec_id", "n_links", "component_id")
    alone = raw.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(spark: SparkSession, vectors: DataFrame, dim: int, least: float) -> DataFrame:
    """(id, links: rows of other classes linked with it, root: an id that it is linked with, or its own), several rows an id."""
    n = vectors.count()
    model = fit(spark, vectors, dim, least=least)
    share = model.share(least) if n else 0.0
    cuts = plan(n, share)
    tables, width = cuts.shape
    masks = _masks(cuts)
    known = spark.sparkContext.broadcast(model)  # dim x 128 numbers

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 1 << np.arange(width)
        for batch in batches:
            bits, codes = known.value.codes(_unit(batch.column(2), dim)) if batch.num_rows else (np.zeros((0, BITS), np.uint8), np.zeros((0, 2), np.uint64))
            values = np.stack([bits[:, cut] @ place for cut in cuts], 1).astype(np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, tables), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in np.ascontiguousarray(codes.view(np.int64).T)), values], ["id", "c0", "c1", "values"])

    codes = common.durable(spark, vectors.mapInArrow(enter, "id bigint, c0 bigint, c1 bigint, values array<bigint>"), "codes")
    row = ["id", "c0", "c1", "s", "v"]
    members = codes.select("id", "c0", "c1", F.posexplode("values").alias("s", "v"))
    # values one bit apart have an even and an odd number of bits: the even one is looked up
    flips = F.array(*[F.col("v").bitwiseXOR(F.lit(1 << b).cast("bigint")) for b in range(width)])
    probes = members.where(F.bit_count("v") % 2 == 0).select("id", "c0", "c1", "s", F.explode(flips).alias("v"))
    # a value of more than CHUNK codes is dealt out: its members by hash, and every look-up goes to all its chunks
    hot = members.groupBy("s", "v").count().where(F.col("count") > CHUNK).select("s", "v", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    hot = common.durable(spark, hot, "hot-values", n * tables // CHUNK)
    chunks = F.coalesce("chunks", F.lit(1))
    members = members.join(hot, ["s", "v"], "left").select(*row, F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"))
    # members of one chunk are compared among themselves, with those of later chunks by a look-up
    later = members.where(F.col("chunk") < F.col("chunks") - 1).select(*row, F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("member"))
    members = members.select(*row, "chunk", F.lit(True).alias("member"))
    probes = probes.join(hot, ["s", "v"], "left").select(*row, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(False).alias("member"))
    groups = max(8, n * tables * (width // 2 + 1) // GROUP)
    group = F.pmod(F.xxhash64("s", "v", "chunk"), F.lit(groups)).cast("int").alias("g")
    most = int(share * BITS + 5 * math.sqrt(share * (1 - share) * BITS)) + 1

    met = members.unionByName(later).unionByName(probes).withColumn("g", group).groupBy("g").applyInArrow(_meeting(masks, most), "id bigint, c0 bigint, c1 bigint, s int, v bigint, chunk int, member boolean")
    met = common.durable(spark, met, "meetings")
    with_vectors = met.join(vectors, "id").withColumn("g", group)
    found = with_vectors.groupBy("g").applyInArrow(_rerank(masks, dim, least), "id bigint, links bigint, root bigint")
    return common.durable(spark, found, "links")


def _masks(cuts: np.ndarray) -> np.ndarray:
    """(tables, BITS / 64) words with the bits of each table."""
    held = np.zeros((len(cuts), BITS), np.uint8)
    np.put_along_axis(held, cuts, 1, 1)
    return np.packbits(held, axis=1, bitorder="little").view("<u8")


def _codes(group: pa.Table) -> np.ndarray:
    return np.stack([group[c].to_numpy() for c in ("c0", "c1")], 1).view(np.uint64)


def _values(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the members, and of them and the look-ups, of each table value and chunk that has two rows or more."""
    s, v, chunk = (group[c].to_numpy() for c in ("s", "v", "chunk"))
    member = group["member"].to_numpy(zero_copy_only=False)
    order = np.lexsort((~member, chunk, v, s))
    same = (s[order][1:] == s[order][:-1]) & (v[order][1:] == v[order][:-1]) & (chunk[order][1:] == chunk[order][:-1])
    bounds = np.append(np.flatnonzero(np.append(True, ~same)), len(order)) if len(order) else np.zeros(1, int)
    held = np.add.reduceat(member[order].astype(int), bounds[:-1]) if len(order) else np.zeros(0, int)
    for i in np.flatnonzero((held > 0) & (np.diff(bounds) > 1)):
        yield order[bounds[i] : bounds[i] + held[i]], order[bounds[i] : bounds[i + 1]]


def _only_first(hit: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, masks: np.ndarray) -> None:
    """Clears the pairs of a (rows) and b (columns) that a table before this one makes meet."""
    r, c = np.nonzero(hit)
    for at in range(0, len(r), 1 << 18):
        x, y = r[at : at + (1 << 18)], c[at : at + (1 << 18)]
        apart = a[x] ^ b[y]
        ok = np.ones(len(x), bool)
        for t in range(table):
            ok &= np.bitwise_count(apart & masks[t]).sum(1) > 1
        hit[x, y] = ok


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])


def _meeting(masks: np.ndarray, most: int):
    """Keeps the look-ups that meet a near code other than their own, and the members that are met."""

    def meeting(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        code, ids, s = _codes(group), group["id"].to_numpy(), group["s"].to_numpy()
        keep = np.zeros(len(code), bool)
        for members, looks in _values(group):
            for at in range(0, len(looks), 1024):
                part = looks[at : at + 1024]
                close = (_apart(code[part], code[members]) <= most) & (ids[part][:, None] != ids[members][None, :])
                if close.any():
                    _only_first(close, code[part], code[members], int(s[part[0]]), masks)
                    keep[part] |= close.any(1)
                    keep[members] |= close.any(0)
        return group.filter(pa.array(keep)).select(["id", "c0", "c1", "s", "v", "chunk", "member"])

    return meeting


def _rerank(masks: np.ndarray, dim: int, least: float):
    def rerank(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        code, ids, s, n = _codes(group), group["id"].to_numpy(), group["s"].to_numpy(), group["n"].to_numpy()
        member = group["member"].to_numpy(zero_copy_only=False)
        x = _unit(group["vector"], dim)
        out_id, out_links, out_root = [], [], []
        for members, looks in _values(group):
            # the group's vectors by number; a look-up and a member of one id are the same vector
            names, place = np.unique(ids[np.concatenate([members, looks])], return_inverse=True)
            of = np.arange(len(names))
            links = np.zeros(len(names), np.int64)
            pm, pl = place[: len(members)], place[len(members) :]
            for at in range(0, len(looks), 512):
                part = looks[at : at + 512]
                hit = (x[part] @ x[members].T >= least) & (ids[part][:, None] != ids[members][None, :])
                if not hit.any():
                    continue
                _only_first(hit, code[part], code[members], int(s[part[0]]), masks)
                links[pl[at : at + 512]] += hit @ n[members]
                # members find one another from both sides, a look-up stands for both
                asked = ~member[part]
                links[pm] += n[part][asked] @ hit[asked]
                for r, row in zip(pl[at : at + 512], hit, strict=True):
                    if row.any():  # join the groups of all it is linked with under the smallest
                        roots = np.unique(of[np.append(pm[row], r)])
                        if len(roots) > 1:
                            of[np.isin(of, roots)] = roots[0]
            use = np.flatnonzero((links > 0) | (of != np.arange(len(names))))
            out_id.append(names[use])
            out_links.append(links[use])
            out_root.append(names[of[use]])
        join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return pa.table({"id": join(out_id), "links": join(out_links), "root": join(out_root)})

    return rerank
