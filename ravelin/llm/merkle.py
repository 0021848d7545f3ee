"""Merkle manifest of a dataset: a digest for each row, a tree for each group, a tree over the groups.

Building is an event-driven combine by key. The rows of each group are numbered in order, so
the size of every run of siblings is known beforehand. A digest is an event for its parent: a
task keeps partial parents, indexed digests of the children that have come, until a parent has
as many as its arity says; then it is hashed, and is itself an event for its own parent. What a
task can't complete, the children of its partial parents, is its frontier: about two runs for
each level, since a task holds a range of the order. The frontiers are dealt anew by an ancestor
SPAN levels up and combined again, until none is left. Each completed parent is written with
its children: these reverse links, followed from the root downwards by blocks of SPAN levels,
give every row its proof, whose upper part is worked out once for each block.

No task holds a group: a block has ARITY ** SPAN rows and the links above them, a partial parent
ARITY digests. The driver gets the number of rows left after each round, and the root.

Digests are lowercase hexadecimal text, and the digest of a run is that of its members'
digests one after the other. A value enters a leaf as ``-`` if it is null, else as its number of
UTF-8 bytes, ``:`` and itself, so no two different rows are written alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node; levels that a frontier is combined over, or a proof followed down, in one exchange.
ARITY, SPAN = 16, 2
#: Child digests that a task keeps before it hands its partial parents on.
MOST_HELD = 200_000
#: Rows of a batch of results.
ROWS = 4096

_MADE = pa.schema([("g", pa.string()), ("level", pa.int32()), ("i", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])
_MADE_SQL = "g string, level int, i bigint, n bigint, digest string, children array<string>"


@dataclass(frozen=True)
class Manifest:
    """leaves: (g, i, n, id, leaf, found): i counts the rows of a group from 0, n are all of them; found is the digest of the
    row as found later, null where nothing is altered.
    links: (g, level, i, n, digest, children): every inner node of the groups' trees, level 1 above the leaves.
    groups: (g, i, n, digest): the groups' roots in order. above: the inner nodes of the tree over them. root: its digest, None without rows.
    g is ``""`` for the null group, else ``=`` and the group's text.
    """

    leaves: DataFrame
    links: DataFrame
    groups: DataFrame
    above: DataFrame
    root: str | None


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def digest_of(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def size_at(n: int, level: int) -> int:
    """Nodes of a level over n leaves."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    level = 0
    while size_at(n, level) > 1:
        level += 1
    return level


class Combiner:
    """Partial parents of a task; ``made`` gets (g, level, i, n, digest, children), with children for a completed parent
    and without for a node of the frontier."""

    def __init__(self) -> None:
        self.partial: dict[tuple[str, int, int], tuple[int, dict[int, str]]] = {}
        self.held = 0
        self.made: list[tuple] = []

    def add(self, g: str, level: int, i: int, n: int, digest: str) -> None:
        size = size_at(n, level)
        while size > 1:
            parent, place = divmod(i, ARITY)
            children = self.partial.setdefault((g, level + 1, parent), (n, {}))[1]
            children[place] = digest
            self.held += 1
            arity = min(ARITY, size - parent * ARITY)
            if len(children) < arity:
                return
            del self.partial[g, level + 1, parent]
            self.held -= arity
            run = [children[k] for k in range(arity)]
            level, i, digest, size = level + 1, parent, digest_of(run), size_at(n, level + 1)
            self.made.append((g, level, i, n, digest, run))

    def hand_on(self) -> None:
        """The children of all partial parents become the frontier."""
        for (g, level, parent), (n, children) in self.partial.items():
            self.made += [(g, level - 1, parent * ARITY + place, n, digest, None) for place, digest in children.items()]
        self.partial, self.held = {}, 0

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.made, strict=True)) or [[]] * len(_MADE)
        self.made = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MADE, strict=True)], schema=_MADE)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (g, level, i, n, digest, block), sorted by block or of one block."""
    at, now = Combiner(), None
    for batch in batches:
        for g, level, i, n, digest, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now or at.held >= MOST_HELD:
                at.hand_on()
                now = block
            at.add(g, level, i, n, digest)
            if len(at.made) >= ROWS:
                yield at.taken()
    at.hand_on()
    yield at.taken()


def _numbered(spark: SparkSession, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with i, the number of a row in its g by ``order`` from 0, and n, the rows of g.

    The rows are dealt by ranges of (g, order) and written, then numbered by the count of each g in each range.
    """
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id())
    dealt = common.durable(spark, dealt.withColumn("part", F.shiftright("at", 33)), name)
    counts = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))  # a row a range and group
    own = Window.partitionBy("g")
    before = F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    return dealt.join(counts, ["g", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _tree(spark: SparkSession, leaves: DataFrame, name: str) -> DataFrame:
    """The inner nodes over (g, i, n, digest)."""
    rows = leaves.where("n > 1").select("g", F.lit(0).alias("level"), "i", "n", "digest", F.lit("").alias("block"))
    made = common.durable(spark, rows.mapInArrow(_combined, _MADE_SQL), f"{name}-0")
    links, top = made.where("children IS NOT NULL"), 0
    frontier = made.where("children IS NULL")
    while frontier.count():
        top += SPAN
        up = F.greatest(F.lit(top), F.col("level") + 1)
        ancestor = _ancestor(F.col("i"), up - F.col("level"))
        dealt = frontier.select("g", "level", "i", "n", "digest", F.concat_ws("/", "g", up, ancestor).alias("block"))
        made = common.durable(spark, dealt.repartition("block").sortWithinPartitions("block", "level", "i").mapInArrow(_combined, _MADE_SQL), f"{name}-{top}")
        links, frontier = links.unionByName(made.where("children IS NOT NULL")), made.where("children IS NULL")
    return links


def _tops(leaves: DataFrame, links: DataFrame) -> DataFrame:
    """(g, n, digest) of each group's root."""
    alone = leaves.where("n = 1").select("g", "n", "digest")
    return alone.unionByName(links.where((F.col("i") == 0) & (_nodes(F.col("n"), F.col("level")) == 1)).select("g", "n", "digest"))


def _nodes(n: Column, level: Column) -> Column:
    """size_at as a column."""
    return _ancestor(n - 1, level) + 1


def _ancestor(i: Column, levels: Column) -> Column:
    """The number of the node that many levels above node i."""
    return F.call_function("shiftright", i, (levels * (ARITY.bit_length() - 1)).cast("int"))


def build(spark: SparkSession, df: DataFrame, columns: list[str], group: str = "source", order: str = "doc_id", altered: dict[str, Column] | None = None) -> Manifest:
    """The manifest of df: rows as leaves over ``columns`` in the order given, a tree for each value of ``group`` with its
    rows by ascending ``order``, and a tree over the groups (null first, then by UTF-8 bytes).

    altered: columns as found later, for proofs that should fail; a row whose altered columns are as before has the same leaf.
    Null orders come first; rows of one order stand by their leaf, so repeated rows give the same tree however they
    are dealt. An empty table has no root. Texts of any length are hashed in the JVM and never leave it; other columns are not read.
    """
    values = [F.col(f"`{c}`") for c in columns]
    later = [(altered or {}).get(c, F.col(f"`{c}`")) for c in columns]
    differs = F.lit(False)
    for c, v in (altered or {}).items():
        differs = differs | ~v.eqNullSafe(F.col(f"`{c}`"))
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = df.select(key.alias("g"), F.col(f"`{order}`").alias("id"), leaf_of(values).alias("leaf"), F.when(differs, leaf_of(later)).alias("found"))
    rows = common.durable(spark, rows, "leaves")  # what is small is what is sorted
    leaves = common.durable(spark, _numbered(spark, rows, ["id", "leaf"], "leaves-in-order"), "leaves-numbered")
    nodes = leaves.withColumnRenamed("leaf", "digest")
    links = _tree(spark, nodes, "links")
    tops = common.durable(spark, _tops(nodes, links).select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), "groups")
    groups = common.durable(spark, _numbered(spark, tops, ["group"], "groups-in-order"), "groups-numbered")
    above = _tree(spark, groups, "above")
    root = _tops(groups, above).first()
    return Manifest(leaves, links, groups.select(F.col("group").alias("g"), "i", "n", "digest"), above, root and root["digest"])


def step_of(run: list[str], place: int) -> str:
    """What a proof says of one level: the place of a node in its run, and the run's other digests one after the other."""
    return f"{place}:{''.join(run[:place])}{''.join(run[place + 1 :])}"


def folded(digest: str, proof: str) -> str:
    """The root that a leaf and its proof give."""
    for step in proof.split(",") if proof else ():
        place, _, others = step.partition(":")
        cut = len(digest) * int(place)
        digest = digest_of([others[:cut], digest, others[cut:]])
    return digest


def proof_digest(proof: str) -> str:
    """The digest of all siblings of a proof, from the leaf upwards."""
    return digest_of([step.partition(":")[2] for step in proof.split(",")] if proof else [])


_DOWN = "g string, level int, i bigint, proof string, top string"


def _followed(batches: Iterator[pa.RecordBatch], low: int, emit) -> Iterator[pa.RecordBatch]:
    """Of rows of blocks, sorted by block and descending level, a proof row first: ``emit`` makes a batch of what
    (row, proof, top) it gets for each row of level ``low`` that is asked for; without it the nodes of that level go on."""
    known: dict[tuple[int, int], str] = {}
    now, top, out = None, None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block, kind, level, i, children, proof, its_top = row[:7]
            if block != now:
                now, known = block, {}
            if kind == 0:
                known[level, i], top = proof, its_top
            elif kind == 1:
                rest = known.pop((level, i))
                for place in range(len(children)):
                    said = step_of(children, place) + ("," + rest if rest else "")
                    if emit is None and level - 1 == low:
                        out.append((block, low, i * ARITY + place, said, top))
                    else:
                        known[level - 1, i * ARITY + place] = said
            else:
                out.append((row, known[low, i], top))
            if len(out) >= ROWS // 4:
                yield _down(out) if emit is None else emit(out)
                out = []
    yield _down(out) if emit is None else emit(out)


def _down(out: list[tuple]) -> pa.RecordBatch:
    columns = [[r[k] for r in out] for k in range(5)]
    columns[0] = [b.rsplit("/", 1)[0] for b in columns[0]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], ["g", "level", "i", "proof", "top"])


def _blocks(links: DataFrame, starts: DataFrame, tier: int) -> DataFrame:
    """The rows that a block of levels low .. high needs: the proof of its uppermost node, then its links."""
    low, high = SPAN * tier, SPAN * (tier + 1)
    block = lambda i, level: F.concat_ws("/", "g", _ancestor(i, F.lit(high) - level))
    none = F.lit(None)
    first = starts.select(block(F.col("i"), F.col("level")).alias("block"), F.lit(0).alias("kind"), "level", "i", none.cast("array<string>").alias("children"), "proof", "top")
    inner = links.where((F.col("level") > low) & (F.col("level") <= high))
    inner = inner.select(block(F.col("i"), F.col("level")).alias("block"), F.lit(1).alias("kind"), "level", "i", "children", none.cast("string").alias("proof"), none.cast("string").alias("top"))
    return first.unionByName(inner)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", "kind", F.desc("level"))


def _proven(spark: SparkSession, links: DataFrame, tops: DataFrame, most: int, name: str) -> DataFrame:
    """The proofs at the tops of the blocks of the lowest levels, from those of the trees' tops (g, n, proof, top); most: leaves of the largest tree."""
    n, tier = F.col("n"), max(0, -(-height(most) // SPAN) - 1)
    level = F.lit(0)
    for k in range(height(most)):  # one sum, not a loop over rows
        level = level + (_nodes(n, F.lit(k)) > 1).cast("int")
    entry = tops.select("g", level.alias("level"), F.lit(0).cast("bigint").alias("i"), "proof", "top")
    above = entry.where(F.col("level") > SPAN * tier) if tier else entry
    while tier:
        made = _sorted(_blocks(links, above, tier)).mapInArrow(lambda batches, low=SPAN * tier: _followed(batches, low, None), _DOWN)
        made = common.durable(spark, made, f"{name}-{tier}")
        tier -= 1
        enters = (F.col("level") <= SPAN * (tier + 1)) & (F.col("level") > SPAN * tier if tier else F.lit(True))
        above = made.unionByName(entry.where(enters))
    return above


def _most(leaves: DataFrame) -> int:
    return leaves.agg(F.max("n")).first()[0] or 1


def group_proofs(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(g, digest, n, proof): of each group's root up to the root."""
    groups = manifest.groups.select(F.lit("").alias("g"), F.col("g").alias("group"), "i", "n", "digest")
    top = groups.where("i = 0").select("g", "n", F.lit("").alias("proof"), F.lit("").alias("top"))
    starts = _proven(spark, manifest.above, top, _most(groups), "group-proofs")

    def emit(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[7] for r, _, _ in found], pa.string()), pa.array([r[8] for r, _, _ in found], pa.string()), pa.array([p for _, p, _ in found], pa.string())], ["g", "digest", "proof"])

    asked = groups.select(_leaf_block().alias("block"), "i", F.col("group").alias("a"), F.col("digest").alias("b"))
    rows = _sorted(_asked(_blocks(manifest.above, starts, 0), asked, ("a", "b")))
    return rows.mapInArrow(lambda batches: _followed(batches, 0, emit), "g string, digest string, proof string")


def _leaf_block() -> Column:
    return F.concat_ws("/", "g", _ancestor(F.col("i"), F.lit(SPAN)))


def _asked(blocks: DataFrame, asked: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """Blocks with the rows of level 0 whose proofs are asked for behind them."""
    none = F.lit(None)
    for c in extra:
        blocks = blocks.withColumn(c, none.cast(asked.schema[c].dataType))
    columns = [none.cast("array<string>").alias("children"), none.cast("string").alias("proof"), none.cast("string").alias("top")]
    return blocks.unionByName(asked.select("block", F.lit(2).alias("kind"), F.lit(0).alias("level"), "i", *columns, *extra))


def proofs(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof, proof_sha256, folded_root, verified): a row for each row of the dataset.

    proof: for each level from the leaf to the root ``place:siblings``, comma-joined. folded_root is recomputed from the row as
    found and the proof; verified says whether it is the root.
    """
    over = common.durable(spark, group_proofs(spark, manifest), "group-proofs")
    sizes = manifest.leaves.where("i = 0").select("g", "n")
    tops = over.join(sizes, "g").select("g", "n", "proof", F.col("digest").alias("top"))
    starts = _proven(spark, manifest.links, tops, _most(manifest.leaves), "proofs")
    kind = manifest.leaves.schema["id"].dataType
    asked = manifest.leaves.select(_leaf_block().alias("block"), "i", "id", "leaf", "found")
    rows = _sorted(_asked(_blocks(manifest.links, starts, 0), asked, ("id", "leaf", "found")))
    id_type = pa.string() if kind.simpleString() == "string" else None

    def emit(found: list[tuple]) -> pa.RecordBatch:
        ids = pa.array([r[7] for r, _, _ in found], id_type or pa.int64())
        text = lambda values: pa.array(values, pa.string())
        proved = [p for _, p, _ in found]
        return pa.RecordBatch.from_arrays(
            [ids, text([r[8] for r, _, _ in found]), text([t for _, _, t in found]), text(proved), text([proof_digest(p) for p in proved]), text([folded(r[9] or r[8], p) for r, p, _ in found])],
            ["id", "leaf", "subroot", "proof", "proof_sha256", "folded_root"],
        )

    id_sql = "string" if id_type else "bigint"
    out = rows.mapInArrow(lambda batches: _followed(batches, 0, emit), f"id {id_sql}, leaf string, subroot string, proof string, proof_sha256 string, folded_root string")
    return out.select("id", "leaf", "subroot", F.lit(manifest.root).alias("root"), "proof", "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(manifest.root)).alias("verified"))
