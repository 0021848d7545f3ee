"""Term co-occurrence: count(j, k) = the multiplicity of k summed over the rows that hold j, for j <> k.

Two plans: stripes (a row's counts travel with each of its terms, with truncation and
padding as options) and pairs. A hot row, one of very many terms, is no array in one task: cut
stripes need its first terms only, and whole ones are made tile by tile, a task a pair of tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..model import PAD, wrap32
from ..operators.partition import PART, ROWS, by_hash, once, tasks_for
from .mapreduce import mapreduce

#: Terms of a tile of a hot row; one row in SAMPLED is looked at to find hot ones; hot rows up to which their table is broadcast.
TILE, SAMPLED, FEW_ROWS = 1 << 16, 64, 1 << 16
#: Pairs that a task makes or sums up, about.
PAIRS = 1 << 20


def _keys(df: DataFrame) -> list[str]:
    """What tells rows apart: the row, and the partition where it was dealt to one, so that nothing that is grouped by both moves."""
    return [*([PART] if PART in df.columns else []), "row_id"]


def term_counts(terms: DataFrame) -> DataFrame:
    """(row_id, term, cnt) from rows (row_id, term); term 0 is padding and never counted.

    Dealt by row_id, the counts need no further exchange to be put together by row or joined with one another.
    """
    return terms.where(F.col("term") != PAD).groupBy(*_keys(terms), "term").agg(F.count(F.lit(1)).alias("cnt"))


def stripes(counts: DataFrame, length: int | None = None) -> DataFrame:
    """(row_id, key, stripe): for each term of a row the counts of the row's other terms, ascending, the first ``length``."""
    keys = _keys(counts)
    rows = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("term", "cnt"))).alias("kv"))
    others = F.filter("kv", lambda x: x["term"] != F.col("key"))
    if length is not None:
        others = F.slice(others, 1, length)
    return rows.select(*keys, "kv", F.explode("kv.term").alias("key")).select(*keys, "key", others.alias("stripe"))


def _seen(terms: DataFrame) -> DataFrame:
    """(row_id, n): the terms of each row in a sample of one in SAMPLED. It decides on plans only: which one a row takes, over how many tasks."""
    return once(terms.sample(1 / SAMPLED, 7).groupBy("row_id").agg(F.count(F.lit(1)).alias("n")))


def _work(seen: DataFrame, tile: int | None, length: int | None = None, pad: bool = False) -> tuple[int, int, int, int]:
    """(terms, pairs) of rows that aren't hot and of those that are, about."""
    hot = F.lit(False) if tile is None else (F.col("n") > tile / SAMPLED / 2) & F.col("row_id").isNotNull()
    terms, pairs = SAMPLED * F.col("n"), SAMPLED**2 * F.col("n") * (F.col("n") - 1)  # n * (n - 1) is expected to be the row's pairs by the square of the fraction
    sums = [F.coalesce(F.sum(F.when(h, x)), F.lit(0)) for h in (~hot, hot) for x in (terms, pairs)]
    found = seen.agg(*[x.alias(f"x{i}") for i, x in enumerate(sums)]).first()
    made = lambda n, p: p if length is None else n * length if pad else min(p, n * length)
    return found[0], made(found[0], found[1]), found[2], made(found[2], found[3])


def hot_rows(terms: DataFrame, tile: int = TILE, seen: DataFrame | None = None) -> tuple[DataFrame | None, bool]:
    """(row_id of rows that may have more than ``tile`` terms, whether they are few); None if there is none.

    A sample tells: of a row beyond the bound it has at least half the rows expected, but for odds of 1 in 10**30 at the
    usual bound. Which plan a row takes changes nothing in its result.
    """
    found = (_seen(terms) if seen is None else seen).where(F.col("n") > tile / SAMPLED / 2)
    found = once(found.select("row_id").where(F.col("row_id").isNotNull()))
    many = found.count()
    return (found if many else None), many <= FEW_ROWS


def tiled(counts: DataFrame, length: int | None = None, tile: int = TILE, tasks: int | None = None, few: bool = False) -> DataFrame:
    """stripes() for hot rows: (row_id, key, stripe). Whole stripes come in pieces, one for each tile of the row's terms.

    Whole: the terms of a row are dealt to tiles by hash, and each pair of tiles meets once: the keys of the one
    with the other's counts as an array. Cut: the first length + 1 terms of a row, which Spark selects before it
    exchanges any, are all that its stripes can hold. tasks: those that make the stripes, each of which has its number, PART; few:
    the rows are.
    """
    pair, near = F.struct("term", "cnt"), F.broadcast if few else lambda df: df
    tasks = tasks or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if length is not None:
        first = counts.withColumn("rank", F.row_number().over(Window.partitionBy("row_id").orderBy("term"))).where(F.col("rank") <= length + 1)
        heads = first.groupBy("row_id").agg(F.array_sort(F.collect_list(pair)).alias("kv"))  # a row a hot row
        others = F.slice(F.filter("kv", lambda x: x["term"] != F.col("key")), 1, length)
        keyed = counts.select("row_id", F.col("term").alias("key"))
        if few:
            met = by_hash(keyed, tasks, "row_id", "key").join(F.broadcast(heads), "row_id")
        else:
            met = by_hash(keyed, tasks, "row_id").join(by_hash(heads, tasks, "row_id"), [PART, "row_id"])
        return met.select(PART, "row_id", "key", others.alias("stripe"))
    sizes = counts.groupBy("row_id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = counts.join(near(sizes), "row_id").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    keys = dealt.select("row_id", F.col("tile").alias("a"), F.col("term").alias("key"), every.alias("b"))
    side = dealt.groupBy("row_id", F.col("tile").alias("b"), "tiles").agg(F.array_sort(F.collect_list(pair)).alias("kv")).select("row_id", "b", "kv", every.alias("a"))
    by_pair = lambda df: by_hash(df, tasks, "row_id", "a", "b")  # noqa: E731  their work is in what they make, not in the bytes that adaptive execution would put together
    met = by_pair(keys).join(by_pair(side), [PART, "row_id", "a", "b"])
    return met.select(PART, "row_id", "key", F.filter("kv", lambda x: x["term"] != F.col("key")).alias("stripe")).where(F.size("stripe") > 0)


def _split(terms: DataFrame, tile: int | None, length: int | None = None, pad: bool = False) -> tuple[DataFrame, DataFrame | None, bool, int, int]:
    """(counts of rows that aren't hot, dealt by row; counts of those that are, if any, and whether these rows are few; tasks for the hot rows' stripes; tasks for the sums of all pairs).

    The number of tasks comes from the terms and the pairs that they will make: few bytes of terms make many pairs, which the
    size of an exchange doesn't tell.
    """
    spark, seen = terms.sparkSession, _seen(terms)
    n, made, hot_n, hot_made = _work(seen, tile, length, pad)
    sure = tile is None or tile >= SAMPLED**2  # else the sample shows rows of any size as hot ones, and what isn't hot is like them
    tasks = max(tasks_for(spark, n if sure else n + hot_n, ROWS), tasks_for(spark, made if sure else made + hot_made, PAIRS))
    hot, few = hot_rows(terms, tile, seen) if tile else (None, True)
    sums = tasks_for(spark, made + hot_made, PAIRS)
    if hot is None:
        return term_counts(by_hash(terms, tasks, "row_id")), None, few, tasks, sums
    if few:
        plain, rest = by_hash(terms.join(F.broadcast(hot), "row_id", "left_anti"), tasks, "row_id"), terms.join(F.broadcast(hot), "row_id", "left_semi")
    else:  # told apart where they were dealt to
        all_tasks = max(tasks_for(spark, n + hot_n, ROWS), tasks_for(spark, made + hot_made, PAIRS))
        told = by_hash(terms, all_tasks, "row_id").join(by_hash(hot.withColumn("__hot", F.lit(True)), all_tasks, "row_id"), [PART, "row_id"], "left")
        plain, rest = told.where(F.col("__hot").isNull()).drop("__hot"), told.where("__hot").drop(PART, "__hot")
    hot_tasks = max(tasks_for(spark, hot_n, ROWS), tasks_for(spark, hot_made, PAIRS))
    return term_counts(plain), term_counts(by_hash(rest, hot_tasks, "row_id", "term")).drop(PART), few, hot_tasks, sums


def padded(emitted: DataFrame, length: int) -> DataFrame:
    """Stripes filled up with (0, 0) to a fixed length."""
    zero = F.struct(F.lit(PAD).cast("bigint").alias("term"), F.lit(0).cast("bigint").alias("cnt"))
    return emitted.withColumn("stripe", V.pad(F.col("stripe"), zero, length))


def _pairs_of(emitted: DataFrame) -> DataFrame:
    part = [PART] if PART in emitted.columns else []
    return emitted.select(*part, F.col("key").alias("left"), F.explode("stripe").alias("s")).select(*part, "left", F.col("s.term").alias("right"), "s.cnt")


def _combined(pairs: DataFrame, wrap: bool = False) -> DataFrame:
    """(left, right, cnt) summed inside each partition, where they lie."""
    total = F.sum("cnt")
    return pairs.groupBy(PART, "left", "right").agg((wrap32(total) if wrap else total).alias("cnt")).drop(PART)


def _summed(pairs: DataFrame, tasks: int | None = None, wrap: bool = False) -> DataFrame:
    total = F.sum("cnt")
    return (pairs.repartition(tasks, "left", "right") if tasks else pairs).groupBy("left", "right").agg((wrap32(total) if wrap else total).alias("cnt"))


def reduce_stripes(emitted: DataFrame, wrap: bool = False, tasks: int | None = None) -> DataFrame:
    """(left, right, cnt): the counts of all stripes of a key, summed by term."""
    return _summed(_pairs_of(emitted).drop(PART), tasks, wrap)


def by_stripes(terms: DataFrame, length: int | None = None, pad: bool = False, wrap: bool = False, partitions: int | None = None, tile: int | None = TILE, phases: bool = False) -> DataFrame:
    """With pad, a key has a row (key, 0, 0) if any of its stripes was shorter than ``length``. tile: terms above which a row is hot; None: no row is."""
    plain, hot, few, hot_tasks, sums = _split(terms, tile, length, pad)

    def emit(_: DataFrame) -> DataFrame:
        made = [stripes(plain, length)] + ([] if hot is None else [tiled(hot, length, tile, hot_tasks, few)])
        made = [padded(m, length) if pad else m for m in made]
        made = [m.drop(PART) if partitions or phases else _combined(_pairs_of(m)) for m in made]
        return made[0].unionByName(made[1]) if made[1:] else made[0]

    def reduce(emitted: DataFrame) -> DataFrame:
        if phases:
            return reduce_stripes(emitted, wrap, sums)
        return _combined(_pairs_of(emitted), wrap) if partitions else _summed(emitted, sums, wrap)

    return mapreduce(terms, emit, reduce, partitions, phases=phases)


def without_padding(counts: DataFrame) -> DataFrame:
    """What a consumer of padded counts keeps."""
    return counts.where(F.col("right") != PAD)


def pairs(counts: DataFrame) -> DataFrame:
    """(row_id, left, right, cnt): each term of a row beside every other of the row."""
    keys = _keys(counts)
    left = counts.select(*keys, F.col("term").alias("left"))
    right = counts.select(*keys, F.col("term").alias("right"), "cnt")
    return left.join(right, keys).where("left <> right").select(*keys, "left", "right", "cnt")


def by_pairs(terms: DataFrame, tile: int | None = TILE) -> DataFrame:
    plain, hot, few, hot_tasks, sums = _split(terms, tile)
    out = _combined(pairs(plain))
    if hot is not None:
        out = out.unionByName(_combined(_pairs_of(tiled(hot, None, tile, hot_tasks, few))))
    return _summed(out, sums)
