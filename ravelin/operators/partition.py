"""Exchanges: contiguous slices, key-aligned range slices, routing by ownership.

Row numbers and running totals are made within ranges of the key and over the totals of the
ranges, so no window gathers more than ROWS rows in a task. The ranges are quantiles of
quantiles, FAN to a level and as many levels as the number of rows asks for, whatever the keys
are; totals of more ranges than ROWS are summed up in the same way.

Ownership, a last key for each slice, is a table that is looked up like a search tree: its
keys in order are bins of FAN, the bins' last keys are bins of FAN again, up to one. A key goes down by one equi-join on
the bin a level and a filter inside it, so any number of slices is served and none is collected.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import permuted, shuffle_order
from ..session import ensure_checkpoints

#: Rows of a range, about; what one level splits a range or a bin into.
ROWS, FAN = 1 << 18, 64
#: Rows up to which ranges or bins are broadcast: numbers of ranges (16 bytes a row), bins (about 1 kB a row).
FEW_TOTALS, FEW_BINS = 1 << 16, FAN**2
#: Elements of vectors whose shuffled orders are kept in a table.
SHORT = 64
#: The partition that a row was dealt to; partitions of an exchange at most.
PART, MOST_TASKS = "__part", 1 << 13


def once(df: DataFrame) -> DataFrame:
    """df computed and kept in the checkpoint folder: for keys that several passes read."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def _below(bounds: Column, key: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < key))


def _few(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _quantiles(key: str, parts: int = FAN) -> Column:
    """The values between so many parts of about as many rows, ascending and each once. Of keys that occur once a part is a fifth too large at most."""
    shares = ", ".join(f"{i / parts}D" for i in range(1, parts))
    return F.array_sort(F.array_distinct(F.expr(f"approx_percentile({_quoted(key)}, array({shares}), {10 * FAN})")))


def _ranged(df: DataFrame, key: str, most: int) -> tuple[DataFrame, int, int]:
    """(df with the range of each key, ascending with it; the number of rows; the number of ranges, at most).

    Null keys come before all others: they have ranges of their own, by a hash of the row. A row is read once
    for each level of ranges, and once more. Bounds are worked out once: two passes over a range never see different ones.
    """
    rows, named = df.agg(F.count(F.lit(1)), F.count(F.col(_quoted(key)))).first()
    place, out, ranges = F.lit(0).cast("bigint"), df, 1
    while named > ranges * most:  # the quantiles of each range of the level above, a row a range
        parts = min(FAN, -(-named // (ranges * most)))
        if ranges == 1:
            bounds = df.agg(_quantiles(key, parts)).first()[0]
            out = df.withColumn("__range", _below(F.expr(_numbers(bounds or [], df.schema[key].dataType.simpleString())), F.col(key)).cast("bigint"))
        else:
            # kept: quantiles depend on the order in which blocks arrive, and every pass must cut the ranges alike
            inner = once(out.where(F.col(key).isNotNull()).groupBy("__range").agg(_quantiles(key, parts).alias("__bounds")))
            out = out.join(_few(inner, ranges <= FEW_BINS), "__range", "left")
            out = out.withColumn("__range", F.col("__range") * parts + _below("__bounds", F.col(key))).drop("__bounds")
        ranges *= parts
    if ranges == 1:
        out = df.withColumn("__range", place)
    if rows == named:
        return out, rows, ranges
    loose = -1 - F.pmod(F.xxhash64(*[F.col(_quoted(c)) for c in df.columns]), F.lit(1 + (rows - named) // most))
    return out.withColumn("__range", F.when(F.col(key).isNull(), loose).otherwise(F.col("__range"))), rows, ranges + 1 + (rows - named) // most


def _numbers(values: list, kind: str = "bigint") -> str:
    """SQL of an array of whole numbers: one expression to parse, not one object for each number."""
    return f"cast(array({', '.join(f'{v}BD' if isinstance(v, Decimal) else f'{v}L' for v in values)}) as array<{kind}>)"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def running_total(df: DataFrame, key: str, value: str, to: str, most: int = ROWS) -> DataFrame:
    """df with the sum of value over all smaller keys and its own (keys whole numbers and unique).

    Rows without a key come before all others, in no order of their own. No row, no result. df is read once for each
    level of ranges and twice more. most: rows that a task sees together, about; 8 at least.
    """
    ranged, rows, ranges = _ranged(df, key, most)
    return _total(ranged, rows, ranges, key, value, to, most)


def _total(ranged: DataFrame, rows: int, ranges: int, key: str, value: str, to: str, most: int) -> DataFrame:
    if rows <= most:  # one range, of most rows at most; null keys come first
        return ranged.withColumn(to, F.sum(value).over(Window.orderBy(F.asc_nulls_first(key)).rowsBetween(Window.unboundedPreceding, 0))).drop("__range")
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    if ranges > most:
        upto = running_total(once(totals.withColumnRenamed("__range", "__inner")), "__inner", "__sum", "__upto", most)
        base = upto.select(F.col("__inner").alias("__range"), (F.col("__upto") - F.col("__sum")).alias("__base"))
    else:
        before = F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        base = totals.select("__range", F.coalesce(before, F.lit(0)).alias("__base"))
    tasks = tasks_for(ranged.sparkSession, rows, most)  # each has its share of the ranges: the session's number of tasks would not grow with the rows
    spread = ranged.withColumn("__task", F.pmod("__range", F.lit(tasks)).cast("int")).repartitionById(tasks, "__task")
    own = F.sum(value).over(Window.partitionBy("__task", "__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    met = spread.withColumn("__own", own).join(_few(base, ranges <= FEW_TOTALS), "__range")
    return met.withColumn(to, F.col("__base") + F.col("__own")).drop("__range", "__task", "__own", "__base")


def row_numbers(df: DataFrame, key: str, to: str = "row_number", most: int = ROWS) -> DataFrame:
    """df with 1 .. n by ascending unique key, rows without a key first."""
    return running_total(df.withColumn("__one", F.lit(1).cast("bigint")), key, "__one", to, most).drop("__one")


def contiguous(df: DataFrame, key: str, slices: int, to: str = "clique_idx", most: int = ROWS) -> DataFrame:
    """df with a slice number: n div k rows each by ascending key, the last one takes the rest; all in the last if n < k."""
    ranged, rows, ranges = _ranged(df.withColumn("__one", F.lit(1).cast("bigint")), key, most)
    each = rows // slices
    number = F.floor((F.col("__rn") - 1) / each) if each else F.lit(slices - 1)
    numbered = _total(ranged, rows, ranges, key, "__one", "__rn", most)
    return numbered.withColumn(to, F.least(number, F.lit(slices - 1)).cast("int")).drop("__rn", "__one")


def last_keys(df: DataFrame, key: str, slice_column: str = "clique_idx") -> DataFrame:
    """The last key of each slice."""
    return df.groupBy(slice_column).agg(F.max(key).alias("last_node"))


def range_starts(counts: DataFrame, key: str, n: str, slices: int) -> DataFrame:
    """(i, start): starts of key-aligned slices of the rows sorted by key, from the rows of each key.

    start_0 = 0; start_i is the first place after 0 where a new key begins at or behind i * (E div slices), else E.
    """
    return range_starts_of(running_total(once(counts), key, n, "__end").select((F.col("__end") - F.col(n)).alias("pos"), F.col(n).alias("n")), slices)


def range_starts_of(placed: DataFrame, slices: int) -> DataFrame:
    """The same from (pos, n) of each key, already summed up."""
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    step, places = total // slices, placed.where("pos > 0")
    # for each place, the largest slice whose start it may be; the least place of this or a later slice is the start
    upto = F.least(F.floor(F.col("pos") / step), F.lit(slices - 1)).cast("int") if step else F.lit(slices - 1)
    able = places.groupBy(upto.alias("i")).agg(F.min("pos").alias("pos"))  # a row a slice at most
    numbers = placed.sparkSession.range(slices).select(F.col("id").cast("int").alias("i"))
    later = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    found = numbers.join(F.broadcast(able), "i", "left").select("i", F.min("pos").over(later).alias("pos"))
    return found.select("i", F.when(F.col("i") == 0, 0).otherwise(F.coalesce("pos", F.lit(total))).cast("bigint").alias("start"))


def slice_cuts(starts: DataFrame, slice_column: str = "clique_idx") -> DataFrame:
    """The last place of each slice that isn't empty, as route() takes it, from the slices' starts (a row a slice)."""
    end = F.coalesce(F.lead("start").over(Window.orderBy("i")), F.lit(2**63 - 1))
    return starts.withColumn("end", end).where("start < end").select(F.col("i").alias(slice_column), (F.col("end") - 1).alias("last_node"))


def slice_ends(placed: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """(clique_idx, last_node): the last key of each slice that isn't empty, from (key, pos) of each key and the slices' starts."""
    keys = placed.select(F.col(key).alias("__key"), "pos")
    return route(keys, slice_cuts(starts), "pos").groupBy("clique_idx").agg(F.max("__key").alias("last_node"))


def dealt(rows: DataFrame, ends: DataFrame, key: str, slices: int, to: str = "slice") -> DataFrame:
    """rows physically dealt to the slices that own their keys, slice i in partition i, sorted by key; ``to`` is the slice.

    The number of the slice is the number of the partition: one exchange, none of samples, and what is grouped by ``to`` later moves no more.
    A key lies in one slice as a whole; null keys are in the first.
    """
    owned = route(rows, ends.withColumnRenamed("clique_idx", to), key, to).withColumn(to, F.coalesce(to, F.lit(0)))
    return owned.repartitionById(slices, to).sortWithinPartitions(key)


def by_slices(rows: DataFrame, key: str, slices: int, to: str = "slice", kept: bool = False, most: int | None = None) -> DataFrame:
    """rows dealt to exact key-aligned slices of about as many rows each (see range_starts); rows are kept on the way, unless they are by now.

    most: rows of a task, about. Slices of more are cut further where keys begin: slice by slice, partitions follow each
    other as their keys do, and PART is a row's partition, of which a slice has one or more. None: a slice is a partition.
    """
    kept = rows if kept else once(rows)
    counts = once(kept.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    placed = once(running_total(counts, key, "n", "__stop").select(key, "n", (F.col("__stop") - F.col("n")).alias("pos")))
    starts = range_starts_of(placed, slices)
    if most is None:
        return dealt(kept, slice_ends(placed, starts, key), key, slices, to)
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finer = slices * max(1, -(-total // (slices * most)))
    cuts = starts.select("start", F.col("i").alias(to)).unionByName(range_starts_of(placed, finer).select("start", F.lit(None).cast("int").alias(to)))
    before = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)  # two rows a part at most
    cuts = once(cuts.groupBy("start").agg(F.max(to).alias(to)).select("start", F.max(to).over(before).alias(to), (F.row_number().over(Window.orderBy("start")) - 1).cast("int").alias("i")))
    parts = cuts.count()
    owned = route(kept, slice_ends(placed, cuts, key).withColumnRenamed("clique_idx", PART), key, PART).withColumn(PART, F.coalesce(PART, F.lit(0)))
    owned = owned.join(_few(cuts.select(F.col("i").alias(PART), to), parts <= FEW_TOTALS), PART)
    return owned.repartitionById(parts, PART).sortWithinPartitions(key)


def by_hash(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows dealt to so many tasks by a hash of their keys; PART is a row's partition, by which what is grouped or joined moves no more."""
    return df.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(tasks)).cast("int")).repartitionById(tasks, PART)


def tasks_for(spark: SparkSession, work: float, each: int) -> int:
    """Tasks that do about ``each`` of the work; where that is few, as many as the session's exchanges have, but for tasks of next to nothing."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(1, -(-int(work) // each), min(usual, -(-int(work) * 16 // each))), MOST_TASKS)


def by_range(df: DataFrame, key: str, slices: int) -> DataFrame:
    """Rows dealt to about equal key ranges, sorted inside; equal keys stay together."""
    return df.repartitionByRange(slices, key).sortWithinPartitions(key)


def route(ids: DataFrame, last: DataFrame, key: str = "node_id", slice_column: str = "clique_idx") -> DataFrame:
    """Each id to the slice that owns it: the one of smallest last key not below the id.

    ``last`` has a row for each slice, however many; of slices with one last key the smallest number counts. An id
    above all last keys, and a null one, has no owner: null. ``last`` is read twice.
    """
    owners = last.where("last_node IS NOT NULL").groupBy("last_node").agg(F.min(slice_column).alias("__owner"))
    n = owners.count()
    bins = row_numbers(owners if n <= ROWS else once(owners), "last_node", "__no").select("last_node", "__owner", F.floor((F.col("__no") - 1) / FAN).alias("__bin"))
    bins = bins.groupBy("__bin").agg(F.array_sort(F.collect_list(F.struct("last_node", "__owner"))).alias("__bounds"))
    tree, count = [bins], -(-n // FAN)
    while count > 1:
        above = tree[-1].select(F.element_at("__bounds", -1)["last_node"].alias("last_node"), "__bin")
        above = above.groupBy(F.floor(F.col("__bin") / FAN).alias("__up")).agg(F.array_sort(F.collect_list(F.struct("last_node", "__bin"))).alias("__bounds"))
        tree.append(above.withColumnRenamed("__up", "__bin"))
        count = -(-count // FAN)
    out = ids.withColumn("__bin", F.lit(0).cast("bigint"))  # from the one bin of the uppermost level down
    for depth, level in enumerate(reversed(tree)):
        few = FAN**depth <= FEW_BINS
        out = out.join(_few(level.withColumnRenamed("__bin", "__b"), few), F.col("__bin") == F.col("__b"), "left")
        found = F.get("__bounds", F.size(F.filter("__bounds", lambda b: b["last_node"] < F.col(key))))
        inner = found["__owner" if depth == len(tree) - 1 else "__bin"]
        out = out.withColumn("__bin", F.when(F.col(key).isNotNull(), inner)).drop("__b", "__bounds")
    return out.withColumn(slice_column, F.col("__bin").cast(last.schema[slice_column].dataType)).drop("__bin")


def inbox(messages: DataFrame, key: str = "node_id", message: str = "message") -> DataFrame:
    """All messages of each receiver as a sorted array, which one task holds; the combined form, where one message is enough, never gathers them."""
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def union(*tables: DataFrame, slice_column: str = "clique_idx") -> DataFrame:
    """All rows of the workers' tables, each with its worker's number; columns are matched by name."""
    numbered = [t.withColumn(slice_column, F.lit(i)) for i, t in enumerate(tables)]
    out = numbered[0]
    for t in numbered[1:]:
        out = out.unionByName(t)
    return out


def shuffled(df: DataFrame, key: str, seed: int, to: str = "position", slices: int | None = None, most: int = ROWS) -> DataFrame:
    """df with a new place 0 .. n-1 for each row: the rows in order of their unique key moved by a permutation that depends on n and seed alone.

    So tables of a size move alike under one seed, whatever their keys and values. Nothing is sorted as a whole: the place
    in key order comes from a scan, the new one from it. slices: deal the rows to that many partitions
    by their new place, ascending from one to the next and inside.
    """
    placed = row_numbers(df, key, "__from", most)
    n = placed.count() if slices else None
    size = F.lit(n) if slices else F.col("__n")
    if not slices:
        placed = placed.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n"))))  # one row
    out = placed.withColumn(to, permuted(F.col("__from") - 1, size, F.lit(seed))).drop("__from", "__n")
    if not slices:
        return out
    return out.repartitionById(slices, F.floor(F.col(to) * slices / max(n, 1)).cast("int")).sortWithinPartitions(to)


def vector_orders(df: DataFrame, vector: str, key: int, to: str = "order") -> DataFrame:
    """df with the order in which keyed_shuffle takes its vectors' elements. Orders of up to SHORT elements are a table of a row a size; longer ones are worked out vector by vector."""
    size = F.size(F.col(_quoted(vector)))
    known = once(df.sparkSession.range(SHORT + 1).select(F.col("id").cast("int").alias("__size"), shuffle_order(F.col("id").cast("int"), F.lit(key)).alias("__order")))
    met = df.join(F.broadcast(known), size == F.col("__size"), "left")
    return met.withColumn(to, F.coalesce("__order", F.when(size > SHORT, shuffle_order(size, F.lit(key))))).drop("__size", "__order")


def with_default(left: DataFrame, right: DataFrame, on: str, column: str, default: Column) -> DataFrame:
    """Every row of left with right's column, the default where right has none (a merge join with gaps filled)."""
    return left.join(right, on, "left").withColumn(column, F.coalesce(F.col(column), default))
