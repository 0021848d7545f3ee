"""Vector primitives as Column -> Column, all inside the JVM. Indices are 0-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iota(n: Column) -> Column:
    """0 .. n-1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fill(value: Column, n: Column) -> Column:
    return F.array_repeat(value, n.cast("int"))


def cut(v: Column, begin: Column, end: Column) -> Column:
    """The half-open slice begin .. end."""
    return F.slice(v, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda function works an outer expression out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gather(v: Column, source: Column) -> Column:
    """v[source[i]]; null where the index is out of range."""
    return let(v, lambda v: F.transform(source, lambda i: F.get(v, i)))


def scatter(v: Column, base: Column, source: Column, target: Column) -> Column:
    """base with base[target[i]] = v[source[i]]. Sizes must agree; a target named twice is an error, one out of range is left out.

    Old and new elements are sorted by place, and of each place the last one is taken.
    """
    fits = F.when(F.size(source) != F.size(target), F.raise_error(F.lit("source and target differ in size")))
    fits = fits.when(F.size(F.array_distinct(target)) != F.size(target), F.raise_error(F.lit("a target is named twice"))).otherwise(target)

    def placed(base: Column) -> Column:
        old = F.transform(base, lambda x, i: F.struct(i.alias("at"), F.lit(0).alias("new"), x.alias("x")))
        new = F.zip_with(fits, gather(v, source), lambda i, x: F.struct(i.cast("int").alias("at"), F.lit(1).alias("new"), x.alias("x")))
        inside = F.filter(new, lambda x: (x["at"] >= 0) & (x["at"] < F.size(base)))
        return F.array_sort(F.concat(old, inside))

    def last(all_: Column) -> Column:
        after = F.slice(all_, F.lit(2), F.size(all_))
        pairs = F.zip_with(all_, after, lambda x, y: F.struct(x.alias("x"), y["at"].alias("next")))
        return F.transform(F.filter(pairs, lambda p: p["next"].isNull() | (p["next"] != p["x"]["at"])), lambda p: p["x"]["x"])

    return let(base, lambda base: F.when(base.isNotNull(), let(placed(base), last)))


def count_bits(bits: Column, starts: Column, ends: Column) -> Column:
    """True values in each half-open range."""
    pairs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    return let(bits, lambda bits: F.transform(pairs, lambda r: F.size(F.filter(cut(bits, r["s"], r["e"]), lambda b: b)).cast("bigint")))


def argsort(v: Column) -> Column:
    """Indices in ascending order of value, ties by index."""
    return F.transform(F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def permute(v: Column, order: Column) -> Column:
    """One public permutation applied to a vector; use the same order for several."""
    return gather(v, order)


#: Fixed values of keyed permutations: the prime of their arithmetic, and of each half-round a multiplier of the key, a summand and a multiplier.
PRIME = 2**31 - 1
ROUNDS = [(pow(7, 3 * k + 1, PRIME), pow(7, 3 * k + 2, PRIME), pow(7, 3 * k + 3, PRIME)) for k in range(8)]
#: Times that a place outside the domain is mixed again; it lies outside again in less than half of all cases, and in few of large domains.
WALK = 64


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Where place i of 0 .. n-1 goes: a permutation that depends on n and key alone, worked out for each place by itself.

    A Feistel network over pairs (l, r) of a rectangle of about sqrt(n) by sqrt(n); its half-rounds add a squared and
    multiplied half to the other. A place that falls outside n is mixed again until it falls inside. It scatters; it hides nothing.
    """
    i, n, key = (c.cast("bigint") for c in (i, n, key))
    key = F.pmod(key, F.lit(PRIME))
    constants = F.array(*[F.struct(*[F.lit(c).cast("bigint").alias(name) for c, name in zip(r, "abc", strict=True)]) for r in ROUNDS])

    def mixed(x: Column, rows: Column, columns: Column) -> Column:
        half = F.struct(F.call_function("div", x, columns).alias("l"), (x % columns).alias("r"))

        def half_round(s: Column, k: Column) -> Column:
            c = F.get(constants, k)
            t = (s["r"] + (key * c["a"] + c["b"]) % PRIME) % PRIME
            added = s["l"] + t * t % PRIME * c["c"] % PRIME
            return F.struct(s["r"].alias("l"), (added % F.when(k % 2 == 0, rows).otherwise(columns)).alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(ROUNDS) - 1)), half, half_round, lambda s: s["l"] * columns + s["r"])

    def walked(rows: Column) -> Column:
        columns = F.call_function("div", n + rows - 1, rows)
        again = lambda x, _: F.when(x < n, x).otherwise(mixed(x, rows, columns))
        inside = lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a place left its domain")))
        walk = lambda x: F.when(x < n, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, again, inside))  # noqa: E731  most places need no step of it
        return let(mixed(i, rows, columns), walk)

    return let(F.floor(F.sqrt(n)).cast("bigint") + 1, walked)


def shuffle_order(n: Column, key: Column) -> Column:
    """Which place of 0 .. n-1 comes first, second and so on, under a key: what depends on size and key alone is worked out once for all vectors that move by it."""
    placed = F.transform(iota(n), lambda i: F.struct(permuted(i, n, key).alias("at"), i.alias("i")))
    return F.transform(F.array_sort(placed), lambda s: s["i"])


def keyed_shuffle(v: Column, key: Column) -> Column:
    """A permutation that depends only on key and size: equal keys move vectors of a size alike."""
    return let(v, lambda v: F.when(v.isNotNull(), gather(v, shuffle_order(F.size(v), key))))


def pad(v: Column, filler: Column, length: int) -> Column:
    return F.concat(v, F.array_repeat(filler, F.greatest(F.lit(length) - F.size(v), F.lit(0))))


def run_starts(v: Column) -> Column:
    """Where a value differs from the one before it; the first is always a start."""
    return let(v, lambda v: F.filter(iota(F.size(v)), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1))))


def _ends(starts: Column, n: Column) -> Column:
    return F.when(n > 0, F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))).otherwise(F.array().cast("array<int>"))


def run_ends(v: Column) -> Column:
    return let(v, lambda v: let(run_starts(v), lambda starts: _ends(starts, F.size(v))))


def run_lengths(v: Column) -> Column:
    """[(value, length)] of the runs."""
    pairs = lambda v, starts: F.zip_with(starts, _ends(starts, F.size(v)), lambda s, e: F.struct(F.get(v, s).alias("value"), (e - s).cast("bigint").alias("length")))
    return let(v, lambda v: let(run_starts(v), lambda starts: pairs(v, starts)))


def unfold(flat: Column) -> Column:
    """[a, b, c, d] as [(a, b), (c, d)]."""
    return let(flat, lambda flat: F.transform(iota(F.floor(F.size(flat) / 2).cast("int")), lambda i: F.struct(F.get(flat, 2 * i).alias("term"), F.get(flat, 2 * i + 1).alias("cnt"))))


def fold(pairs: Column) -> Column:
    """[(a, b), (c, d)] as [a, b, c, d]."""
    return F.flatten(F.transform(pairs, lambda p: F.array(p["term"], p["cnt"])))
