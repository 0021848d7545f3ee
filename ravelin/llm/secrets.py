"""Secrets in texts, by DataFrame functions alone.

Three base kinds are found by pattern: assignments to a password-like name, access keys and
lower-case hexadecimal runs. Beside them, candidate strings (long runs of key characters
with a digit) are read through a sliding window whose Shannon entropy is kept by
incremental counts: a character that enters or leaves changes one term of
sum(c * log2(c)). Windows above the threshold of the candidate's character class are
joined into spans; candidates on the allow-list, and spans within a base one, are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds (A-Z and a-z in either case for names only).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A run of key characters with a digit in it.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy in bits a character of a window, by character class.
THRESHOLDS = {r"^[0-9a-fA-F]+$": 2.9, r"^[A-Za-z0-9]+$": 3.6, r"": 3.9}
#: Candidates that are no secrets: numbers, UUIDs, paths and sample keys.
ALLOWED = r"^[0-9_=+/-]+$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^/?(?:[A-Za-z_-]+[0-9]{0,4}/){2,}(?:[A-Za-z_-]+[0-9]{0,4})?$|EXAMPLE|[Ee]xample|[Pp]laceholder|0123456789|1234567890|^[A-Za-z_-]+[0-9]{1,4}$"


_SPAN = "array<struct<start:bigint,end:bigint>>"


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once: inside a lambda function an outer expression is worked out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    """(start, end, match) of all matches, leftmost first, in code points: what lies between them is split off and measured.

    The running place is summed up over blocks of about the root of the matches, so that no long array grows match by match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match")), lambda p: F.struct(F.char_length(p["gap"]).cast("bigint").alias("gap"), F.char_length(p["match"]).cast("bigint").alias("n"), p["match"].alias("match")))

    def blocks(pairs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(pairs).cast("double"))).cast("int"), F.lit(1))
        starts = F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.size(pairs), size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.slice(pairs, at, size))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda n, p: n + p["gap"] + p["n"]))
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("bases"))
        bases = F.aggregate(sums, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")), lambda acc: acc["bases"])
        return F.flatten(F.zip_with(blocks, bases, within))

    def within(block: Column, base: Column) -> Column:
        none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

        def step(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + pair["gap"]
            end = begin + pair["n"]
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match")))).alias("spans"))

        return F.aggregate(block, F.struct(base.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    return _let(pairs, lambda p: _let(blocks(p), placed))


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


#: First of the characters that are counted (the ASCII codes of key characters, + to z), five bits a count, twelve counts a number.
_FIRST, _EACH, _NUMBERS = 43, 12, 7


def _windows(s: Column, threshold: Column) -> Column:
    """(start, end) in s of the joined windows whose entropy reaches the threshold.

    The counts of a window are kept as seven numbers; a step takes the leaving character off and adds the entering one,
    and with them a term each of the sum of c * log2(c).
    """
    term = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]
    gain = F.array(*[F.lit(b - a) for a, b in zip(term[:-1], term[1:], strict=True)])  # of one more of a character
    none = F.lit(0).cast("bigint")

    def place(c: Column) -> Column:
        shift = (c % _EACH * 5).cast("int")
        return F.struct(F.floor(c / _EACH).cast("int").alias("k"), shift.alias("by"), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift).alias("one"))

    chars = F.transform(F.split(s, ""), lambda c: place(F.ascii(c) - _FIRST))
    blank = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("by"), none.alias("one"))
    both = lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(blank, WINDOW), c), F.lit(1), F.size(c)), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    zero = F.struct(F.array_repeat(none, _NUMBERS).alias("counts"), F.lit(0.0).alias("sum"), none.alias("i"), F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"), F.array().cast(_SPAN).alias("spans"))

    def of(counts: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, c["k"]), c["by"]).bitwiseAND(F.lit(31)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        # the one that enters, beside the others that stay, and the one that leaves
        enters = F.get(gain, of(acc["counts"], new))
        leaves = F.when(old["k"] >= 0, F.get(gain, of(acc["counts"], old) - 1)).otherwise(0.0)
        total = F.when((new["k"] == old["k"]) & (new["by"] == old["by"]), acc["sum"]).otherwise(acc["sum"] + enters - leaves)
        return _let(total, lambda total: met(acc, x, total))

    def met(acc: Column, x: Column, total: Column) -> Column:
        new, old = x["new"], x["old"]
        counts = F.transform(acc["counts"], lambda n, k: n + F.when(k == new["k"], new["one"]).otherwise(none) - F.when(k == old["k"], old["one"]).otherwise(none))
        end = acc["i"] + 1
        begin = end - WINDOW
        hit = (begin >= 0) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= threshold - 1e-9)
        joined = hit & (begin <= acc["end"])
        close = hit & (begin > acc["end"]) & (acc["end"] >= 0)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            end.alias("i"),
            F.when(joined, acc["start"]).when(hit, begin).otherwise(acc["start"]).alias("start"),
            F.when(hit, end).otherwise(acc["end"]).alias("end"),
            F.when(close, F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        )

    def last(acc: Column) -> Column:
        return F.when(acc["end"] >= 0, F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["spans"])

    return F.aggregate(_let(chars, both), zero, step, last)


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``secrets`` array<struct<start, kind, end>>, by start and kind, and ``base_secrets`` (kinds 0-2 only).

    Places are code points, end exclusive; kind is an index of KINDS. The work on a candidate grows with its length. Null and empty texts
    have none, an empty table gives no row. Columns of these names are replaced, all others and repeated rows stay. Only
    texts that hold a match at all are taken apart; texts are read whole.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    held = {"__assign": ASSIGN, "__access": ACCESS, "__hex": HEX, "__candidate": CANDIDATE}
    out = df.drop("secrets", "base_secrets", *held)
    kept = out.columns
    out = out.select("*", *[F.when(t.rlike(p), t).otherwise("").alias(c) for c, p in held.items()])
    values = F.transform(F.regexp_extract_all(F.col("__assign"), F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v))
    assign = F.zip_with(_found(F.col("__assign"), ASSIGN), values, lambda s, n: F.struct(s["start"].alias("start"), F.when(n >= 12, s["end"]).otherwise(-1).alias("end")))
    assign = F.filter(assign, lambda s: s["end"] >= 0)
    base = F.concat(_kind(assign, 0), _kind(_found(F.col("__access"), ACCESS), 1), _kind(_found(F.col("__hex"), HEX), 2))
    out = out.select(*kept, "__candidate", F.array_sort(base).alias("base_secrets"))

    def of(match: Column) -> Column:
        bits = F.lit(THRESHOLDS[""])
        for pattern in list(THRESHOLDS)[-2::-1]:
            bits = F.when(match.rlike(pattern), F.lit(THRESHOLDS[pattern])).otherwise(bits)
        return F.when(match.rlike(ALLOWED), F.array().cast(_SPAN)).otherwise(_let(bits, lambda bits: _windows(match, bits)))

    candidates = _found(F.col("__candidate"), CANDIDATE)
    hits = F.flatten(F.transform(candidates, lambda c: F.transform(of(c["match"]), lambda w: F.struct((c["start"] + w["start"]).alias("start"), F.lit(3).alias("kind"), (c["start"] + w["end"]).alias("end")))))
    # both by start, base ones first: a hit that ends no later than a base one before it lies within that
    mark = lambda spans, hit: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(hit).alias("hit"), x["end"].alias("end")))
    zero = F.struct(F.lit(-1).cast("bigint").alias("top"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))
        return F.struct(F.when(x["hit"] == 0, F.greatest(acc["top"], x["end"])).otherwise(acc["top"]).alias("top"), F.when((x["hit"] == 1) & (x["end"] > acc["top"]), F.concat(acc["kept"], F.array(span))).otherwise(acc["kept"]).alias("kept"))

    new = F.aggregate(F.array_sort(F.concat(mark(F.col("base_secrets"), 0), mark(hits, 1))), zero, step, lambda acc: acc["kept"])
    return out.select(*kept, "base_secrets", F.array_sort(F.concat("base_secrets", new)).alias("secrets"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of secrets in the text replaced by the mark, overlapping ones by one mark. Texts without a secret, null ones among them, stay as they are."""
    found = find(df.select(F.col(text).alias("__text"), F.struct(*df.columns).alias("__row")), "__text")
    t = F.col("__text")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("gaps"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end")))
        fresh = (s["start"] >= acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    def kept(chars: Column, begin: Column, length: Column) -> Column:
        return F.array_join(F.slice(chars, (begin + 1).cast("int"), length.cast("int")), "")

    def joined(chars: Column, acc: Column) -> Column:
        gaps = F.transform(acc["gaps"], lambda g: F.concat(kept(chars, g["start"], g["end"] - g["start"]), F.lit(mark)))
        return F.concat(F.array_join(gaps, ""), kept(chars, acc["at"], F.size(chars) - acc["at"]))

    whole = _let(F.aggregate(F.col("secrets"), zero, step), lambda acc: _let(F.split(t, ""), lambda chars: joined(chars, acc)))
    return found.select(*[F.when(F.size("secrets") > 0, whole).otherwise(t).alias(c) if c == text else F.col("__row")[c].alias(c) for c in df.columns])
