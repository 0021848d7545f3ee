"""Repair of conversations' structure: the cheapest edits that make the roles alternate.

A conversation's rows become a string, its signature: a letter for each row says its role's
initial and its first fault. Equal signatures have equal repairs, so each distinct one is solved once
and its audit, the letters of the edits in order, is joined back and replayed on the rows.

Wanted are roles whose initials read ``(s?(ua)+)?``: four states, 0 nothing yet, 1 after s, 2 after u, 3 after a.
The least cost from each row and state to the end is found by recursion over the signature from its end, in
blocks of BLOCK letters memoised under the letters and the costs behind them, which differ little; then the
edits of least text are walked forward over the set of states that they may have led to. A conversation
of more than PIECE rows is cut: the costs through a piece are a matrix, the matrices of a
conversation are folded from its end, its state sets from its beginning, and each piece is
walked on its own. So no task holds a conversation, however long: rows are dealt by
ranges of (conversation, turn), signatures have PIECE letters at most, and the replay streams.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# What an edit costs, and what a truncated row that stays adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows of a piece of a signature; letters of a memoised block; memoised blocks; characters of a batch of results.
PIECE, BLOCK, MEMO, BATCH = 1 << 16, 24, 1 << 16, 1 << 21
#: A cost beyond all others.
NEVER = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
ROLES, FAULTS = "suax", ("sound", "blank", "duplicate", "truncated")
#: State after a role's initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, END = 0, (0, 3)

Costs = tuple[int, int, int, int]


def letter(role: int, fault: int) -> str:
    return chr(ord("A") + 4 * role + fault)


@lru_cache(maxsize=64)
def _meaning(c: str) -> tuple[str, bool, int]:
    """(role's initial, whether the row must go, what it adds if it stays)."""
    role, fault = divmod(ord(c) - ord("A"), 4)
    return ROLES[role], FAULTS[fault] in ("blank", "duplicate"), TRUNCATED if FAULTS[fault] == "truncated" else 0


def _inserting(costs: list[int]) -> Costs:
    """With inserted rows allowed first; more than two in a row never pay."""
    zero, one, two, three = costs
    two, three = min(two, INSERT + three), min(three, INSERT + two)
    return min(zero, INSERT + two), min(one, INSERT + two), two, three


LAST: Costs = _inserting([0 if s in END else NEVER for s in range(4)])


@lru_cache(maxsize=MEMO)
def _least(letters: str, after: Costs) -> Costs:
    """Least costs from each state before the letters, given those behind them."""
    if not letters:
        return after
    then = _least(letters[1:], after)
    role, must_go, adds = _meaning(letters[0])
    out = []
    for state in range(4):
        cost = DELETE + then[state]
        if not must_go:
            for to, s in NEXT[state].items():
                if to == role:
                    cost = min(cost, adds + then[s])
                if to != "s":
                    cost = min(cost, REROLE + adds + then[s])
        out.append(cost)
    return _inserting(out)


@lru_cache(maxsize=MEMO)
def _walk(letters: str, after: Costs, states: frozenset[int], last: bool) -> tuple[str, frozenset[int]]:
    """The edits of least text among the cheapest, from any of the states, and the states they may lead to."""
    out = []
    for i in range(len(letters) + 1):
        here = _least(letters[i:], after)
        left = min(here[s] for s in states)
        states = frozenset(s for s in states if here[s] == left)
        while True:
            if i == len(letters):
                if not last or left == 0:
                    break
            else:
                then = _least(letters[i + 1 :], after)
                role, must_go, adds = _meaning(letters[i])
                gone = frozenset(s for s in states if DELETE + then[s] == left)
                if gone:
                    out.append("D")
                    states = gone
                    break
            put = frozenset(t for s in states for to, t in NEXT[s].items() if to != "s" and INSERT + here[t] == left)
            if put:
                out.append("I")
                states, left = put, left - INSERT
                continue
            kept = frozenset() if must_go else frozenset(NEXT[s][role] for s in states if role in NEXT[s] and adds + then[NEXT[s][role]] == left)
            out.append("K" if kept else "R")
            states = kept or frozenset(t for s in states for to, t in NEXT[s].items() if to != "s" and REROLE + adds + then[t] == left)
            break
    return "".join(out), states


def _relative(costs: Costs) -> tuple[int, Costs]:
    low = min(costs)
    return low, tuple(min(c - low, NEVER) for c in costs)


def _afters(signature: str, after: Costs) -> tuple[list[tuple[str, Costs]], Costs]:
    """(block, relative costs behind it) of a signature's blocks, first to last, and the costs before it."""
    out, sum_, now = [], 0, after
    for at in range((len(signature) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        low, now = _relative(now)
        sum_ += low
        out.append((signature[at : at + BLOCK], now))
        now = _least(*out[-1])
    return out[::-1], tuple(min(c + sum_, NEVER) for c in now)


def solve(signature: str, after: Costs = LAST, states: frozenset[int] = frozenset({START}), last: bool = True) -> tuple[str, int, frozenset[int]]:
    """(audit, cost, the states after it) of a signature, or of a piece that the given costs follow and the given states lead to."""
    blocks, before = _afters(signature, after)
    out = []
    start = min(before[s] for s in states)
    for k, (block, behind) in enumerate(blocks):
        said, states = _walk(block, behind, states, last and k == len(blocks) - 1)
        out.append(said)
    return "".join(out), start - (0 if last else min(after[s] for s in states)), states


def through(signature: str) -> list[int]:
    """Least costs through a piece from state s to state t at 4 s + t, row by row."""
    to = [_afters(signature, tuple(0 if s == t else NEVER for s in range(4)))[1] for t in range(4)]
    return [to[t][s] for s in range(4) for t in range(4)]


def _bits(states: frozenset[int]) -> int:
    return sum(1 << s for s in states)


def _states(bits: int) -> frozenset[int]:
    return frozenset(s for s in range(4) if bits >> s & 1)


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def _digest() -> Column:
    """Equal for rows of equal role and text alone; also what orders rows of one turn."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("h")


def _coded(rows: DataFrame) -> DataFrame:
    """(conv, turn, h, code): code is a letter's number as it is without duplicates."""
    initial, stripped = F.substring("role", 1, 1), F.rtrim(F.col("text"), F.lit(SPACES))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(stripped == "", 1).when(F.substring(stripped, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    rows = rows.select("conv", "turn", _digest(), (4 * role + fault).alias("code"))
    known = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv", "h").agg(F.min(known).alias("first")).select(F.col("conv").alias("c"), F.col("h").alias("hh"), "first")
    met = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("hh")))
    # of rows with the turn of the first the order tells which is the first
    return met.select("conv", "turn", "h", "code", (known > F.col("first")).alias("later"))


_PIECES = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("h", pa.binary()), ("signature", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())])
_PIECES_SQL = "conv bigint, turn bigint, h binary, signature string, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
LEGAL = ("su", "ua", "au")


def _pieces(most: int):
    """Signatures of at most ``most`` letters, with the faults in them, from sorted rows (conv, turn, h, code, later)."""

    def piece(begun: tuple, letters: list[str], turns: list[int]) -> tuple:
        faults = [sum((ord(c) - ord("A")) % 4 == k for c in letters) for k in (1, 2, 3)]
        roles = [_meaning(c)[0] for c in letters]
        illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
        return (*begun, "".join(letters), *(turns[:2] or (None, None)), turns[2] if turns else 0, *faults, illegal)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        letters: list[str] = []
        turns: list[int] = []  # the least, the greatest, the number of different ones
        begun = held = None
        size = 0
        for batch in batches:
            for conv, turn, h, code, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = held is not None and held[0] == conv
                if letters and (not same or len(letters) >= most):
                    out.append(piece(begun, letters, turns))
                    size += len(letters) + 200
                    letters, turns = [], []
                    if size > BATCH:
                        yield _batch(out, _PIECES)
                        out, size = [], 0
                if not letters:
                    begun = (conv, turn, h)
                later = later or (same and held[1:] == (turn, h))
                letters.append(letter(code // 4, 2 if later and code % 4 != 1 else code % 4))
                if turn is not None:
                    turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
                held = (conv, turn, h)
        if letters:
            out.append(piece(begun, letters, turns))
        yield _batch(out, _PIECES)

    return cut


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def signatures(spark: SparkSession, rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv, no, turn, h, signature, ...): the pieces of each conversation's signature, ascending by no, with the turn and digest of
    the first row of each, its least and greatest turn, the number of its different turns, and the faults in it."""
    coded = common.durable(spark, _coded(rows), "coded-turns")
    order = ["conv", "turn", "h"]
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(piece), _PIECES_SQL)
    return common.durable(spark, dealt.withColumn("no", F.monotonically_increasing_id()), "signatures")


def _counts(pieces: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, pieces); pairs of rows and repeated turns across pieces count too."""
    order = Window.partitionBy("conv").orderBy("no")
    role = lambda at: F.substring(F.lit(ROLES), (F.floor((F.ascii(F.substring("signature", at, 1)) - ord("A")) / 4) + 1).cast("int"), F.lit(1))
    ends = pieces.withColumn("one", role(1)).withColumn("other", role(-1))
    met = ends.withColumn("pair", F.concat(F.lag("other").over(order), "one")).withColumn("again", F.col("low") == F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    out = met.groupBy("conv").agg(
        *sums,
        (F.sum("illegal") + F.count_if(~F.col("pair").isin(*LEGAL))).alias("illegal"),
        (F.max("high") - F.min("low") + 1 - F.sum("turns") + F.count_if(F.col("again"))).alias("gaps"),
        F.count(F.lit(1)).alias("pieces"),
    )
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0)))


def _entries(spark: SparkSession, pieces: DataFrame, many: DataFrame) -> DataFrame:
    """(conv, no, a0 .. a3, states, last): what lies behind each piece of the conversations of several pieces, and the states that lead to it."""
    own = pieces.join(many.select(F.col("conv").alias("c")), F.col("conv").eqNullSafe(F.col("c"))).select("conv", "no", "signature")
    own = common.durable(spark, own, "long-signatures")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([through(s) for s in said], pa.list_(pa.int64()))], ["s", "matrix"])

    def behind(group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        after, out = LAST, []
        for m in reversed(group["matrix"].to_pylist()):
            out.append(_relative(after)[1])
            after = tuple(min(min(m[4 * s + t] + after[t] for t in range(4)), NEVER) for s in range(4))
            after = _relative(after)[1]
        last = [False] * (group.num_rows - 1) + [True]
        out = [out[-1 - k] if not last[k] else LAST for k in range(group.num_rows)]
        return pa.table([group["conv"], group["no"], *(pa.array([o[k] for o in out], pa.int64()) for k in range(4)), pa.array(last)], names=["conv", "no", "a0", "a1", "a2", "a3", "last"])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            made = []
            for s, *after, last in zip(*columns, strict=True):
                before = _afters(s, tuple(after))[1]
                fits = [b for b in range(1, 16) if len({before[x] for x in _states(b)}) == 1]
                to = {b: _bits(solve(s, tuple(after), _states(b), last)[2]) for b in fits}
                made.append([to.get(b, 0) for b in range(16)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int32()))], [*batch.schema.names, "to"])

    def entered(group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        states, out = _bits(frozenset({START})), []
        for to in group["to"].to_pylist():
            out.append(states)
            states = to[states]
        return group.drop_columns(["to"]).append_column("states", pa.array(out, pa.int32()))

    through_each = common.durable(spark, own.select(F.col("signature").alias("s")).distinct().mapInArrow(matrices, "s string, matrix array<bigint>"), "matrices")
    after = own.join(through_each, F.col("signature") == F.col("s")).select("conv", "no", "matrix").groupBy("conv").applyInArrow(behind, "conv bigint, no bigint, a0 bigint, a1 bigint, a2 bigint, a3 bigint, last boolean")
    key = ["signature", "a0", "a1", "a2", "a3", "last"]
    known = common.durable(spark, after.withColumnsRenamed({"conv": "c", "no": "n"}).join(own, F.col("c").eqNullSafe(F.col("conv")) & (F.col("n") == F.col("no"))).select("conv", "no", *key), "costs-behind")
    stepped = known.select(*key).distinct().mapInArrow(steps, "signature string, a0 bigint, a1 bigint, a2 bigint, a3 bigint, last boolean, to array<int>")
    stepped = known.join(stepped, key).select("conv", "no", *key[1:], "to")
    return stepped.groupBy("conv").applyInArrow(entered, "conv bigint, no bigint, a0 bigint, a1 bigint, a2 bigint, a3 bigint, last boolean, states int")


def audits(spark: SparkSession, pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(conv, no, turn, h, audit, cost): the edits of each piece and their part of the conversation's cost."""
    key = ["signature", "a0", "a1", "a2", "a3", "last", "states"]
    place = ["conv", "no", "turn", "h"]
    alone = counts.where("pieces = 1").select(F.col("conv").alias("c"))
    whole = [F.lit(c).cast("bigint").alias(f"a{k}") for k, c in enumerate(LAST)]
    asked = pieces.join(alone, F.col("conv").eqNullSafe(F.col("c"))).select(*place, "signature", *whole, F.lit(True).alias("last"), F.lit(_bits(frozenset({START}))).alias("states"))
    many = counts.where("pieces > 1")
    if not many.isEmpty():
        entries = _entries(spark, pieces, many).withColumnsRenamed({"conv": "c", "no": "n"})
        met = pieces.join(entries, F.col("conv").eqNullSafe(F.col("c")) & (F.col("no") == F.col("n")))
        asked = asked.unionByName(met.select(*place, *key))
    asked = common.durable(spark, asked, "asked-signatures")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [solve(s, tuple(after), _states(states), last)[:2] for s, *after, last, states in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], [*batch.schema.names, "audit", "cost"])

    once = asked.select(*key).distinct().mapInArrow(solved, "signature string, a0 bigint, a1 bigint, a2 bigint, a3 bigint, last boolean, states int, audit string, cost bigint")
    return asked.join(once, key).select(*place, "audit", "cost")


class _Replay:
    """One conversation's edits on its rows."""

    def __init__(self) -> None:
        self.edits: deque[Iterator[str]] = deque()
        self.placed = 0  # rows so far that are not the system's first

    def letters(self) -> Iterator[str]:
        while self.edits:
            c = next(self.edits[0], None)
            if c is None:
                self.edits.popleft()
            else:
                yield c

    def _role(self) -> str:
        self.placed += 1
        return "user" if self.placed % 2 else "assistant"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what is put before a row, and of the row."""
        for c in self.letters():
            if c == "I":
                yield c, self._role(), ""
                continue
            if c == "K":
                self.placed += not role.startswith("s")
                yield c, role, text
            elif c == "R":
                yield c, self._role(), text
            return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for c in self.letters():
            yield c, self._role(), ""


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list, Iterator[tuple[str, str, str]], list[str]]]:
    """(conv, what its first row says, its repaired rows, its audit once these are taken) of sorted rows (conv, kind, role, text, audit, *counts)."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held = next(rows, None)
    while held is not None:
        conv, said = held[0], list(held[5:])
        replay, audit = _Replay(), []

        def own() -> Iterator[tuple[str, str, str]]:
            nonlocal held
            held = next(rows, None)
            while held is not None and held[0] == conv:
                _, kind, role, text, edits, *_ = held
                if kind == 1:
                    replay.edits.append(iter(edits))
                    audit.append(edits)
                else:
                    yield from replay.row(role, text)
                held = next(rows, None)
            yield from replay.rest()

        yield conv, said, own(), audit


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repairs(spark: SparkSession, df: DataFrame, of: DataFrame | None, conv_id: str, turn: str, role: str, text: str, piece: int) -> DataFrame:
    """Rows of each conversation in order: its counts, its edits by piece, each before the rows it is for, and its rows."""
    rows = df.select(F.col(f"`{conv_id}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), _text(role).alias("role"), _text(text).alias("text"))
    pieces = signatures(spark, rows, piece)
    counts = common.durable(spark, _counts(pieces), "counts")
    edits = common.durable(spark, audits(spark, pieces, counts), "audits")
    costs = edits.groupBy("conv").agg(F.sum("cost").alias("cost")).withColumnRenamed("conv", "c2")
    said = counts.withColumnRenamed("conv", "c").join(costs, F.col("c").eqNullSafe(F.col("c2")))
    ids = rows.select("conv") if of is None else of.select(F.col(f"`{conv_id}`").cast("bigint").alias("conv"))
    heads = ids.distinct().join(said, F.col("conv").eqNullSafe(F.col("c")), "left")
    none = F.lit(None)
    zeros = [F.lit(0).cast("bigint").alias(c) for c in _COUNTS]
    place = ["conv", "z", "turn", "h", "kind", "no"]
    head = heads.select("conv", F.lit(0).alias("z"), none.cast("bigint").alias("turn"), none.cast("binary").alias("h"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("no"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("string").alias("audit"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _COUNTS])
    edit = edits.select("conv", F.lit(1).alias("z"), "turn", "h", F.lit(1).alias("kind"), "no", none.cast("string").alias("role"), none.cast("string").alias("text"), "audit", *zeros)
    body = rows.select("conv", F.lit(1).alias("z"), "turn", _digest(), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("no"), "role", "text", none.cast("string").alias("audit"), *zeros)
    everything = head.unionByName(edit).unionByName(body)
    return everything.repartition("conv").sortWithinPartitions(*place).select("conv", "kind", "role", "text", "audit", *_COUNTS)


_DONE = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def repair(spark: SparkSession, df: DataFrame, of: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of each repaired conversation in order; place counts from 0, edit is K for a row
    kept, R for one with a new role, I for one put in. Deleted rows are gone; a conversation may end up without rows.

    Rows stand by turn, null turns first, those of one turn by the digest of role and text. Null roles and texts are one space; rows without a
    conv_id are one conversation. A row's first fault counts: blank, duplicate (role and text seen earlier in
    the conversation), truncated (its last character that is no space isn't ``.``, ``!`` or ``?``). Of equally cheap repairs the one whose
    audit comes first as ASCII text is made. An empty table gives no row; other columns are not read; a long text streams
    through one task and a conversation of any length through another, piece by piece. piece: rows of a piece of a signature.
    """
    sql = "conv_id bigint, place bigint, role string, text string, edit string"

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for conv, _, rows, _ in _replayed(batches):
            for place, (edit, r, t) in enumerate(rows):
                out.append((conv, place, r, t, edit))
                chars += len(t) + 100
                if chars > BATCH:
                    yield _batch(out, _TURNS)
                    out, chars = [], 0
        yield _batch(out, _TURNS)

    return _repairs(spark, df, of, conv_id, turn, role, text, piece).mapInArrow(turns, sql)


def audit(spark: SparkSession, df: DataFrame, of: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conversation of df and of
    ``of``, which may name conversations that df has no rows of: these get zeros, no edits and the digest of the empty text.

    gaps: turns missing between the least and the greatest; illegal: neighbours whose roles' initials aren't su, ua or au; both of
    the rows as they are. audit: the letters of all edits in order, D for a row deleted. repaired_sha256: of ``role:text`` of the repaired rows, joined by new lines.
    What repair() says of nulls, ties and long texts holds here too.
    """
    sql = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for conv, said, rows, edits in _replayed(batches):
            digest, first = hashlib.sha256(), True
            for _, r, t in rows:
                digest.update(("" if first else "\n").encode() + f"{r}:{t}".encode())
                first = False
            out.append((conv, *said, "".join(edits), digest.hexdigest()))
            chars += len(out[-1][-2]) + 200
            if chars > BATCH:
                yield _batch(out, _DONE)
                out, chars = [], 0
        yield _batch(out, _DONE)

    return _repairs(spark, df, of, conv_id, turn, role, text, piece).mapInArrow(done, sql)
