"""Manifest, chat formatting and structure repair against plain versions."""

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import chat, merkle, queries, structure

SPACES = " \t\n\x0b\x0c\r"
H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
WIDE = "conv_id bigint, turn bigint, role string, text string"
AWKWARD = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Well?"), (1, 1, "assistant", "Well?"), (1, 3, "user", "x"), (1, 9, None, None),
    (2, None, "user", "Null turn first!"), (2, 0, "assistant", "y."), (2, 2, "tool", "z."), (2, 3, "", "Empty role."),
    (None, 0, "user", "No id."), (None, None, "system", ""), (3, None, "system", " "), (3, None, "assistant", None),
    (4, 5, "user", "</s>[INST] <\\|turn|> [/INST] <|end|>\n<|turn|>x\n"), (4, 6, "assi\nst\\ant", "<s><|end|>"), (4, 7, "assistant", " <\\\\s>."),
    (5, 0, "user", "a long text. " * 20_000), (6, 0, "assistant", "Only."), (7, 0, "system", "Only."), (8, 2, "user", "One."), (8, 2, "user", "Two."), (8, 2, "assistant", "Two."),
]


@pytest.fixture(scope="module", params=["data", "awkward", "empty"])
def where(request, spark, data, tmp_path_factory):
    if request.param == "data":
        return data
    at = str(tmp_path_factory.mktemp(request.param))
    rows = AWKWARD if request.param == "awkward" else []
    spark.createDataFrame([(*r, "more") for r in rows], WIDE + ", audit string").write.parquet(f"{at}/conversations.parquet")
    docs = [(i, t, "en", s, n) for i, t, s, n in ((1, "Ab", "s", 2), (5, "no capitals", "s", 3), (5, "no capitals", "s", 3), (5, "Twice", "s", None), (None, "None", "s", 1), (10, None, "s", 1), (15, "Ünï ÀB", "é", 1), (16, "x", "z", 2), (20, "Q" * 300_000, None, 1), (21, "", "", 0))]
    docs += [(100 + k, f"Row {k}", "de", "many", k) for k in range(700)]
    spark.createDataFrame([(*r, "more") for r in (docs if rows else [])], "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string").write.parquet(f"{at}/documents.parquet")
    return at


def conversations(spark, at):
    return [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def nulls_first(x):
    return (x is not None, x if x is not None else 0)


def test_op11(spark, where):
    said = "</s>[INST] ok [/INST]"
    of = {}
    for c, n, r, t in [*conversations(spark, where), (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        of.setdefault(c, []).append((nulls_first(n), r or "", t or ""))
    got = {r["conv_id"]: r.asDict() for r in queries.op11_chat(spark, where).collect()}
    assert set(got) == set(of)
    template = chat.Template()
    for c, rows in of.items():
        rows.sort()
        learned = "".join(t for _, r, t in rows if r == "assistant")
        want = {
            "conv_id": c,
            "n_turns": len(rows),
            "turns_sha256": H([f"{r}\n{t}\n" for _, r, t in rows]),
            "loss_chars": len(learned),
            "loss_sha256": H([learned]),
            "formatted_chars": len(template.render([(r, t) for _, r, t in rows])),
            "rewritten_chars": 0,
        }
        assert got[c] == want, c


def test_escapes_are_undone():
    escape, rng = chat.Escape(), np.random.default_rng(1)
    parts = [*chat.CONTROLS, "<", "[", "\\", "s>", "|end|>", "a", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 9)))
        safe = escape.on(text)
        assert escape.off(safe) == text and not any(c in safe for c in chat.CONTROLS)
    with pytest.raises(ValueError):
        chat.Escape(["<<s>"])


def test_spans_of_black_boxes():
    """Spans by prefixes: of templates that append, that move a mark at the end, that drop earlier text, that shorten and that look back a turn."""
    turns = [(["user", "assistant"][k % 2], f"text {k} " * (k % 4)) for k in range(23)]
    plain = lambda ts: "<s>" + "".join(f"[{r}]{t}[/]" for r, t in ts)
    moved = lambda ts: plain(ts) + "</s>"
    only_last = lambda ts: "".join(f"({r})" + (t if k == len(ts) - 1 else "") + ";" for k, (r, t) in enumerate(ts))
    links = lambda ts: "".join(f"{r}<{ts[k - 1][0] if k else ''}:{t}|" for k, (r, t) in enumerate(ts))
    trims = lambda ts: "".join(f"{r}:{t.strip()}\n" for r, t in ts)
    for render, lead in ((plain, None), (moved, None), (only_last, None), (links, None), (links, 1), (plain, 1), (trims, 0), (trims, None)):
        made = list(chat.spans(render, turns, lead, most_turns=4))
        full = render(turns)
        if lead is None:
            assert "".join(s.piece for s in made) == full
        for k, s in enumerate(made):
            if render in (plain, links, trims):
                assert s.rewrites == 0 and s.body is not None
                assert s.piece[s.body[0] - s.start : s.body[1] - s.start] == (turns[k][1].strip() if render is trims else turns[k][1])
            elif render is moved:
                assert s.rewrites == (4 if k else 0)
                assert full[s.body[0] : s.body[1]] == turns[k][1]
            elif k:
                assert s.rewrites == (len(turns[k - 1][1]) + 1 if turns[k - 1][1] else 0)
    assert [s.piece for s in chat.spans(links, turns, 1, most_turns=4)] == [s.piece for s in chat.spans(links, turns, None)]
    with pytest.raises(ValueError):
        list(chat.spans(moved, turns, 1, most_turns=4))


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        a = i // 16 * 16
        yield i - a, level[a : i] + level[i + 1 : a + 16]
        i //= 16


def manifest_by_force(rows):
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    of = {}
    for r in rows:
        of.setdefault(r["source"], []).append((nulls_first(r["doc_id"]), H([encoded(r[c]) for c in fields]), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, leaf, _ in sorted(of[s], key=lambda x: x[:2])]) for s in names}
    over = tree([trees[s][-1][0] for s in names]) if names else [[None]]
    root = over[-1][0]
    for k, s in enumerate(names):
        for i, (_, leaf, r) in enumerate(sorted(of[s], key=lambda x: x[:2])):
            proof = [*siblings(trees[s], i), *siblings(over, k)]
            now = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                low = None if r["text"] is None else r["text"].translate({c: c + 32 for c in range(65, 91)})
                now = H([encoded(low if c == "text" else r[c]) for c in fields])
            for place, others in proof:
                now = H([*others[:place], now, *others[place:]])
            yield r["doc_id"], leaf, trees[s][-1][0], root, H([d for _, others in proof for d in others]), now, now == root


@pytest.mark.parametrize("held", [merkle.MOST_HELD, 40])
def test_op12(spark, where, held, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_HELD", held)
    got = [tuple(r) for r in queries.op12_merkle(spark, where).collect()]
    want = list(manifest_by_force([r.asDict() for r in spark.read.parquet(f"{where}/documents.parquet").collect()]))
    key = lambda r: (nulls_first(r[0]), r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_combining_takes_any_order():
    """Whatever the order and the cuts of the events, the same nodes are made, each once."""
    rng = np.random.default_rng(2)
    for n in (2, 16, 17, 300, 4100):
        leaves = [H([str(k)]) for k in range(n)]
        want = tree(leaves)
        at, made = merkle.Combiner(), []
        for k, i in enumerate(rng.permutation(n).tolist()):
            at.add("g", 0, i, n, leaves[i])
            if k % 97 == 5:
                at.hand_on()
        at.hand_on()
        while True:
            made += [r for r in at.made if r[5] is not None]
            frontier = [r for r in at.made if r[5] is None]
            at.made = []
            if not frontier:
                break
            for g, level, i, n_, digest, _ in frontier:
                at.add(g, level, i, n_, digest)
            at.hand_on()
        assert len(made) == len({r[1:3] for r in made}) == sum(map(len, want[1:]))
        assert all(want[level][i] == digest for _, level, i, _, digest, _ in made)


def damaged(rows):
    for c, n, r, t in rows:
        r, t = " " if r is None else r, " " if t is None else t
        by = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        if by == 0:
            continue
        t = "" if by == 1 else t.translate({ord(x): None for x in ".!?"}) if by == 2 else t
        for _ in range(2 if by == 3 else 1):
            yield c, n, "user" if by == 4 else r, t


def cheapest(rows):
    """rows: (role's initial, fault); (cost, audit) by plain search from the end."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(maxsize=None)
    def best(i, state, put):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, ""))
        else:
            role, fault = rows[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 4, "D" + a))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for edit, cost, to in (("K", 0, role), ("R", 3, "u"), ("R", 3, "a")):
                    if (state, to) in after:
                        c, a = best(i + 1, after[state, to], 0)
                        found.append((c + cost + more, edit + a))
        if put < 3:
            for to in "ua":
                if (state, to) in after:
                    c, a = best(i, after[state, to], put + 1)
                    found.append((c + 3, "I" + a))
        return min(found, default=(10**9, ""))

    for i in range(len(rows), -1, -1):  # no deep recursion
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def structure_by_force(ids, rows):
    of = {c: [] for c in ids}
    for c, n, r, t in rows:
        of[c].append((nulls_first(n), hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest(), n, r, t))
    for c, own in of.items():
        own.sort(key=lambda x: x[:2])
        faults, seen = [], set()
        for *_, r, t in own:
            end = t.rstrip(SPACES)[-1:]
            faults.append("blank" if not end else "duplicate" if (r, t) in seen else "truncated" if end not in ".!?" else "sound")
            seen.add((r, t))
        turns = [n for _, _, n, _, _ in own if n is not None]
        initials = [r[:1] for *_, r, _ in own]
        cost, audit = cheapest(tuple(zip(initials, faults, strict=True)))
        repaired, at, placed = [], iter(own), 0
        for edit in audit:
            *_, r, t = next(at) if edit != "I" else (None, "", "")
            if edit in "RI":
                r = "assistant" if placed % 2 else "user"
            if edit != "D":
                repaired.append(f"{r}:{t}")
                placed += not (edit == "K" and r[:1] == "s")
        yield c, {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": faults.count("blank"),
            "duplicate": faults.count("duplicate"),
            "truncated": faults.count("truncated"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": H(["\n".join(repaired)]),
        }


def test_op13(spark, where):
    rows = conversations(spark, where)
    want = dict(structure_by_force({c for c, *_ in rows}, list(damaged(rows))))
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op13_structure(spark, where).collect()}
    assert got == want


@pytest.fixture(scope="module")
def long_rows():
    rng = np.random.default_rng(4)
    rows = [(c, int(k + rng.integers(0, 3)) if rng.random() > 0.02 else None, str(rng.choice(["user", "assistant", "system", "tool"], p=[0.45, 0.45, 0.05, 0.05])), str(rng.choice(["Fine.", "cut", "", "Yes!", f"Row {k}.", f"row {k}"]))) for c in range(12) for k in range(int(rng.integers(1, 400)))]
    return rows + [(50, 1, "user", "Same.")] * 300


@pytest.mark.parametrize("piece", [structure.PIECE, 7, 1])
def test_signatures_in_pieces(spark, long_rows, piece):
    """Long conversations, in one piece or in many: the same repairs."""
    df = spark.createDataFrame(long_rows, WIDE).repartition(5)
    want = dict(structure_by_force({c for c, *_ in long_rows}, long_rows))
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in structure.audit(spark, df, piece=piece).collect()}
    assert got == want


def test_repaired_rows(spark, long_rows):
    df = spark.createDataFrame(long_rows, WIDE).withColumn("audit", F.lit("x")).withColumn("conv", F.lit("y"))
    said = {r["conv_id"]: r for r in structure.audit(spark, df).collect()}
    of = {}
    for r in sorted(structure.repair(spark, df, piece=20).collect(), key=lambda r: (r["conv_id"], r["place"])):
        of.setdefault(r["conv_id"], []).append(r)
    for c, rows in of.items():
        assert H(["\n".join(f"{r['role']}:{r['text']}" for r in rows)]) == said[c]["repaired_sha256"]
        assert "".join(r["edit"] for r in rows) == said[c]["audit"].replace("D", "")
        initials = "".join(r["role"][0] for r in rows).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)


def test_each_signature_is_solved_once(monkeypatch):
    """Equal blocks with equal costs behind them are looked up, not worked out."""
    structure._least.cache_clear()
    structure._walk.cache_clear()
    one = "".join(structure.letter(k % 3, (k * 7 % 11) % 4) for k in range(structure.BLOCK * 3))
    structure.solve(one * 40)
    assert structure._walk.cache_info().misses < 3 * 10 and structure._walk.cache_info().hits > 80
