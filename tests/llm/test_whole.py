"""What must be found whatever the size: recall, large groups, true similarity, parts of candidates."""

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import embeddings, simhash


@pytest.mark.parametrize("n", [4000, 100_000, 3_000_000, 80_000_000])
def test_vector_recall_does_not_fall_with_size(spark, monkeypatch, n):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(2000, 64)))
    u = rng.normal(size=x.shape)
    u = unit(u - (u * x).sum(1, keepdims=True) * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * u
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    if n > len(rows):  # tables as for n vectors
        real = embeddings.plan
        monkeypatch.setattr(embeddings, "plan", lambda _, share: real(n, share))
    got = {r["vec_id"]: r for r in embeddings.near(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert max(r["n_links"] for r in got.values()) == 1
    assert np.mean([got[i]["component_id"] == got[i + 2000]["component_id"] == i and got[i]["n_links"] == 1 for i in range(2000)]) >= 0.975


@pytest.mark.parametrize("n", [30_000, 220_000, 12_000_000, 33_000_000])
def test_fingerprints_of_least_similarity_meet_at_any_size(n):
    rng = np.random.default_rng(6)
    share = np.arccos(1.6 / 1.8) / np.pi
    cuts = simhash.plan(n, share)
    assert cuts.shape[1] >= (n - 1).bit_length() - 6 and not (cuts % 64 == 63).any()
    apart = rng.random((4000, 256)) < share
    assert (apart[:, cuts].sum(2) <= 1).any(1).mean() >= 0.98


def groups_of(pairs, n):
    of = list(range(n))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in pairs:
        of[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("chunk", [4096, 30])
def test_hot_values_lose_no_link(spark, monkeypatch, chunk):
    """A chain in which each differs from the one before in 20 bits, and all share the tables' values but for a bit."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    n = 150
    code = np.zeros((n, 256), np.uint8)
    free = np.flatnonzero(np.arange(256) % 64 < 50)[12:]
    for i in range(1, n):
        code[i] = code[i - 1]
        code[i, rng.choice(free, 20, replace=False)] ^= 1
        code[i, 0] = i % 2
    words = np.packbits(code, axis=1, bitorder="little").view(np.int64)
    rows = [(*map(int, w), int(i)) for i, w in zip(rng.permutation(n), words, strict=True)]
    classes = spark.createDataFrame(rows, "w0 bigint, w1 bigint, w2 bigint, w3 bigint, id bigint")
    edges = simhash._candidates(spark, classes, np.arange(12)[None, :], 21).collect()
    assert set(groups_of([(r["a"], r["b"]) for r in edges], n)) == {0}


def test_segments_change_tables_not_links(spark):
    rng = np.random.default_rng(12)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    prints = set(base)
    for x in base:  # far and near ones, and a crowd around one that shares half its bits
        for _ in range(4):
            prints.add(x ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    for _ in range(300):
        prints.add(base[0] ^ sum(1 << int(b) for b in rng.choice(30, int(rng.integers(1, 5)), replace=False)))
    prints = sorted(prints)
    df = spark.createDataFrame([(x,) for x in prints], "simhash bigint")
    want = groups_of([(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints[:i]) if (x ^ y).bit_count() <= 2], len(prints))
    place = {x: i for i, x in enumerate(prints)}
    seen = set()
    for segments, hot in ((1, 32), (2, 32), (2, 3), (3, 4), (4, 10**9)):
        made = simhash.links(df, segments, hot).collect()
        assert all((r["a"] ^ r["b"]).bit_count() <= 2 for r in made)
        assert groups_of([(place[r["a"]], place[r["b"]]) for r in made], len(prints)) == want, (segments, hot)
        seen.add(tuple(sorted(r["v"] for r in simhash.tables(df, segments).collect())))
    assert len(seen) == 4


def test_only_true_similarity_links(spark):
    rng = np.random.default_rng(9)
    texts, sets = [], []
    for i in range(60):  # pairs with from 1 to 15 of 300 words changed: similarity from 0.97 to 0.6
        words = [f"w{i}x{j}" for j in rng.integers(0, 10**6, 300)]
        other = list(words)
        for at in rng.choice(300, 1 + i // 4, replace=False):
            other[at] = "changed" + str(at)
        texts += [words, other]
    dull = ["so", "it", "is", "then"] * 200  # texts that one repeated line dominates
    texts += [dull + [f"a{j}" for j in range(40)], dull + [f"b{j}" for j in range(40)]]
    for w in texts:
        sets.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)})
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, docs).collect()}
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.65 < s < 0.8 for s in alike) > 10
    assert [got[2 * i + 1] == 2 * i for i in range(len(alike))] == [s >= 0.8 for s in alike]


@pytest.mark.parametrize("block", [2000, 9])
def test_large_components_of_candidates_lose_no_link(spark, monkeypatch, block):
    """Copies of one text, a chain that leads away from it and texts alike to none: in one block, or dealt over chunks."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    rng = np.random.default_rng(14)
    base = [f"w{j}" for j in rng.integers(0, 10**6, 250)]
    texts = [base]
    for _ in range(25):
        copy = list(base)
        copy[int(rng.integers(250))] = f"c{rng.integers(10**6)}"
        texts.append(copy)
    for _ in range(25):  # each differs from the one before by few words, from the first by many
        step = list(texts[-1])
        for at in rng.choice(250, 4, replace=False):
            step[at] = f"s{rng.integers(10**6)}"
        texts.append(step)
    for _ in range(12):  # too far from all
        far = list(base)
        for at in rng.choice(250, 11, replace=False):
            far[at] = f"f{rng.integers(10**6)}"
        texts.append(far)
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(i), " ".join(t)) for i, t in zip(order, texts, strict=True)], "doc_id bigint, text string")
    sets = {int(i): {tuple(t[a : a + 5]) for a in range(len(t) - 4)} for i, t in zip(order, texts, strict=True)}
    want = groups_of([(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])], len(sets))
    monkeypatch.setattr(simhash, "plan", lambda n, share: np.arange(250)[None, :1])  # all are candidates of one another
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, docs).collect()}
    assert len(set(want)) > 3 and [got[i] for i in range(len(sets))] == want


def test_spanning_forests():
    from ravelin.llm.components import spanning

    rng = np.random.default_rng(15)
    for n, m in ((1, 0), (50, 30), (50, 200), (2000, 1500)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        root, node = spanning(a, b)
        want = groups_of(list(zip(a.tolist(), b.tolist())), n)
        assert groups_of(list(zip(root.tolist(), node.tolist())), n) == want and len(set(node.tolist())) == len(node)
        assert all(want[y] == x for x, y in zip(root.tolist(), node.tolist()))
    line = np.arange(5000)
    assert set(spanning(line[1:], line[:-1])[0].tolist()) == {0}
