"""Operators that learn or hash, held against plain loops over the same definition."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import embeddings, fingerprints, language, packing, quality, queries, textops

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "the cat sat on the mat and the cat sat on the mat again and again",
    "Größe über çà et là, naïve café 你好 世界",
    "x",
    "",
    None,
    " \n\t ",
    "one two one two one two one two\none two",
    "z" * 5000 + " y " * 70_000,
]


def hash_of(word):
    texts = textops.Texts(pa.array([word]))
    return int(texts.hashes(np.array([0]), np.array([len(word.encode())]))[0])


def test_quality_is_a_plain_average(spark):
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=(1 << quality.BITS, 4)).astype(np.float32), rng.normal(size=(4, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    table, bias = model.weights()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, score string")
    for r in quality.score(docs, model).collect():
        text = TEXTS[r["doc_id"]] or ""
        words = WORD.findall(text)
        rows = [hash_of(w) >> 48 for w in words]
        seen = set()
        for a in range(len(words) - 2):
            gram = tuple(words[a : a + 3])
            rows += [(1 << 16) - 1] * (gram in seen)
            seen.add(gram)
        chars = [32 if c in " \t\n\x0b\x0c\r" else ord(c) for c in text]
        for n in (3, 4):
            for a in range(len(chars) - n + 1):
                gram = chars[a : a + n]
                if 32 not in gram[1:-1]:
                    h = gram[0]
                    for c in gram[1:]:
                        h = (h * 0x01000193 + c) % 2**32
                    h = h * 0x9E3779B1 % 2**32
                    h ^= h >> 15
                    rows.append(h * 0x85EBCA77 % 2**32 >> 16)
        mean = float(np.mean(table[rows].astype(float))) if rows else 0.0
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-mean - bias)), abs=1e-5), r["doc_id"]


def test_quality_learns_from_whole_counts(spark):
    """More than 65,535 of one feature count in full."""
    rows = [(i, ("good word " if i % 2 else "bad thing ") * (70_000 if i < 2 else 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(spark, docs, labels, epochs=20)).collect()}
    assert min(got[i] for i in range(1, 40, 2)) > max(got[i] for i in range(0, 40, 2))


def plain_language(samples, text):
    """(language, score) by searching substrings in the samples."""

    def kinds(t):
        out = ""
        for c in t:
            k = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
            if k != " " or not out.endswith(" "):
                out += k
        return out

    letters = {c for t in samples.values() for c in t.lower() if c.isalpha()}
    known = {name: kinds(t.lower()) for name, t in samples.items()}
    text = "".join(c if c == " " or c in letters else "\0" for c in kinds(text))
    if not text.strip(" "):
        return "und", 0.0
    cost = {}
    for name, sample in sorted(known.items()):
        phrases = 0
        for a in range(0, len(text), language.BLOCK):
            phrases, now = phrases + 1, ""
            for c in text[a : a + language.BLOCK]:
                if now + c in sample:
                    now += c
                else:
                    phrases, now = phrases + 1, c if c in sample else ""
        cost[name] = phrases * math.log2(max(2, len(sample)))
    order = sorted(cost, key=lambda n: (cost[n], n))
    return order[0], 1 - cost[order[0]] / max(cost[order[1]], 1e-9) if len(order) > 1 else 1.0


@pytest.mark.parametrize("letters", ["few", "many"])
def test_language_is_a_plain_parse(spark, letters):
    """Also with scripts of 2000 letters each, most of which have no column, and letters that no language has."""
    rng = np.random.default_rng(3)
    if letters == "few":
        stock = {"a": [f"ab{x}c" for x in "defgh"], "b": [f"ba{x}dé" for x in "defgh"], "c": [f"xyz{x}" for x in "defgh"]}
    else:
        cjk = [chr(0x4E00 + i) for i in range(5000)]
        stock = {"a": cjk[:2000], "b": cjk[1500:3500], "c": cjk[3000:5000]}
    prose = lambda name, n: (" " if letters == "few" else "").join(rng.choice(stock[name], n))
    samples = {name: prose(name, 1500) for name in stock}
    assert letters == "few" or language.learn(samples).rare > 2000
    texts = [prose(name, n) for name in stock for n in (1, 30, 700)] + ["ж" * 5 + prose("a", 40), "12 34", "", None, "Q" + prose("b", 9) + " ߷ß"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in language.predict(spark, docs, language.learn(samples)).collect():
        want = plain_language(samples, texts[r["doc_id"]] or "")
        assert (r["lang_pred"], pytest.approx(r["score"], abs=1e-9)) == want, (r["doc_id"], want)


def test_language_samples_are_whole_documents(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["aa", "bc", "dd"], int(rng.integers(1, 900)))), f"l{i % 3}") for i in range(600)] + [(1001, "w" * 50_000, "only-long"), (1002, "v" * 60_000, "only-long"), (1003, None, "l1"), (1004, "free", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = {}
    monkeypatch.setattr(language, "learn", lambda samples: seen.update(samples))
    language.fit(spark, docs)
    texts = {lang: {t for _, t, own in rows if own == lang and t} for lang in ("l0", "l1", "l2", "only-long")}
    assert set(seen) == set(texts)
    stretches = seen.pop("only-long").split()  # longer than the whole sample may be: parts of one text, from its beginning to its end
    assert len(stretches) == language.STRETCHES and len({x[0] for x in stretches}) == 1 and 23_000 < sum(map(len, stretches)) <= 24_000
    for lang, sample in seen.items():
        rest, used = sample, 0
        while rest:
            t = max((t for t in texts[lang] if rest[1:] == t or rest[1:].startswith(t + " ")), key=len)
            rest, used = rest[1 + len(t) :], used + 1
        assert used >= 4 and len(sample) <= 24_000 + 64


def test_fingerprints_are_plain_sets(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    texts = [*TEXTS[:7], " ".join(rng.choice(words, 3)), " ".join(rng.choice(words, 40)), " ".join(rng.choice(words, 900)), " ".join(["so", "it", "is"] * 300), " ".join(rng.choice(words, 2000))]
    texts += [texts[-1] + " and more", texts[8]]
    rows = dict(enumerate(texts))

    def sketch(text):
        w = WORD.findall(text)
        grams = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        hashes = set()
        for g in grams:
            hashes.add(int(textops.shingles(np.array([hash_of(x) for x in g], np.uint64), len(g))[0]))
        return {h for h in hashes if h <= 2**62} or set(sorted(hashes)[:1])

    def like(a, b):
        if a == b:
            return 1.0
        a, b = {h for h in a if h <= 2**62}, {h for h in b if h <= 2**62}
        return len(a & b) / min(len(a), len(b)) if a and b else 0.0

    docs = spark.createDataFrame([(i, t) for i, t in rows.items()], "doc_id bigint, text string")
    order = sorted(rows, reverse=True)
    for r in fingerprints.compare_with_next(spark, docs).collect():
        at = order.index(r["doc_id"])
        text, after = rows[r["doc_id"]] or "", rows[order[(at + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert r["fingerprint"] == "".join(f"{h:016x}" for h in sorted(sketch(text)))
        assert r["edited_fingerprint"] == "".join(f"{h:016x}" for h in sorted(sketch(edited)))
        assert r["near_edited"] == pytest.approx(like(sketch(text), sketch(edited)))
        assert r["near_next"] == pytest.approx(like(sketch(text), sketch(after)))
    short = {t: set() for t in map(lambda t: " ".join(WORD.findall(t or "")), texts) if len(t.split()) < 130}
    for r in fingerprints.compare_with_next(spark, docs).collect():
        plain = " ".join(WORD.findall(rows[r["doc_id"]] or ""))
        if plain in short:
            short[plain].add(r["fingerprint"])
    assert all(len(x) == 1 for x in short.values()) and len(set.union(*short.values())) == len(short)


def test_merged_sketches_are_those_of_the_union():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    for sizes in ((10, 20), (100, 90), (30, 3000), (2000, 3000)):
        parts = [" ".join(rng.choice(words, n)) for n in sizes]
        made = fingerprints.sketches(textops.Texts(pa.array(parts)))
        union = fingerprints.merge(*made)
        whole = [fingerprints.sketches(textops.Texts(pa.array([p])), fraction=1)[0] for p in parts]
        want = np.unique(np.concatenate(whole))
        want = want[want <= np.uint64(2**62)]
        assert np.array_equal(union, want) and np.array_equal(fingerprints.from_text(fingerprints.as_text(union)), union)
        assert fingerprints.containment(made[0], union) == 1.0


def test_languages_of_one_giant_text(spark):
    """Of a language with a single text of 5 million characters the driver gets a bounded part, from all over it."""
    rng = np.random.default_rng(13)
    stock = {"aa": ["toki", "pona", "jan", "suli", "kama"], "bb": ["ghrx", "vlod", "zemn", "krtek", "smrt"], "cc": ["lumea", "noua", "este", "mare", "azi"]}
    giant = {k: " ".join(rng.choice(v, 900_000)) + f" end{k}" for k, v in stock.items()}
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(ids[k], giant[lang], lang) for k, lang in enumerate(giant)], "doc_id bigint, text string, lang string")
    model = language.fit(spark, docs)
    assert model.languages and all(len(giant[lang]) > 4_000_000 for lang in giant)
    texts = [(lang, " ".join(rng.choice(v, 12))) for lang, v in stock.items() for _ in range(5)]
    asked = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id bigint, text string")
    assert [r["lang_pred"] for r in sorted(language.predict(spark, asked, model).collect(), key=lambda r: r["doc_id"])] == [lang for lang, _ in texts]
    assert model.table.nbytes < 64 << 20


def test_small_sketches_against_plain_sets():
    """All pairs of small sets of hashes, low and high ones: of what lies below the fraction the likeness is that of sets."""
    low, high = [5, 6, 7], [2**63, 2**63 + 1]
    sets = [[x for k, x in enumerate(low + high) if bits >> k & 1] for bits in range(32)]
    kept = [sorted(x for x in s if x in low) or s[:1] for s in sets]
    for a, x in zip(kept, sets, strict=True):
        for b in kept:
            p, q = (np.array(v, np.uint64) for v in (a, b))
            m, n = set(a) & set(low), set(b) & set(low)
            want = (len(m & n) / len(m | n), len(m & n) / min(len(m), len(n))) if m and n else (1.0, 1.0) if a == b else (0.0, 0.0)
            assert (fingerprints.resemblance(p, q), fingerprints.containment(p, q)) == want, (x, a, b)
            union = fingerprints.merge(p, q).tolist()
            assert union == (sorted(m | n) or sorted({*a, *b})[:1])


def test_rows_without_ids_stand_in_ranges(spark, monkeypatch):
    """Many rows without an id: each is compared with one other, in descending order of their texts within a range, and none is lost."""
    real = fingerprints.common.in_ranges
    monkeypatch.setattr(fingerprints.common, "in_ranges", lambda *a, **b: real(*a, **b, least=3000, most=3000))
    texts = [f"row {k} " + "of many words " * 10 for k in range(300)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(k, f"with id {k} " * 30) for k in range(40)], "doc_id bigint, text string").repartition(4)
    got = fingerprints.compare_with_next(spark, df).collect()
    assert len(got) == 340 and sum(r["doc_id"] is None for r in got) == 300
    by_id = {r["doc_id"]: r["edited_sha256"] for r in got if r["doc_id"] is not None}
    for k in range(1, 40):
        t, after = f"with id {k} " * 30, f"with id {k - 1} " * 30
        half = len(t) // 2
        assert by_id[k] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_vectors_of_every_length_link(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(20)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(4)] + [(200, [1.0, 2.0, 3.0, 4.001]), (201, [5.0]), (202, [2.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.QUERIES["op7_embeddings"](spark, str(tmp_path)).collect()}
    assert all(got[100 + i] == (4, 100, i == 0) for i in range(4)) and got[200] == (4, 100, False)
    assert got[201] == (1, 201, True) and got[202] == (1, 201, False) and got[None] == (0, None, True) and len(got) == len(rows)


@pytest.mark.parametrize("dim,n", [(16, 100_000), (128, 70_000), (384, 3_000_000)])
def test_vector_recall_at_other_lengths(dim, n):
    """Pairs at the least cosine meet in the tables of n vectors, on vectors without a common mean."""
    rng = np.random.default_rng(10)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(3000, dim)))
    u = rng.normal(size=x.shape)
    u = unit(u - (u * x).sum(1, keepdims=True) * x)
    model = embeddings.learn(x)
    cuts = embeddings.plan(n, model.share(0.95))
    apart = model.codes(x)[0] ^ model.codes(0.951 * x + np.sqrt(1 - 0.951**2) * u)[0]
    assert (apart[:, cuts].sum(2) <= 1).any(1).mean() >= 0.95


def test_packing_keeps_to_the_mix(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "sea"], 60)), ("a", "b", "c")[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    path = queries.vocabulary("byte_bpe_50k.json")
    for mix in (None, {"a": 6, "b": 3, "c": 1}):
        made = packing.pack(spark, docs, path, mix=mix).collect()
        share = {s: (mix or {"a": 1, "b": 1, "c": 1})[s] for s in "abc"}
        total, fill = {}, {}
        for r in made:
            total[r["source"]] = total.get(r["source"], 0) + r["length"]
            own = fill.setdefault(r["sequence_id"], {})
            own[r["source"]] = own.get(r["source"], 0) + r["length"]
        last = min(total[s] / share[s] for s in total) * sum(share.values()) / 1024  # until a queue is empty
        windows = [fill[k] for k in sorted(fill) if k < last - 1]
        assert len(windows) > 10
        so_far = dict.fromkeys("abc", 0)
        for k, own in enumerate(windows, 1):  # carried deficits stay below a window
            for s in "abc":
                so_far[s] += own.get(s, 0)
                assert abs(so_far[s] - 1024 * k * share[s] / sum(share.values())) < 1024, (k, s)
    monkeypatch.setattr(packing, "MOST_QUEUES", 2)  # more sources than queues
    many = spark.createDataFrame([(i, "word " * (i % 7), f"s{i % 50}" if i % 9 else None) for i in range(300)], "doc_id bigint, text string, source string")
    made = packing.pack(spark, many, path).collect()
    end = {}
    for r in sorted(made, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == end.get(r["doc_id"], 0)
        end[r["doc_id"]] = r["start"] + r["length"]
    assert len(end) == 300 and all(r["doc_tokens"] == end[r["doc_id"]] for r in made)
    fill = {}
    for r in made:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fill.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(places), sorted(places)[1:]))


def test_rows_without_ids_are_spread(spark):
    """A third of the rows, or all, without an id: several ranges, every row comes back, none is a reference."""
    from ravelin.llm import common, substrings

    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(None if i % 3 else i, text + f" {i % 2}") for i in range(120)], "doc_id bigint, text string")
    dealt, size, ranges = common.in_ranges(spark, df, "doc_id", "text", least=20_000, most=20_000, spread=True)
    assert size > 0 and len({r["__shard"] for r in dealt.where("doc_id is null").select("__shard").collect()}) > 2
    assert dealt.where(f"(doc_id is null) <> (__shard >= {ranges})").isEmpty()
    got = substrings.remove(spark, df.where("doc_id is null or doc_id < 0"), give=("n_removed",)).collect()
    assert len(got) == 80 and all(r["n_removed"] == 0 for r in got)
