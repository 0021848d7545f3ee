"""The stages of the pipeline against plain versions and planted cases."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from ravelin.llm import secrets

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo") for b in ("ra", "te", "su", "no", "di") for c in ("n", "s", "", "l")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def planted(spark):
    passage = prose(99, 60)
    rows = {1: prose(1, 300), 2: prose(2, 300), 3: prose(1, 300), 4: prose(3, 200) + " " + passage + " " + prose(4, 100), 5: passage + "\n" + prose(5, 150)}
    w = rows[2].split()
    w[50] = "changed"
    rows[6] = " ".join(w)  # a near copy of 2
    rows[7] = prose(7, 100) + " password=Zq8kL2mN4pR6 " + prose(8, 20)
    rows[8], rows[9] = None, ""
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or ""), "x") for i, t in rows.items()], SCHEMA), rows


def test_copies_go_and_others_stay(spark, planted, data):
    docs, rows = planted
    kept = pipeline.simhash_near_dedup(spark, docs, data)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5, 7, 8]


def test_passages_go(spark, planted, data):
    docs, rows = planted
    got = {r["doc_id"]: r for r in pipeline.substring_dedup(spark, docs, data).collect()}
    assert got[5]["text"].split() == rows[5].split()[60:] and got[5]["n_chars"] == len(got[5]["text"])
    assert got[3]["text"].strip() == "" and got[8]["text"] is None
    assert all(got[i]["text"] == rows[i] for i in (1, 2, 4, 7, 9))


def test_secrets_are_masked(spark, planted, data):
    docs, rows = planted
    got = {r["doc_id"]: r["text"] for r in pipeline.secret_scans(spark, docs, data).collect()}
    assert got[7] == rows[7].replace("password=Zq8kL2mN4pR6", "[SECRET]")
    assert all(got[i] == rows[i] for i in rows if i != 7)


def test_masks_follow_the_spans(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    spans = {r["doc_id"]: r["secrets"] for r in secrets.find(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in secrets.redact(docs).collect():
        out, at, t = "", 0, texts[r["doc_id"]]
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += t[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["text"] == out + t[at:]


def test_masks_in_odd_texts(spark):
    key = "password=Zq8kL2mN4pR6"
    texts = [key, f"🙂é{key}", f"{key}🙂", f"a {key} b {key}", key + "\n" + key, "🙂 no secret", "", None, f"token={'aZ9+' * 8} x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    want = [t and t.replace(key, "[SECRET]") for t in texts]
    assert [got[i] for i in range(8)] == want[:8] and got[8] == "[SECRET] x"


def test_whole_run(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    pieces = pipeline.run(spark, data).collect()
    kept = {r["doc_id"] for r in pieces}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept for i in labels if labels[i] == 0]) < 0.2
    assert np.mean([i in kept for i in good]) > 0.75  # the others are copies
    fill = {}
    for r in pieces:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in fill.values())
    assert kept <= set(docs)


def test_stages_keep_columns_and_bear_nulls(spark, data):
    rows = [(1, "a b c", "en", None, None), (1, "a b c", "en", None, None), (None, None, None, "s", 3), (None, prose(1, 90), None, None, None), (2, "", None, "s", 0), (3, prose(1, 90), "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ("score", "simhash", "secrets", "base_secrets", "shard", "factors", "g", "key", "id", "w0", "component_id", "ids", "part", "tokens")
    for c in names:
        docs = docs.withColumn(c, docs["text"])
    for held in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, held, data)
            assert out.columns == docs.columns
            assert out.where("not (score <=> simhash)").isEmpty()
            kept = out.count()
            assert kept == 0 if held is not docs else kept >= 3
        pieces = pipeline.STAGES[-1][1](spark, held, data)
        assert pieces.count() >= (6 if held is docs else 0)


def test_whole_run_against_plain_stages(spark, data):
    """All stages by plain loops, but for the learned classifier (what it keeps is taken) and the masks of secrets (held elsewhere)."""
    import re

    from tokenizers import Tokenizer

    from ravelin.llm import queries

    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = pipeline.quality_classifier(spark, docs, data)
    texts = {r["doc_id"]: r["text"] for r in good.select("doc_id", "text").collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def shingles(t):
        w = word.findall(t or "")
        return {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    of = {i: i for i in texts}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(texts)
    for b in ids:
        for a in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                of[max(top(a), top(b))] = min(top(a), top(b))
    kept = [i for i in ids if top(i) == i]
    assert 0 < len(kept) < len(ids) < docs.count()
    k, first, plain = pipeline.PASSAGE_WORDS, {}, {}
    places = {i: [m.span() for m in word.finditer(texts[i] or "")] for i in kept}
    runs = {i: [tuple((texts[i] or "")[s:e] for s, e in places[i][a : a + k]) for a in range(len(places[i]) - k + 1)] for i in kept}
    for i in kept:
        for run in runs[i]:
            first.setdefault(run, i)
    for i in kept:
        t, gone = texts[i], {a + x for a, run in enumerate(runs[i]) if first[run] < i for x in range(k)}
        ends = [s for s, _ in places[i][1:]] + [len(t or "")]
        out, at = "", 0
        for a in sorted(gone):
            out, at = out + t[at : places[i][a][0]], ends[a]
        plain[i] = t if t is None else out + t[at:]
    masked = secrets.redact(spark.createDataFrame(sorted(plain.items()), "doc_id bigint, text string"))
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in masked.collect()}
    got: dict = {}
    for r in sorted(pipeline.run(spark, data).collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and len(r["ids"]) == 4 * r["length"]
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert got == want
