"""Toxicity, quality and language: accuracy on rows that were not learned from, and odd rows."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import language, quality, toxicity
from weftline.llm.labelled import fold, logistic
from weftline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")}


def held_out(spark, tables, name, label):
    rows = QUERIES[name](spark, FOLDER).where("held_out").join(tables["labels"], "doc_id").select("score", "predicted", label).collect()
    assert all(0 <= r[0] <= 1 for r in rows) and len(rows) > 100
    return rows


def test_toxicity_held_out(spark, tables):
    rows = held_out(spark, tables, "op4_toxic_segments", "toxic")
    toxic = [r for r in rows if r[2] == 1]
    assert sum(r[1] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r[1] for r in rows if r[2] == 0) <= 0.01 * len(rows)


def test_quality_held_out(spark, tables):
    rows = held_out(spark, tables, "op10_naive_bayes_support_vectors", "quality")
    assert sum(r[1] == r[2] for r in rows) >= 0.97 * len(rows)


def test_language_held_out(spark, tables):
    rows = QUERIES["op6_ppm_language"](spark, FOLDER).where("held_out").join(tables["documents"], "doc_id").select("lang_pred", "lang").collect()
    assert sum(r[0] == r[1] for r in rows) >= 0.99 * len(rows)


def test_odd_rows(spark, tables):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (3, "12 34 !!", 0), (None, "the idiot clown " * 3000, 0), (4, "é", 0)], "doc_id bigint, text string, score int")
    own = tables["documents"], tables["labels"]
    tox = toxicity.train_toxicity(*own, fold("doc_id", 5) != 0)
    qual = quality.train_quality(*own, fold("doc_id", 4) != 2)
    lang = language.train_language(own[0], fold("doc_id", 3) != 1)
    for out in (toxicity.score_toxicity(docs, tox), quality.score_quality(docs, qual), language.predict_language(docs, lang)):
        rows = out.collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["lang_pred"] for r in language.predict_language(docs, lang).where("doc_id < 4").collect()] == ["und"] * 4
    assert toxicity.score_toxicity(docs, tox).where("doc_id is null").first()["score"] > 0.5
    none = docs.limit(0)
    empty = own[1].limit(0)
    assert toxicity.score_toxicity(none, tox).collect() == [] and quality.score_quality(none, qual).collect() == []
    assert len(toxicity.score_toxicity(docs, toxicity.train_toxicity(own[0], empty, F.lit(True))).collect()) == 6
    assert len(quality.score_quality(docs, quality.train_quality(own[0], empty, F.lit(True))).collect()) == 6
    unknown = language.predict_language(docs, language.train_language(own[0].limit(0), F.lit(True))).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}


def brute_segments(scores):
    """Repeatedly take the best segment, then the same left and right of it."""
    if not scores:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a, b in itertools.combinations(range(len(scores) + 1), 2)))
    total, a = best[0], -best[2]
    b = a - best[1]
    if total <= 1e-12:
        return []
    return brute_segments(scores[:a]) + [(round(total, 6), a, b - 1)] + [(s, x + b, y + b) for s, x, y in brute_segments(scores[b:])]


def test_segments_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 18)
        marks = {i: rng.choice([0.3, 0.7, 1.1, 2.3]) + rng.random() / 100 for i in range(n) if rng.random() < 0.4}
        got = toxicity.segments(list(marks), list(marks.values()), gap=-0.5)
        want = brute_segments([marks.get(i, -0.5) for i in range(n)])
        assert [(round(s, 6), a, b) for s, a, b in got] == want


def test_segments_of_a_million_scattered_hits():
    places = list(range(0, 20_000_000, 20))
    assert toxicity.segments(places, [1.5] * len(places)) == [(pytest.approx(1.5, abs=1e-6), i, i) for i in places]
    close = toxicity.segments(list(range(1_000_000)), [1.5] * 1_000_000)
    assert len(close) == 1 and close[0][1:] == (0, 999_999)
    # Every segment starts lower than the one before it, and then higher again.
    rng = random.Random(8)
    mixed = toxicity.segments(places, [rng.choice([0.5, 3.0, 4.5]) for _ in places])
    assert sum(s for s, _, _ in mixed) > 0 and all(a[2] < b[1] for a, b in zip(mixed, mixed[1:]))


def test_passages_and_their_evidence():
    model = toxicity.Model({"vile": 3.0, "foul": 2.0, "badl|": 1.6})
    model.rate, model.chance = 1.0, 0.004
    words = ["calm"] * 500
    for i in range(0, 500, 50):
        words[i] = "vile"
    words[101], words[103] = "foul", "badly"
    found = model.passages(words)
    assert len(found) == 10  # each use of a word is a passage, however often it was said before
    assert found[2] == (pytest.approx(3.0 + 2.0 - 0.2 + 1.6), 100, 103)
    # As evidence the k-th use of a word counts 1 / k^2, and what then falls below the least segment nothing.
    kept = [3.0, 3.0 / 9 + 2.0 - 0.2 + 1.6]
    assert model.weights(words) == [pytest.approx(k) for k in kept]
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(kept, reverse=True), 1):
        total += s - math.log(0.004 * 500)
        if total > r:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - math.log(r + 1))
    assert model.evidence(words) == pytest.approx(best) and best > 0
    assert model.evidence([]) == 0.0
    many = model.passages(["vile", *["calm"] * 50] * 300)
    assert len(many) == 300


def test_token_scores_against_a_plain_count(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(["sun", "rain", "wind", "vile", "foul"] if label else ["sun", "rain", "wind", "cloud"]) for _ in range(30)), label) for label in [0, 1] * 150]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "text string, label int").repartition(3))
    has = {label: [set(t.split()) for t, y in rows if y == label] for label in (0, 1)}
    want = {}
    for word in ("sun", "rain", "wind", "cloud", "vile", "foul"):
        for name in toxicity.names_of(word):
            toxic, clean = (sum(any(name in toxicity.names_of(w) for w in ws) for ws in has[y]) for y in (1, 0))
            prior = 0.5 + 100.0 * (toxic + clean) / 300 / 1000
            t, c = toxic + prior, clean + prior
            delta = math.log(t / (150 + 2 - toxic)) - math.log(c / (150 + 2 - clean))
            if delta >= 1.5 and delta / math.sqrt(1 / t + 1 / c) >= 3.3:
                want[name] = pytest.approx(min(delta, 6.0))
    assert set(want) == {"vile", "vile|", "foul", "foul|"} and model.scores == want
    # lambda: the mean of exp(lambda * score) over the words of clean texts is one, or lambda is one.
    assert 0 < model.rate <= 1.0 and model.slope > 0


def test_letters():
    for text in ("", None, "12 34", "\u00bd \u00b2", "\u2460 \u2160", "_ _", "\u0660", "+ \u20ac"):
        assert not language.has_letter(text)
    for text in ("a", "\u00bd\u00e9", "\u4e2d", "\u02b0", "1\u01c5"):
        assert language.has_letter(text)


def plain_cost(counts, text, order):
    """Bits of a text under one language's counts, byte by byte."""
    bits = 0.0
    for i, symbol in enumerate(text):
        for k in range(order, -1, -1):
            context = bytes(text[j] if j >= 0 else 0 for j in range(i - k, i))
            seen = {s: n for (c, s), n in counts.items() if c == context and len(c) == k}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                bits += math.log2(total / seen[symbol])
                break
            bits += math.log2(total / len(seen))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    train = {"a": [b"abracadabra abra", b"cadabra"], "b": [b"hello hollow yellow", "é è".encode()]}
    parts, plain = [], []
    for texts in train.values():
        raw = np.frombuffer(b"".join(texts), np.uint8)
        gram, n = np.unique(language.grams(raw, np.cumsum([0, *map(len, texts)])), return_counts=True)
        parts.append((gram, n.astype(float)))
        counts = {}
        for t in texts:
            for i, s in enumerate(t):
                for k in range(language.ORDER + 1):
                    c = bytes(t[j] if j >= 0 else 0 for j in range(i - k, i))
                    counts[c, s] = counts.get((c, s), 0) + 1
        plain.append(counts)
    model = language.Model(list(train), parts)
    texts = [b"abra hello", b"", b"zzz", "é".encode(), b"a", b"yellow cad"]
    got = model.lengths(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    want = [[plain_cost(c, t, language.ORDER) for c in plain] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than 64, and one with few but very long documents."""
    rng = random.Random(4)
    words = {f"l{j:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for j in range(70)}
    rows = [(i, " ".join(rng.choices(words[name], k=30)), name) for i, name in enumerate([*words] * 2)]
    long = ["zyx", "wvu", "tsr"]
    rows += [(1000 + i, " ".join(rng.choices(long, k=40_000)), "long") for i in range(2)]
    monkeypatch.setattr(language, "MOST_BYTES", 4000)
    monkeypatch.setattr(language, "COSTS_HELD", 10_000)
    model = language.train_language(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    fresh = [(name, " ".join(rng.choices(own, k=20))) for name, own in [*words.items(), ("long", long)]]
    got = language.predict_language(spark.createDataFrame(fresh, "doc_id string, text string"), model).collect()
    assert len(got) == 71 and all(r["lang_pred"] == r["doc_id"] for r in got)


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(60)]
    y = np.array([1.0 if (r < 6).sum() + rng.normal() > len(r) / 2 else -1.0 for r in rows])
    scale = np.ones(quality.INDICATORS)
    old, quality.PASSES = quality.PASSES, 2000
    try:
        w, bias = quality.dual_descent(rows, y, scale)
    finally:
        quality.PASSES = old
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r))
        x[i, 12] = 1
    share = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))

    def loss(v):
        return v @ v / 2 + (share * np.maximum(0, 1 - y * (x @ v))).sum()

    best = loss(np.append(w[:12], bias))
    assert all(loss(np.append(w[:12], bias) + rng.normal(size=13) * s) >= best - 1e-3 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_logistic():
    x = np.array([0.0, 0, 0, 1, 1, 2, 2, 3])
    slope, offset = logistic(x, np.array([0, 0, 0, 0, 1, 1, 1, 1]))
    assert slope > 0 and offset < 0 and logistic(x, np.ones(8)) == (1.0, 0.0)
