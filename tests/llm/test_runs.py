import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tools import SPACED

from weftline.llm import queries, runs


def brute(w, least=12):
    """Longest stretches of every period; equal ends keep the smallest period."""
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(0, 30), st.integers(1, 20), st.sampled_from([2, 12]))
def test_runs_against_brute_force(words, at, period, least):
    tail = [words[i] if i < at or at + period > len(words) else words[at + (i - at) % period] for i in range(len(words))]
    for w in (words, tail, tail + [9] + tail):
        assert runs.word_runs(w, least) == brute(w, least)


def test_appending_reports_the_runs_of_each_prefix():
    rng = random.Random(3)
    words = [rng.choice("ab") for _ in range(40)] + list("xyz" * 8) + ["q"] + list("z" * 14)
    catcher = runs.SquareCatcher()
    for i, w in enumerate(words, 1):
        catcher.append(w)
        assert catcher.runs() == brute(words[:i])


def test_long_repetitive_texts_take_few_steps():
    assert runs.word_runs(["a"] * 50_000) == [(0, 50_000, 1)]
    rng = random.Random(5)
    part = [rng.randrange(900) for _ in range(7000)]
    assert runs.word_runs(part * 9) == [(0, 63_000, 7000)]


def expected(doc_id, text):
    w = SPACED.findall(text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path, prose):
    texts = [prose(1, 90), "", None, " \t\n ", "one", "a b " * 30, "α β γ " * 9, "x " * 400 + "y", prose(2, 1500, 30), ("p q r\x0bs\x0c" * 4 + "t ") * 6]
    rows = [(i, texts[i % len(texts)], "clash") for i in range(120)] + [(7, texts[7], "again"), (None, "a b " * 9, ""), (None, None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(i, t) for i, t, _ in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120)) > 5


def test_empty_table_and_kept_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 8, "k")], "doc_id bigint, text string, n_words string")
    [row] = runs.find_runs(docs.withColumnRenamed("n_words", "label"), keep=("label",)).collect()
    assert (row.label, row.n_words, row.collapsed) == ("k", 16, "a b") and tuple(row.runs[0]) == (0, 16, 2)
    assert runs.find_runs(docs.limit(0)).collect() == []
