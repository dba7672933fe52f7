import pytest
from llm_tools import alnum_words

from weftline.llm import decontaminate


def brute(docs, items):
    windows = set()
    for i, text in items:
        w = alnum_words(text)
        windows |= {(i, tuple(w[k:k + 13])) for k in range(max(1, len(w) - 12))} if w else set()
    out = []
    for d, text in docs:
        w = alnum_words(text)
        hit, found = set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_LIMIT, 0])
def test_against_brute_force(spark, prose, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_LIMIT", limit)
    items = [(i, prose(i, 12 + i)) for i in range(12)] + [(50, None), (51, ""), (52, "Alpha beta"), (53, "solo"), (54, prose(3, 15)), (55, "a a a a a a a a a a a a a a")]
    w = prose(7, 19).split()
    docs = [
        (1, prose(900, 40) + " " + prose(5, 17) + " " + prose(901, 30)), (2, " ".join(w[:12])), (3, "X, " + "-".join(w[3:16]).upper() + "."), (4, " ".join(w[6:19])),
        (5, " ".join(w[:13]) + " gap " + " ".join(w[13:])), (6, None), (7, ""), (8, "say alpha, BETA solo"), (9, prose(900, 3000) + " " + prose(3, 15)),
        (10, "a " * 40), (11, " ".join(w)), (11, " ".join(w)), (12, prose(3, 15) + " " + prose(3, 15)), (None, prose(11, 23)), (13, "é ü 日本 " * 9),
    ]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id bigint, text string, n int, w string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, q int")
    got = sorted((tuple(r) for r in decontaminate.contamination(df, bench).collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark, prose):
    df = spark.createDataFrame([(1, prose(1, 20))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, prose(1, 20))], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.contamination(df, bench.limit(0)).collect()] == [(1, 20, 0, 0, [], False)]
    assert decontaminate.contamination(df.limit(0), bench).collect() == []
