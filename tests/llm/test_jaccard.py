import random

from llm_tools import LOWER, SPACED, components

from weftline.llm import jaccard
from weftline.llm.components import connected_components, forest, partial_components


def brute(rows):
    sets = {}
    for i, text in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = components(sets, edges)
    return sorted((i, len(s), found[i]) for i, s in sets.items())


def family(prose, rng, seed, n, size, edits):
    base = prose(seed, n).split()
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(n)] = f"z{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def corpus(prose):
    rng = random.Random(5)
    texts = [None, "", "   \t\n", "one", "One", "one two three", "one  two\nthree", "a b c d e", "A b c d e", "a b c d e f"]
    for seed, n, size, edits in ((1, 60, 40, 3), (2, 150, 25, 6), (3, 12, 10, 1), (4, 400, 6, 10)):
        texts += family(prose, rng, seed, n, size, edits)
    passage = prose(99, 80)
    texts += [passage + " " + prose(100 + i, 10 + i) for i in range(25)]
    texts += [prose(500, 3000), prose(500, 3000) + " tail", prose(501, 90)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_against_brute_force(spark, prose, monkeypatch):
    rows = corpus(prose)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == want
    for name, value in (("LONG_LIST", 4), ("HUBS", 2), ("BLOCK_ROWS", 3), ("GROUP_ROWS", 4), ("BATCH_SHINGLES", 500)):
        monkeypatch.setattr(jaccard, name, value)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == want


def test_odd_rows(spark):
    rows = [(7, "x y z u v w", 1, "n"), (7, "x y z u v w", 2, "n"), (3, "x y z u v w", 3, "n"), (None, "x y z u v w", 4, "n"), (9, None, 5, "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int, node string")
    got = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, 3), (9, 0, 9)], key=str)
    assert jaccard.jaccard_components(df.limit(0)).collect() == []


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5), (None, 4)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    plain = [e for e in edges if e[0] is not None]
    want = components({x for e in plain for x in e}, plain)
    assert {r["id"]: r["component"] for r in connected_components(df).collect()} == want
    import numpy as np
    node, root = forest(*(np.array(c) for c in zip(*plain)))
    assert dict(zip(node.tolist(), root.tolist())) == want


def test_partial_components_keep_every_link(spark):
    """A chain and a tree with random ids over many partitions: the rows left by two rounds have the true components."""
    rng = random.Random(3)
    ids = rng.sample(range(10 ** 6), 320)
    chain, tree = ids[:120], ids[120:]
    edges = list(zip(chain, chain[1:])) + [(tree[(i - 1) // 2], tree[i]) for i in range(1, len(tree))]
    rng.shuffle(edges)
    labels, rows = partial_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(40), 2)
    want = {i: min(chain) for i in chain} | {i: min(tree) for i in tree}
    assert {r["id"]: r["component"] for r in connected_components(rows).collect()} == want
    assert all(want[r["component"]] == want[r["id"]] for r in labels.collect())
