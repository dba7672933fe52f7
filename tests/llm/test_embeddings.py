import math

import numpy as np
from llm_tools import components

from weftline.llm import embeddings


def brute(rows, t=0.9):
    good = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, float)
            u = u / np.abs(u).max()
            good[k] = (i, u / math.sqrt(u @ u))
    near = [(a, b) for a in good for b in good if a < b and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= t]
    found = components({r[0] for r in rows}, [(good[a][0], good[b][0]) for a, b in near])
    count = [sum(k in e for e in near) for k in range(len(rows))]
    return sorted((r[0], n, found[r[0]], found[r[0]] == r[0]) for r, n in zip(rows, count))


def test_links_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = [(c + rng.normal(size=16) * s).tolist() for c in centres for s in (0.0, 0.05, 0.3, 0.45, 0.5, 0.55) for _ in range(4)]
    vectors += [(np.array(vectors[0]) * 7).tolist(), (np.array(vectors[0]) * -1).tolist()] + [rng.normal(size=16).tolist() for _ in range(60)]
    vectors += [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.1], [1e-30] * 16, [1e30] * 16, [1.0]]
    order = rng.permutation(len(vectors))
    rows = [(int(i) * 3 + 1, vectors[i]) for i in order] + [(1, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = brute(rows)
    assert sorted(map(tuple, embeddings.embedding_links(df).collect())) == want
    assert embeddings.embedding_links(df.limit(0)).collect() == []


def test_tree_skips_only_distant_leaves(spark):
    """Many small leaves over far more than one grid cell: nothing is lost between them."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(900, 3))
    rows = [(i, (v / np.linalg.norm(v) + 1e-3 * rng.normal(size=3)).tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    cells = embeddings.embedding_links(df, threshold=0.9995).collect()
    single = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    assert sorted(map(tuple, cells)) == brute(single, 0.9995)


def test_many_blocks_and_a_dense_group(spark, monkeypatch):
    """Blocks of a few leaves, half of the vectors near copies of one: no link is lost between blocks."""
    monkeypatch.setattr(embeddings, "BLOCK_VALUES", 16 * 600)
    rng = np.random.default_rng(11)
    rows = np.concatenate([rng.normal(size=(1200, 16)), rng.normal(size=16) + rng.normal(size=(1300, 16)) * 0.1])
    rows = [(int(i), rows[k].astype(np.float32).tolist()) for i, k in enumerate(rng.permutation(len(rows)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.array([i for i, _ in rows])
    while (low := np.where(near, label, len(rows)).min(axis=1)).tolist() != label.tolist():
        label = low
    want = sorted((i, int(n) - 1, int(c), i == c) for (i, _), n, c in zip(rows, near.sum(axis=1), label))
    assert sorted(map(tuple, embeddings.embedding_links(df).collect())) == want


def test_report_of_skipped_pairs(spark):
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    told = embeddings.join_report(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).first()
    assert told["vectors"] == 3000 and told["pairs"] == 3000 * 3001 // 2
    assert 3000 <= told["compared"] and told["skipped_share"] > 0.9
    none = embeddings.join_report(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).first()
    assert tuple(none) == (0, 0, 0, 1.0)
