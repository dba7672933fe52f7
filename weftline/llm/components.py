"""Connected components of an undirected graph given as rows (a, b)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut


#: The rounds grow with the logarithm of the longest path; this many are never needed.
MOST_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, each with the smallest node it reaches through them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        while True:
            jumped = after[after]
            if np.array_equal(jumped, after):
                break
            after = jumped
        if np.array_equal(after, label):
            return nodes, nodes[label]
        label = after


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task, some millions at a time, by the forest with the same components."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def flush():
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        node, root = forest(a, b)
        keep = node != root
        return node[keep], root[keep]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        count += batch.num_rows
        if count >= 2_000_000:
            done = flush()
            if len(done[0]) >= 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], names=["a", "b"])
                held, count = [], 0
            else:
                held, count = [done], len(done[0])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in flush()], names=["a", "b"])


def _plain(edges: DataFrame) -> DataFrame:
    first, second = edges.columns[:2]
    return edges.select(F.col(first).cast("bigint").alias("a"), F.col(second).cast("bigint").alias("b")).dropna()


def _hung(plain: DataFrame, rounds: int | None) -> DataFrame:
    """Rows (a, b) with the components of `plain`, after so many rounds or when nothing changes."""
    now = cut(plain.where("a <> b").mapInArrow(_shrink, "a bigint, b bigint"))
    mark = None
    for turn in range(MOST_ROUNDS):
        if turn == rounds:
            return now
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stats[0] == 0 or tuple(stats) == mark:
            return now
        mark = tuple(stats)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Every row now points from a larger node (a) to a smaller one (b).
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(down, F.col("a") == F.col("k"))
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(moved.union(down.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct())
    raise RuntimeError("components did not settle")


def _labels(now: DataFrame, plain: DataFrame) -> DataFrame:
    rows = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component"))
    alone = plain.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    return rows.union(roots).union(alone).groupBy("id").agg(F.min("component").alias("component"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every node of `edges`; component is the smallest id reached.

    Edges are two bigint columns; self loops, repeats and both directions are
    fine, and rows with a null are ignored.  Each task first replaces its edges
    by a forest, then large-star and small-star rounds hang every node below its
    smallest neighbour until nothing changes.  A round costs two shuffles of at
    most one row for each node, hubs are joined under AQE's skew splitting, and
    each round is cut into the shared checkpoint folder.
    """
    plain = _plain(edges)
    return _labels(_hung(plain, None), plain)


def partial_components(edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Labels (id, component) after so many rounds, and the rows (a, b) that have the components of `edges`.

    Nodes with one label are connected for certain, but a true component may still
    have several.  Labels alone have lost links: a node may hang below several
    others, and its label names one.  Who goes on must go on from the rows.
    """
    plain = _plain(edges)
    now = _hung(plain, rounds)
    return _labels(now, plain), now
