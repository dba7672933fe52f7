"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2 t) of each other, and no
orthogonal projection moves them apart.  So the vectors are projected on their
leading principal dimensions, cut into grid cells of side eps, and sorted by cell.
The sorted sequence is cut into leaves, and runs of leaves form blocks; eight
blocks form an interval, eight of those a larger one, up to one root.  Starting
with the root joined to itself, pairs of intervals are split into pairs of their
parts, and a pair whose bounding boxes lie more than eps apart is skipped with
everything below it.  Inside a pair of blocks the recursion goes on by halves down
to leaves, and inside a pair of leaves down to single vectors: their cosine is at
most the product of their prefixes plus the product of the lengths of what is left,
and only pairs that this bound lets through are compared whole.

A block is sent once for each block it may meet, as the components it came with,
and a group holds two blocks, so a group's memory is bounded.  No link is ever
listed outside its group: what comes back is a count for each vector and a forest
with the same components.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, tidy_group
from weftline.llm.components import connected_components, forest

#: Principal dimensions of the grid and of the boxes.
GRID_DIMS = 12
#: Leading principal dimensions that bound the cosine of two vectors before they are compared whole.
PREFIX_DIMS = 24
#: Vector components of one leaf and of one block (512 and 16,384 vectors of 64 components), and the parts of an interval.
LEAF_VALUES, BLOCK_VALUES, FAN_BITS = 1 << 15, 1 << 20, 3
#: Vectors of one partition of the sorted sequence; one small row for each partition reaches the driver.
PART_ROWS = 65_536
#: Blocks up to which their boxes are broadcast (200 bytes each), and pairs of blocks up to which the list of them is.
BROADCAST_BLOCKS, BROADCAST_PAIRS = 4_096, 100_000
#: Partitions of the comparison at most; a task takes several groups one after another.
MOST_TASKS = 100_000
#: Share of a leaf pair above which it is compared as one matrix product, not pair by pair.
DENSE = 0.05
#: Cosines in single precision that close to the threshold are computed anew in double.
BAND = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length, as rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that squares neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sizes = batch.column("size").to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        if batch.num_rows:
            unit = _unit(_matrix(batch.column("vec")))
            unit = np.concatenate([unit, np.ones((len(unit), 1))], axis=1)
            total = total + unit.T @ unit
    if not np.isscalar(total):
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])


def principal(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The commonest vector length and its leading principal directions (one d x d matrix of sums reaches the driver)."""
    common = vectors.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return 0, np.zeros((0, 0))
    size = common["size"]
    sums = vectors.where(F.col("size") == size).mapInArrow(_moments, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    whole = np.zeros((size + 1, size + 1))
    for r in sums.collect():
        whole[r["i"], r["j"]] = r["v"]
    mean = whole[size, :size] / whole[size, size]
    _, directions = np.linalg.eigh(whole[:size, :size] / whole[size, size] - np.outer(mean, mean))
    return size, np.ascontiguousarray(directions[:, ::-1][:, :PREFIX_DIMS])


def _prefix(unit: np.ndarray, size: int, directions: np.ndarray) -> np.ndarray:
    """The leading PREFIX_DIMS coordinates; vectors of other lengths than the commonest use their first components."""
    low = unit @ directions if unit.shape[1] == size else unit[:, :PREFIX_DIMS]
    return np.pad(low, ((0, 0), (0, PREFIX_DIMS - low.shape[1])))


def _grid(size: int, directions: np.ndarray, eps: float):
    """Add the grid cell of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, GRID_DIMS), np.int64)
            for _, at in _by_length(batch):
                low = _prefix(_unit(_matrix(batch.column("vec").take(pa.array(at)))), size, directions)
                cells[at] = np.floor(low[:, :GRID_DIMS] / eps)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(cells[:, i]) for i in range(GRID_DIMS))], names=[*batch.schema.names, *(f"c{i}" for i in range(GRID_DIMS))])

    return run


SIDES = [f"{s}{i}" for i in range(GRID_DIMS) for s in ("lo", "hi")]
LEAF = "part int, turn int, size int, start bigint, weight bigint, ids binary, weights binary, vecs binary, " + ", ".join(f"{s} double" for s in SIDES)


def _leaves(size: int, directions: np.ndarray, single: bool):
    """Cut a sorted partition into leaves of one vector length, with their bounding boxes.

    `start` is the number of vector components before the leaf in its partition.
    """
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, start = TaskContext.get().partitionId(), 0, 0
        held: dict[int, list] = {}

        def leaf(length, ids, weights, rows):
            nonlocal turn, start
            low = _prefix(_unit(rows), size, directions)
            box = [x for i in range(GRID_DIMS) for x in (low[:, i].min(), low[:, i].max())]
            values = [part, turn, length, start, rows.size, ids.tobytes(), weights.tobytes(), rows.astype(kind).tobytes(), *box]
            turn, start = turn + 1, start + rows.size
            types = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.binary()] * 3 + [pa.float64()] * (2 * GRID_DIMS)
            names = ["part", "turn", "size", "start", "weight", "ids", "weights", "vecs", *SIDES]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for length, at in _by_length(batch):
                new = [batch.column("rep").to_numpy(zero_copy_only=False)[at], batch.column("copies").to_numpy(zero_copy_only=False)[at],
                       _matrix(batch.column("vec").take(pa.array(at)))]
                old = held.pop(length, None)
                new = new if old is None else [np.concatenate(p) for p in zip(old, new)]
                rows, first = max(16, LEAF_VALUES // length), 0
                while len(new[0]) - first >= rows:
                    yield leaf(length, *(np.ascontiguousarray(x[first:first + rows]) for x in new))
                    first += rows
                if first < len(new[0]):
                    held[length] = [x[first:] for x in new]
        for length, rest in held.items():
            yield leaf(length, *map(np.ascontiguousarray, rest))

    return run


def _merge(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The labels after tying p[i] to q[i]; a label is the index of one of its class."""
    node, root = forest(label[p], label[q])
    after = np.arange(len(label))
    after[node] = root
    return after[label]


def _compare(threshold: float, size: int, directions: np.ndarray, single: bool):
    """Per pair of blocks: each vector's weighted number of links, and the smallest vector it reaches within the pair.

    One more row, without a vector, counts the pairs of vectors that were in the group and those compared whole.
    """
    eps2 = (2 - 2 * threshold) * (1 + 1e-9)
    kind = np.float32 if single else np.float64

    def links(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray, int]:
        bound = a["bound"] @ b["bound"].T
        p, q = np.nonzero(bound >= np.float32(threshold - BAND))
        if len(p) > DENSE * bound.size:
            near = a["unit"].astype(np.float32) @ b["unit"].astype(np.float32).T
            p, q = np.nonzero(near >= threshold - BAND)
            sure = np.ones(len(p), bool)
            close, whole = np.flatnonzero(near[p, q] < threshold + BAND), bound.size
        else:
            sure = np.zeros(len(p), bool)
            close, whole = np.arange(len(p)), len(p)
        for i in range(0, len(close), 1 << 15):
            at = close[i:i + (1 << 15)]
            sure[at] = np.einsum("ij,ij->i", a["unit"][p[at]], b["unit"][q[at]]) >= threshold
        return p[sure], q[sure], whole

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["x", "y", "block", "part", "turn", "size", "ids", "weights", "vecs", *SIDES]).to_pylist()
        x, y = rows[0]["x"], rows[0]["y"]
        leaves, total = [], 0
        for r in sorted(rows, key=lambda r: (r["block"], r["part"], r["turn"])):
            ids = np.frombuffer(r["ids"], np.int64)
            unit = _unit(np.frombuffer(r["vecs"], kind).reshape(len(ids), -1).astype(np.float64))
            low = _prefix(unit, size, directions)
            rest = np.sqrt(np.maximum(0, 1 - (low * low).sum(axis=1, keepdims=True)))
            leaves.append({"block": r["block"], "size": r["size"], "ids": ids, "weights": np.frombuffer(r["weights"], np.int64), "unit": unit, "at": total,
                           "bound": np.concatenate([low, rest], axis=1).astype(np.float32),
                           "lo": np.array([r[f"lo{i}"] for i in range(GRID_DIMS)]), "hi": np.array([r[f"hi{i}"] for i in range(GRID_DIMS)])})
            total += len(ids)
        ids, weights = (np.concatenate([leaf[c] for leaf in leaves]) for c in ("ids", "weights"))
        lo, hi = (np.stack([leaf[c] for leaf in leaves]) for c in ("lo", "hi"))
        label, counts = np.arange(total), np.zeros(total, np.int64)
        whole = 0

        def far(i: range, j: range) -> bool:
            apart = np.maximum(lo[i.start:i.stop].min(0) - hi[j.start:j.stop].max(0), lo[j.start:j.stop].min(0) - hi[i.start:i.stop].max(0))
            apart = np.maximum(apart, 0)
            return float(apart @ apart) > eps2

        first = [k for k, leaf in enumerate(leaves) if leaf["block"] == x]
        left = range(first[0], first[-1] + 1)
        right = left if x == y else range(left.stop, len(leaves))
        todo = [(left, right)]
        while todo:
            i, j = todo.pop()
            if i.start > j.start or far(i, j):
                continue
            if max(len(i), len(j)) > 1:
                halves = [[r] if len(r) < 2 else [r[:len(r) // 2], r[len(r) // 2:]] for r in (i, j)]
                todo.extend((a, b) for a in halves[0] for b in halves[1])
                continue
            a, b = leaves[i.start], leaves[j.start]
            if a["size"] != b["size"]:
                continue
            p, q, looked = links(a, b)
            whole += looked
            p, q = p + a["at"], q + b["at"]
            if a is b:
                p, q = p[p != q], q[p != q]
            if not len(p):
                continue
            counts += np.bincount(p, weights[q], total).astype(np.int64)
            if a is not b:
                counts += np.bincount(q, weights[p], total).astype(np.int64)
            star = np.flatnonzero(np.diff(p, prepend=-1))
            label = _merge(label, p[star], q[star])
            loose = label[p] != label[q]
            if loose.any():
                label = _merge(label, p[loose], q[loose])
        least = np.full(total, np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        hit = np.flatnonzero(counts)
        n = sum(len(leaves[k]["ids"]) for k in left)
        pairs = n * (n + 1) // 2 if x == y else n * (total - n)
        return pa.table({"rep": pa.array([*ids[hit].tolist(), None], pa.int64()), "root": pa.array([*least[label[hit]].tolist(), pairs], pa.int64()),
                         "links": pa.array([*counts[hit].tolist(), whole], pa.int64())})

    return tidy_group(run)


def _descend(boxes: DataFrame, eps: float, number: int) -> DataFrame:
    """Pairs (x, y) of blocks, x <= y, that no interval pair above them rules out."""
    hint = F.broadcast if number <= BROADCAST_BLOCKS else lambda df: df
    top = -(-(number - 1).bit_length() // FAN_BITS)

    def level_boxes(level: int) -> DataFrame:
        if level == 0:
            return boxes.withColumnRenamed("block", "node")
        return boxes.groupBy(F.shiftright("block", FAN_BITS * level).alias("node")).agg(*(F.min(s).alias(s) if s.startswith("lo") else F.max(s).alias(s) for s in SIDES))

    def side(level: int, name: str) -> DataFrame:
        return hint(level_boxes(level).select(
            F.col("node").alias(name), F.shiftright("node", FAN_BITS).alias(f"up_{name}"), *(F.col(s).alias(f"{s}_{name}") for s in SIDES)))

    gap = sum((F.pow(F.greatest(F.col(f"lo{i}_x") - F.col(f"hi{i}_y"), F.col(f"lo{i}_y") - F.col(f"hi{i}_x"), F.lit(0.0)), F.lit(2)) for i in range(GRID_DIMS)), F.lit(0.0))
    pairs = level_boxes(top).select(F.col("node").alias("px"), F.col("node").alias("py"))
    for level in range(top - 1, -1, -1):
        met = pairs.join(side(level, "x"), F.col("px") == F.col("up_x")).join(side(level, "y"), F.col("py") == F.col("up_y"))
        met = met.where((F.col("x") <= F.col("y")) & (gap <= eps * eps * (1 + 1e-9)))
        pairs = met.select(F.col("x").alias("px"), F.col("y").alias("py"))
    return pairs.select(F.col("px").alias("x"), F.col("py").alias("y"))


def _joined(classes: DataFrame, threshold: float, single: bool) -> DataFrame:
    """Rows (rep, root, links) of all pairs of blocks, and for each pair of blocks a row (null, pairs, compared whole)."""
    eps = math.sqrt(2 - 2 * threshold)
    size, directions = principal(classes)
    number = classes.count()
    order = ["size", *(f"c{i}" for i in range(GRID_DIMS)), "rep"]
    kind = "float" if single else "double"
    cells = classes.select("rep", "copies", "size", "vec").mapInArrow(
        _grid(size, directions, eps), f"rep bigint, copies bigint, size int, vec array<{kind}>, " + ", ".join(f"c{i} bigint" for i in range(GRID_DIMS)))
    parts = max(1, -(-number // PART_ROWS))
    leaves = cut(cells.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_leaves(size, directions, single), LEAF))
    sizes = sorted(leaves.groupBy("part").agg(F.sum("weight")).collect())
    before = dict(zip((p for p, _ in sizes), np.cumsum([0] + [w for _, w in sizes]).tolist()))
    blocks = max(1, -(-sum(w for _, w in sizes) // BLOCK_VALUES))
    spark = classes.sparkSession
    offsets = spark.createDataFrame(list(before.items()), "at_part int, before bigint")
    leaves = leaves.join(F.broadcast(offsets), F.col("part") == F.col("at_part"))
    leaves = leaves.withColumn("block", F.floor((F.col("before") + F.col("start")) / F.lit(BLOCK_VALUES)).cast("bigint")).drop("at_part", "before", "start", "weight")
    boxes = cut(leaves.groupBy("block").agg(*(F.min(s).alias(s) if s.startswith("lo") else F.max(s).alias(s) for s in SIDES)))
    pairs = cut(_descend(boxes, eps, blocks))
    met = pairs.count()
    member = pairs.withColumn("member", F.explode(F.array_distinct(F.array("x", "y"))))
    sent = leaves.join(F.broadcast(member) if met <= BROADCAST_PAIRS else member, F.col("block") == F.col("member")).drop("member")
    sent = sent.repartition(max(1, min(4 * met, MOST_TASKS)), "x", "y")
    return cut(sent.groupBy("x", "y").applyInArrow(_compare(threshold, size, directions, single), "rep bigint, root bigint, links bigint"))


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """Rows with the two hashes of their vector (null if it links with nothing), and the classes of equal vectors."""
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("vec", F.when(F.coalesce(good, F.lit(False)), F.col("vec")))
    rows = rows.withColumn("k1", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))).withColumn("k2", F.xxhash64(F.lit(1), "vec"))
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"))
    return rows, cut(classes.withColumn("size", F.size("vec")).where("rep is not null")), single


def join_report(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row: vectors (different ones), pairs of them, compared (those compared whole), skipped_share of the others."""
    _, classes, single = _classes(vectors, id_col, vec_col)
    told = _joined(classes, threshold, single).where("rep is null").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("compared"))
    number = classes.agg(F.count("*").alias("vectors"))
    pairs = (F.col("vectors") * (F.col("vectors") + 1) / 2).cast("bigint")
    return number.crossJoin(told).select("vectors", pairs.alias("pairs"), "compared", (1 - F.col("compared") / F.greatest(pairs, F.lit(1))).alias("skipped_share"))


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one for each row of `vectors`.

    Two rows link when the cosine of their vectors, in double precision, is at
    least `threshold` (above 0).  n_links counts the rows linked directly,
    component_id is the smallest id reachable by links, kept says whether that is
    the row's own.

    A vector links with nothing if it is null, empty or zero, or has a null, NaN
    or infinite component; vectors of different lengths do not link either.
    Equal vectors are compared once and counted with their number.  Rows that
    repeat an id count as rows of their own and share the smaller component.
    Columns other than the two named are ignored.
    """
    rows, classes, single = _classes(vectors, id_col, vec_col)
    partial = _joined(classes, threshold, single).where("rep is not null")
    counts = partial.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(partial.where("rep <> root").select("rep", "root")).withColumnRenamed("id", "node")
    found = classes.drop("vec", "size").join(counts, "rep", "left").join(component, F.col("rep") == F.col("node"), "left")
    found = found.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "copies", "links", F.coalesce("component", "rep").alias("component"))
    out = rows.drop("vec").join(found, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")), "left")
    component_id = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(False)).alias("kept"))
