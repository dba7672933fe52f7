"""N-gram Jaccard join: rare-first prefix filtering over packed shingle sets.

1. One pass turns each text into its set of word 5-gram hashes.  A set is known
   by a 64-bit digest, its node; texts with one set share a node, so copies are
   never compared.
2. A second pass deals the sets out by shingle, packed into blobs.  Each bucket
   counts document frequencies and sends back only the shingles of two or more
   nodes: a shingle of one node alone can never be shared.
3. Per node that leaves its shared shingles, rare first, behind `n - m` unshared
   ones (the rarest of all).  If those fill the prefix, the node links with
   nothing.
4. Prefix shingles of the others are joined.  First each node meets the smallest
   and the largest set of each posting list, then in long lists a few nodes drawn
   by hash, which ties large groups of near copies together in linear work; then
   only pairs that are still in different components meet, under length and positional filters, each pair once.
5. Pairs that pass a bound from binned counts are verified on the shared shingles
   after a suffix filter.

Shingles that a sizeable part of a batch holds (very common passages) are counted
beforehand and take no part in the deal, so no bucket gets a posting for every
document of the corpus.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, SPACE_WORD, cut, mix, slices, text_bytes, tidy, tidy_group, width, word_hashes
from weftline.llm.components import connected_components, partial_components

#: Shingles gathered by a task before they are dealt out, and those of one bucket of the deal.
BATCH_SHINGLES = 1_000_000
#: A shingle may be hot if so many texts of one batch hold it.
HOT_IN_BATCH = 16
#: Rows of one posting list that meet in one task.
BLOCK_ROWS = 512
#: Rows of the posting lists of much the same nodes that meet in one group, and the mean rows of a bucket of groups.
GROUP_ROWS = 2048
#: Posting lists above this length go through HUB_ROUNDS rounds of HUBS drawn nodes before pairs are listed.
LONG_LIST, HUBS, HUB_ROUNDS = 64, 48, 1
#: Parts of the counts that travel with the nodes of long lists, and the count that stands for any larger one.
BINS, FULL = 64, 65535
LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(batch: pa.RecordBatch, text: str, k: int) -> list[np.ndarray]:
    """The sorted distinct k-gram hashes of each row's text; fewer words make one shingle of all of them."""
    raw, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    words, at = word_hashes(LOWER[raw], offsets, SPACE_WORD)
    seed = np.uint64(0x9E3779B97F4A7C15)
    if len(words) >= k:
        grams = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[i:len(grams) + i]
        grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = mix(h * seed + w + np.uint64(b - a))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sizes(text: str, k: int):
    """Rows (kind 0: id, n, node) for the documents and (kind 1: shingle, count) for what may be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def hot():
            values, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            keep = times >= HOT_IN_BATCH
            values, times = values[keep].view(np.int64), times[keep].astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(values), np.int8)), pa.array(values), pa.array(times), pa.nulls(len(values), pa.int64())],
                names=["kind", "id", "n", "node"])

        for batch in slices(batches, text):
            sets = shingle_sets(batch, text, k)
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int8)), batch.column(0).cast(pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())], names=["kind", "id", "n", "node"])
            held += [s for s in sets if len(s)]
            count += sum(map(len, sets))
            if count >= BATCH_SHINGLES:
                yield hot()
                held, count = [], 0
        yield hot()

    return run


def _pack(bucket: int, nodes, sizes, refs, shingles, df=None) -> tuple:
    """One row of the deal: nodes with their set sizes, and per posting the node's place and the shingle."""
    used, refs = np.unique(refs, return_inverse=True)
    six = np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8)[:, :6] if df is None else shingles
    return (bucket, nodes[used].tobytes(), sizes[used].astype(np.uint32).tobytes(), refs.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes(),
            np.ascontiguousarray(six).tobytes(), None if df is None else np.minimum(df, 65535).astype(np.uint16).tobytes())


PACKED = "bucket bigint, nodes binary, sizes binary, refs binary, shingles binary, df binary"
PACKED_ARROW = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("nodes", "sizes", "refs", "shingles", "df")]])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PACKED_ARROW.types)], schema=PACKED_ARROW)


def _unpack(table: pa.Table) -> Iterator[tuple]:
    for row in table.to_pylist():
        nodes = np.frombuffer(row["nodes"], np.int64)
        refs = np.frombuffer(row["refs"], np.uint32 if len(nodes) > 65535 else np.uint16).astype(np.int64)
        sizes = np.frombuffer(row["sizes"], np.uint32)
        if row["df"] is None:
            wide = np.zeros((len(refs), 8), np.uint8)
            wide[:, :6] = np.frombuffer(row["shingles"], np.uint8).reshape(-1, 6)
            yield nodes, sizes, refs, wide.view(np.uint64).ravel(), None
        else:
            yield nodes, sizes, refs, np.frombuffer(row["shingles"], np.uint64), np.frombuffer(row["df"], np.uint16)


def _bucket(shingles: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(shingles + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _identity(shingles: np.ndarray, bucket) -> np.ndarray:
    """The lower 48 bits tell a bucket's shingles apart, the bucket fills the rest."""
    return (shingles & LOW48) | ((np.asarray(bucket).astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48))


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    values, starts = np.unique(keys[order], return_index=True)
    for v, part in zip(values.tolist(), np.split(order, starts[1:])):
        yield v, part


def _deal(text: str, k: int, buckets: int, hot):
    """Shingles of a task's texts by bucket; hot ones come out with their count, in a bucket below zero of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_values, hot_counts = hot.value
        held: dict[int, np.ndarray] = {}
        count, turn = 0, 0
        part = TaskContext.get().partitionId()

        def flush():
            nodes = np.array(list(held), np.int64)
            lengths = np.array([len(s) for s in held.values()], np.int64)
            refs, shingles = np.repeat(np.arange(len(nodes)), lengths), np.concatenate(list(held.values()))
            rows = []
            if len(hot_values):
                at = np.minimum(np.searchsorted(hot_values, shingles), len(hot_values) - 1)
                is_hot = hot_values[at] == shingles
                if is_hot.any():
                    own, which = shingles[is_hot], at[is_hot]
                    rows.append(_pack(-1 - (part * 1_000_003 + turn), nodes, lengths, refs[is_hot], _identity(own, _bucket(own, buckets)), hot_counts[which]))
                    refs, shingles = refs[~is_hot], shingles[~is_hot]
            for b, at in _by(_bucket(shingles, buckets)):
                rows.append(_pack(b, nodes, lengths, refs[at], shingles[at]))
            return rows

        for batch in slices(batches, text):
            for s in shingle_sets(batch, text, k):
                if len(s) and (node := node_of(s)) not in held:
                    held[node] = s
                    count += len(s)
            if count >= BATCH_SHINGLES:
                rows = flush()
                for i in range(0, len(rows), 64):
                    yield _rows(rows[i:i + 64])
                held, count, turn = {}, 0, turn + 1
        if held:
            rows = flush()
            for i in range(0, len(rows), 64):
                yield _rows(rows[i:i + 64])

    return run


def _shared(buckets: int):
    """Within a bucket: the postings of shingles that two or more nodes hold, dealt out again by node."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        nodes, sizes, shingles, df = [], [], [], []
        for n, s, r, h, d in _unpack(table):
            nodes.append(n[r]), sizes.append(s[r]), shingles.append(h), df.append(d)
        nodes, sizes, shingles = map(np.concatenate, (nodes, sizes, shingles))
        if bucket >= 0:
            order = np.lexsort((nodes, shingles))
            nodes, sizes, shingles = nodes[order], sizes[order], shingles[order]
            again = np.zeros(len(nodes), bool)
            again[1:] = (nodes[1:] == nodes[:-1]) & (shingles[1:] == shingles[:-1])
            nodes, sizes, shingles = nodes[~again], sizes[~again], shingles[~again]
            _, group, counts = np.unique(shingles, return_inverse=True, return_counts=True)
            df = counts[group]
            keep = df >= 2
            nodes, sizes, shingles, df = nodes[keep], sizes[keep], _identity(shingles[keep], bucket), df[keep]
        else:
            df = np.concatenate(df)
        rows = []
        for b, at in _by(np.abs(nodes % buckets)):
            own, refs = np.unique(nodes[at], return_inverse=True)
            first = np.zeros(len(own), np.int64)
            first[refs] = sizes[at]
            rows.append(_pack(b, own, first, refs, shingles[at], df[at]))
        return pa.Table.from_batches([_rows(rows)] if rows else [], schema=PACKED_ARROW)

    return run


SETS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("shared", pa.binary()), ("bins", pa.binary())])


def _bins(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of BINS parts; the smaller counts of two sets bound their overlap."""
    return np.minimum(np.bincount((mix(shingles) % np.uint64(BINS)).astype(np.int64), minlength=BINS), FULL).astype(np.uint16).tobytes()


def _sets(percent: int):
    """Per node its shared shingles, rare first, if the unshared ones leave a part of the prefix."""

    def run(table: pa.Table) -> pa.Table:
        nodes, sizes, shingles, df = [], [], [], []
        for n, s, r, h, d in _unpack(table):
            nodes.append(n[r]), sizes.append(s[r]), shingles.append(h), df.append(d)
        nodes, sizes, shingles, df = map(np.concatenate, (nodes, sizes, shingles, df))
        order = np.lexsort((shingles, df, nodes))
        nodes, sizes, shingles = nodes[order], sizes[order], shingles[order]
        again = np.zeros(len(nodes), bool)  # a node met in several tasks sends its hot shingles from each
        again[1:] = (nodes[1:] == nodes[:-1]) & (shingles[1:] == shingles[:-1])
        nodes, sizes, shingles = nodes[~again], sizes[~again], shingles[~again]
        own, starts = np.unique(nodes, return_index=True)
        out = []
        for node, at in zip(own.tolist(), np.split(np.arange(len(nodes)), starts[1:])):
            n, m = int(sizes[at[0]]), len(at)
            if n - m < prefix(n, percent):
                out.append((node, n, m, shingles[at].tobytes(), _bins(shingles[at])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SETS.types)], schema=SETS) if out else SETS.empty_table()

    return run


def prefix(n: int, percent: int) -> int:
    """So many first shingles of a set of n hold one that any linked set shares."""
    return n - -(-percent * n // 100) + 1


def needed(a, b, percent: int):
    """The least overlap of linked sets of a and b shingles: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _postings(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, m, shared = (batch.column(i).to_pylist() for i in range(4))
            parts = [np.frombuffer(s, np.int64)[:prefix(b, percent) - (b - c)] for b, c, s in zip(n, m, shared)]
            counts = np.array([len(p) for p in parts], np.int64)
            if not counts.sum():
                continue
            rep = np.repeat(np.arange(len(node)), counts)
            pos = np.arange(len(rep)) - np.repeat(np.cumsum(counts) - counts, counts)
            n, m = np.array(n, np.int64), np.array(m, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts)), pa.array(np.array(node, np.int64)[rep]), pa.array(n[rep]), pa.array((n - m)[rep] + pos)],
                names=["shingle", "node", "n", "pos"])

    return run


def _pairs(percent: int):
    """Pairs of one bucket of posting lists that pass the filters and lie in different components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("kin", "shingle", "lo", "hi", "blk", "node", "n", "pos", "component")}
        order = np.lexsort((col["n"], col["shingle"], col["hi"], col["lo"], col["kin"]))
        col = {c: v[order] for c, v in col.items()}
        nodes, where, place = np.unique(col["node"], return_index=True, return_inverse=True)
        bins = np.stack([np.frombuffer(b, np.uint16) for b in table.column("bins").take(pa.array(order[where])).to_pylist()]).astype(np.int64)
        bins[bins == FULL] = 1 << 40
        size = col["n"][where]
        new = np.ones(len(order), bool)
        new[1:] = np.any([col[c][1:] != col[c][:-1] for c in ("shingle", "lo", "hi")], axis=0)
        found: list[np.ndarray] = []
        held = 0
        for at in np.split(np.arange(len(order)), np.flatnonzero(new)[1:]):
            comp = col["component"][at]
            if len(at) < 2 or (comp == comp[0]).all():
                continue
            blk = col["blk"][at]
            left, right = (at, at) if col["lo"][at[0]] == col["hi"][at[0]] else (at[blk == col["lo"][at[0]]], at[blk == col["hi"][at[0]]])
            for i in range(0, len(left), 256):
                x = left[i:i + 256, None]
                y = right[None, :]
                n, m = col["n"][x], col["n"][y]
                good = (col["component"][x] != col["component"][y]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                good &= np.minimum(n - col["pos"][x], m - col["pos"][y]) >= needed(n, m, percent)
                p, q = np.nonzero(good)
                if len(p):
                    u, v = place[x[p, 0]], place[y[0, q]]
                    found.append(np.unique(np.minimum(u, v) * len(nodes) + np.maximum(u, v)))
                    held += len(found[-1])
                    if held > 4_000_000:
                        found = [np.unique(np.concatenate(found))]
                        held = 0
        if not found:
            return schema.empty_table()
        pairs = np.unique(np.concatenate(found))
        bound = np.concatenate([np.minimum(bins[p // len(nodes)], bins[p % len(nodes)]).sum(axis=1) for p in np.split(pairs, range(4096, len(pairs), 4096))])
        pairs = pairs[bound >= needed(size[pairs // len(nodes)], size[pairs % len(nodes)], percent)]
        return pa.Table.from_arrays([pa.array(nodes[pairs // len(nodes)]), pa.array(nodes[pairs % len(nodes)])], schema=schema)

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Upper bound of the overlap of two sorted sets: cut both at the quartiles of x and add the smaller parts."""
    marks = x[[len(x) // 4, len(x) // 2, 3 * len(x) // 4]]
    own = np.diff(np.concatenate([[0], np.searchsorted(x, marks), [len(x)]]))
    other = np.diff(np.concatenate([[0], np.searchsorted(y, marks), [len(y)]]))
    return int(np.minimum(own, other).sum())


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "sa", "sb"))):
                least = needed(n, m, percent)
                x, y = np.sort(np.frombuffer(x, np.uint64)), np.sort(np.frombuffer(y, np.uint64))
                if min(len(x), len(y)) < least or suffix_bound(x, y) < least:
                    continue
                if len(np.intersect1d(x, y, assume_unique=True)) >= least:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(tidy(_verify(percent)), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id_col, n_shingles, component_id), one for each row of `docs`.

    Words are what ASCII white space separates, A-Z lower-cased; a text's set is
    its distinct word k-grams, or its whole word sequence if it has fewer words.
    Texts link when 100 * |intersection| >= percent * |union|; component_id is the
    smallest id reachable by links.

    A null text, and one without words, has an empty set and is its own
    component.  Rows that repeat an id come out as often as they go in and share
    the smaller component.  A null id counts as no id: the row comes out with
    the component of its text's other copies, null without any.  Other columns are ignored and may have any
    name.  An empty table gives an empty result.  Sets are known by 64-bit
    digests, shingles by 48 bits of their hash within their bucket.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(plain.mapInArrow(tidy(_sizes("text", k)), "kind tinyint, id bigint, n bigint, node bigint"))
    members = rows.where("kind = 0").drop("kind")
    texts, shingles = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least_hot = max(64, texts // 1000)  # at most shingles / least_hot of them: a thousand times a text's mean
    hot = rows.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least_hot).collect()
    hot_values = np.array([r["id"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(hot_values)
    sent = spark.sparkContext.broadcast((hot_values[order], np.array([r["n"] for r in hot], np.int64)[order]))
    buckets = max(width(spark), -(-shingles // BATCH_SHINGLES))

    dealt = plain.select("text").mapInArrow(tidy(_deal("text", k, buckets, sent)), PACKED)
    shared = dealt.groupBy("bucket").applyInArrow(tidy_group(_shared(buckets)), PACKED)
    sets = cut(shared.groupBy("bucket").applyInArrow(tidy_group(_sets(percent)), "node bigint, n bigint, m bigint, shared binary, bins binary"))
    postings = cut(sets.mapInArrow(tidy(_postings(percent)), "shingle bigint, node bigint, n bigint, pos bigint"))

    def passes(n, m, p, q):
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
            F.least(n - p, m - q) >= F.ceil(F.lit(percent) * (n + m) / (100 + percent)))

    ends = postings.groupBy("shingle").agg(
        F.min(F.struct("n", "node", "pos")).alias("first"), F.max(F.struct("n", "node", "pos")).alias("last")
    ).where("first <> last")
    met = postings.join(ends, "shingle")
    hubs = [
        met.where((F.col("node") != F.col(f"{end}.node")) & passes(F.col("n"), F.col(f"{end}.n"), F.col("pos"), F.col(f"{end}.pos")))
        .select(F.least("node", f"{end}.node").alias("a"), F.greatest("node", f"{end}.node").alias("b"))
        for end in ("first", "last")
    ]
    tried = cut(hubs[0].union(hubs[1]).distinct())
    links = cut(_linked(tried, sets, percent))
    # Labels only tell which pairs need no look; the components come from the rows that hold every link.
    labels, linked = partial_components(links, rounds=2)
    component = cut(labels)

    def place() -> DataFrame:
        named = component.withColumnRenamed("id", "node")
        return cut(postings.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")))

    def open_lists(placed: DataFrame) -> DataFrame:
        seen = placed.groupBy("shingle").agg(
            F.count("*").alias("rows"), F.min(F.xxhash64("node")).alias("kin"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        return seen.where("c0 <> c1").select("shingle", "rows", "kin")

    placed = place()
    for turn in range(HUB_ROUNDS):
        # In long lists that are not one component yet some nodes, drawn by hash, meet the others;
        # a node takes part in its longest list only.
        rest = placed.join(open_lists(placed).where(F.col("rows") > LONG_LIST), "shingle")
        rest = rest.groupBy("node").agg(F.max(F.struct("rows", "shingle", "n", "pos", "component")).alias("in")).select("node", "in.*")
        drawn = F.xxhash64("node", F.lit(turn))
        hub = rest.groupBy("shingle", F.pmod(drawn, F.lit(HUBS)).alias("slot")).agg(
            F.min(F.struct(drawn.alias("drawn"), "node", "n", "pos", "component")).alias("hub"))
        met = rest.join(hub, "shingle").where(F.col("component") != F.col("hub.component"))
        met = met.where(passes(F.col("n"), F.col("hub.n"), F.col("pos"), F.col("hub.pos")))
        fresh = cut(met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            break
        found = cut(_linked(fresh, sets, percent))
        tried = tried.union(fresh)
        labels, linked = partial_components(linked.union(found), rounds=2)
        component = cut(labels)
        placed = place()

    # Lists of much the same nodes go to one bucket, so that a pair comes out of few of them; where that
    # would be too many rows, the lists are dealt to several.
    lists = open_lists(placed).withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS))
    kins = lists.groupBy("kin").agg(F.ceil(F.sum("rows") / GROUP_ROWS).alias("salts"))
    lists = cut(lists.join(kins, "kin").select("shingle", "kin", "rows", "blocks", F.pmod(F.xxhash64("shingle"), "salts").alias("salt")))
    dealt_rows = lists.agg(F.coalesce(F.sum(F.col("rows") * F.col("blocks")), F.lit(0))).first()[0]
    rest = placed.join(lists.drop("rows"), "shingle")
    rest = rest.withColumn("blk", F.pmod(F.xxhash64("node"), "blocks"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rest = rest.select("kin", "salt", "shingle", "node", "n", "pos", "component", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk")
    rest = rest.join(sets.select("node", "bins"), "node")
    groups = max(4 * width(spark), -(-dealt_rows // GROUP_ROWS))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("kin", "salt", "lo", "hi"), F.lit(groups)))
    more = rest.groupBy("bucket").applyInArrow(tidy_group(_pairs(percent)), "a bigint, b bigint").distinct().join(tried, ["a", "b"], "left_anti")
    final = linked.union(cut(_linked(more, sets, percent)))

    nodes = members.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    tree = nodes.join(connected_components(final).withColumnRenamed("id", "node"), "node", "left")
    tree = tree.withColumn("component", F.coalesce("component", "node"))
    least = tree.groupBy("component").agg(F.min("least").alias("component_id"))
    named = tree.join(least, "component").select(F.col("node").alias("own"), "component_id")
    joined = members.join(named, F.col("node") == F.col("own"), "left")
    out = joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out
