"""Classes brought to exact sizes: rows left out of the larger ones, copies added to the rarer ones."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordering import CHUNK_OF_COPIES, repeat_rows
from weftline.operators.sampling import HASH_DIGITS, _hash_order
from weftline.types import name_ref

#: Classes, and bytes of their names, up to which the table of classes is broadcast.
BROADCAST_CLASSES, BROADCAST_BYTES = 100_000, 16 << 20


def resample_classes(
    df: DataFrame, field: str, sizes: int | str | Mapping[object, int], seed: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """The table with every class of `field` at an exact size.

    sizes: one number for all classes, "smallest" or "largest" for the size of the rarest or
    most common class, or a number for each class (classes that are not named keep all
    their rows; 0 drops one).  Null is a class like any other.

    A class of n rows with size s holds each row s div n times, and the s mod n rows with the
    smallest keyed digests once more, so a seed gives the same rows under any
    partitioning.  `keys` name a row's identity (default: all columns); seed 0 draws
    a new seed per call.  An empty table stays empty.

    One pass counts digest prefixes of all classes; those counts say which prefixes are
    taken whole.  Only the rows of each class's one cut prefix are ordered (a class's rows / 65,536), equal
    rows as one.
    """
    if isinstance(sizes, str) and sizes not in ("smallest", "largest"):
        raise ValueError(f"unknown size {sizes!r}")
    numbers = sizes.values() if isinstance(sizes, Mapping) else [sizes]
    if any(not isinstance(n, str) and n < 0 for n in numbers):
        raise ValueError("a size is 0 or more")
    tagged, digest = _hash_order(df, seed, keys)
    # Internal names, so that none can meet a column of the caller's.
    own = [f"c{i}" for i in range(len(df.columns))]
    rows = tagged.select(*[name_ref(c).alias(n) for c, n in zip(df.columns, own)], name_ref(digest).alias("digest"))
    rows = rows.withColumn("prefix", F.conv(F.substring("digest", 1, HASH_DIGITS), 16, 10).cast("int"))
    kind = own[df.columns.index(field)]
    counted = rows.groupBy(F.col(kind).alias("class"), "prefix").agg(F.count("*").alias("n"))
    totals = counted.groupBy("class").agg(F.sum("n").alias("total"))
    facts = totals.agg(
        F.count("*").alias("classes"), F.coalesce(F.sum(F.octet_length(F.col("class").cast("string"))), F.lit(0)).alias("bytes"),
        F.min("total").alias("smallest"), F.max("total").alias("largest")).first()
    if not facts["classes"]:
        return df
    if isinstance(sizes, Mapping):
        size = _named_size(sizes)
    else:
        size = F.lit(facts[sizes] if isinstance(sizes, str) else sizes).cast("bigint")
    # At most 65,536 rows of a class meet here.
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("class").orderBy("prefix")))
    upto = upto.withColumn("total", F.sum("n").over(Window.partitionBy("class"))).withColumn("size", size)
    upto = upto.withColumn("base", F.expr("size div total")).withColumn("rest", F.expr("size % total"))
    cuts = upto.groupBy("class", "base", "rest").agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("prefix"))).alias("cut"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("taken"),
    ).select("class", "base", "cut", (F.col("rest") - F.col("taken")).alias("left"))
    if facts["classes"] <= BROADCAST_CLASSES and facts["bytes"] <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    placed = rows.join(cuts, F.col(kind).eqNullSafe(F.col("class"))).drop("class")

    whole = placed.where("prefix <> cut or left = 0")
    whole = whole.select(*own, (F.col("base") + (F.col("prefix") < F.col("cut")).cast("int")).alias("times"))
    edge = placed.where("prefix = cut and left > 0").groupBy(*own, "digest", "base", "left").agg(F.count("*").alias("copies"))
    order = Window.partitionBy(kind).orderBy("digest", *own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("before", F.sum("copies").over(order) - F.col("copies"))
    extra = F.greatest(F.lit(0), F.least("copies", F.col("left") - F.col("before")))
    every = whole.unionByName(edge.select(*own, (F.col("base") * F.col("copies") + extra).alias("times")))
    few = every.where(f"times > 0 and times <= {CHUNK_OF_COPIES}")
    out = few.select(*own, F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select(*own)
    out = out.unionByName(repeat_rows(every.where(f"times > {CHUNK_OF_COPIES}"), "times")) if _may_repeat(sizes, facts) else out
    return out.select(*[F.col(n).alias(c) for n, c in zip(own, df.columns)])


def _named_size(sizes: Mapping[object, int]) -> Column:
    """The size of a row's class; without one, the class's own number of rows."""
    named = [F.when(F.col("class").eqNullSafe(F.lit(value)), F.lit(n).cast("bigint")) for value, n in sizes.items()]
    return F.coalesce(*named, F.col("total"))


def _may_repeat(sizes, facts) -> bool:
    """Whether a row, or the copies of one, may come out more than CHUNK_OF_COPIES times."""
    most = max(sizes.values(), default=0) if isinstance(sizes, Mapping) else facts[sizes] if isinstance(sizes, str) else sizes
    return max(most, facts["largest"]) > CHUNK_OF_COPIES
