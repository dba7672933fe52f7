"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every nine consecutive word 5-grams of a text the least hash is kept, on both
sides.  A shared span of 13 words holds nine shared 5-grams in a row, so both sides
keep the same one of them, at the same place: joining the kept hashes misses no
shared span.  Each hit is then extended: the windows of 13 item words around it are
compared word by word with the document, so the hashes only propose.

Benchmark items of fewer than 13 words are windows as a whole; where there are any,
the documents' n-grams of just those lengths are looked up as well.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import words

#: Words of a window, of a hashed gram, and grams from which the least hash is kept.
WINDOW, GRAM = 13, 5
KEEP_OF = WINDOW - GRAM + 1
#: A kept hash shares its 64 bits with the place it comes from.
PLACE_BITS = 30
#: Benchmark fingerprints up to which the benchmark side is broadcast (each under 2 kB).
BROADCAST_LIMIT = 20_000


def _grams(tokens: Column, length: int, tag: int) -> Column:
    """Hash and place of every gram of `length` words, packed into one number each."""
    count = F.size(tokens) - length

    def one(i):
        h = F.xxhash64(F.slice(tokens, i + 1, F.lit(length)), F.lit(tag))
        return F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("bigint"))

    return F.when(count >= 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def _winnow(grams: Column) -> Column:
    count = F.size(grams) - KEEP_OF
    least = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: F.array_min(F.slice(grams, i + 1, F.lit(KEEP_OF))))
    return F.when(count >= 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _hash(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _context(tokens: Column, place: Column) -> Column:
    """The words that a window holding the gram at `place` can reach."""
    return F.slice(tokens, F.greatest(place - (KEEP_OF - 1), F.lit(0)) + 1, F.lit(WINDOW + KEEP_OF - 1))


def benchmark_fingerprints(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (fp, item, q, m, win, reach, item_words): kept grams of the items, short items as one gram each."""
    base = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).withColumn("m", F.size("w")).where("m > 0")
    long = base.where(F.col("m") >= WINDOW).withColumn("grams", _grams(F.col("w"), GRAM, 0))
    long = long.select("item", "w", "m", F.explode_outer(_winnow(F.col("grams"))).alias("packed"), F.lit(WINDOW).alias("win"), F.lit(KEEP_OF - 1).alias("reach"))
    short = base.where(F.col("m") < WINDOW)
    tag = F.col("m")
    h = F.xxhash64(F.col("w"), tag)
    short = short.select("item", "w", "m", F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS), PLACE_BITS).alias("packed"), F.col("m").alias("win"), F.lit(0).alias("reach"))
    both = long.union(short).withColumn("q", _place(F.col("packed")))
    return both.select(_hash(F.col("packed")).alias("fp"), "item", "q", "m", "win", "reach", _context(F.col("w"), F.col("q")).alias("item_words"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    percent: int = 5,
) -> DataFrame:
    """Rows (id_col, n_words, n_hit, n_items, items, contaminated), one for each row of `docs`.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    A document word is hit if it lies inside an occurrence of 13 consecutive words
    of an item, or of a whole shorter item; n_items counts the items that occur,
    `items` lists their ids, sorted as strings.  contaminated: n_hit > 0 and n_hit
    is at least `percent` of n_words.

    A null or empty text has no words, a null or empty item no windows.  Repeated
    rows come out as often as they go in; items with equal texts all count.  Other
    columns of either table are ignored.  An empty benchmark leaves every document
    clean, an empty table gives an empty result.
    """
    bench = benchmark_fingerprints(items, item_col, item_text)
    short = items.select(F.size(words(F.col(item_text))).alias("m")).where((F.col("m") > 0) & (F.col("m") < WINDOW))
    lengths = [r["m"] for r in short.distinct().collect()]  # twelve values at most
    small = bench.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT

    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), words(F.col(text_col)).alias("w"))
    base = base.withColumn("grams", _grams(F.col("w"), GRAM, 0))
    looked_up = F.concat(F.array(F.lit(None).cast("bigint")), _winnow(F.col("grams")), *(_grams(F.col("w"), n, n) for n in lengths))
    rows = base.select("doc", "key", "w", F.size("w").alias("n"), looked_up.alias("kept"))
    if small:
        # explode_outer, as explode would infer a filter that works the hashes out anew inside each lambda.
        # One row without a hash stands for the document itself.
        flat = rows.select("doc", "key", "w", "n", F.explode_outer("kept").alias("packed"))
        met = flat.join(F.broadcast(bench), _hash(F.col("packed")) == F.col("fp"), "left").where("packed is null or fp is not null")
        met = met.withColumn("p", _place(F.col("packed")))
        met = met.select("doc", "key", "n", "p", "item", "q", "m", "win", "reach", "item_words", F.when(F.col("fp").isNotNull(), _context(F.col("w"), F.col("p"))).alias("near"))
    else:
        flat = rows.select("doc", "key", F.explode_outer("kept").alias("packed")).where("packed is not null")
        met = flat.join(bench, _hash(F.col("packed")) == F.col("fp")).distinct()
        met = met.select(F.col("doc").alias("d"), F.col("key").alias("k"), "packed", "item", "q", "m", "win", "reach", "item_words")
        named = base.select("doc", "key", "w", F.size("w").alias("n"))
        hits = named.dropDuplicates(["doc", "key"]).join(met, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
        hits = hits.withColumn("p", _place(F.col("packed"))).withColumn("near", _context(F.col("w"), _place(F.col("packed"))))
        columns = ["doc", "key", "n", "p", "item", "q", "m", "win", "reach", "item_words", "near"]
        itself = named.select("doc", "key", "n", *(F.lit(None).cast(t).alias(c) for c, t in hits.select(columns[3:]).dtypes))
        met = itself.union(hits.select(columns))

    def start(j):
        """Where the document's copy of the item window at j begins, if it is one."""
        s = F.col("p") - F.col("q") + j
        mine = F.slice("near", s - F.greatest(F.col("p") - (KEEP_OF - 1), F.lit(0)) + 1, F.col("win"))
        theirs = F.slice("item_words", j - F.greatest(F.col("q") - (KEEP_OF - 1), F.lit(0)) + 1, F.col("win"))
        fits = (s >= 0) & (s + F.col("win") <= F.col("n"))
        return F.when(fits, F.when(mine == theirs, s))

    first = F.greatest(F.col("q") - F.col("reach"), F.col("q") - F.col("p"), F.lit(0))
    last = F.least(F.col("q"), F.col("m") - F.col("win"))
    starts = F.when(F.col("item").isNotNull() & (last >= first), F.array_compact(F.transform(F.sequence(first, F.greatest(first, last)), start)))
    found = met.withColumn("starts", starts)
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("win") - 1)))
    found = found.select("doc", "key", "n", F.col("p").isNull().alias("itself"), F.when(F.size("starts") > 0, F.col("item").cast("string")).alias("item"), F.array_distinct(covered).alias("covered"))
    out = found.groupBy("doc", "key").agg(
        F.count(F.when(F.col("itself"), 1)).alias("copies"), F.max("n").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    hit = F.col("n_hit").cast("bigint")
    return out.select(
        F.col("doc").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items",
        ((hit > 0) & (100 * hit >= percent * F.col("n_words"))).alias("contaminated"))
