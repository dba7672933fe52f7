"""Approximate matching of short texts by edit distance, without comparing all pairs.

Texts within distance k share, of their positional q-grams, all but k * q.  So of
each text only its k * q + 1 rarest grams have to meet those of the others: an
equality join on (gram, length), in which the right side stands at every length
within k, filtered by position and by the number of grams found in common.  Where
both texts are so short that they may share no gram at all, they meet by the texts
that deleting up to k characters leaves of them.  Each pair of different texts is
verified once, inside the JVM.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.blend import renamed_side
from weftline.types import name_ref

#: Postings of one gram that meet in one task; a longer list is split on one side and repeated on the other.
HOT_POSTINGS = 20_000
#: Distinct grams up to which their frequencies are broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_GRAMS = 500_000
#: Marks in front of and behind a text, so that its ends are grams too.
HEAD, TAIL = "\u0001", "\u0002"


def _letters(text: Column, q: int) -> Column:
    """The characters of the padded text."""
    ends = [F.array_repeat(F.lit(mark), q - 1) for mark in (HEAD, TAIL)]
    return F.concat(ends[0], F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), ends[1])


def _grams(letters: Column, q: int) -> Column:
    """Positional q-grams: structs (pos, gram), one more by q - 1 than the text has characters."""
    return F.transform(F.sequence(F.lit(0), F.size(letters) - q), lambda i: F.struct((i + 1).alias("pos"), F.concat(*(F.get(letters, i + j) for j in range(q))).alias("gram")))


def _deletions(text: Column, k: int) -> Column:
    """What is left of the text after deleting up to k characters, each once."""
    out, last = F.array(text), F.array(text)
    for _ in range(k):
        shorter = F.transform(last, lambda v: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda p: p <= F.length(v)),
            lambda p: F.concat(F.substring(v, F.lit(1), p - 1), F.substring(v, p + 1, F.length(v)))))
        last = F.array_distinct(F.flatten(shorter))
        out = F.array_distinct(F.concat(out, last))
    return out


def _postings(texts: DataFrame, k: int, q: int) -> DataFrame:
    """(text, sides, size, rest, gram, pos): the rarest k * q + 1 grams of each text, and all others that equal the last of them."""
    padded = texts.withColumn("letters", _letters(F.col("text"), q))
    grams = padded.select("text", "is_left", "is_right", F.explode(_grams(F.col("letters"), q)).alias("g")).select("text", "is_left", "is_right", "g.*")
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    few = often.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    counted = grams.join(F.broadcast(often) if few else often, "gram")
    # As many entries as a text has characters meet here.
    rare = counted.groupBy("text", "is_left", "is_right").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "pos"))).alias("all"))
    last = F.get("all", F.least(F.lit(k * q), F.size("all") - 1))
    kept = F.filter("all", lambda g: (g["often"] < last["often"]) | ((g["often"] == last["often"]) & (g["gram"] <= last["gram"])))
    cut = rare.select("text", "is_left", "is_right", F.size("all").alias("n"), kept.alias("kept"))
    return cut.select(
        "text", "is_left", "is_right", F.length("text").alias("size"), (F.col("n") - F.size("kept")).alias("rest"), F.explode("kept").alias("g")
    ).select("text", "is_left", "is_right", "size", "rest", "g.gram", "g.pos")


def _by_grams(texts: DataFrame, k: int, q: int) -> DataFrame:
    """Candidate pairs (a, b) of which at least one text is long enough to share a gram for certain."""
    postings = _postings(texts, k, q)
    lists = postings.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT_POSTINGS)
    # At most postings / HOT_POSTINGS rows; others get one part.
    hot = lists.select(F.col("gram").alias("hot"), F.ceil(F.col("n") / HOT_POSTINGS).cast("int").alias("cuts"))
    placed = postings.join(hot, F.col("gram") == F.col("hot"), "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).drop("hot")
    left = placed.where("is_left").select(
        F.col("text").alias("a"), F.col("size").alias("la"), F.col("rest").alias("ra"), "gram", F.col("pos").alias("pa"),
        F.col("size").alias("meets"), F.pmod(F.xxhash64("text"), "cuts").cast("int").alias("part"))
    near = F.sequence(F.greatest(F.col("size") - k, F.lit(0)), F.col("size") + k)
    right = placed.where("is_right").select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"))
    right = right.select(
        F.col("text").alias("b"), F.col("size").alias("lb"), F.col("rest").alias("rb"), "gram", F.col("pos").alias("pb"), F.explode(near).alias("meets"), "part")
    met = left.join(right, ["gram", "meets", "part"]).where(F.abs(F.col("pa") - F.col("pb")) <= k)
    found = met.groupBy("a", "b").agg(F.count("*").alias("shared"), *(F.first(c).alias(c) for c in ("la", "lb", "ra", "rb")))
    # Grams behind the rarest can match at most as often as one text has them.
    least = F.greatest("la", "lb") + (q - 1 - k * q)
    return found.where(F.col("shared") + F.greatest("ra", "rb") >= least).select("a", "b")


def _by_deletions(texts: DataFrame, k: int, longest: int) -> DataFrame:
    """Candidate pairs of two texts of at most `longest` characters."""
    rows = texts.where(F.length("text") <= longest).select("text", "is_left", "is_right", F.explode(_deletions(F.col("text"), k)).alias("left_over"))
    left = rows.where("is_left").select(F.col("text").alias("a"), "left_over")
    return left.join(rows.where("is_right").select(F.col("text").alias("b"), "left_over"), "left_over").select("a", "b").distinct()


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_on: str, right_on: str, max_distance: int = 2, q: int = 2) -> DataFrame:
    """Rows (left_text, right_text, distance): all pairs of different-row texts whose edit distance is at most `max_distance`.

    Each pair of distinct texts comes once, equal texts with distance 0.  Inserting,
    deleting or replacing one character costs 1.  A null matches nothing; an empty
    text is a text.  An empty table gives an empty result.
    """
    if max_distance < 0 or q < 2:
        raise ValueError("fuzzy matching needs a distance of 0 or more and grams of 2 or more characters")
    k = max_distance

    def side(df: DataFrame, name: str, is_left: bool) -> DataFrame:
        text = name_ref(name).cast("string")
        return df.select(text.alias("text"), F.lit(is_left).alias("is_left")).where("text is not null")

    both = side(left, left_on, True).union(side(right, right_on, False)).groupBy("text").agg(
        F.bool_or("is_left").alias("is_left"), F.bool_or(~F.col("is_left")).alias("is_right"))
    same = both.where("is_left and is_right").select(F.col("text").alias("left_text"), F.col("text").alias("right_text"), F.lit(0).alias("distance"))
    if k == 0:
        return same
    longest = (k - 1) * q + 1
    parts = [_by_grams(both, k, q), _by_deletions(both, k, longest)]
    short = F.greatest(F.length("a"), F.length("b")) <= longest
    pairs = parts[0].where(~short).unionByName(parts[1]).where("a <> b")
    measured = pairs.withColumn("distance", F.levenshtein("a", "b", k)).where("distance >= 0")
    return same.unionByName(measured.select(F.col("a").alias("left_text"), F.col("b").alias("right_text"), "distance"))


def fuzzy_match(left: DataFrame, right: DataFrame, left_on: str, right_on: str, max_distance: int = 2, q: int = 2, distance: str = "distance") -> DataFrame:
    """Left rows joined to the right rows whose text is within `max_distance` edits.

    Columns of the right side that the left has too get the suffix `_right`; the column
    `distance` is added.  See `fuzzy_pairs`, which does not repeat copies.
    """
    pairs = fuzzy_pairs(left, right, left_on, right_on, max_distance, q)
    l, lnames = renamed_side(left, "l")
    r, rnames = renamed_side(right, "r")
    joined = l.join(pairs, F.col(lnames[left_on]).cast("string") == F.col("left_text")).join(r, F.col(rnames[right_on]).cast("string") == F.col("right_text"))
    out = [F.col(n).alias(c) for c, n in lnames.items()] + [F.col(n).alias(f"{c}_right" if c in lnames else c) for c, n in rnames.items()]
    taken = reduce(lambda names, c: names | {c}, [*lnames, *(f"{c}_right" if c in lnames else c for c in rnames)], set())
    if distance in taken:
        raise ValueError(f"column {distance!r} exists already")
    return joined.select(*out, F.col("distance").alias(distance))
