"""License scan by a positional index of rare license words, with DataFrame functions only.

The index holds, for every word of the license texts below, where it stands in
which of them.  All license words of a document are looked up, so that the words of
one license never push out another's.  Looked-up words that keep their distance
within a license text vote for one and the same shift; a shift with enough of the
weight of the license's rarest words proposes the license, and its mandatory phrase
must then stand in the document.
"""
from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import words

#: Fixed phrases that are reported wherever they stand: (phrase, label).
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: (label, notice or opening of the license, phrase that must stand in the document).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "Released under the MIT License", "mit license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache license version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3", "gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided", "redistribution and use in source and binary forms"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", "cc0 1 0"),
)
#: Words that say nothing of a license.
COMMON = frozenset("a and any are as at be by for in into is it of on or that the this to under use used with without you may not v 0 1 2 3 4".split())
#: A license weighs what so many of its rarest words weigh; the share of that weight that a shift must gather.
RAREST, LEAST_SHARE = 12, 0.6


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


POSTINGS = [(word, t, at) for t, (_, text, _) in enumerate(TEMPLATES) for at, word in enumerate(tokens_of(text)) if word not in COMMON]
VOCABULARY = sorted({p[0] for p in POSTINGS})


def word_weights(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of every license word over all documents (one number a word reaches the driver)."""
    texts = docs.select(words(F.col(text_col)).alias("w"))
    present = F.array_intersect(F.concat(F.col("w"), F.array(F.lit("").cast("string"))), _strings([*VOCABULARY, ""]))
    # The empty word stands for the document itself.
    rows = texts.select(F.explode_outer(present).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) for w in VOCABULARY}


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _places(w: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    parts = phrase.split()
    last = F.size(w) - len(parts)

    def fits(i):
        same = F.element_at(w, i + 1) == parts[0]
        for k, part in enumerate(parts[1:], 2):
            same = same & (F.element_at(w, i + k) == part)
        return same

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), fits))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score), one for each row of `docs`.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    n_base counts the places of BASE_PHRASES, first_word and last_word are their
    least and greatest first word (null without any); base_labels and labels are
    sorted arrays, labels with those that the index adds.  score is the largest
    share of a license's weight found at one shift, 1 with a base phrase, 0 without
    a confirmed license.

    A null or empty text has no words and no labels.  Repeated rows come out as
    often as they go in.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    weights = word_weights(docs, text_col)
    full = {t: sum(sorted((weights[w] for w, x, _ in POSTINGS if x == t), reverse=True)[:RAREST]) for t in range(len(TEMPLATES))}
    postings = spark.createDataFrame([(w, t, at, weights[w] / full[t]) for w, t, at in POSTINGS], "word string, template int, at int, share double")

    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), words(F.col(text_col)).alias("w"))
    base = base.withColumn("present", F.array_intersect(F.col("w"), _strings(VOCABULARY))).withColumn("n", F.size("w"))
    some = F.size("present") > 0
    joined = F.when(some, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    base = base.withColumn("joined", joined)
    for i, (phrase, _) in enumerate(BASE_PHRASES):
        base = base.withColumn(f"base{i}", F.when(F.col("joined").contains(f" {phrase} "), _places(F.col("w"), phrase)))
    phrases = sorted({t[2] for t in TEMPLATES})
    base = base.withColumn("phrases", F.when(some, F.array_compact(F.array(*(F.when(F.col("joined").contains(f" {p} "), F.lit(p)) for p in phrases)))))
    marks = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("place"), x.alias("word"))), lambda s: F.array_contains(F.col("present"), s["word"]))
    itself = F.struct(F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("word"))
    marks = F.when(F.size("phrases") > 0, F.concat(F.array(itself), marks)).otherwise(F.array(itself))
    # Each document goes on as one row for itself and one for each license word, all to one task.
    rows = base.select("doc", "key", "n", "base0", "base1", "base2", "phrases", F.explode_outer(marks).alias("mark"))
    rows = rows.withColumn("word", F.col("mark.word")).join(F.broadcast(postings), "word", "left").where("word is null or template is not null")
    own = F.col("word").isNull()
    rows = rows.select("doc", "key", "template", (F.col("mark.place") - F.col("at")).alias("shift"), "at", "share", "phrases",
                       F.when(own, F.struct("n", "base0", "base1", "base2")).alias("base"))
    rows = rows.repartition("doc", "key")
    label = F.element_at(_strings(t[0] for t in TEMPLATES), F.col("template") + 1)
    phrase = F.element_at(_strings(t[2] for t in TEMPLATES), F.col("template") + 1)
    # Within one shift a place of the license is one place of the document, so shares add up once.
    shifts = rows.groupBy("doc", "key", "template", "shift").agg(
        F.sum("share").alias("share"), F.first("phrases").alias("phrases"), F.count("base").alias("copies"), F.max("base").alias("base"))
    good = F.col("template").isNotNull() & (F.col("share") >= LEAST_SHARE) & F.array_contains("phrases", phrase)
    shifts = shifts.select("doc", "key", "copies", "base", F.when(good, label).alias("label"), F.when(good, F.least("share", F.lit(1.0))).alias("share"))
    out = shifts.groupBy("doc", "key").agg(F.sum("copies").alias("copies"), F.max("base").alias("base"), F.collect_set("label").alias("found"), F.max("share").alias("share"))
    places = F.flatten(F.array_compact(F.array(*(F.col(f"base.base{i}") for i in range(len(BASE_PHRASES))))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"base.base{i}") > 0, F.lit(x)) for i, (_, x) in enumerate(BASE_PHRASES))))
    out = out.select("doc", "copies", F.col("base.n").alias("n"), places.alias("places"), F.sort_array(base_labels).alias("base_labels"), "found", "share")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select(
        F.col("doc").alias(id_col), F.col("n").cast("bigint").alias("n_words"), F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        "base_labels", F.sort_array(F.array_union("base_labels", "found")).alias("labels"), score.alias("score"))
