"""A corpus pipeline over `documents`: each stage works on all that its predecessor kept.

1. toxicity          drops documents whose toxic-segment score is 0.5 or more
2. near_duplicates   keeps one document of each group of near copies
3. decontamination   drops documents that hold too much of a benchmark item
4. secrets           replaces every secret by its kind; no document goes
5. tokens            encodes the texts, and decodes them again as a check

All but the last return the columns they got, the last (doc_id, n_tokens, ids,
decoded_sha256).  Rows with a null text pass through as empty texts do; a row whose
doc_id is null is a document of its own, judged as any other, and gives way to near copies
with an id (unless ids reach 2 ** 62: then it is the one that stays); rows that repeat a doc_id are one document for stage 2, of which one row
stays, and for stage 3, which drops them all if one is contaminated.  An empty
table gives an empty result at each stage, and extra columns are carried along.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import bpe
from weftline.llm.common import cut
from weftline.llm.decontaminate import contamination
from weftline.llm.jaccard import jaccard_components
from weftline.llm.queries import tokenizer_path
from weftline.llm.secrets import redact, scan_secrets
from weftline.llm.toxicity import score_toxicity, train_toxicity
from weftline.session import configure, shared_folder
from weftline.types import name_ref

#: Ids up to which a list of documents to drop is broadcast (16 bytes each); a longer one is joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Ids up to which rows without one are numbered above all others.
ROOM = 1 << 62


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is not among `dropped` (one bigint column)."""
    dropped = cut(dropped)
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")


def _numbered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """The table with an id of its own for each row without one, and the doc_id to give back in its place.

    Own ids lie above all others, so that rows with an id represent a group; only
    if ids reach ROOM do they lie below them.  The rows that get one are kept in the shared folder, so that every
    pass over them, and a task that runs again, sees the same ids.
    """
    without = docs.where("doc_id is null")
    if not without.limit(1).count():
        return docs, F.col("doc_id")
    low, high = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)).cast("bigint"), F.coalesce(F.max("doc_id"), F.lit(0)).cast("bigint")).first()
    number = F.monotonically_increasing_id()
    own = F.lit(high + 1) + number if high < ROOM else F.lit(low - 1) - number
    given = cut(without.withColumn("doc_id", own))
    known = F.col("doc_id") <= high if high < ROOM else F.col("doc_id") >= low
    back = F.when(known, F.col("doc_id")).cast(docs.schema["doc_id"].dataType)
    return docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint")).unionByName(given), back


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with names that no operator's own columns have (but for doc_id), and the map to them."""
    names = {c: c if c == "doc_id" else f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(name_ref(c).alias(n) for c, n in names.items())), names


def _back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    plain, names = _apart(docs)
    scored = score_toxicity(plain, model, text_col=names["text"], keep=tuple(n for n in names.values() if n != "doc_id"))
    return _back(scored.where("score < 0.5"), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    docs, doc_id = _numbered(docs)
    found = jaccard_components(docs)
    kept = _without(docs, found.where("doc_id <> component_id").select("doc_id").distinct())
    again = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.limit(1).count():
        one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = _without(kept, again).unionByName(one)
    return kept.select(*(doc_id.alias(c) if c == "doc_id" else name_ref(c) for c in columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    docs, doc_id = _numbered(docs)
    judged = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    kept = _without(docs, judged.where("contaminated").select("doc_id").distinct())
    return kept.select(*(doc_id.alias(c) if c == "doc_id" else name_ref(c) for c in columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = _apart(docs)
    text = names["text"]
    found = scan_secrets(plain, text_col=text, keep=tuple(n for n in names.values() if n != "doc_id"))
    found = found.withColumn("hit", F.size("spans") > 0).withColumn(text, redact(F.col(text), F.col("spans")))
    if "n_chars" in names:
        size = F.length(text).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn(names["n_chars"], F.when(F.col("hit"), size).otherwise(F.col(names["n_chars"])))
    return _back(found, names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe(docs, tokenizer_path())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens),
]

#: Trained scores, components of similarity and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents; what each keeps is written to the shared folder as Parquet."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
