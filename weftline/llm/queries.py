"""The registered queries of this subpackage, each over its whole table."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import sql
from weftline.llm.bpe import bpe
from weftline.llm.conversations import damaged, fold_pieces, repair_conversations
from weftline.llm.decontaminate import contamination
from weftline.llm.embeddings import embedding_links
from weftline.llm.jaccard import jaccard_components
from weftline.llm.labelled import fold
from weftline.llm.language import predict_language, train_language
from weftline.llm.licenses import scan_licenses
from weftline.llm.quality import score_quality, train_quality
from weftline.llm.runs import find_runs, with_planted_runs
from weftline.llm.secrets import KINDS, scan_secrets
from weftline.llm.toxicity import score_toxicity, train_toxicity
from weftline.llm.urls import judge_urls
from weftline.llm.warc import assemble, payload, read_warc, write_warc
from weftline.session import configure, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


@query("op2_winnowing_decontamination", sql.DECONTAMINATE)
def op2(spark, table):
    judged = contamination(table("documents"), table("benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op3_structural_secrets")
def op3(spark, table):
    found = scan_secrets(table("documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(of(*KINDS[:3])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op4_toxic_segments")
def op4(spark, table):
    docs, part = table("documents"), fold("doc_id", 5)
    scored = score_toxicity(docs, train_toxicity(docs, table("labels"), part != 0))
    return scored.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_rare_token_licenses")
def op5(spark, table):
    found = scan_licenses(table("documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query("op6_ppm_language")
def op6(spark, table):
    docs, part = table("documents"), fold("doc_id", 3)
    scored = predict_language(docs, train_language(docs, part != 1))
    return scored.select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")


@query("op7_host_reputation", sql.URLS)
def op7(spark, table):
    return judge_urls(table("pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op8_ngram_jaccard_join")
def op8(spark, table):
    return jaccard_components(table("documents"))


def tokenizer_path() -> str:
    """The public tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_embedding_grid_join")
def op1(spark, table):
    return embedding_links(table("embeddings"))


@query("op9_bpe_round_trip")
def op9(spark, table):
    coded = bpe(table("documents"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op10_naive_bayes_support_vectors")
def op10(spark, table):
    docs, part = table("documents"), fold("doc_id", 4)
    scored = score_quality(docs, train_quality(docs, table("labels"), part != 2))
    return scored.select("doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op11_warc_transactions", sql.WARC)
def op11(spark, table):
    pages = table("pages")
    folder = shared_folder(spark, f"warc-{uuid.uuid4().hex}")
    write_warc(pages, folder)
    captures = assemble(read_warc(spark, folder))
    told = F.col("metadata")[0]["block"].cast("string")
    body = payload(F.col("response.block"))
    stored = F.col("response.record_type") == "response"
    kind = pages.schema["page_id"].dataType
    named = lambda text: F.nullif(text, F.lit("")).cast(kind)
    return captures.select(
        named(F.regexp_extract(told, r"pageId: ([^\r\n]*)", 1)).alias("page_id"),
        F.when(stored, F.octet_length(body)).otherwise(F.regexp_extract(told, r"payloadLength: (\d+)", 1)).cast("bigint").alias("payload_bytes"),
        F.when(stored, F.sha1(body)).otherwise(F.substring_index("response.payload_digest", ":", -1)).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        named(F.replace("response.refers_to", F.lit("urn:page:"), F.lit(""))).alias("refers_to"))


@query("op12_periodic_runs")
def op12(spark, table):
    found = find_runs(with_planted_runs(table("documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    top = found.withColumn("best", best).withColumns({"start": F.col("best.start"), "length": -F.col("best.col1"), "period": F.col("best.period")})
    return top.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "start", "length", "period", F.floor(F.lit(1000) * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_conversation_repair")
def op13(spark, table):
    return fold_pieces(repair_conversations(damaged(table("conversations").select("conv_id", "turn", "role", "text"))))
