"""The pipeline against a plain version of its decisions, and its entry in the registry."""
import random

import numpy as np
from llm_tools import alnum_words
from test_decontaminate import brute as contaminated
from test_jaccard import brute as grouped

import __spark_entry__ as entry
import corpus_pipeline
from weftline.llm.queries import tokenizer_path
from weftline.llm.secrets import find_armoured, find_secrets

BAD = ("idiot", "clown", "scum")


def folder(spark, prose, path):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(160):
        words = prose(i, 30 + i % 50, 3000).split()
        if i % 4 == 0:
            for _ in range(8):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 4 == 0)))
    items = [(i, prose(7000 + i, 20)) for i in range(6)]
    docs += [(1000 + i, t, "en", "s0") for i, (_, t, *_) in enumerate(docs[:12])]
    docs += [(1100 + i, prose(8000, 200, 3000).replace("w1", "w2", i), "de", None) for i in range(9)]
    docs += [(1200 + i, prose(8100 + i, 30) + " " + items[i][1] + " end", "fr", "s1") for i in range(6)]
    docs += [(1300, None, "en", "s1"), (1301, "", None, "s1"), (1302, prose(3, 40) + " password=abcdef12345 AKIA" + "B" * 16 + " end", "en", "s1"), (1303, prose(8200, 20000), "en", "s2")]
    frame = spark.createDataFrame([(*d, None if d[1] is None else len(d[1])) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def test_stages_against_plain_versions(spark, prose, tmp_path):
    from tokenizers import Tokenizer

    docs, items = folder(spark, prose, tmp_path)
    texts = {d[0]: d[1] for d in docs if not set(alnum_words(d[1])) & set(BAD)}
    texts = {i: texts[i] for i, _, c in grouped(list(texts.items())) if i == c}
    hit = {r[0] for r in contaminated(list(texts.items()), items) if r[-1]}
    assert len(hit) == 6
    texts = {i: t for i, t in texts.items() if i not in hit}
    library = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, t in texts.items():
        out, at = "", 0
        for a, kind, b in sorted(find_secrets(t or "") + find_armoured(t or "")):
            if a >= at:
                out += t[at:a] + ("[assign]" if kind == 0 else "[access]")
            at = max(at, b)
        want[i] = library.encode(out + (t or "")[at:], add_special_tokens=False).ids
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got} == want and len(got) == len(want)


def test_stages_with_odd_rows(spark, prose, tmp_path):
    """Nulls, repeated ids and an extra column go through every stage; an empty table stays empty."""
    folder(spark, prose, tmp_path)
    rows = [(1, prose(1, 30), "a"), (1, prose(1, 30), "b"), (None, prose(2, 30), "c"), (2, prose(2, 30), "d"), (None, None, "e"), (None, prose(4, 9), "f"), (3, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, score string, spans int, `column1` int, `a.b` int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert name == "tokens" or docs.columns == before
        if name == "near_duplicates":
            kept = sorted((r["doc_id"], r["score"]) for r in docs.collect() if r["doc_id"] is not None and r["text"])
            assert kept in ([(1, "a"), (2, "d")], [(1, "b"), (2, "d")]) and docs.where("doc_id is null").count() == 2
    assert docs.count() == 5


def test_rows_without_an_id_are_judged(spark, prose, tmp_path):
    """Near copies and contaminated texts go whether or not they have an id; each null row counts for itself."""
    _, items = folder(spark, prose, tmp_path)
    long, other = prose(11, 90), prose(12, 90)
    near = " ".join([*long.split()[:-1], "changed"])
    dirty = prose(13, 40) + " " + items[0][1]
    rows = [(None, near, "a"), (5, long, "b"), (None, other, "c"), (None, other, "c2"), (None, dirty, "d"), (9, dirty + " and more", "e"), (None, None, "f"), (None, None, "g")]
    for high in (100, 2**62 + 5):
        docs = spark.createDataFrame([*rows, (high, prose(14, 30), "h")], "doc_id bigint, text string, tag string")
        kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        tags = {(r["doc_id"], r["tag"]) for r in kept.collect()}
        one = {t for t in tags if t[1] in ("c", "c2")}
        of_group = {(5, "b"), (9, "e")} if high == 100 else {(None, "a"), (None, "d")}
        assert len(one) == 1 and tags - one == {*of_group, (None, "f"), (None, "g"), (high, "h")}
        clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
        assert {(r["doc_id"], r["tag"]) for r in clean} == {(None, "a"), (5, "b"), (None, "c"), (None, "c2"), (None, "f"), (None, "g"), (high, "h")}


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names if n.startswith("op")}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
