"""Secrets, licenses, URLs and BPE."""
import base64
import json
import random
import re

import numpy as np
import pytest
from llm_tools import LOWER, alnum_words
from pyspark.sql import functions as F

from weftline.llm import licenses, urls
from weftline.llm.bpe import Tokenizer, bpe, byte_symbols, read_tokenizer
from weftline.llm.queries import tokenizer_path
from weftline.llm.secrets import find_armoured, redact, scan_secrets


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def rsa_like():
    return der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * n) for k, n in enumerate((64, 3, 64, 32, 32, 32, 32, 32))))


def field(data):
    return len(data).to_bytes(4, "big") + data


KEY = base64.b64encode(rsa_like()).decode()
SSH = base64.b64encode(field(b"ssh-ed25519") + field(b"k" * 32)).decode()
TOKEN = ".".join(base64.urlsafe_b64encode(json.dumps(p).encode()).decode().rstrip("=") for p in ({"alg": "HS256", "typ": "JWT"}, {"sub": "x" * 20})) + ".c2lnbmF0dXJl"
ARMOURED = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(KEY[i:i + 64] for i in range(0, len(KEY), 64)) + "\n-----END RSA PRIVATE KEY-----"


def test_structures_are_confirmed(spark):
    broken = base64.b64encode(rsa_like()[:-5]).decode()
    rows = [
        (1, f"é {KEY} end"), (2, broken), (3, f"ssh-ed25519 {SSH} me"), (4, f"x {TOKEN} y"), (5, TOKEN.replace(TOKEN[:8], "eyJxxxxx")),
        (6, ARMOURED), (7, "-----BEGIN RSA PRIVATE KEY-----"), (8, "text -----END RSA PRIVATE KEY-----"), (9, rsa_like().hex()), (10, None), (11, ""),
        (6, ARMOURED), (12, "password = 'hunter22' and token:abc, API_KEY=\"q/w+e-r\""), (13, "AKIA" + "B7" * 8 + " AKIASHORT"), (14, "x" * 200000 + " secret=abcdefg"),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, spans int")
    got = {(r["doc_id"]): [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in scan_secrets(df).collect()}
    assert got[1] == [("der", 2, 2 + len(KEY))] and got[2] == [] and got[3] == [("ssh", 12, 12 + len(SSH))]
    assert got[4] == [("jwt", 2, 2 + len(TOKEN))] and got[5] == []
    assert ("armour", 0, len(ARMOURED)) in got[6] and got[7] == [] == got[8] == got[10] == got[11]
    assert [s[0] for s in got[9]] == ["hex", "der"]
    assert [s[0] for s in got[12]] == ["assign", "assign"] and got[13] == [("access", 0, 20)] and got[14] == [("assign", 200001, 200015)]
    assert scan_secrets(df).count() == len(rows) and scan_secrets(df.limit(0)).collect() == []


def test_armour_between_unended_headers():
    header = "-----BEGIN RSA PRIVATE KEY-----\n"
    many = header * 100_000
    assert find_armoured(many) == []
    assert find_armoured(many + ARMOURED + "\n" + many) == [(len(many), 3, len(many) + len(ARMOURED))]
    assert find_armoured(ARMOURED.replace("END RSA", "END EC")) == []
    assert find_armoured(ARMOURED + ARMOURED) == [(0, 3, len(ARMOURED)), (len(ARMOURED), 3, 2 * len(ARMOURED))]
    assert find_armoured(header[:-1] + "END RSA PRIVATE KEY-----") == []


def test_escaped_line_ends_and_upper_case_hex(spark):
    escaped, upper = ARMOURED.replace("\n", "\\n"), rsa_like().hex().upper()
    rows = spark.createDataFrame([(1, f"{{'key': '{escaped}'}}"), (2, f"x {upper} y"), (3, upper[:-2])], "doc_id bigint, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in scan_secrets(rows).collect()}
    assert ("armour", 9, 9 + len(escaped)) in got[1] and ("der", 2, 2 + len(upper)) in got[2]
    assert "der" not in [s[0] for s in got[3]]


def test_base_patterns_against_plain_search(spark):
    rng = random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "apikey", "api_key", "=", ":", " ", "'", '"', "abc", "DEF123", "a/b+c=", "AKIA", "ABCD1234", "0af", "deadbeef" * 4, "ſecret", "K", "\n", "é"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(400)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        assign = [m.span() for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", text.translate(low)) if len(m[2]) >= 6]
        access = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        hexes = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        want = sorted([(a, 0, "assign", b) for a, b in assign] + [(a, 1, "access", b) for a, b in access] + [(a, 2, "hex", b) for a, b in hexes])
        assert [s for s in got[i] if s[0] in ("assign", "access", "hex")] == [(k, a, b) for a, _, k, b in want]


def test_redaction(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "é token=abcdef123 x " + "0af" * 9 + " end"), (2, "clean"), (3, None), (4, "secret=" + "ab" * 20)], "doc_id bigint, text string")
    found = scan_secrets(df, keep=("text",)).select("doc_id", redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in found} == {1: "é [assign] x [hex] end", 2: "clean", 3: None, 4: "[assign]"}


def test_licenses(spark, prose):
    texts = [
        None, "", prose(1, 50), "Released under the MIT License.", "x under the mit license under the MIT-license y", "Apache License, Version 2.0", "CC BY-NC 4.0 and cc by nc",
        "This work is licensed under the GNU General Public License, version 3.", "the GNU general public", prose(2, 2000) + " under the mit license " + prose(3, 10),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit", "under the", "under the mit license",
    ]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(13, texts[13], 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word int")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        w = alnum_words(text)
        places = [(k, label) for p, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), sorted({x[1] for x in places})), text
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert got[7]["labels"] == ["gpl-3"] and got[8]["labels"] == [] and "mit" in got[10]["labels"] and got[10]["base_labels"] == [] and got[11]["labels"] == []
    assert licenses.scan_licenses(df).count() == len(rows) and licenses.scan_licenses(df.limit(0)).collect() == []


def test_licenses_of_a_notice_file(spark, prose):
    """Each of four notices in one text keeps its label, whatever license words stand around them."""
    notices = {t[0]: t[1] for t in licenses.TEMPLATES if t[0] in ("apache-2", "gpl-3", "bsd-3")} | {"mit": licenses.TEMPLATES[0][1]}
    both = " ".join(prose(60 + i, 40) + " " + t for i, t in enumerate(notices.values()))
    rows = [(1, both), (2, notices["gpl-3"] + " " + " ".join(licenses.VOCABULARY))] + [(10 + i, prose(80 + i, 30)) for i in range(30)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["labels"] == sorted(notices) and "gpl-3" in got[2]["labels"]
    assert all(r["labels"] == [] for i, r in got.items() if i >= 10)


RULES_AS_STATED = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def stated(url):
    """(host, path, rule, verdict) by the rules as stated, read literally."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, tail = rest.partition("/")
    host, path = host.translate(LOWER), slash + tail
    fits = []
    for verdict, rule in RULES_AS_STATED:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    """Rules, ties between rules, hosts and paths against a plain reading; pages without a rule by the rate of all labelled pages."""
    hosts = ["org", "A.Example.ORG", "example.org", "notexample.org", "b.com", "com", "h.net", "", "x.example.org:80", "user@c.com", "10.0.0.1"]
    paths = ["", "/", "/es/", "/es", "/ES/x", "/en/1", "/en/19", "/en/2", "/fr", "/fr/", "/free", "/fr/a/b", "/de", "/de/x", "/demo", "/deutsch", "//de/"]
    urls_in = [f"{s}://{h}{p}{e}" for h in hosts for p in paths for s, e in (("http", ""), ("x", "?q=/de/"), ("http", "#/fr/"))]
    urls_in += [None, "", "no scheme", "a://b://c/d", "://?x", "http://h.net#a/b", "http:/a.com/de/", "é://É.com/fr/é"]
    rows = [(i, u, "h") for i, u in enumerate(urls_in)] + [(0, urls_in[0], "h"), (None, "http://a.com/de/x", "h"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([("good.net", 0)], "host string, bad int")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, outcomes=outcomes).collect()), key=str)
    want = [(i, *stated(u)) for i, u, _ in rows]
    assert got == sorted(((*w[:4], w[4] or "allow") for w in want), key=str)
    assert {w[3] for w in want} == {None, *(r for _, r in RULES_AS_STATED)} and stated("http://a.com/free")[2] is None and stated("http://b.com/demo")[2] is None
    assert urls.judge_urls(df.limit(0)).collect() == []


def test_rules_of_equal_length_and_suffix_lists(spark):
    """Of rules of equal length the first by verdict, host and prefix counts last; the longest suffix of the list is the suffix."""
    df = spark.createDataFrame([("http://ab.c/de/f",), ("http://x.y.gov.uk/",), ("http://y.gov.uk",), ("http://gov.uk",), ("http://a.b.nhs.gov.uk",)], "url string")
    host, path = urls.host_and_path(F.col("url"))
    rules = (("allow", "c", "/de/f"), ("block", "ab.c", "/de"))
    suffixes = ("gov.uk", "nhs.gov.uk", "co.uk")
    names = [d.alias(n) for d, n in zip(urls.domain_levels(host, suffixes), ("domain", "suffix"))]
    got = df.select(urls.matching_rule(host, path, rules).alias("hit"), *names).collect()
    assert tuple(got[0].hit) == ("ab.c/de", "block") and got[1].hit is None
    assert [(r.domain, r.suffix) for r in got] == [("ab.c", "c"), ("y.gov.uk", "gov.uk"), ("y.gov.uk", "gov.uk"), ("gov.uk", "gov.uk"), ("b.nhs.gov.uk", "nhs.gov.uk")]


def test_reputation_shrinks(spark):
    """A host with many bad pages is blocked, one with a single bad page only if its domain is bad too."""
    bad = [("a.bad.net", 1)] * 60 + [("b.bad.net", 1)] * 3 + [("one.good.net", 1)] + [("two.good.net", 0)] * 60 + [("x.fine.net", 0)] * 60 + [(None, 1), ("", 1), ("q.net", None)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(("a.bad.net", "b.bad.net", "c.bad.net", "one.good.net", "x.fine.net", "new.net", "10.0.0.1"))], "page_id bigint, url string")
    got = [r["verdict"] for r in urls.judge_urls(pages, outcomes=spark.createDataFrame(bad, "host string, bad int")).orderBy("page_id").collect()]
    assert got[0] == got[1] == "block" and got[3:] == ["allow"] * 4


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer as Library

    library = Library.from_file(tokenizer_path())
    rng = random.Random(1)
    texts = ["", "A ΣΑΣ İstanbul  ﬁ ½²³ ' 's're <|endoftext|>x<|startoftext|>", "x" * 300, "ab" * 2000, "don't I'LL 'll'd _-_ ٠١", "a\x1cb\x85c", "👨\u200d👩 ok", "日本語テキスト", "Ω K ß ẞ"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x400, 0x44F), rng.randint(0x4E00, 0x4E40)])) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(999, None, 0), (0, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = bpe(df, tokenizer_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(texts[r["doc_id"]] if r["doc_id"] < 999 else "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe(df.limit(0), tokenizer_path()).collect() == []


def test_merges_skip_stale_entries():
    spec = read_tokenizer(tokenizer_path())
    bytes_only = [c + e for e in ("", "</w>") for c in byte_symbols()]
    model = {**spec["model"], "vocab": {t: i for i, t in enumerate([*bytes_only, "ab", "bc", "abc", "aa"])}, "merges": [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "a"]]}
    own = Tokenizer({**spec, "model": model, "added_tokens": []})
    ids = [model["vocab"][c] for c in "abcaaab"]
    assert [own.strings[i] for i in own.merge(ids)] == ["abc", "aa", "ab"]
    with pytest.raises(ValueError):
        Tokenizer({**read_tokenizer(tokenizer_path()), "decoder": {"type": "x"}})
