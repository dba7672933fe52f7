"""Secret scan: fixed patterns, then candidates whose decoded structure confirms them."""
from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, tidy

#: Fixed patterns, in the order in which their kinds are listed.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: What may be encoded: runs of base64 or base64url characters, dotted tokens, and armoured blocks.
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)(?=-----)")
ARMOURED = re.compile(r"[A-Za-z0-9+/=\s:,-]*(?:\\[nr][A-Za-z0-9+/=\s:,-]*)*")
HEADER_LINE = re.compile(r"(?m)^[A-Za-z-]+:.*$")
#: Hex digits of either case, long enough for a key.
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40,}")
#: Base kinds, then those that a decoded structure confirms.
KINDS = ("assign", "access", "hex", "armour", "der", "ssh", "jwt")
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
SSH_MAGIC = b"openssh-key-v1\0"


def decoded(text: str) -> bytes | None:
    """What a base64 or base64url text decodes to; surplus characters at the end make it no encoding."""
    text = text.rstrip("=").translate({0x2D: "+", 0x5F: "/"})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly, else None."""
    parts = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > end:
                return None
            size, at = int.from_bytes(data[at:at + count], "big"), at + count
        if at + size > end:
            return None
        parts.append((tag, at, at + size))
        start = at + size
    return parts


def is_der_key(data: bytes) -> bool:
    """Whether bytes are a private key in DER: one sequence over all of them that holds a small version number
    and then a key's integers, an algorithm with an object identifier, or a key string; all nested lengths fit."""
    outer = der_parts(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_parts(data, outer[0][1], outer[0][2])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 3:
        return False
    kinds = [p[0] for p in parts[1:]]
    if kinds[0] == 0x30:  # algorithm and wrapped key
        inner = der_parts(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06 and len(kinds) > 1 and kinds[1] == 0x04
    if kinds[0] == 0x04:  # elliptic curve
        return 16 <= parts[1][2] - parts[1][1] <= 80
    return len(kinds) >= 5 and set(kinds) == {0x02}  # the integers of a key


def is_ssh_key(data: bytes) -> bool:
    """Whether bytes are an SSH key: the private key's magic, or length-prefixed fields that start with a key type and fill them."""
    if data.startswith(SSH_MAGIC):
        return True
    at, fields = 0, []
    while at < len(data):
        if at + 4 > len(data) or len(fields) > 32:
            return False
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and fields[0] in SSH_NAMES


def is_signed_token(token: str) -> bool:
    """Whether the first two dotted parts decode to JSON objects and the header names an algorithm."""
    header, body, _ = token.split(".")
    try:
        first, second = (json.loads(decoded(p) or b"") for p in (header, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(second, dict) and isinstance(first.get("alg"), str)


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end) of all secrets that keep to a line, sorted; ends are exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]

    def confirm(data: bytes, start: int, end: int) -> None:
        if is_der_key(data):
            found.append((start, 4, end))
        elif is_ssh_key(data):
            found.append((start, 5, end))

    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0:
            confirm(bytes.fromhex(m[0]), m.start(), m.end())
    for m in ENCODED.finditer(text):
        if data := decoded(m[0]):
            confirm(data, m.start(), m.end())
    found += [(m.start(), 6, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    return sorted(found)


def find_armoured(text: str) -> list[tuple[int, int, int]]:
    """As find_secrets, for the armoured private keys of one text."""
    found = []
    if "-----BEGIN " not in text:
        return found
    opened = None
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            opened = m
            continue
        # A key holds neither headers nor ends, so only the nearest header counts, and no text is looked at twice.
        begin, opened = opened, None
        if begin is None or begin[2] != m[2] or begin.end() + 5 > m.start() or not ARMOURED.fullmatch(text, begin.end() + 5, m.start()):
            continue
        lines = text[begin.end() + 5:m.start()].replace("\\n", "\n").replace("\\r", "\n")
        body = decoded("".join(HEADER_LINE.sub("", lines).split()))
        if body and (is_der_key(body) or is_ssh_key(body) or m[2].startswith("ENCRYPTED") and der_parts(body, 0, len(body))):
            found.append((begin.start(), 3, m.end() + 5))
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, spans), one for each row of `docs`; spans is array<struct<kind, start, end>>.

    Kinds are those of KINDS, in whose order spans with one start are sorted; start
    and end count code points, end is exclusive.  The fixed patterns match leftmost
    and without overlap within a kind.  The other kinds are reported only where the
    decoded bytes parse to their end: private keys in DER with nested lengths (bare
    or armoured), SSH keys, signed tokens with a JSON header that names an algorithm.

    A null or empty text has no spans.  Repeated rows come out as often as they go
    in.  Columns other than the named ones are dropped.  An empty table gives an
    empty result.  Texts are scanned some megabytes at a time, joined by line feeds,
    which only armoured blocks can cross: those are looked for text by text.
    """
    names = [id_col, *keep]
    kinds = [docs.schema[n].dataType.simpleString() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            starts, at = [], 0
            for t in texts:
                starts.append(at)
                at += len(t) + 1
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for start, kind, end in find_secrets("\n".join(texts)):
                i = bisect_right(starts, start) - 1
                spans[i].append((start - starts[i], kind, end - starts[i]))
            listed = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(s + find_armoured(t))] for s, t in zip(spans, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(listed, pa.list_(span))], names=[*(f"k{j}" for j in range(len(names))), "spans"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), *(F.col(n).alias(f"k{j}") for j, n in enumerate(names)))
    schema = ", ".join(f"k{j} {kind}" for j, kind in enumerate(kinds))
    out = rows.mapInArrow(tidy(run), f"{schema}, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return out.select(*(F.col(f"k{j}").alias(n) for j, n in enumerate(names)), "spans")


def redact(text, spans):
    """Column: the text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise((b["end"] - a["end"]).cast("int")))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["done"], mark).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, lambda acc: F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))).otherwise(text)
