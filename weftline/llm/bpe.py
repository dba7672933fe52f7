"""BPE encoding and decoding with the merges of a public tokenizer file."""
from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, tidy

#: White space in the sense of Unicode, which is what the tokenizer's \s means.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters beyond the basic plane.
WIDE = re.compile("[\U00010000-\U0010FFFF]")
#: Distinct words whose encoding a task remembers, in each of two generations.
REMEMBERED = 150_000
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1


@cache
def characters(category: str, last: int) -> str:
    """The characters of a general category up to `last`, as ranges for a character class."""
    out, start = [], None
    for i in range(last + 2):
        inside = i <= last and unicodedata.category(chr(i))[0] == category
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


def own_pattern(pattern: str, last: int = sys.maxunicode) -> re.Pattern:
    """A pattern with \\p{L}, \\p{N} and \\s spelled out, in and outside of classes, for texts with characters up to `last`.

    Classes within the basic plane are looked up in a table, others are searched range by range.
    """
    for name, members in ((r"\p{L}", characters("L", last)), (r"\p{N}", characters("N", last)), (r"\s", SPACE)):
        parts = pattern.split(name)
        done = parts[0]
        for part in parts[1:]:
            in_class = done.count("[") > done.count("]")
            done += (members if in_class else f"[{members}]") + part
        pattern = done
    return re.compile(pattern)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """A BPE model with word ends: NFC, white space folded, lower case, then words cut by the file's pattern."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed" or spec["decoder"]:
            raise ValueError("this tokenizer file asks for steps that are not supported")
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        if max(vocab.values()) > ID_MASK or any(c + e not in vocab for c in symbols for e in ("", end)):
            raise ValueError("this vocabulary is too large or lacks single bytes")
        self.byte_ids = [vocab[c] for c in symbols], [vocab[c + end] for c in symbols]
        # Pair of ids -> rank and id of what it merges to.
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left] << ID_BITS | vocab[right]] = rank << ID_BITS | vocab[left + right]
        self.pattern, self.wide_pattern = (own_pattern(split["pattern"]["Regex"], last) for last in (0xFFFF, sys.maxunicode))
        self.space = re.compile(f"[{SPACE}]+")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.strings = {i: s for s, i in (vocab | added).items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair has one.

        The symbols are a doubly linked list; a queue holds rank and place of every
        adjacent pair as it arises, in one number.  An entry whose place no longer
        holds a pair of its rank is stale and skipped when it comes up.
        """
        n = len(symbols)
        symbol = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        queue = []
        for i in range(n - 1):
            if (pair := pairs.get(symbol[i] << ID_BITS | symbol[i + 1])) is not None:
                queue.append(pair >> ID_BITS << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            pair = pairs.get(symbol[i] << ID_BITS | symbol[j])
            if pair is None or pair >> ID_BITS != entry >> 32:
                continue
            symbol[i], symbol[j] = pair & ID_MASK, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := pairs.get(symbol[i] << ID_BITS | symbol[k])) is not None:
                    heapq.heappush(queue, pair >> ID_BITS << 32 | i)
            h = before[i]
            if h >= 0 and (pair := pairs.get(symbol[h] << ID_BITS | symbol[i])) is not None:
                heapq.heappush(queue, pair >> ID_BITS << 32 | h)
        return [x for x in symbol if x >= 0]

    def word(self, word: str) -> bytes:
        """The ids of one word as little-endian unsigned 32-bit integers."""
        inner, last = self.byte_ids
        raw = word.encode()
        ids = [inner[b] for b in raw[:-1]]
        ids.append(last[raw[-1]])
        ids = self.merge(ids) if len(ids) > 1 else ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def remembered(self, word: str) -> bytes:
        """The ids of a word, from one of two generations of remembered words."""
        if (ids := self.known.get(word)) is None:
            if (ids := self.older.get(word)) is None:
                ids = self.word(word)
            if len(word) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        parts = self.added_pattern.split(text) if self.added_pattern and "<" in text else [text]
        out: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
                continue
            if not part.isascii():
                # One letter at a time: str.lower() would turn a capital sigma at a word's end into another letter.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            pattern = self.wide_pattern if WIDE.search(part) else self.pattern
            words = pattern.findall(self.space.sub(" ", part).lower())
            known = self.known
            out += [known.get(w) or self.remembered(w) for w in words]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids; the file names no decoder, so a space joins them."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_tokenizer(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Rows (id_col, n_tokens, ids, decoded), one for each row of `docs`.

    `ids` is binary: the token ids as little-endian unsigned 32-bit integers, in the
    order of the text, without special tokens added; the strings of special tokens
    in a text become their ids.  `decoded` is what the ids decode to (null with
    decoded=False).  The tokenizer file at `path` is read once, by the driver; its
    vocabulary has a fixed size and is broadcast.

    A null text is empty and has no ids.  Repeated rows come out as often as they go
    in.  Other columns are ignored.  An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for batch in slices(batches, "text", 1 << 20):
            tokenizer = tokenizer or Tokenizer(sent.value)
            ids = [tokenizer.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            text = [tokenizer.decode(i) for i in ids] if decoded else [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(text, pa.string())],
                names=["id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, n_tokens bigint, ids binary, decoded string").withColumnRenamed("id", id_col)
