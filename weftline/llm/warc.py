"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records: the request, the response (or a revisit of an
earlier response with the same payload) and metadata about both.  Request and
metadata name the response in WARC-Concurrent-To.  Records are rows of text that end
in two line ends, so Spark's own text writer lays the archives down in any store.
Reading parses each archive by its content lengths; assembly joins the records of a
transaction through their concurrent-to identifiers, in whichever direction they
point, and emits one nested row per capture.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut

#: Payloads of fewer bytes are stored again rather than revisited.
LEAST_REVISIT = 1000
#: Bytes of text that one archive aims at; the records of one file are counted from the mean size.
ARCHIVE_BYTES = 128 << 20
#: Repeated payloads up to which their table is broadcast (about 60 bytes each); a longer one is joined by a shuffle.
BROADCAST_PAYLOADS = 500_000
#: Records of one Arrow batch hold about so many bytes.
BATCH_BYTES = 4 << 20

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

RECORD = ("record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
          "payload_digest string, content_type string, block binary")


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines of those pairs that have a value."""
    return F.concat_ws("\r\n", *(F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in pairs))


def _record(kind: Column | str, rid: Column, block: Column, *more: tuple[str, Column | str]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    named = _headers(("WARC-Type", kind), ("WARC-Record-ID", rid), *more, ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit("WARC/1.1\r\n"), named, F.lit("\r\n\r\n"), block)


def _line(text: Column) -> Column:
    """Text that stands on one header line: white space and control characters are percent-encoded."""
    odd = F.regexp_extract_all(text, F.lit(r"[\x00-\x20\x7F]"), F.lit(0))
    plain = F.aggregate(F.array_distinct(odd), text, lambda acc, c: F.replace(acc, c, F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))))
    return F.when(text.rlike(r"[\x00-\x20\x7F]"), plain).otherwise(text)


def _numbered(pages: DataFrame) -> DataFrame:
    """Add `rid`, a record identifier of each row's own: the page's id, and a number where several rows share it."""
    again = pages.groupBy("id").count().where("count > 1").select(F.col("id").alias("again"))
    first = F.concat(F.lit("urn:page:"), _line(F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    if not again.limit(1).count():
        return pages.withColumn("rid", first)
    same = F.col("id").eqNullSafe(F.col("again"))
    # A written table, so that a repeated task gives the rows the same numbers.
    repeated = cut(pages.join(again, same, "left_semi")).withColumn("rid", F.concat(first, F.lit(":"), F.monotonically_increasing_id()))
    return pages.join(again, same, "left_anti").withColumn("rid", first).unionByName(repeated)


def capture_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """The WARC records of all captures, one a row in the column `value`.

    Of the pages with one payload of at least `least` bytes that with the largest id
    becomes a response; the others become revisits that refer to it.  Smaller ones
    are responses.  A null payload is empty, a null url leaves out its lines.  Rows
    with a null id are captures of their own; among equal payloads they revisit the
    one with an id, or are responses if there is none.  Rows that repeat the largest
    id are responses.  Other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    # The second hash keeps apart payloads that were made to share a digest.
    rows = rows.withColumn("check", F.xxhash64("payload"))
    large = rows.where(F.col("size") >= least)
    groups = large.groupBy("digest", "check").agg(F.max("id").alias("chosen"), F.count("*").alias("copies"))
    shared = groups.where("copies > 1 and chosen is not null").select(F.col("digest").alias("of_digest"), F.col("check").alias("of_check"), "chosen")
    shared = cut(shared)
    if shared.count() <= BROADCAST_PAYLOADS:
        shared = F.broadcast(shared)
    same = (F.col("digest") == F.col("of_digest")) & (F.col("check") == F.col("of_check")) & (F.col("size") >= least)
    told = _numbered(rows).join(shared, same, "left")
    revisit = F.col("chosen").isNotNull() & ~F.col("id").eqNullSafe(F.col("chosen"))
    made = told.withColumn("origin", F.when(revisit, F.concat(F.lit("urn:page:"), _line(F.col("chosen").cast("string")))))

    rid, digest = F.concat(F.lit("<"), F.col("rid"), F.lit(">")), F.concat(F.lit("sha1:"), F.col("digest"))
    uri, when = ("WARC-Target-URI", _line(F.col("url"))), ("WARC-Date", EPOCH)
    after = F.regexp_replace(_line(F.col("url")), r"^[^:/?#]*://[^/?#]*|#.*$", "")
    path = F.coalesce(F.when(after.startswith("/"), after).otherwise(F.concat(F.lit("/"), after)), F.lit("/"))
    host = F.nullif(F.regexp_extract(_line(F.col("url")), r"^[^:/?#]*://([^/?#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\n"), _headers(("Host", host)), F.lit("\r\n\r\n"))
    status = _headers(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("size").cast("string")))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), status, F.lit("\r\n\r\n"), F.when(F.col("origin").isNull(), F.col("payload")).otherwise(""))
    about = F.concat(_headers(("pageId", F.col("id").cast("string")), ("payloadLength", F.col("size").cast("string"))), F.lit("\r\n"))
    response = _record(
        F.when(F.col("origin").isNull(), "response").otherwise("revisit"), rid, answer, when, uri, ("WARC-Payload-Digest", digest),
        ("WARC-Profile", F.when(F.col("origin").isNotNull(), REVISIT_PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<"), F.col("origin"), F.lit(">"))),
        ("Content-Type", "application/http;msgtype=response"))
    part = lambda name: F.concat(F.lit("<"), F.col("rid"), F.lit(f":{name}>"))
    request = _record("request", part("request"), asked, when, uri, ("WARC-Concurrent-To", rid), ("Content-Type", "application/http;msgtype=request"))
    metadata = _record("metadata", part("metadata"), about, when, uri, ("WARC-Concurrent-To", rid), ("Content-Type", "application/warc-fields"))
    return made.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write the captures of `pages` as gzipped WARC files of about ARCHIVE_BYTES before compression.

    Every file is one gzip member, so it can be read as a whole only.  An empty table
    gives a folder without records.  See `capture_records`.
    """
    size = F.octet_length(F.coalesce(F.col(payload_col).cast("string"), F.lit("")))
    mean = pages.agg(F.avg(size).alias("m")).first()["m"] or 0.0
    per_file = max(3, 3 * int(ARCHIVE_BYTES / (mean + 1500)))
    records = capture_records(pages, id_col, url_col, payload_col, least)
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def _unzipped(content: memoryview) -> Iterator[bytes]:
    """Pieces of an archive's bytes; members of a gzip file follow each other."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for i in range(0, len(content), 1 << 20):
            yield bytes(content[i:i + (1 << 20)])
        return
    member, at = zlib.decompressobj(31), 0
    while at < len(content):
        piece = bytes(content[at:at + (1 << 18)])
        at += len(piece)
        while piece:
            try:
                yield member.decompress(piece)
            except zlib.error:  # what follows is no gzip data: an archive cut short, or padding
                return
            piece = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r?\n")


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers, block) of every whole record; what is no record is skipped up to the next one, a record cut short is left out."""
    buffer, ended = bytearray(), False

    def more(n: int) -> bool:
        nonlocal ended
        while len(buffer) < n and not ended:
            piece = next(pieces, None)
            if piece is None:
                ended = True
            else:
                buffer.extend(piece)
        return len(buffer) >= n

    while more(1):
        more(8)
        if not buffer.startswith(b"WARC/"):
            start = buffer.find(b"\nWARC/", 0)
            while start < 0 and not ended:
                del buffer[:max(0, len(buffer) - 6)]
                more(len(buffer) + 1)
                start = buffer.find(b"\nWARC/")
            if start < 0:
                return
            del buffer[:start + 1]
            continue
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0 and not ended:
            seen = len(buffer)
            more(len(buffer) + 1)
        if end < 0:
            return
        fields: dict[str, list[str]] = {}
        for name, value in FIELD.findall(bytes(buffer[:end + 2])):
            fields.setdefault(name.decode("latin-1").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
        size = fields.get("content-length", [""])[0]
        if not size.isdecimal():
            del buffer[:5]
            continue
        stop = end + 4 + int(size)
        if not more(stop):
            return
        yield fields, bytes(buffer[end + 4:stop])
        more(stop + 4)
        del buffer[:stop + 4 if buffer[stop:stop + 4] == b"\r\n\r\n" else stop]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in a folder (plain or gzipped), one a row, with the columns of RECORD.

    Identifiers come without angle brackets.  A task holds the bytes of one archive
    as stored, and unzips it piece by piece.  Records that are cut short are left
    out, bytes between records are skipped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "content_type", "block"]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 5, pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse_records(_unzipped(memoryview(content.as_buffer()))):
                    one = lambda name: (fields.get(name) or [None])[0]  # noqa: E731, B023
                    bare = lambda v: v if v is None else v.removeprefix("<").removesuffix(">")
                    rows.append((bare(one("warc-record-id")), one("warc-type"), [bare(v) for v in fields.get("warc-concurrent-to", [])], bare(one("warc-refers-to")),
                                 one("warc-target-uri"), one("warc-date"), one("warc-payload-digest"), one("content-type"), block))
                    held += len(block) + 500
                    if held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, response, request, metadata).

    A capture is a response, revisit or resource record; `response` is a struct of its
    columns, `request` and `metadata` are arrays of the structs of all other records
    joined to it (`metadata` of those that are no requests), ordered by their columns.
    A record belongs to the capture that it names in concurrent_to, or that names it,
    or to that of a record it is so linked to, at any number of steps; of several the
    nearest counts, then the smallest id.  Records linked to no capture come out one a
    row with a null response, under their own ids (so do those without an id).  Captures that repeat an id, or have none,
    stay rows of their own; those that repeat one get the same records.  An empty
    table gives an empty result.  A transaction is a few records: all that belong to
    one capture meet in one row.
    """
    main = F.coalesce(F.col("record_type").isin("response", "revisit", "resource"), F.lit(False))
    ends = cut(records.select("record_id", main.alias("main"), F.explode_outer("concurrent_to").alias("other")).where("record_id is not null").distinct())
    links = ends.where("other is not null").select("record_id", "other")
    both = links.unionByName(links.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    # What is still to be placed: links that start at a record which is no capture.
    steps = both.join(ends.where("not main").select("record_id").distinct(), "record_id", "left_semi").distinct()
    reached = ends.where("main").select(F.col("record_id").alias("to"), F.col("record_id").alias("capture")).distinct()
    placed = None
    while True:
        fresh = cut(steps.join(reached, F.col("other") == F.col("to")).groupBy("record_id").agg(F.min("capture").alias("capture")))
        placed = fresh if placed is None else placed.unionByName(fresh)
        steps = steps.join(fresh.select("record_id"), "record_id", "left_anti")
        reached = fresh.select(F.col("record_id").alias("to"), "capture")
        if not fresh.limit(1).count() or not steps.limit(1).count():
            break
    return _nested(records, main, placed)


def _nested(records: DataFrame, main: Column, placed: DataFrame) -> DataFrame:
    """The captures with the records that `placed` (record_id, capture) gives them, and the records it does not name."""
    whole = F.struct(*(F.col(c) for c in records.columns))
    others = records.where(~main).select(F.col("record_id").alias("own_id"), (F.coalesce(F.col("record_type"), F.lit("")) == "request").alias("asks"), whole.alias("record"))
    others = others.join(placed, F.col("own_id") == F.col("record_id"), "left")
    asked, told = F.when(F.col("asks"), F.col("record")), F.when(~F.col("asks"), F.col("record"))
    parts = others.where("capture is not null").groupBy("capture").agg(
        F.sort_array(F.collect_list(asked)).alias("request"), F.sort_array(F.collect_list(told)).alias("metadata"))
    captures = records.where(main).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    none = F.array().cast(parts.schema["request"].dataType)
    joined = captures.join(parts, F.col("capture_id") == F.col("capture"), "left").select(
        "capture_id", "response", *(F.coalesce(c, none).alias(c) for c in ("request", "metadata")))
    alone = others.where("capture is null").select(
        F.col("own_id").alias("capture_id"), F.lit(None).cast(captures.schema["response"].dataType).alias("response"),
        F.array_compact(F.array(asked)).alias("request"), F.array_compact(F.array(told)).alias("metadata"))
    return joined.unionByName(alone)


def payload(block: Column) -> Column:
    """The body of an HTTP message: what follows its first empty line; all of it if there is none."""
    at = F.instr(block.cast("string"), "\r\n\r\n")
    return F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise(block)
