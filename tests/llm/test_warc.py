import gzip
import hashlib

import duckdb
import pytest

from weftline.llm import queries, sql, warc

BIG = "<p>" + "é\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n" * 60
PAGES = [
    (1, "http://a.org/x y", BIG), (2, "http://b.org", BIG), (3, None, BIG), (4, "no scheme", "small"), (5, "http://c.org/q?z#f", "small"),
    (6, "http://d.org/\r\nHost: evil", None), (7, "http://e.org/", ""), (8, "http://f.org/", "WARC/1.1\r\n\r\n"), (9, "http://g.org/", "x" * 999), (10, "http://g.org/", "x" * 999),
    (11, "http://h.org/", "y" * 1000), (12, "http://h.org/", "y" * 1000), (13, "http://long.org/", "日本 " * 300_000),
]


def plain(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        ids = [j for j, _, h in pages if h == html and j is not None]
        chosen = max(ids) if len(data) >= 1000 and ids else None
        again = chosen is not None and chosen != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", chosen if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [warc.BROADCAST_PAYLOADS, 0])
def test_query_against_brute_force_and_sql(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", limit)
    rows = PAGES + [(12, "http://h.org/", "y" * 1000), (4, "no scheme", "small"), (None, None, "y" * 1000), (None, "http://n.org", "z" * 2000), (None, "http://n.org", "z" * 2000)]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, record_id string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op11_warc_transactions"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(sql.WARC).fetchall(), key=str) == plain(rows)


def test_records_read_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w")
    assert len(list((tmp_path / "w").glob("*.gz"))) > 3
    got = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, f"{tmp_path}/w")).collect()}
    assert set(got) == {f"urn:page:{i}" for i, _, _ in PAGES}
    for i, url, html in PAGES:
        row = got[f"urn:page:{i}"]
        assert [r.record_type for r in row.request] == ["request"] and [r.record_type for r in row.metadata] == ["metadata"]
        if row.response.record_type == "response":
            assert bytes(row.response.block).split(b"\r\n\r\n", 1)[1].decode() == (html or "")
        else:
            assert row.response.refers_to == ("urn:page:3" if html == BIG else "urn:page:12")
    assert got["urn:page:6"].response.target_uri == "http://d.org/%0D%0AHost:%20evil" and got["urn:page:3"].response.target_uri is None
    assert bytes(got["urn:page:5"].request[0].block) == b"GET /q?z HTTP/1.1\r\nHost: c.org\r\n\r\n"
    empty = f"{tmp_path}/none"
    warc.write_warc(pages.limit(0), empty)
    assert warc.assemble(warc.read_warc(spark, empty)).collect() == []


def record(kind, rid, body=b"", *more):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *more, f"Content-Length: {len(body)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Links of either direction and of several steps, records in different files, damaged and cut archives."""
    to = lambda x: f"WARC-Concurrent-To: <{x}>"
    first = record("warcinfo", "i") + record("response", "r1", b"A", to("q1")) + record("request", "q1", b"B") + b"junk\r\n\r\nmore" + b"\r\n"
    first += record("metadata", "m1", b"C", to("q1")) + record("metadata", "m3", b"", to("m2"))
    second = gzip.compress(record("request", "q2", b"D", to("r2"))) + gzip.compress(record("response", "r2", b"\r\n\r\nWARC/1.0")) + gzip.compress(record("metadata", "lost", b"E", to("gone")))
    third = record("metadata", "m2", b"F", to("m1")) + record("response", "r3", b"G" * 50)[:-20]
    fourth = gzip.compress(record("response", "r4", b"H" * 9000, "warc-refers-to: <r1>"))[:-300] + b"tail"
    for name, data in (("a.warc", first), ("b.warc.gz", second), ("c.warc", third), ("d.warc.gz", fourth), ("e.warc", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.capture_id: ([x.record_id for x in r.request], [x.record_id for x in r.metadata]) for r in warc.assemble(warc.read_warc(spark, str(tmp_path))).collect() if r.response}
    assert got == {"r1": (["q1"], ["m1", "m2", "m3"]), "r2": (["q2"], [])}
    alone = [r for r in warc.assemble(warc.read_warc(spark, str(tmp_path))).collect() if not r.response]
    assert sorted((r.capture_id, len(r.metadata)) for r in alone) == [("i", 1), ("lost", 1)]


def test_records_with_repeated_and_missing_ids(spark):
    rows = [(None, "response", [], b"1"), ("r", "response", [], b"2"), ("r", "response", [], b"3"), ("q", "request", ["r"], b"4"), (None, "metadata", ["r"], b"5"), ("n", None, None, b"6")]
    rest = "null AS refers_to, null AS target_uri, null AS date, null AS payload_digest, null AS content_type"
    records = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to array<string>, block binary")
    records = records.selectExpr("record_id", "record_type", "concurrent_to", *rest.split(", "), "block")
    got = [(r.capture_id, r.response and bytes(r.response.block), [bytes(x.block) for x in r.request + r.metadata]) for r in warc.assemble(records).collect()]
    assert sorted(got, key=str) == [("n", None, [b"6"]), ("r", b"2", [b"4"]), ("r", b"3", [b"4"]), (None, None, [b"5"]), (None, b"1", [])]
