"""WARC round trips, revisit records and payloads that imitate records."""

import base64
import gzip
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from memloom.llm import warc  # noqa: E402

ODD = [
    (1, "http://a/", "<p>one</p>"), (2, None, None), (3, "http://a/\r\nX-Page-ID: 9", ""), (4, "http://b/", "<p>one</p>"), (4, "http://b/", "<p>one</p>"), (None, "http://c/", "<p>one</p>"), (None, "http://d/", "<p>two</p>"),
    (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx"), (6, "u", "x\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"), (7, "u", "\r\n\r\n"), (8, "u", "tail\r\n\r\nWARC/1."), (9, "u", "é😀\x00\r\n" + "long " * 100_000), (10, "u", "\n a \r b \n\n"),
    (11, "u", "\r\n\r\nWARC/1.1\r\n" * 40 + "WARC/1." * 3 + "é"), (12, "u", "WARC/1.0"), (13, "u", "0\r\n\r\nWARC/1."),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least=0):
    out, seen = [], {}
    for i, (page, _, html) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        raw = (html or "").encode()
        first = seen.setdefault(raw, (i, page)) if len(raw) >= least else (i, page)
        out.append((page, len(raw), digest(html), "response" if first[0] == i else "revisit", None if first[0] == i else first[1]))
    return sorted(map(str, out))


def archive(spark, df, tmp_path, **kw):
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write(df, f"{root}/raw", per_file=4)
    warc.deduplicate(spark, f"{root}/raw", f"{root}/out", **kw)
    return root, warc.read(spark, f"{root}/out")


@pytest.mark.parametrize(("least", "broadcast"), [(0, warc.BROADCAST), (1, 0), (12, warc.BROADCAST)])
def test_revisits(spark, tmp_path, monkeypatch, least, broadcast):
    monkeypatch.setattr(warc, "BROADCAST", broadcast)
    _, records = archive(spark, pages(spark, ODD).repartition(3), tmp_path, least=least)
    got = warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == plain(ODD, least)
    assert records.filter("not complete").count() == 0


def test_payloads_come_back(spark, tmp_path):
    root, records = archive(spark, pages(spark, ODD), tmp_path)
    raw = warc.read(spark, f"{root}/raw").select("page", F.col("payload").cast("string")).collect()
    assert sorted((r[0] or "", r[1]) for r in raw) == sorted(("" if p is None else str(p), h or "") for p, _, h in ODD)
    ids = [r["record_id"] for r in records.select("record_id").collect()]
    assert len(set(ids)) == len(ODD)
    assert records.filter("kind = 'revisit'").agg(F.sum(F.octet_length("payload"))).first()[0] == 0 and records.filter("kind = 'revisit' and refers_to_id is null").count() == 0


def test_archives_are_plain_warc(spark, tmp_path):
    """A reader that goes by Content-Length alone finds the same records."""
    root, records = archive(spark, pages(spark, ODD), tmp_path)
    n = 0
    for path in __import__("pathlib").Path(f"{root}/out").glob("part-*"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            n += 1
            data = rest[size + 4 :]
    assert n == records.count() == len(ODD)


def test_foreign_archive(spark, tmp_path):
    """Other header orders and letters, no HTTP header, a record type of no interest, and a record that holds the start of another."""
    body = "WARC/1.0\r\ncontent-length: 4\r\nWarc-Type: resource\r\nWARC-Record-ID: <a>\r\n\r\nbody\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\nContent-Length: 40\r\n\r\nx\r\n\r\nWARC/1.0\r\ny\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(body.encode())
    got = {r["record_id"]: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert bytes(got["<a>"]["payload"]) == b"body" and got["<a>"]["complete"] and not got["<b>"]["complete"]


def test_chunks_of_a_foreign_server(spark):
    body = b"5;name=x\r\nab\r\nc\r\nA\r\n0123456789\r\n0\r\nTrailer: 1\r\n\r\n"
    got = spark.createDataFrame([(bytearray(body),), (bytearray(b""),), (bytearray(b"zz\r\n"),)], "b binary").select(warc.unchunked(F.col("b"))).collect()
    assert [bytes(r[0]) for r in got] == [b"ab\r\nc0123456789", b"", b""]


def test_empty_table(spark, tmp_path):
    _, records = archive(spark, pages(spark, []), tmp_path)
    assert warc.resolve(records).collect() == []


def test_digest_column(spark):
    df = spark.createDataFrame([(x,) for x in ("", "a", "é" * 1000)], "t string")
    assert [r[0] for r in df.select(warc.base32_sha1(F.col("t").cast("binary"))).collect()] == [digest(x) for x in ("", "a", "é" * 1000)]


def test_revisit_without_its_response(spark, tmp_path):
    _, records = archive(spark, pages(spark, [(1, "a", "x"), (2, "b", "x")]), tmp_path)
    row = warc.resolve(records.filter("kind = 'revisit'")).first()
    assert (row["page_id"], row["payload_bytes"], row["payload_digest"], row["refers_to"]) == (2, None, digest("x"), None)
