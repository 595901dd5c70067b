r"""WARC archives written, read, deduplicated and resolved with revisit records, on Spark's own text source.

A record is a header block, a payload behind its HTTP header, and the terminator ``\r\n\r\n``. Spark's text sink writes
records as lines that end with the terminator; the text source reads them back as lines that end where a terminator
meets the next record's ``WARC/1.``, without Python and without gathering a file. A payload that would imitate such a
place is written in HTTP's chunked transfer encoding, cut inside the imitation, and put together again on reading.
Archives are gzip files (quick compression); PER_FILE bounds their records.

``deduplicate`` shuffles headers alone: the smallest page of each payload digest (SHA-1, size and a second hash, so that
a constructed SHA-1 collision does no harm) keeps its response, all others become revisit records that name it.
``resolve`` joins revisit records to the responses they name. Payloads are joined by record id, which no two records share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from memloom.llm.scratch import Scratch

END = "\r\n\r\n"
VERSION = "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PER_FILE = 20_000
#: Copies (rows of two record ids, about 100 bytes) that are broadcast at most.
BROADCAST = 200_000
#: Fixed value: the digits of base 32, and those that ``conv`` writes.
BASE32, CONV = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
FIELDS = {
    "record_id": "WARC-Record-ID", "kind": "WARC-Type", "page": "X-Page-ID", "url": "WARC-Target-URI", "date": "WARC-Date",
    "digest": "WARC-Payload-Digest", "length": "Content-Length", "refers_to_id": "WARC-Refers-To",
}


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32; ten hexadecimal digits are eight of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV, BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; control characters would end the line, so they are percent-encoded."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F\x7F]", "%00")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _written(rows: DataFrame, path: str, per_file: int) -> None:
    """``rows(record_id, page, url, date, digest, kind, refers_to_id, payload)`` as records."""
    body = F.coalesce(F.col("payload"), F.lit(""))
    imitates = (F.col("kind") == "response") & F.concat(F.lit(END), body).contains(END + VERSION)
    size = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(imitates, F.lit("Transfer-Encoding: chunked")).otherwise(size), F.lit(END))
    pieces = F.transform(F.split(body, r"(?<=WARC/)(?=1[.])"), lambda p: F.concat(F.hex(F.octet_length(p)), F.lit("\r\n"), p, F.lit("\r\n")))
    sent = F.when(imitates, F.concat(F.array_join(pieces, ""), F.lit("0" + END))).when(F.col("kind") == "response", body).otherwise("")
    rows = rows.withColumn("block", F.concat(http, sent))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        _line("X-Page-ID", F.col("page")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.col("refers_to_id")),
        _line("WARC-Profile", F.when(F.col("refers_to_id").isNotNull(), F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
        F.col("block"),
    )
    writer = rows.select(header.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file)
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", per_file: int = PER_FILE) -> None:
    """Writes each row of ``pages`` as a response record into gzip archives below ``path``, at most ``per_file`` records each.

    The payload is the column's text in UTF-8, null as empty; a null id or url has no header line. Control characters
    of an url are percent-encoded. Repeated rows are records of their own; an empty table gives no records. Record ids
    are drawn anew in each run.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("record_id"), F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.lit(date).alias("date"), base32_sha1(F.col("payload").cast("binary")).alias("digest"), F.lit("response").alias("kind"), F.lit(None).cast("string").alias("refers_to_id"))
    _written(rows, path, per_file)


def unchunked(block: Column) -> Column:
    """The body of a binary column in chunked transfer encoding; what follows the last chunk goes."""
    text = lambda x: x.cast("string")
    steps = F.sequence(F.lit(1), F.size(F.split(text(block), "\r\n")))  # no fewer than there are chunks

    def step(state: Column, _: Column) -> Column:
        line = F.substring_index(text(F.substring(block, state["at"], F.lit(1 << 10))), "\r\n", 1)
        size = F.coalesce(F.conv(F.trim(F.substring_index(line, ";", 1)), 16, 10).cast("int"), F.lit(0))
        start = state["at"] + F.octet_length(line) + 2
        more = F.struct((start + size + 2).alias("at"), F.concat(state["out"], F.substring(block, start, size)).alias("out"), (size == 0).alias("over"))
        return F.when(state["over"], state).otherwise(more)

    first = F.struct(F.lit(1).alias("at"), F.lit(b"").cast("binary").alias("out"), F.lit(False).alias("over"))
    return F.aggregate(steps, first, step, lambda s: s["out"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``: the columns of FIELDS but ``length``, ``complete`` and ``payload``.

    ``payload`` is binary, without its HTTP header and transfer encoding; ``complete`` is false where a record is shorter
    than its header says, as a foreign archive's record is that holds the start of another one. ``page`` is a string.
    """
    rows = spark.read.option("lineSep", END + VERSION).text(path).filter("value <> ''")
    rows = rows.select(F.substring_index("value", END, 1).alias("head"), F.col("value").cast("binary").alias("raw"))
    head = F.concat(F.lit("\r\n"), F.col("head"), F.lit("\r\n"))
    has = lambda name: F.lower(head).contains(f"\r\n{name.lower()}:")  # noqa: E731  cheaper than a pattern that finds nothing
    named = {c: F.when(has(name), F.regexp_extract(head, f"\r\n(?i:{name}): *([^\r\n]*)\r\n", 1)) for c, name in FIELDS.items()}
    rows = rows.select(*[v.alias(c) for c, v in named.items()], F.octet_length("head").alias("skip"), "raw")
    rows = rows.withColumn("block", F.substring(F.col("raw"), F.col("skip") + 5, F.col("length").cast("int")))
    http = F.when(F.substring(F.col("block"), 1, 5) == F.lit(b"HTTP/"), F.substring_index(F.col("block").cast("string"), END, 1))
    rows = rows.withColumn("http", http).withColumn("body", F.when(F.col("http").isNotNull(), F.substring(F.col("block"), F.octet_length("http") + 5, F.octet_length("block"))).otherwise(F.col("block")))
    chunked = F.coalesce(F.col("http").rlike(r"(?i)\r\ntransfer-encoding: *chunked"), F.lit(False))
    complete = F.coalesce(F.octet_length("block") == F.col("length").cast("int"), F.lit(False)).alias("complete")
    return rows.select(*[c for c in FIELDS if c != "length"], complete, F.when(chunked, unchunked(F.col("body"))).otherwise(F.col("body")).alias("payload"))


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0, page_type=LongType(), per_file: int = PER_FILE) -> None:
    """Reads the archives below ``source`` and writes them below ``target`` with fresh headers: one response for each payload of ``least`` bytes or more.

    The response of the smallest page (null last, then the smallest record id) stays, the others become revisit records without payload;
    smaller payloads all stay responses. Revisit records of the source, which have no payload to compare, are kept as they are.
    """
    rows = read(spark, source).filter("kind in ('response', 'revisit')")
    heads = rows.filter("kind = 'response'").select("record_id", F.col("page").cast(page_type).alias("page"), "digest", F.xxhash64("payload").alias("check"), F.octet_length("payload").alias("bytes"))
    scratch = Scratch(spark, "heads")
    heads = scratch.save(heads.filter(F.col("bytes") >= least))
    first = F.struct(F.col("page").isNull().alias("last"), "page", "record_id")
    groups = heads.groupBy("digest", "check", "bytes").agg(F.min(first).alias("first"), F.count("*").alias("n")).filter("n > 1")
    kept = groups.select("digest", "check", "bytes", F.col("first.record_id").alias("original"))
    # what a group's copies need is one narrow row; a group of a third of all rows is split by the adaptive skew join
    again = heads.join(kept, ["digest", "check", "bytes"]).filter("record_id <> original").select(F.col("record_id").alias("again"), "original")
    again = scratch.save(again)
    few = again.limit(BROADCAST + 1).count() <= BROADCAST
    # more copies than that take a shuffle of the records, by an id of their own each
    out = rows.join(F.broadcast(again) if few else again, F.col("record_id") == F.col("again"), "left")
    kind = F.when(F.col("original").isNotNull(), F.lit("revisit")).otherwise(F.col("kind"))
    _written(out.select("record_id", "page", "url", "date", F.regexp_replace("digest", "^sha1:", "").alias("digest"), kind.alias("kind"), F.coalesce("original", "refers_to_id").alias("refers_to_id"), F.col("payload").cast("string").alias("payload")), target, per_file)
    scratch.clear()


def resolve(records: DataFrame, page_type=LongType()) -> DataFrame:
    """``(record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` of ``read``'s records, a revisit's payload being that of the response it names.

    A revisit whose response is not there keeps its own header's digest and has null bytes and refers_to.
    """
    own = records.filter("kind in ('response', 'revisit')").select("record_id", F.col("page").cast(page_type).alias("page_id"), "url", "kind", "refers_to_id", F.regexp_replace("digest", "^sha1:", "").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    own = Scratch(records.sparkSession, "resolve").save(own)
    responses, revisits = own.filter("kind = 'response'"), own.filter("kind = 'revisit'")
    # a response that a third of all records revisit: its revisits are split by the adaptive skew join
    ends = responses.select(F.col("record_id").alias("end"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("end_bytes"), F.col("sha1").alias("end_sha1"))
    found = revisits.join(ends, F.col("refers_to_id") == F.col("end"), "left")
    names = ["record_id", "page_id", "url"]
    left = responses.select(*names, F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast(page_type).alias("refers_to"))
    return left.union(found.select(*names, "end_bytes", F.coalesce("end_sha1", "digest"), "kind", "refers_to"))
