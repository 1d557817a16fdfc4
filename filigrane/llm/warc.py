"""WARC archives: a writer, a reader, and the assembly of transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record.  Spark's text
sink writes them: a record ends with CR LF CR LF, which is the sink's line separator, so its files are valid
WARC files.  The reader takes whole files by Spark's binary source, goes by Content-Length, and the three
records of a capture are joined by their WARC-Concurrent-To identifiers into one nested row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.shared import prepare, scratch, staged, table

CRLF = "\r\n"
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 0
#: Captures a file by the size of their payloads, up to so many bytes: no file holds more than some 200 MB or one capture.
FILE_CAPTURES = ((1 << 16, 3000), (1 << 21, 96), (1 << 62, 1))
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hex40: Column) -> Column:
    """Bare upper-case base32 of a hex SHA-1: 32 digits of 5 bits, from 4 parts of 40 bits."""
    parts = [F.conv(F.substring(hex40, 1 + 10 * k, 10), 16, 10).cast("long") for k in range(4)]
    digits = [F.substr(F.lit(_BASE32), F.shiftright(parts[i // 8], 35 - 5 * (i % 8)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(32)]
    return F.concat(*digits)


def _record(kind: Column, record_id: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    """A record without the CR LF CR LF at its end. Headers that are null are left out."""
    lines = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit("WARC-Date: 1970-01-01T00:00:00Z"), *headers,
        F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(lines, F.lit(CRLF * 2), block)


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write page_id, url, html as captures into path.

    Of pages with equal payloads of at least min_revisit_bytes, those with the smallest page_id get a response
    record, others a revisit; a null page_id comes after all others.  A null html is an empty payload, a
    null url gives no target header (line breaks in a url become %0A, %0D) and a request without a host.  Payloads of
    any length are whole; extra columns, whatever their names, are ignored; a table without rows gives an archive
    that holds its warcinfo record only, as every archive does in a file of its own.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumns(
        {"sha1": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")}
    )
    groups = base.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"), F.max("bytes").alias("most")).filter((F.col("copies") > 1) & (F.col("most") >= min_revisit_bytes)).drop("copies", "most")
    is_copy = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    by_payload = F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">"))
    own = lambda: F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    target = F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    rows = (
        base.join(staged(pages.sparkSession, groups, "payloads"), "sha1", "left")
        .withColumn("digest", base32_of_hex(F.col("sha1")))
        .withColumn("copy", is_copy)
        .withColumn("capture", F.when(F.col("copy"), own()).when(F.col("first").isNotNull(), by_payload).otherwise(own()))
    )
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    with_capture = F.concat(F.lit("WARC-Concurrent-To: "), F.col("capture"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#\s]*)", 1)
    asked = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^#]*)", 1)
    asked = F.regexp_replace(F.when(asked.startswith("/"), asked).otherwise(F.concat(F.lit("/"), asked)), r"[\s\p{Cntrl}]", "%20")
    get = F.concat(F.lit("GET "), asked, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.when(F.col("copy"), F.concat(F.lit("WARC-Refers-To: "), by_payload))
    profile = F.when(F.col("copy"), F.lit(f"WARC-Profile: {_PROFILE}"))
    records = F.array(
        _record(F.lit("request"), own(), [target, with_capture], "application/http; msgtype=request", get),
        _record(
            F.when(F.col("copy"), "revisit").otherwise("response"), F.col("capture"), [target, digest, profile, refers], "application/http; msgtype=response", F.when(F.col("copy"), http).otherwise(F.concat(http, F.col("html")))
        ),
        _record(F.lit("metadata"), own(), [target, with_capture], "application/warc-fields", fields),
    )
    spark = pages.sparkSession
    said = F.concat(F.lit("software: filigrane"), F.lit(CRLF), F.lit("format: WARC File Format 1.1"), F.lit(CRLF))
    about = _record(F.lit("warcinfo"), own(), [], "application/warc-fields", said)
    spark.range(1).coalesce(1).select(about.alias("value")).write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    most, least = base.agg(F.max("bytes"), F.min("bytes")).first()
    above = -1
    for k, (upto, captures_a_file) in enumerate(FILE_CAPTURES):
        if k == 0 or (most or 0) > above:  # the first also for a table without rows
            own = rows if (least or 0) > above and (most or 0) <= upto else rows.filter((F.col("bytes") > above) & (F.col("bytes") <= upto))
            out = own.select(F.explode(records).alias("value")).write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip")
            out.option("maxRecordsPerFile", 3 * captures_a_file).text(path)
        above = upto


RECORD = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, page_id long"


def parse(content: bytes):
    """(headers by lower-case name, block) of each record of a WARC file, plain or gzip of one or more members."""

    def pieces():
        if content[:2] != b"\x1f\x8b":
            yield content
            return
        left = content
        while left:
            z = zlib.decompressobj(31)
            while not z.eof and left:
                out = z.decompress(left, 1 << 20)
                left = z.unconsumed_tail
                if out:
                    yield out
                if not left and not z.eof:
                    yield z.flush()
                    break
            left = z.unused_data

    held, source, at = bytearray(), pieces(), 0

    def more() -> bool:
        nonlocal at
        piece = next(source, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while held[at : at + 2] in (b"\r\n", b"\r", b"") and (at + 2 <= len(held) or more()):
            at += 2 * (held[at : at + 2] == b"\r\n")
        if at >= len(held):
            return
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("a WARC record's header does not end")
        lines = bytes(held[at:end]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4
        size = int(headers["content-length"])
        while len(held) - at < size:
            if not more():
                raise ValueError("a WARC record is cut off")
        yield headers, bytes(held[at : at + size])
        at += size


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row a record of the archives in path; payload, if asked for, is the response's without HTTP headers.

    A response's digest and size are those of the payload as read; a revisit's are its headers'.
    """

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in (RECORD + ", payload binary" * with_payload).split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()] * with_payload
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                for h, block in parse(content):
                    kind = h.get("warc-type")
                    digest = size = page = payload = None
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        said = {k.strip().lower(): v for k, _, v in (x.partition(b":") for x in head.split(b"\r\n"))}
                        if kind == "response":
                            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        else:
                            digest, size, payload = h.get("warc-payload-digest", "").removeprefix("sha1:"), int(said.get(b"content-length", 0)), None
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x)
                        page = int(fields["page-id"]) if fields.get("page-id", "").strip() else None
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, size, page, *([payload] * with_payload)))
                    held += len(payload or b"") if with_payload else 0
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD + ", payload binary" * with_payload)


def captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: record_type, request, response, metadata, and the response's record a revisit refers to.

    request and metadata are those whose concurrent-to names the capture's record, null if there are none;
    of several one is taken.  Records of other types are left out.
    """
    one = records.filter(F.col("kind").isin("response", "revisit"))
    cols = [c for c in records.columns if c != "concurrent_to"]

    def beside(kind: str) -> DataFrame:
        return records.filter((F.col("kind") == kind) & F.col("concurrent_to").isNotNull()).groupBy("concurrent_to").agg(F.min(F.struct("record_id", "target_uri", "page_id")).alias(kind))

    return (
        one.select(F.col("kind").alias("record_type"), F.struct(*cols).alias("response"), F.col("record_id").alias("concurrent_to"))
        .join(beside("request"), "concurrent_to", "left")
        .join(beside("metadata"), "concurrent_to", "left")
        .select("record_type", "request", "response", "metadata")
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back."""
    prepare(spark)
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    found = staged(spark, captures(staged(spark, read_records(spark, path), "records")), "captures")
    shown = [F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), "record_type"]
    revisits = found.filter("record_type = 'revisit'").withColumn("refers", F.col("response.refers_to"))
    asked = staged(spark, revisits.select("refers").distinct(), "asked")
    responses = found.filter("record_type = 'response'")
    named = responses.select(F.col("response.record_id").alias("refers"), F.col("metadata.page_id").alias("first")).join(asked, "refers").groupBy("refers").agg(F.min("first").alias("refers_to"))
    return responses.select(*shown, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.join(staged(spark, named, "named"), "refers", "left").select(*shown, "refers_to"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
