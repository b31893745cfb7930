"""WARC archives: written from pages, read back, and assembled into one nested row per capture."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import materialized, send_code

#: Payloads of at least so many bytes that repeat are written as revisit records.
MIN_BYTES = 0
#: Pages in one archive file; bounds what one reading task holds.
PAGES_PER_FILE = 1500
END = "\r\n\r\n"
RECORDS = (
    "file string, offset long, record_id string, kind string, concurrent_to string, target string, "
    "digest string, refers_to string, fields map<string,string>, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: each 40 bits are eight digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _head(kind: str, record_id: Column, block: Column, kind_of_block: str, *more: Column) -> Column:
    return F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z"), F.lit(f"Content-Type: {kind_of_block}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), *more)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write request, response or revisit, and metadata records of every page (page_id, url, html) under ``path``.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of ``min_bytes`` or more, rows with the
    largest page_id are responses (a repeated row of that id too), the others revisits that refer to it; a null
    page_id never is the one referred to unless all are null. Control characters in urls are written as ``%``
    codes. Files are gzip, of PAGES_PER_FILE pages at most; two CRLF end each record, so Spark's text writer
    with that line end writes them, on any file system it knows.

    Only digests and ids are grouped; of them only payloads that repeat meet the pages again.
    """
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("*", base32_sha1(F.encode("html", "UTF-8")).alias("digest"))
    same = p.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = materialized(same, "warc-same")
    p = p.join(same, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    p = p.withColumn("id", F.expr("uuid()")).withColumn("revisit", revisit)
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    main_id = F.concat(F.lit("<urn:uuid:"), F.col("id"), F.lit(">"))
    own = [F.concat(F.lit("<urn:uuid:"), F.col("id"), F.lit(f"#{k}>")) for k in ("request", "metadata")]
    to = F.concat(F.lit("WARC-Concurrent-To: "), main_id)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END))
    ask = F.concat(F.lit("GET "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit(" HTTP/1.1" + END))
    meta = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("payload-bytes: "), F.octet_length("html").cast("string"), F.lit("\r\n"))
    blocks = {
        "request": ask, "response": F.concat(http, F.col("html")), "revisit": http, "metadata": meta,
    }
    app = "application/http; msgtype="
    records = F.array(
        F.concat(_head("request", own[0], blocks["request"], app + "request", target, to), F.lit(END), blocks["request"]),
        F.when(F.col("revisit"), F.concat(
            _head("revisit", main_id, blocks["revisit"], app + "response", target, digest, refers, profile),
            F.lit(END), blocks["revisit"])).otherwise(F.concat(
                _head("response", main_id, blocks["response"], app + "response", target, digest),
                F.lit(END), blocks["response"])),
        F.concat(_head("metadata", own[1], meta, "application/warc-fields", target, to), F.lit(END), meta))
    lines = p.select(F.explode(records).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", 3 * PAGES_PER_FILE).text(path)


def parse_archive(content: bytes):
    """The records of one archive, plain or gzip in one or more members: (offset, headers, block)."""
    if content[:2] == b"\x1f\x8b":
        parts = []
        while content:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(content))
            content = member.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = content[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = int(fields.get("content-length", 0))
        yield at, fields, content[end + 4:end + 4 + size]
        at = end + 4 + size
        while content[at:at + 2] == b"\r\n":
            at += 2


def _rows(frames):
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            out = []
            for at, head, block in parse_archive(content):
                kind, more, payload = head.get("warc-type"), {}, None
                if kind in ("response", "request", "revisit"):
                    payload = block.partition(b"\r\n\r\n")[2]
                elif kind == "metadata":
                    lines = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)
                    more = {k.strip(): v.strip() for k, _, v in lines}
                if kind == "response":
                    more["computed"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.append((path, at, head.get("warc-record-id"), kind, head.get("warc-concurrent-to"),
                            head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha1:"),
                            head.get("warc-refers-to"), more, payload))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORDS.split(", ")], dtype=object)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``. A task reads whole files, which the writer keeps small."""
    send_code(__name__)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(_rows, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata records.

    Requests and metadata find their capture through WARC-Concurrent-To; of several, the first by id counts, so
    a repeated record never doubles a capture. A capture without request or metadata keeps null there. Records
    of other kinds, and ones that point nowhere, give no row.
    """
    main = records.where("kind in ('response', 'revisit')").where("record_id is not null")
    main = main.select("record_id", F.struct("kind", "target", "digest", "refers_to", "payload", "fields").alias("response"))

    def side(kind: str, *columns: str) -> DataFrame:
        found = records.where((F.col("kind") == kind) & F.col("concurrent_to").isNotNull())
        return found.groupBy(F.col("concurrent_to").alias("record_id")).agg(
            F.min(F.struct("record_id", *columns)).alias(kind))

    fields = records.where("kind = 'metadata' and concurrent_to is not null").groupBy(
        F.col("concurrent_to").alias("record_id")).agg(F.min_by(F.struct("record_id", "fields"), "record_id").alias("metadata"))
    return main.join(side("request", "target"), "record_id", "left").join(fields, "record_id", "left")


def captures(assembled: DataFrame) -> DataFrame:
    """The digest of each capture: page_id, payload_bytes, payload_digest, record_type, refers_to, payload_ok.

    ``payload_ok`` tells whether a response's payload, as read, has the digest in its header (null: revisit)."""
    data = F.col("metadata.fields")
    return assembled.select(
        data["page-id"].cast("long").alias("page_id"),
        data["payload-bytes"].cast("long").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.regexp_extract("response.refers_to", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"),
        (F.col("response.fields")["computed"] == F.col("response.digest")).alias("payload_ok"),
    )
