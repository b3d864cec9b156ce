"""WARC archives: captures written as records, and records put together to captures again."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolframe.llm.store import fresh_path, join_counted, stored

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_BASE32_OF_HEX = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

#: Bytes of pages that a file holds about, and the most captures in it.
FILE_BYTES, RECORDS_PER_FILE = 1 << 27, 10_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four of it."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), *_BASE32_OF_HEX)


def _record_id(*parts: Column) -> Column:
    """A name in the form of a UUID, of the parts alone, so writing anew names alike."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    """The text of a record without the two line ends that follow it; headers without a value are left out."""
    fields = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in headers]
    size = F.octet_length(body).cast("string")
    return F.concat(F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\n"), *fields, F.lit("Content-Length: "), size, F.lit("\r\n\r\n"), body)


def captures(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row (text) for each page: its response or revisit record, its request and its metadata.

    Of pages with one payload of at least `least_bytes` bytes the one with the smallest key
    holds it, the others revisit that; smaller payloads are all held. Rows that repeat the smallest
    key all hold it. Pages without a key revisit any that has one. Every row is a capture of its own, repeated rows
    too: a record's id is of the page and of where its row is.

    Payloads are told apart by digests, and only digests that several pages have are joined to pages; a
    payload that very many pages have is broadcast (see `join_counted`). Partitions hold about FILE_BYTES.
    """
    made = pages.select(
        pages[key].alias("page_id"),
        # A header is one line, so what isn't printed in an address is escaped.
        F.regexp_replace(F.coalesce(pages[url], F.lit("")), r"[\x00-\x20\x7F]+", "%20").alias("url"),
        F.coalesce(pages[html], F.lit("")).alias("html"),
    ).withColumns({"digest": base32_sha1(F.col("html")), "bytes": F.octet_length("html")})
    digests = stored(made.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "digests")
    n, size = digests.agg(F.sum("n"), F.sum("bytes")).first()
    several = digests.where(F.col("n") > 1).select("digest", "least", "n")
    files = -(-(size or 0) // FILE_BYTES)
    usual = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = join_counted(made, several, "digest", "n", n or 0, files if files > usual else 0)
    again = (F.col("bytes") >= least_bytes) & F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    joined = joined.withColumns({"again": again, "place": F.monotonically_increasing_id()})
    own = _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("place"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    main = _record(
        F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", own),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html"))),
    )
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", _record_id(own, F.lit("request"))), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", _record_id(own, F.lit("metadata"))), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    return joined.select(F.concat_ws("\r\n\r\n", request, main, metadata).alias("text"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archives of `pages` in a folder: gzip files of records, written by the tasks."""
    rows = captures(pages, least_bytes, key, url, html)
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_RECORD = "record_id string, type string, uri string, date string, concurrent_to string, content_type string, digest string, payload_bytes bigint, payload_digest string, fields map<string,string>"


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, of a file that may be gzip, in several members."""
    zipped = content[:2] == b"\x1f\x8b"
    held, rest = b"", content
    unzip = zlib.decompressobj(31) if zipped else None

    def more() -> bytes:
        nonlocal rest, unzip
        if not zipped:
            out, rest = rest, b""
            return out
        while rest:
            out = unzip.decompress(rest, 1 << 20)
            rest = unzip.unconsumed_tail
            if unzip.eof:
                rest = unzip.unused_data
                unzip = zlib.decompressobj(31)
            if out:
                return out
        return b""

    def until(size: int) -> bool:
        nonlocal held
        parts, total = [held], len(held)
        while total < size:
            part = more()
            if not part:
                break
            parts.append(part)
            total += len(part)
        held = b"".join(parts)
        return total >= size

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not until(len(held) + 1):
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
        if not end:
            held = held[4:]
            continue
        top = held[:end].decode().split("\r\n")
        if not top[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in top[1:])}
        size = int(headers["content-length"])
        if not until(end + 4 + size):
            raise ValueError("the archive ends within a record")
        yield headers, held[end + 4 : end + 4 + size]
        held = held[end + 4 + size :]


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives in a folder, gzip or plain, each file read by one task.

    payload_bytes and payload_digest are those of a response's payload itself, null for
    other records; `digest` is what a record's header says. `fields` has the lines of
    a block of warc-fields. `with_payload` adds the payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for headers, block in _parse(content.as_buffer().to_pybytes()):
                    kind, payload = headers.get("warc-type"), None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                    fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if ": " in line) if headers.get("content-type") == "application/warc-fields" else {}
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append(
                        (
                            headers.get("warc-record-id"),
                            kind,
                            headers.get("warc-target-uri"),
                            headers.get("warc-date"),
                            headers.get("warc-concurrent-to"),
                            headers.get("content-type"),
                            digest,
                            None if payload is None else len(payload),
                            None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                            list(fields.items()),
                        )
                        + ((payload,) if with_payload else ())
                    )
                    if len(rows) >= 2000:
                        yield table(rows)
                        rows = []
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * 7, pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * (10 + with_payload)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=[f.split(" ")[0] for f in schema.split(", ")])

    schema = _RECORD + ", payload binary" * with_payload
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """A row per capture: uri, date, main (its response or revisit), request, metadata, refers_to.

    Requests and metadata are joined to the record that their concurrent-to names; of
    several the one with the smallest id counts, where there is none the struct is null.
    A record that is there twice counts once. refers_to is, for a revisit, the metadata of
    the response with the same payload, and its size.
    """
    records = records.where("record_id IS NOT NULL").dropDuplicates(["record_id"])
    row = F.struct(*[c for c in records.columns])

    def joined_to(kind: str) -> DataFrame:
        return records.where(F.col("type") == kind).where("concurrent_to IS NOT NULL").groupBy("concurrent_to").agg(F.min_by(row, "record_id").alias(kind)).withColumnRenamed("concurrent_to", f"of_{kind}")

    main = records.where(F.col("type").isin("response", "revisit")).select(row.alias("main"))
    for kind in ("request", "metadata"):
        other = joined_to(kind)
        main = main.join(other, F.col("main.record_id") == F.col(f"of_{kind}"), "left").drop(f"of_{kind}")
    return main.select(F.col("main.uri").alias("uri"), F.col("main.date").alias("date"), "main", "request", "metadata")


def page_rows(assembled: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every capture.

    A revisit has the size of the payload that it refers to, the response of equal digest
    with the smallest page_id.
    """
    flat = assembled.select(
        F.element_at("metadata.fields", "page-id").cast("bigint").alias("page_id"),
        F.col("main.type").alias("record_type"),
        F.coalesce("main.payload_digest", "main.digest").alias("payload_digest"),
        F.col("main.payload_bytes").alias("own_bytes"),
    )
    flat = stored(flat, "captures")
    holder = F.min(F.when(F.col("record_type") == "response", F.col("page_id"))).alias("holder")
    held = flat.where("payload_digest IS NOT NULL").groupBy("payload_digest").agg(holder, F.max("own_bytes").alias("bytes"), F.count("*").alias("n")).where("n > 1")
    joined = join_counted(flat, stored(held, "held"), "payload_digest", "n", flat.count())
    return joined.select("page_id", F.coalesce("own_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("holder")).alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` written as archives in the shared folder, and what these hold when read again."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    return page_rows(assemble(read(pages.sparkSession, path)))
