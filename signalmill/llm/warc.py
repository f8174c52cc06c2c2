"""WARC: legacy archive conversion.

ARC files start blocks with a ``filedesc://`` line that states the version; the version
fixes the fields of every header line after it. Records are cut by their declared lengths
and become WARC records with identifiers, timestamps, types and digests made from them.
Archives are written by Spark's text writer as gzip files, and read as whole binary files of
bounded size, so any file system that Spark knows will do.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import scratch, table

#: Fields of a header line by version, as the version block declares them.
FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Date of pages that have none.
DATE = "20240101000000"
#: Raw bytes of records per ARC version block and output file; a longer record has a file of its own.
BLOCK = 8_000_000


def _token(text: str | None) -> str:
    """A header field: white space and control characters percent-encoded, all else as it is, '-' if empty."""
    out = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in text or "")
    return out or "-"


def arc_block(version: str, records: list[bytes], name: str) -> bytes:
    fields = " ".join(FIELDS[version])
    body = f"{version} 0 signalmill\n{fields}\n\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", DATE, "text/plain"]
    head += ["200", "-", "-", "0", name] if version == "2" else []
    return b"".join([" ".join([*head, str(len(body))]).encode() + b"\n" + body, *records])


def arc_record(version: str, url: str | None, content: bytes, status: str = "200", name: str = "-", date: str = DATE) -> bytes:
    head = [_token(url), "0.0.0.0", date, "text/html"]
    head += [status, hashlib.md5(content).hexdigest(), "-", "0", name] if version == "2" else []
    return " ".join([*head, str(len(content))]).encode() + b"\n" + content + b"\n"


def _unpacked(content: bytes) -> bytes:
    """A file without its gzip members; a member cut short gives what it holds."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(content) + d.flush())
        except zlib.error:
            break
        content = d.unused_data
    return b"".join(out)


def _header(line: list[str], fields: tuple[str, ...]) -> dict | None:
    """The fields of a header line, or None if it is none: too few fields, or a date or length that is no number."""
    if len(line) > len(fields):  # a URL with spaces: the fields after it are fixed
        line = [" ".join(line[: len(line) - len(fields) + 1]), *line[len(line) - len(fields) + 1 :]]
    found = dict(zip(fields, line))
    numbers = (found.get("Archive-length", ""), found.get("Archive-date", ""))
    return found if len(line) == len(fields) and all(x.isascii() and x.isdigit() for x in numbers) else None


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: header fields by the version last declared, `content`, its `at` in the file and whether it is `cut` short.

    Lines that are no header are passed over up to the next that is one. A version block
    that declares neither fields nor a known version leaves those before it in force.
    """
    at, fields = 0, FIELDS["1"]
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        opens = line[0].startswith("filedesc://")
        # Version 2 opens with its own ten fields, before it has declared them.
        found = next((h for f in (fields, *FIELDS.values()) if (h := _header(line, f) if len(line) == len(f) or not opens else None)), None)
        if not found:
            at = end + 1
            continue
        begin, length = end + 1, int(found["Archive-length"])
        content = data[begin : begin + length]
        if opens:
            said = content.decode("utf-8", "replace").split("\n")
            declared = tuple(said[1].split()) if len(said) > 1 else ()
            good = "Archive-length" in declared and "Archive-date" in declared and "URL" in declared
            fields = declared if good else FIELDS.get(said[0].split(" ")[0], fields)
        else:
            yield found | {"content": content, "at": at, "cut": len(content) < length}
        at = begin + length


def split_http(content: bytes) -> tuple[dict, bytes]:
    """Response headers by lower-case name, and the payload; without headers all is payload."""
    if not content.startswith(b"HTTP/"):
        return {}, content
    head, _, payload = content.partition(b"\r\n\r\n")
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}, payload


def iso_time(date: str) -> str:
    """An ARC date of up to 14 digits as a WARC date; missing months and days are 01, missing times 0."""
    date = (date + "00000101000000"[len(date) :])[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(place: str) -> str:
    """Identifier made from the place of a record: its archive and offset there."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def warc_header(kind: str, lines: list[tuple[str, object]], length: int) -> str:
    """Header lines of a record, without those whose value is None; the blank line after them included."""
    said = [f"{k}: {v}" for k, v in [("WARC-Type", kind), *lines, ("Content-Length", length)] if v is not None]
    return "\r\n".join(["WARC/1.1", *said]) + "\r\n\r\n"


def warc_info(place: str) -> bytes:
    """The record that opens an archive."""
    body = b"software: signalmill\r\nformat: WARC File Format 1.1\r\n"
    return warc_header("warcinfo", [("WARC-Record-ID", record_id(place)), ("WARC-Date", iso_time(DATE)), ("Content-Type", "application/warc-fields")], len(body)).encode() + body


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers by lower-case name, block) of each record, cut by Content-Length; a record without a length or a whole block is passed over."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        pairs = (x.partition(": ") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        head = {k.lower(): v for k, _, v in pairs}
        start, length = end + 4, head.get("content-length", "")
        if not length.isdigit():
            at = start
            continue
        at = start + int(length)
        if at <= len(data):
            yield head, data[start:at]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html", date_col: str | None = None) -> None:
    """Pages as ARC archives of version blocks, versions 1 and 2 in turn.

    Null payloads are empty, null urls '-', null ids have no X-Page-Id; date_col holds
    14-digit dates. Repeated rows give a record each, an empty table archives without any.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        version, held, size = "1", [], 0
        for batch in batches:
            for key, url, payload, date in zip(batch["i"], batch["u"], batch["p"], batch["d"]):
                named = "" if key is None else f"X-Page-Id: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}\r\n".encode()
                held.append(arc_record(version, url, head + payload.encode("utf-8", "surrogatepass"), date=date))
                size += len(held[-1])
                if size > BLOCK // 8:
                    yield pd.DataFrame({"value": [arc_block(version, held, f"part-{version}.arc")]})
                    version, held, size = "2" if version == "1" else "1", [], 0
        if held:
            yield pd.DataFrame({"value": [arc_block(version, held, f"part-{version}.arc")]})

    # Ids travel as text: a batch with a null would turn them into doubles.
    ready = pages.select(
        F.col(id_col).cast("long").cast("string").alias("i"), F.col(url_col).cast("string").alias("u"), F.coalesce(F.col(payload_col), F.lit("")).alias("p"),
        F.coalesce(F.col(date_col) if date_col else F.lit(None).cast("string"), F.lit(DATE)).alias("d"),
    )
    blocks = ready.mapInPandas(each, "value binary")
    blocks.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", 8).text(path)


CONVERTED = ["page_id", "url", "date", "record_id", "cut", "content", "payload_bytes", "payload_digest"]


def convert_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC archives with the identifiers, payload sizes and SHA-1 digests made for them."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                rows, size = [], 0
                for r in parse_arc(_unpacked(bytes(data))):
                    head, payload = split_http(r["content"])
                    key = head.get("x-page-id", "")
                    key = key if re.fullmatch(r"-?\d{1,19}", key) else None
                    rows.append((key, r["URL"], r["Archive-date"], record_id(f"{name}:{r['at']}"), r["cut"], r["content"], len(payload), hashlib.sha1(payload).hexdigest()))
                    size += len(payload)
                    if size > 4_000_000:
                        yield pd.DataFrame(rows, columns=CONVERTED)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=CONVERTED)

    kinds = "page_id string, url string, date string, record_id string, cut boolean, content binary, payload_bytes long, payload_digest string"
    return _files(spark, path).mapInPandas(each, kinds).withColumn("page_id", F.expr("try_cast(page_id as long)"))


def with_types(records: DataFrame, least: int = 1000, salts: int = 16) -> DataFrame:
    """Add `refers_to` and `refers_id`: of records with one payload of `least` bytes or more, the largest page_id and a record of it; null for records of that page.

    Digests are aggregated first; a digest that many records share is met by `salts` copies
    of its one row, so its records spread over as many tasks. Without any page_id the
    largest record_id stands.
    """
    top = F.max(F.struct("page_id", "record_id"))
    first = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(top.alias("_to"), F.count("*").alias("_n"))
    first = first.where("_n > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = records.withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    joined = left.join(first, ["payload_digest", "payload_bytes", "_salt"], "left")
    other = F.col("_to").isNotNull() & ~F.when(F.col("_to.page_id").isNull(), F.col("_to.record_id") == F.col("record_id")).otherwise(F.col("_to.page_id").eqNullSafe(F.col("page_id")))
    return joined.withColumns({"refers_to": F.when(other, F.col("_to.page_id")), "refers_id": F.when(other, F.col("_to.record_id"))}).drop("_salt", "_to", "_n")


def write_warc(records: DataFrame, path: str) -> None:
    """A response, or a revisit without payload, for every converted record; each part opens with a warcinfo record."""
    names = ("page_id", "url", "date", "record_id", "cut", "content", "payload_bytes", "payload_digest", "refers_to", "refers_id")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for key, url, date, name, cut, content, n, digest, to, to_id in zip(*(batch[c] for c in names)):
                block, kind, profile = bytes(content), "response", None
                if to_id is not None:
                    kind, profile = "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    block = block[: block.find(b"\r\n\r\n") + 4] if block.startswith(b"HTTP/") else b""
                lines = [
                    ("WARC-Record-ID", name), ("WARC-Date", iso_time(date)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", n),
                    ("X-Page-Id", key), ("WARC-Refers-To", to_id), ("X-Refers-To-Page", to), ("WARC-Profile", profile), ("WARC-Truncated", "length" if cut else None),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                if not held:
                    held.append(warc_info(f"{name}-info"))
                held.append(warc_header(kind, lines, len(block)).encode("utf-8", "surrogatepass") + block)
                size += len(held[-1])
                if size > BLOCK // 8:
                    yield pd.DataFrame({"value": [b"\r\n\r\n".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [b"\r\n\r\n".join(held)]})

    blocks = records.select(*[F.col(c).cast("string") if c in ("page_id", "refers_to") else F.col(c) for c in names]).mapInPandas(each, "value binary")
    blocks.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 8).text(path)


READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of WARC archives; a response's size and digest come from its own payload, a revisit's from its header."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for head, block in parse_warc(_unpacked(bytes(data))):
                    kind = head.get("warc-type")
                    if kind == "response":
                        _, payload = split_http(block)
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    elif kind == "revisit":
                        size, digest = int(head.get("x-payload-bytes", 0)), head.get("warc-payload-digest", "").removeprefix("sha1:")
                    else:
                        continue
                    rows.append((head.get("x-page-id"), size, digest, kind, head.get("x-refers-to-page")))
                if rows:
                    yield pd.DataFrame(rows, columns=READ)

    kinds = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return _files(spark, path).mapInPandas(each, kinds).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    write_warc(with_types(convert_arc(spark, arc)), warc)
    return read_warc(spark, warc)


OP4_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.top IS NOT NULL AND f.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.top <> p.page_id THEN f.top END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 1000
"""
