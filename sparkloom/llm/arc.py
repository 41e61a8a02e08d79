"""Legacy web archives: ARC records of versions 1 and 2 converted to WARC, with identical payloads as revisits."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, new_path, text_bytes, tracked, written
from sparkloom.llm.unpacking import Stream

#: The fields of a record's header line in either version, the last one the length.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive segment that this module writes, about; records of one WARC file, and bytes of their payloads.
SEGMENT_BYTES, FILE_RECORDS, FILE_BYTES = 4 << 20, 2000, 64 << 20
#: Up to so many payloads that occur twice are broadcast, some 100 bytes for each; beyond that they join by a shuffle.
BROADCAST_PAYLOADS = 50_000
#: Bytes that records of one Arrow batch hold, about.
BATCH = 8 << 20
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
#: A line that begins a record in either version, wherever it is found.
_HEADER = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:.* \d{1,3}(?:\.\d{1,3}){3} \d{4,14} \S+ (?:\S+ \S+ \S+ \d+ \S+ )?\d+\r?\n")


@dataclass
class ArcRecord:
    """``fields``: those that only version 2 has, by name. ``damage``: what is wrong, if this is no record but lost bytes."""

    url: bytes
    ip: bytes
    date: bytes
    kind: bytes
    body: bytes
    truncated: bool = False
    fields: dict[str, str] = field(default_factory=dict)
    is_version_block: bool = False
    damage: str | None = None


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file. The first is its version block, which says how many fields a header line has.

    Fields are taken from the right, as URLs in old archives may hold blanks. A record that the file ends within, or that
    runs into damage, is marked as truncated. Bytes that belong to no record come as one with ``damage``: they reach to
    the next line that looks like a header, beyond a damaged gzip member to the next one.
    """
    stream, names, first = Stream(data), ARC_FIELDS[1].split(b" "), True
    while True:
        line = stream.line()
        if line is None:
            if lost := stream.rest():
                yield _lost(lost, "no header line")
            if not stream.resume():
                return
            continue
        if not line.strip(b"\r\n"):
            continue
        is_block = first and line.startswith(b"filedesc://")
        first = False
        parts = line.rstrip(b"\r\n").rsplit(b" ", (5 if is_block else len(names)) - 1)
        if len(parts) != (5 if is_block else len(names)) or not parts[-1].isdigit():
            yield _lost(_to_next_header(stream, line), "a header line without its fields")
            continue
        size = int(parts[-1])
        body = stream.take(size)
        own = {n.decode(): v.decode("utf-8", "replace") for n, v in zip(names[4:-1], parts[4:-1], strict=False)}
        yield ArcRecord(*parts[:4], body, len(body) < size, {n: v for n, v in own.items() if v != "-"}, is_block)
        if is_block:
            names = ARC_FIELDS[2 if body[:1] == b"2" else 1].split(b" ")


def _lost(data: bytes, what: str) -> ArcRecord:
    return ArcRecord(b"", b"", b"", b"application/octet-stream", data, damage=what)


def _to_next_header(stream: Stream, line: bytes) -> bytes:
    lost = [line]
    while (line := stream.line()) is not None:
        if _HEADER.fullmatch(line):
            stream.back(line)
            break
        lost.append(line)
    return b"".join(lost)


def arc_record(url: str, ip: str, date: str, kind: str, body: bytes, version: int = 1) -> bytes:
    """A record as an ARC file of that version holds it."""
    start = [re.sub(r"\s", "%20", url) or "about:blank", ip, date, kind]
    if version == 2:
        start += ["200", "-", "-", "0", "-"]
    return b"\n" + f"{' '.join(start)} {len(body)}\n".encode() + body


def version_block(name: str, date: str, version: int = 1) -> bytes:
    body = b"%d 0 sparkloom\n" % version + ARC_FIELDS[version] + b"\n\n"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body


def iso_date(date: bytes) -> str:
    """An ARC date of up to 14 digits as a WARC date; what is missing is the first moment of what there is."""
    digits = re.sub(rb"\D", b"", date).decode()[:14]
    given = digits + "19700101000000"[len(digits) :] if len(digits) >= 4 else "19700101000000"
    given = given[:4] + (given[4:6] if given[4:6] > "00" else "01") + (given[6:8] if given[6:8] > "00" else "01") + given[8:]
    return f"{given[:4]}-{given[4:6]}-{given[6:8]}T{given[8:10]}:{given[10:12]}:{given[12:14]}Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


RECORD_SCHEMA = "record_id string, record_type string, target_uri string, date string, ip string, content_type string, http_header binary, payload binary, payload_digest string, truncated boolean, warcinfo_id string, arc_fields map<string,string>, damage string"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("content_type", pa.string()), ("http_header", pa.binary()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("truncated", pa.bool_()), ("warcinfo_id", pa.string()), ("arc_fields", pa.map_(pa.string(), pa.string())), ("damage", pa.string())])


def converted(record: ArcRecord, warcinfo_id: str | None = None) -> dict:
    """The WARC fields for an ARC record: an identifier made of its content, so reruns agree, an ISO date, its type and digest.

    A version block becomes a warcinfo record whose payload is the block, and lost bytes a metadata record.
    """
    http = record.body.startswith(b"HTTP/") and not record.damage
    split = record.body.find(b"\r\n\r\n") + 4 if http else 0
    if http and split < 4:
        split = len(record.body)
    header, payload = record.body[:split], record.body[split:]
    digest = base32_sha1(payload)
    name = b"\x00".join((record.url, record.date, record.ip, header, digest.encode()))
    kind = "response" if http else "warcinfo" if record.is_version_block else "metadata" if record.damage else "resource"
    return {
        "record_id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, hashlib.sha1(name, usedforsecurity=False).hexdigest())}>", "record_type": kind,
        "target_uri": record.url.decode("utf-8", "replace"), "date": iso_date(record.date), "ip": record.ip.decode("ascii", "replace"),
        "content_type": "application/http; msgtype=response" if http else record.kind.decode("ascii", "replace"),
        "http_header": header, "payload": payload, "payload_digest": digest, "truncated": record.truncated,
        "warcinfo_id": None if record.is_version_block else warcinfo_id, "arc_fields": list(record.fields.items()), "damage": record.damage,
    }


def _bounded(rows: Iterator[dict], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about BATCH bytes and 500 rows at most; ``size`` tells a row's bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= BATCH or len(held) >= 500:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _all_converted(data: bytes) -> Iterator[dict]:
    warcinfo_id = None
    for record in parse_arc(data):
        made = converted(record, warcinfo_id)
        if record.is_version_block:
            warcinfo_id = made["record_id"]
        yield made


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            yield from _bounded(_all_converted(content.as_py() or b""), _ARROW, lambda r: len(r["payload"]))


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """The WARC records, RECORD_SCHEMA, for all ARC records in the files' ``content``; null and empty files have none.

    ``archives`` is what ``spark.read.format("binaryFile")`` reads, gzip members or plain; files are unpacked and read as
    streams. Each file's version block becomes a warcinfo record, to which its other records refer; ``arc_fields`` holds
    what a version 2 header says beyond version 1. Torn records are ``truncated``. Bytes that damage leaves without a
    record are kept as one of type metadata, whose ``damage`` says what is wrong; intact records after them are found.
    Repeated records stay.
    """
    bounded_batches(archives.sparkSession)
    return archives.select("content").mapInArrow(_convert, RECORD_SCHEMA)


def _segments(segment_bytes: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        date, number = "20200101000000", itertools.count()
        for batch in batches:
            pages = iter(zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "_html")), strict=True))
            for page in pages:
                version, size = 1 + next(number) % 2, 0
                parts = [version_block("pages.arc", date, version)]
                for page_id, url, html in itertools.chain([page], pages):
                    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
                    header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{own}\r\n"
                    parts.append(arc_record(url or "", "192.0.2.1", date, "text/html", header.encode() + html, version))
                    size += len(html)
                    if size >= segment_bytes:
                        break
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    return made


def pages_to_arc(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``content``: ARC segments of both versions, one record for each page; a page's id goes into its HTTP header."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("string").alias("page_id"), pages["url"].cast("string").alias("url"), text_bytes(pages["html"]).alias("_html"))
    return rows.mapInArrow(_segments(segment_bytes), "content binary")


def page_id(http_header: Column) -> Column:
    """The id that :func:`pages_to_arc` put into a header."""
    found = F.regexp_extract(F.decode(http_header, "ISO-8859-1"), r"\r\nX-Page-Id: (-?\d+)\r\n", 1)
    return F.when(found != "", found.cast("long"))


def mark_revisits(records: DataFrame, key: Column, min_bytes: int = 0) -> DataFrame:
    """``records`` with ``refers_to``, the record_id of the first response of equal payload, null for that one itself.

    The first is the one of the smallest ``key``, null last. Records of the smallest key are all responses, and so are
    payloads under ``min_bytes``. Only responses count.
    """
    keyed = records.withColumn("_key", key)
    able = (F.col("record_type") == "response") & (F.octet_length("payload") >= min_bytes)
    order = F.struct(F.col("_key").isNull(), F.col("_key"), F.col("record_id"))
    groups = keyed.where(able).groupBy(F.col("payload_digest").alias("_digest")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    groups = written(groups.where("_n > 1").select("_digest", F.col("_first")["_key"].alias("_first_key"), F.col("_first")["record_id"].alias("_first_id")), "arc-payloads")
    few = groups.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS
    found = keyed.join(F.broadcast(groups) if few else groups, (F.col("payload_digest") == F.col("_digest")) & able, "left")
    refers = F.when(F.col("_digest").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first_key")), F.col("_first_id"))
    return found.withColumn("refers_to", refers).drop("_key", "_digest", "_first_key", "_first_id")


def warc_text(records: DataFrame) -> DataFrame:
    """``value``: each record in WARC/1.1 but for the blank lines that end it; ``refers_to`` makes a revisit.

    What WARC has no field for is kept in fields of its own: ``X-Arc-…`` for those of ARC version 2, ``X-Damage``, and on
    revisits ``X-Payload-Length``.
    """
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.col("http_header")).otherwise(F.concat("http_header", "payload"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))
    optional = lambda name, value: F.coalesce(line(name, F.when(value != "", value)), F.lit(""))
    extra = F.transform(F.map_entries("arc_fields"), lambda e: F.concat(F.lit("\r\nX-Arc-"), e["key"], F.lit(": "), e["value"]))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise(F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), optional("WARC-Target-URI", F.when(F.col("record_type") != "warcinfo", F.col("target_uri"))),
        optional("WARC-Filename", F.when(F.col("record_type") == "warcinfo", F.regexp_replace("target_uri", "^filedesc://", ""))), optional("WARC-Warcinfo-ID", F.col("warcinfo_id")),
        optional("WARC-IP-Address", F.col("ip")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.col("refers_to")), line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("X-Payload-Length", F.octet_length("payload")))).otherwise(""),
        F.when(F.col("truncated"), line("WARC-Truncated", F.lit("unspecified"))).otherwise(""), F.array_join(extra, ""), optional("X-Damage", F.col("damage")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length(block)), F.lit("\r\n\r\n"),
    )
    return records.select(F.concat(header, block.cast("string")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """The records as gzip files under ``path``; Spark commits them, so a lost task leaves no half files.

    Records are written by classes of their size, each with so many to a file that no file holds more than FILE_BYTES, or
    one larger record. ``records`` is read once to see the sizes and once for each class there is, one class for most
    corpora, so it had better be a written table.
    """
    size = F.octet_length("http_header") + F.octet_length("payload")
    limits = [FILE_BYTES // FILE_RECORDS]
    while limits[-1] < FILE_BYTES:
        limits.append(limits[-1] * 16)
    kind = F.least(F.lit(len(limits)), F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < size)))
    for k in sorted(r["kind"] for r in records.select(kind.alias("kind")).distinct().collect()):
        most = max(1, FILE_BYTES // limits[k]) if k < len(limits) else 1
        text = warc_text(records.where(kind == k)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most)
        text.text(f"{path}/{k}")
    records.sparkSession.createDataFrame([], "value string").write.mode("append").text(path)  # the folder, where there is no record


_READ = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("http_header", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file by their declared lengths, one at a time. A response's digest is that of the payload read,
    and an error if the header says otherwise; a revisit's length and digest are those its header declares. A file that
    is damaged or ends within a record is an error too."""
    stream = Stream(data)
    while (line := stream.line()) is not None:
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.line() or b"").strip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            fields[name] = value
        size, kind = int(fields["Content-Length"]), fields["WARC-Type"]
        block = stream.take(size)
        if len(block) < size:
            raise ValueError(f"{fields['WARC-Record-ID']}: the file ends within the record")
        split = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind != "revisit" and base32_sha1(block[split:]) != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have the digest of its header")
        length = int(fields["X-Payload-Length"]) if kind == "revisit" else len(block) - split
        yield {"record_id": fields["WARC-Record-ID"], "record_type": kind, "target_uri": fields.get("WARC-Target-URI"), "http_header": block[:split], "payload": block[split:], "payload_bytes": length, "payload_digest": digest, "refers_to": fields.get("WARC-Refers-To"), "fields": list(fields.items())}
    if stream.rest():
        raise ValueError("the file ends within a record's header")


def _read(columns: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([_READ.field(c) for c in columns])
        for batch in batches:
            for content in batch.column("content"):
                rows = ({c: r[c] for c in columns} for r in parse_warc(content.as_py() or b""))
                yield from _bounded(rows, schema, lambda r: len(r.get("payload") or b""))

    return read


def read_warc(df_spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the WARC files under ``path``, which :func:`write_warc` wrote: files are bounded, and read as streams.

    ``fields`` holds all header fields by name. Empty files have no records; damage is an error.
    """
    columns = columns or _READ.names
    kinds = {"http_header": "binary", "payload": "binary", "payload_bytes": "long", "fields": "map<string,string>"}
    bounded_batches(df_spark)
    files = df_spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read(columns), ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, as read back from its archive.

    The pages become ARC segments, those WARC records, and these files in the shared folder. Null html is an empty
    payload, a null url ``about:blank``; a page of any length is one record. Repeated rows stay, and with the smallest
    page_id all are responses; a null page_id comes last. An empty table gives an empty table. Other columns of ``pages``
    are not read.
    """
    spark = pages.sparkSession
    path = tracked(spark, new_path(spark, "warc"))
    records = written(arc_to_warc(pages_to_arc(pages)), "arc-records")
    write_warc(mark_revisits(records, page_id(F.col("http_header")), min_bytes), path)
    read = read_warc(spark, path, ["record_id", "record_type", "http_header", "payload_bytes", "payload_digest", "refers_to"])
    read = read.where(F.col("record_type").isin("response", "revisit"))
    index = written(read.withColumn("page_id", page_id(F.col("http_header"))).drop("http_header"), "warc-index")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    again = index.where("record_type = 'revisit'")
    sought = again.select(F.col("refers_to").alias("_sought")).distinct()
    first = index.where("record_type = 'response'").join(sought, F.col("record_id") == F.col("_sought"), "left_semi")
    first = written(first.groupBy(F.col("record_id").alias("_id")).agg(F.min("page_id").alias("_page")), "warc-responses")
    few = first.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS
    again = again.join(F.broadcast(first) if few else first, F.col("refers_to") == F.col("_id"), "left").select(*columns, F.col("_page").alias("refers_to"))
    return again.union(index.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")))
