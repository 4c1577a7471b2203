"""Legacy archive converter: ARC files in, WARC files out, and readers of both.

An ARC record is a header line of space-separated fields, whose names the version block of the
file lists (five in version 1, ten in version 2), and as many bytes as its last field declares.
The converter parses those and synthesises what a WARC record needs: an identifier from key and
digest, an ISO timestamp, a type, and SHA-256 payload and block digests. Payloads of at least
``LEAST_REVISIT`` bytes that occur more than once are stored with the smallest key; the other
records become revisits that refer to it.

Records of the same key and payload are copies of one record: all are responses if theirs is
the smallest key. A null key is larger than all others. Null payloads are empty. Archives are
written by Spark, so they can live in any store that Spark reaches, as gzip members of a record
each, in files bounded by their bytes; the reader inflates a file record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

LEAST_REVISIT = 100
#: Bytes of records in one ARC segment, compressed bytes after which a WARC file ends, bytes of a record in one gzip member.
SEGMENT_BYTES, FILE_BYTES, MEMBER_BYTES = 4 << 20, 32 << 20, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
KEY_HEADER = b"x-record-key"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes

    @property
    def url(self) -> str:
        return self.fields["URL"]


def arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int, name: str = "-", offset: int = 0, code: str = "200") -> bytes:
    url = url.replace("%", "%25").replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A") if any(c in url for c in " \r\n") else url
    rest = [code, "-", "-", str(offset), name] if version == 2 else []
    return " ".join([url or "-", ip, date, kind, *rest, str(length)]).encode() + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that begins a file."""
    block = f"{version} 0 tideflow\n{' '.join(FIELDS[version])}\n".encode()
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(block), name) + block + b"\n"


def read_arc(stream: BinaryIO, version: int = 1) -> Iterator[ArcRecord]:
    """Records of an ARC stream; each version block sets the fields of the lines after it."""
    names = FIELDS[version]
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if line.startswith(b"filedesc://"):
            n = int(line.rsplit(b" ", 1)[1])
            block = stream.read(n)
            lines = block.decode("latin-1").splitlines()
            version = int(lines[0].split()[0])
            names = lines[1].split() if len(lines) > 1 and lines[1].strip() else FIELDS[version]
            own = FIELDS[2] if len(line.split(b" ")) >= 10 else FIELDS[1]
        else:
            own, n, block = names, None, None
        parts = line.decode("utf-8", "replace").rsplit(" ", len(own) - 1)  # a URL may hold spaces
        if len(parts) != len(own) or not parts[-1].isdigit():
            raise ValueError(f"not a header line of version {version}: {line[:80]!r}")
        if block is None:
            n = int(parts[-1])
            block = stream.read(n)
        if len(block) < n:
            raise ValueError(f"{n} bytes were declared, {len(block)} are there")
        yield ArcRecord(dict(zip(own, parts, strict=True)), block)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header block with its blank line, and body; no header if there is no status line."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    for end in (b"\r\n\r\n", b"\n\n"):
        at = content.find(end)
        if at >= 0:
            return content[: at + len(end)], content[at + len(end):]
    return content, b""


def http_value(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\n")[1:]:
        key, sep, value = line.partition(b":")
        if sep and key.strip().lower() == name:
            return value.strip()
    return None


def record_id(key: str, digest: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{key}:{digest}'.encode()).digest()[:16], version=5)}"


def iso_date(date: str) -> str:
    """14 digits (or the 12 of the oldest files) as an ISO timestamp."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def converted(record: ArcRecord) -> dict:
    """What the WARC record of an ARC record has, whether its payload will be stored or not."""
    head, payload = split_http(record.content)
    kind = record.fields["Content-type"]
    if record.url.startswith("filedesc:"):
        warc_type, kind = "warcinfo", "application/warc-fields"
        payload = b"software: tideflow\r\nformat: WARC File Format 1.1\r\n"
    elif head:
        warc_type, kind = "response", "application/http; msgtype=response"
    else:
        warc_type = "resource"
    key = http_value(head, KEY_HEADER)
    return {
        "warc_type": warc_type, "uri": record.url, "ip": record.fields["IP-address"], "date": iso_date(record.fields["Archive-date"]),
        "content_type": kind, "key": int(key) if key else None, "digest": hashlib.sha256(payload).hexdigest(), "length": len(payload),
        "head": head, "payload": payload,
    }


CONVERTED = "warc_type string, uri string, ip string, date string, content_type string, key bigint, digest string, length bigint, head binary, payload binary"


def convert(archives: DataFrame, column: str = "content") -> DataFrame:
    """Rows of ARC file contents (plain or gzip) to rows of records to write. Keeps no other column."""

    def run(frames):
        for frame in frames:
            for content in frame[column]:
                if content is None:
                    continue
                stream = io.BytesIO(content)
                stream = gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream
                batch, size = [], 0
                for record in read_arc(stream):
                    batch.append(converted(record))
                    size += len(record.content)
                    if size >= SEGMENT_BYTES:
                        yield _frame(batch)
                        batch, size = [], 0
                if batch:
                    yield _frame(batch)

    return archives.select(column).mapInPandas(run, CONVERTED)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    out["key"] = out["key"].astype("Int64")
    return out


def without_copies(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``records`` and refers_to: the smallest key of an equal payload, null for records that keep theirs.

    Only digests, lengths and keys are grouped; the payloads move once, by key.
    """
    spark = records.sparkSession
    work = Workspace(spark, "warc")
    facts = work.table(records.where("length >= %d and warc_type != 'warcinfo'" % least).select("digest", "key"))
    first = facts.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = facts.join(first, "digest").where(~F.col("key").eqNullSafe(F.col("first"))).select(F.col("key").alias("_key"), F.col("digest").alias("_digest"), "first").distinct()
    revisits = work.only(revisits)
    on = records["key"].eqNullSafe(revisits["_key"]) & (records["digest"] == revisits["_digest"])
    return records.join(revisits, on, "left").select(*records.columns, F.col("first").alias("refers_to"))


def warc_record(r: dict) -> bytes:
    key = "null" if r["key"] is None else r["key"]
    own = record_id(key, r["digest"]) if r["warc_type"] != "warcinfo" else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, r['uri'])}"
    revisit = r["refers_to"] is not None
    block = r["head"] + (b"" if revisit else r["payload"])
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['warc_type']}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha256:{r['digest']}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(r['refers_to'], r['digest'])}>", f"X-Refers-To-Key: {r['refers_to']}"]
    lines += [f"Content-Type: {r['content_type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(record: bytes) -> bytes:
    """A record as a gzip member of its own; one of more than MEMBER_BYTES as several. The last byte is zero: the top of a length below 16 MB."""
    pieces = range(0, max(len(record), 1), MEMBER_BYTES)
    return b"".join(gzip.compress(record[i : i + MEMBER_BYTES], 6, mtime=0) for i in pieces)


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write records (see ``without_copies``) as WARC files of gzip members below ``path``; a file ends with the record that takes it to ``file_bytes``.

    Spark's text writer puts out the bytes of a file's one row as they are; its line end is the zero byte that ends a member.
    """

    def run(frames):
        parts, size = [], 0
        for frame in frames:
            for r in frame.to_dict("records"):
                parts.append(members(warc_record(r)))
                size += len(parts[-1])
                if size >= file_bytes:
                    yield pd.DataFrame({"value": [b"".join(parts)[:-1]]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"value": [b"".join(parts)[:-1]]})

    # keys as text: pandas would make floats of them where there are nulls
    texts = {c: F.col(c).cast("string") for c in ("key", "refers_to")}
    rows = records.withColumns(texts).mapInPandas(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_warc_stream(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; blocks end where their declared length says."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.lower()] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError(f"{n} bytes were declared, {len(block)} are there")
        yield headers, block


READ = "record_id string, warc_type string, uri string, date string, key bigint, payload_bytes bigint, payload_digest string, refers_to_id string, refers_to bigint, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the WARC files below ``path``. A revisit has the length and digest of the payload it stands for."""

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                rows, size = [], 0
                for h, block in read_warc_stream(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    head, payload = split_http(block) if h["content-type"].startswith("application/http") else (b"", block)
                    revisit = h["warc-type"] == "revisit"
                    key, declared = http_value(head, KEY_HEADER), http_value(head, b"content-length")
                    refers = h.get("x-refers-to-key")
                    rows.append({
                        "record_id": h["warc-record-id"].strip("<>"), "warc_type": h["warc-type"], "uri": h.get("warc-target-uri"), "date": h["warc-date"],
                        "key": int(key) if key else None, "payload_bytes": int(declared) if revisit and declared else len(payload),
                        "payload_digest": h["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha256(payload).hexdigest(),
                        "refers_to_id": h.get("warc-refers-to", "").strip("<>") or None, "refers_to": int(refers) if refers else None,
                        "payload": payload if payloads and not revisit else None,
                    })
                    size += len(block)
                    if size >= SEGMENT_BYTES:
                        yield _read_frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _read_frame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,gz}").load(path)
    return files.select("content").mapInPandas(run, READ)


def _read_frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"key": "Int64", "refers_to": "Int64"})


def pages_to_arc(pages: DataFrame, key: str, url: str, payload: str, date: str = "19970101000000") -> DataFrame:
    """Pages as ARC segments of a few megabytes, of version 2 and 1 in turn, a record per page: a corpus for the converter."""

    def run(frames):
        for n, frame in enumerate(frames):
            parts, size, version = [], 0, 0
            for i, (k, u, body) in enumerate(zip(frame["k"], frame["u"], frame["b"], strict=True)):
                if not parts:
                    version = 1 if version == 2 else 2
                    parts.append(arc_head(version, f"pages-{n}-{i}.arc", date))
                own = b"" if pd.isna(k) else b"X-Record-Key: %d\r\n" % int(k)
                content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(body), own) + bytes(body)
                parts += [arc_line(version, u, "0.0.0.0", date, "text/html", len(content), "pages.arc", size), content, b"\n"]
                size += len(content)
                if size >= SEGMENT_BYTES:
                    yield pd.DataFrame({"content": [b"".join(parts)]})
                    parts, size = [], 0
            if parts:
                yield pd.DataFrame({"content": [b"".join(parts)]})

    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    # keys as text: pandas would make floats of them where there are nulls
    rows = pages.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(url), F.lit("-")).alias("u"), body.alias("b"))
    return rows.mapInPandas(run, "content binary")


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Pages through ARC and the converter into WARC files in the shared folder, and read back from those."""
    spark = pages.sparkSession
    path = Workspace(spark, "warc").path()
    records = convert(pages_to_arc(pages, key, url, payload)).where("warc_type != 'warcinfo'")
    write_warc(without_copies(records), path)
    return read_warc(spark, path, payloads=False)


def sql() -> str:
    """The query over pages in DuckDB."""
    return f"""with d as (select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) s from pages),
f as (select s, min(page_id) first from d where n >= {LEAST_REVISIT} group by s)
select page_id, n payload_bytes, d.s payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end record_type,
case when page_id <> first then first end refers_to from d left join f on d.s = f.s and n >= {LEAST_REVISIT}"""
