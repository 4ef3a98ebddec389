"""Legacy archive converter: ARC files to WARC records, and a WARC reader.

ARC version 1 header lines have five fields (URL, IP address, date, content
type, length), version 2 lines have ten (URL, IP address, date, content type,
result code, checksum, location, offset, file name, length).  The version is
read from the version block that opens every archive.  A record's body is
taken by its declared length, never by what it contains.  WARC identifiers are
name-based UUIDs of the archive's own fields, so a repeated conversion gives
the same ones; the 14-digit date becomes an ISO 8601 time; digests are base32
SHA-1 of the payload.

Legacy archives are a written table, at most ``ARC_RECORDS`` records and about
``ARC_BYTES`` each, named by the task and the sequence that made them, so no two
share a name.  Which page is the response is found from digests and ids alone;
each archive then gets the list of its revisits, so payloads move once, by
archive, and no digest draws them together.

WARC files are written with Spark's text sink (records end with CRLF CRLF, which
is the line separator; a row is the records of one archive), so any file system
that Spark writes works, and read back whole through the ``binaryFile`` source,
record by record by ``Content-Length``.  Files are compressed as a whole (``.gz``).  A file holds
``FILE_ARCHIVES`` archives at most, which bounds its bytes unless single pages are giant.

Edge cases: null html is an empty payload and null url an empty one; spaces and
control characters in a URL are percent-encoded; of records with equal payloads
the largest ``page_id`` is the response and all rows of that id are (a repeated
row is written twice); a null ``page_id`` ranks below every other; other
columns are not read; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

#: The field lists of the two ARC versions.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Seconds from which the synthetic archive dates count (2001-09-09T01:46:40Z).
EPOCH = 1_000_000_000
ARC_RECORDS = 64
ARC_BYTES = 1 << 20
FILE_ARCHIVES = 64
#: A digest of more than one in so many of all records is hot.
HOT_SHARE = 4000
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:treeloom:arc")
_UNSAFE = re.compile(rb"[\x00-\x20\x7f%]")


def arc_block(version: int, name: str) -> bytes:
    """The version block that opens an archive."""
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    body = f"{version} 0 treeloom\n{fields}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 19700101000000 text/plain "
    head += f"{len(body)}\n" if version == 1 else f"200 - - 0 {name} {len(body)}\n"
    return head.encode() + body + b"\n"


def arc_record(version: int, name: str, url: bytes, date: str, body: bytes, offset: int) -> bytes:
    """One ARC record: the header line, the body, a new line."""
    safe = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url) or b"-"
    head = safe + f" 0.0.0.0 {date} text/html ".encode()
    if version == 2:
        head += f"200 {hashlib.md5(body).hexdigest()} - {offset} {name} ".encode()
    return head + b"%d\n" % len(body) + body + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an archive, the version block left out; raises on a header line that its version doesn't allow."""
    view, at, width = memoryview(data), 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        fields = bytes(view[at:end]).split(b" ")
        if not width:
            if not fields[0].startswith(b"filedesc://"):
                raise ValueError("an archive opens with its version block")
            body_at, length = end + 1, int(fields[-1])
            version = int(bytes(view[body_at : body_at + length]).split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"unknown version {version}")
            width = 5 if version == 1 else 10
            at = body_at + length + 1
            continue
        if len(fields) != width:
            raise ValueError(f"{len(fields)} fields at byte {at}; version {version} has {width}")
        length = int(fields[-1])
        if end + 1 + length > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield {"url": fields[0], "date": fields[2].decode(), "type": fields[3].decode(), "offset": at, "body": bytes(view[end + 1 : end + 1 + length])}
        at = end + 1 + length + 1


def payload_digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


_ARCHIVES = "archive string, version int, page_ids array<long>, z binary"


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(``archive``, ``version``, ``page_ids``, ``z``: compressed bytes): legacy archives of the pages, versions 1 and 2 in turn."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, zip_ = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        data, ids = bytearray(), []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"archive": [name], "version": [version], "page_ids": [ids], "z": [zip_.compress(bytes(data))]},
                pa.schema([("archive", pa.string()), ("version", pa.int32()), ("page_ids", pa.list_(pa.int64())), ("z", pa.binary())]),
            )

        for batch in batches:
            for r in batch.to_pylist():
                if not ids:
                    version = 1 + seq % 2
                    name = f"pages-{part}-{seq}-v{version}.arc"
                    data = bytearray(arc_block(version, name))
                data += arc_record(version, name, (r["url"] or "").encode(), r["stamp"], (r["html"] or "").encode(), len(data))
                ids.append(r["page_id"])
                if len(ids) >= ARC_RECORDS or len(data) >= ARC_BYTES:
                    yield out()
                    ids, seq = [], seq + 1
        if ids:
            yield out()

    stamp = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyyMMddHHmmss")
    return pages.select("page_id", "url", "html", stamp.alias("stamp")).mapInArrow(pack, _ARCHIVES)


def convert_record(archive: str, page_id: int | None, r: dict) -> dict:
    """The WARC fields of one record of a legacy archive."""
    d = r["date"]
    return {
        "page_id": page_id,
        "record_id": str(uuid.uuid5(_NAMESPACE, f"{archive} {r['offset']}")),
        "url": r["url"].decode("utf-8", "replace"),
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "content_type": r["type"],
        "digest": payload_digest(r["body"]),
        "payload": r["body"],
    }


def _records(batch: pa.RecordBatch) -> Iterator[tuple[str, list[dict]]]:
    """(archive, its converted records in order)."""
    zip_ = zstandard.ZstdDecompressor()
    for name, ids, z in zip(*(batch.column(c).to_pylist() for c in ("archive", "page_ids", "z")), strict=True):
        yield name, [convert_record(name, i, r) for i, r in zip(ids, parse_arc(zip_.decompress(z)), strict=True)]


def digests(archives: DataFrame) -> DataFrame:
    """(``archive``, ``place``, ``page_id``, ``record_id``, ``digest``, ``payload_bytes``) of every record; no payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("place", pa.int32()), ("page_id", pa.int64()), ("record_id", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64())])
        for batch in batches:
            for name, rows in _records(batch):
                yield pa.RecordBatch.from_pylist([{"archive": name, "place": k, **{c: r[c] for c in ("page_id", "record_id", "digest")}, "payload_bytes": len(r["payload"])} for k, r in enumerate(rows)], schema)

    return archives.mapInArrow(read, "archive string, place int, page_id long, record_id string, digest string, payload_bytes long")


def revisits(records: DataFrame, total: int, min_bytes: int = 0) -> DataFrame:
    """(``archive``, ``place``, ``refers_to``: page, ``refers_id``: record) of the rows of ``digests`` that revisit another.

    The response of each digest comes from a partial aggregate.  Fewer than ``HOT_SHARE`` digests are hot; they are broadcast, and
    their records take no part in the join by digest.
    """
    low = F.lit(-(2**63))
    keyed = records.where(F.col("payload_bytes") >= min_bytes).withColumn("rank", F.coalesce("page_id", low))
    tops = keyed.groupBy("digest").agg(F.max(F.struct("rank", "page_id", "record_id")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tops = written(tops.select("digest", "top", (F.col("n") * HOT_SHARE > total).alias("hot")), "warc-tops")
    hot = F.broadcast(tops.where("hot").select("digest", F.col("top").alias("hot_top")))
    cold = tops.where("not hot").select(F.col("digest").alias("by"), F.col("top").alias("cold_top"))
    met = keyed.join(hot, "digest", "left").withColumn("by", F.when(F.col("hot_top").isNotNull(), F.concat(F.lit("-"), "record_id")).otherwise(F.col("digest"))).join(cold, "by", "left")
    top = F.coalesce("hot_top", "cold_top")
    return met.where(F.col("rank") < top["rank"]).select("archive", "place", top["page_id"].alias("refers_to"), top["record_id"].alias("refers_id"))


def warc_record(r: dict, refers: tuple[int | None, str] | None) -> str:
    """One WARC 1.1 record without its closing lines; a revisit has no block and names its response."""
    size = len(r["payload"])
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{r['record_id']}>",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-Date: {r['date']}",
        f"WARC-Payload-Digest: sha1:{r['digest']}",
        f"X-Payload-Length: {size}",
        f"X-Page-ID: {'-' if r['page_id'] is None else r['page_id']}",
    ]
    if refers:
        page, record = refers
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record}>", f"X-Refers-To-Page: {'-' if page is None else page}"]
    head += [f"Content-Type: {r['content_type']}", f"Content-Length: {0 if refers else size}"]
    return "\r\n".join(head) + "\r\n\r\n" + ("" if refers else r["payload"].decode())


def write_warc(archives: DataFrame, found: DataFrame, path: str) -> None:
    """Write the archives' records as WARC files below ``path``; ``found``: the rows of ``revisits``."""
    by_archive = found.groupBy(F.col("archive").alias("of")).agg(F.collect_list(F.struct("place", "refers_to", "refers_id")).alias("revisits"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, rows), own in zip(_records(batch), batch.column("revisits").to_pylist(), strict=True):
                refers = {x["place"]: (x["refers_to"], x["refers_id"]) for x in own or []}
                yield pa.RecordBatch.from_pydict({"value": ["\r\n\r\n".join(warc_record(r, refers.get(k)) for k, r in enumerate(rows))]}, pa.schema([("value", pa.string())]))

    joined = archives.join(by_archive, F.col("archive") == F.col("of"), "left").select("archive", "page_ids", "z", "revisits")
    joined.mapInArrow(work, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_ARCHIVES).option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield head, block
        at = end + 8 + size


def read_warc(spark, path: str) -> DataFrame:
    """One row for every record below ``path``; the digest of a stored payload is computed anew and must match."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf.content:
                rows = []
                for head, block in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    stored = head["warc-type"] == "response"
                    if stored and (payload_digest(block) != digest or len(block) != int(head["x-payload-length"])):
                        raise ValueError(f"{head['warc-record-id']}: the payload doesn't have its digest")
                    page, refers = head["x-page-id"], head.get("x-refers-to-page", "-")
                    rows.append((None if page == "-" else int(page), head["warc-record-id"], head.get("warc-target-uri", ""), head["warc-date"], int(head["x-payload-length"]), digest, head["warc-type"], None if refers == "-" else int(refers), block if stored else None))
                yield pd.DataFrame(rows, columns=["page_id", "record_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(read, "page_id long, record_id string, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def convert_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through legacy archives into WARC files in the shared folder, read back."""
    spark = pages.sparkSession
    path = new_path(spark, "arc")
    pages_to_arc(pages).write.option("compression", "zstd").parquet(path)
    archives = spark.read.schema(_ARCHIVES).parquet(path)
    records = written(digests(archives), "arc-digests")
    path = new_path(spark, "warc")
    write_warc(archives, revisits(records, records.count(), min_bytes), path)
    return read_warc(spark, path)
