"""A content-addressed WARC archive.

Payload bytes are stored once, under a verified SHA-256; the exact headers of every record are
stored apart; joins bring the original records back. Archives are .warc.gz files of one gzip
member a record, written with Spark's text sink, so that any Hadoop file system serves: the sink
ends each row with one zero byte, which is the last byte of the member's own length field.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, shared_dir, stored, text_bytes

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = b"1970-01-01T00:00:00Z"
#: Our own field for a URL that a header can't hold.
SOURCE_URI = b"X-Source-URI-Base64"

#: Bytes of a file of average pages before compression, and of a record's headers: a file is read whole.
FILE_BYTES, HEAD_BYTES = 256 << 20, 512
#: No file is longer, whatever pages meet in it: readers take a file as one value.
MOST_BYTES = 1900 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, sha256: str) -> bytes:
    return f"<urn:page:{'null' if page_id is None else page_id}:{sha256}>".encode()


def target_uri(url: str | None) -> list[bytes]:
    """The header lines of a URL. What a header can't hold is percent-encoded; where that changes the URL, the URL itself stands
    beside it in base64, so that it comes back as it was. A null URL has no line."""
    if url is None:
        return []
    safe = re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    return [b"WARC-Target-URI: " + safe.encode()] + ([SOURCE_URI + b": " + base64.b64encode(url.encode())] if safe != url else [])


def source_url(fields: dict[str, str]) -> str | None:
    encoded = fields.get(SOURCE_URI.decode().lower())
    return fields.get("warc-target-uri") if encoded is None else base64.b64decode(encoded).decode()


def record_headers(kind: str, page_id: int | None, url: str | None, sha1: str, sha256: str, refers_to: int | None, length: int) -> bytes:
    lines = [
        VERSION,
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: " + record_id(page_id, sha256),
        b"WARC-Date: " + RECORD_DATE,
        *target_uri(url),
        b"WARC-Payload-Digest: sha1:" + sha1.encode(),
        b"WARC-Block-Digest: sha256:" + sha256.encode(),
    ]
    if refers_to is not None:
        lines += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + record_id(refers_to, sha256)]
    lines += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % length]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """One gzip member whose last byte is zero: of 16 MB or more, an empty member follows."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = deflate.compress(data) + deflate.flush()
    return out if not out[-1] else out + zlib.compress(b"", 0, wbits=31)


def gzip_members(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The members one after another; what is fed past a member's end is at most one step."""
    at = 0
    while at < len(data):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a member")
            out.append(inflate.decompress(data[at : at + step]))
            at = min(at + step, len(data))
        at -= len(inflate.unused_data)
        if record := b"".join(out):
            yield record


def parse_record(record: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """The exact header bytes, the fields by lower-case name, the block."""
    end = record.index(b"\r\n\r\n") + 4
    head = record[:end]
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    block = record[end : end + int(fields["content-length"])]
    if record[end + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its Content-Length says")
    return head, fields, block


_PACKED = pa.schema([("member", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            out = []
            for page_id, url, payload, sha256, refers_to in zip(*(c.to_pylist() for c in b.slice(lo, 512).columns), strict=True):
                kind = "response" if refers_to is None else "revisit"
                block = payload if refers_to is None else b""
                head = record_headers(kind, page_id, url, sha1_base32(payload), sha256, refers_to, len(block))
                out.append(gzip_member(head + block + b"\r\n\r\n")[:-1])
            yield batch({"member": out}, _PACKED)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a record for each row: of equal payloads of at least min_bytes bytes those with the
    largest id are responses and the others revisit them; smaller ones are all responses.

    A null payload is empty. A record's id is made of the page's id and the payload's digest. A row
    without an id revisits the page with its payload; where there is none it is a response. Other
    columns are ignored.
    """
    raw = text_bytes(html)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), raw.alias("payload"), F.sha2(raw, 256).alias("sha256"))
    meta = stored(rows.select("page_id", "sha256", F.octet_length("payload").alias("n")).distinct(), "warc-digests")
    owners = meta.where(F.col("n") >= min_bytes).groupBy(F.col("sha256").alias("digest")).agg(F.max("page_id").alias("owner"))
    other = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    roles = meta.join(owners, F.col("sha256") == F.col("digest"), "left").select(F.col("page_id").alias("id"), F.col("sha256").alias("id_sha256"), F.when(other, F.col("owner")).alias("refers_to"))
    placed = rows.join(roles, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha256") == F.col("id_sha256")))
    packed = placed.select("page_id", "url", "payload", "sha256", "refers_to").mapInArrow(_pack, "member binary")
    size, largest = (x or 0 for x in meta.agg(F.avg("n"), F.max("n")).first())
    members = packed.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000")
    members.option("maxRecordsPerFile", max(1, int(min(FILE_BYTES / (size + HEAD_BYTES), MOST_BYTES / (largest + HEAD_BYTES))))).text(path)


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("headers", pa.binary()), ("sha1", pa.string()), ("sha256", pa.string()), ("payload", pa.binary()), ("verified", pa.bool_())])
RECORDS_DDL = "page_id long, url string, record_type string, refers_to long, headers binary, sha1 string, sha256 string, payload binary, verified boolean"


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            rows: list[tuple] = []
            held = 0
            for record in gzip_members(memoryview(content.as_buffer())):
                head, fields, block = parse_record(record)
                kind = fields["warc-type"]
                sha1, sha256 = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-block-digest"].removeprefix("sha256:")
                sound = None if kind == "revisit" else (hashlib.sha256(block).hexdigest() == sha256 and sha1_base32(block) == sha1)
                ident = lambda v: None if (i := v.strip("<>").split(":")[2]) == "null" else int(i)
                rows.append((ident(fields["warc-record-id"]), source_url(fields), kind, ident(fields["warc-refers-to"]) if kind == "revisit" else None, head, sha1, sha256, block if kind == "response" else None, sound))
                held += len(block)
                if held > 8 << 20:
                    yield batch(dict(zip(_RECORDS.names, zip(*rows, strict=True), strict=True)), _RECORDS)
                    rows, held = [], 0
            if rows:
                yield batch(dict(zip(_RECORDS.names, zip(*rows, strict=True), strict=True)), _RECORDS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as it stands in the archives: revisits have no payload. verified: its digests hold, null for revisits."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(_unpack, RECORDS_DDL)


def _sound(value: str, sound: Column, error: str) -> Column:
    return F.when(sound, F.col(value)).otherwise(F.raise_error(F.lit(error)))


#: A record beside the payload that its digest led to; a revisit also names the page of that payload.
_MEETS = "sha1 = stored_sha1 and (refers_to is null or refers_to = owner)"
_UNSOUND, _APART = "a payload doesn't match its digest", "a record doesn't match the payload it refers to"


def payload_store(records: DataFrame) -> DataFrame:
    """sha256, payload, owner, stored_sha1: each payload once. Responses whose digest doesn't hold raise an error."""
    checked = records.where(F.col("record_type") == "response").withColumn("payload", _sound("payload", F.col("verified"), _UNSOUND))
    return checked.groupBy("sha256").agg(F.max("payload").alias("payload"), F.max("page_id").alias("owner"), F.max("sha1").alias("stored_sha1"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, headers, payload of every original record: the header store joined to the payload store. The URL is the row's own, a null one too."""
    records = read_records(spark, path)
    heads = records.select("page_id", "url", "record_type", "refers_to", "headers", "sha1", "sha256")
    joined = heads.join(payload_store(records), "sha256", "left")
    return joined.select("page_id", "url", "headers", "record_type", "refers_to", "sha1", _sound("payload", F.expr(_MEETS), _APART).alias("payload"))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's digests are compared with those of the response that it refers to. Rows without an id
    count as revisits of nothing, as in the query's SQL, whatever record holds them.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archive(pages, path, min_bytes)
    records = stored(read_records(spark, path).select("page_id", "record_type", "refers_to", "sha1", "sha256", "verified", F.octet_length("payload").cast("long").alias("payload")), "warc-read")
    joined = records.drop("payload").join(payload_store(records), "sha256", "left")
    known = F.col("page_id").isNotNull()
    return joined.select(
        "page_id", _sound("payload", F.expr(_MEETS), _APART).alias("payload_bytes"), F.col("stored_sha1").alias("payload_digest"),
        F.when(known, F.col("record_type")).otherwise("revisit").alias("record_type"), F.when(known, F.col("refers_to")).alias("refers_to"),
    )
