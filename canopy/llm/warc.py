"""WARC archives: written by Spark's own file writer, read back as a sequential stream.

Archives hold one gzip member per record. The reader walks a file from its start:
incremental zlib decompression member by member, framing by Content-Length, and a check
of each record's payload digest.

How raw members get through Spark's text writer: the last byte of a gzip member is the
top byte of its length, 0 for records under 16 MiB. Members are written without that
byte and the writer's line separator (U+0000) puts it back, so files are plain
concatenated members. Longer payloads are split into continuation records.

Each row that is written is a whole file, closed by records or bytes between two payloads, so
that the records of a payload never part and a file fits the memory of a task that reads it.

Of records with equal payloads of ``min_revisit`` bytes or more, those with the largest
id are responses and the others revisit it; rows that repeat that id and payload are all
responses. Null payloads are empty. A null id is written without an id field and read
back as null. Ids are carried in a field of their own (WARC-Source-ID); a revisit names the
response by WARC-Refers-To as well, and the payload's length is the HTTP header's. A file is
read as one value, so foreign archives have to be under 2 GB each. An empty table gives archives without records
and no rows. Only id, address and payload are written, so further columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.stage import long_rows, made, quoted, shared_dir, written

MIN_REVISIT = 1_000
#: Bytes of payload in one record; what is over goes on in continuation records.
SEGMENT = 8 << 20
#: Payloads in one file at most, and bytes after which it is closed (a larger payload has a file to itself).
FILE_RECORDS, FILE_BYTES = 4_000, 32 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_END = b"\r\n\r\n"
READ_SCHEMA = "record_id string, id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary"


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + _END) + z.flush()


def _record_id(id_, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{id_}|{sha1.hex()}')}>"


def _members(id_, url, payload: bytes, sha1: bytes, refers_to):
    record_id, http = _record_id(id_, sha1), _HTTP % len(payload)
    shared = [("WARC-Record-ID", record_id), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if id_ is not None:
        shared.append(("WARC-Source-ID", str(id_)))
    if url is not None:
        shared.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    shared += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode())]
    if refers_to is not None:
        yield _member([("WARC-Type", "revisit"), *shared, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, sha1)), ("WARC-Refers-To-Source-ID", str(refers_to)), ("Content-Type", "application/http;msgtype=response")], http)
        return
    pieces = [payload[i : i + SEGMENT] for i in range(0, len(payload), SEGMENT)] or [b""]
    number = [("WARC-Segment-Number", "1")] if len(pieces) > 1 else []
    yield _member([("WARC-Type", "response"), *shared, *number, ("Content-Type", "application/http;msgtype=response")], http + pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        yield _member([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id[:-1] + f"-{k}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(k))], piece)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """All columns plus ``__sha1`` (binary) and ``__refers_to`` (null for responses)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = pages.withColumn("__size", F.octet_length(payload)).withColumn("__sha1", F.unhex(F.sha1(payload)))
    # the digest that records carry, plus a second hash, stands for equality of payloads
    keyed = keyed.withColumn("__key", F.when(F.col("__size") >= min_revisit, F.xxhash64(payload)))
    groups = keyed.filter("__key is not null").groupBy("__key", "__sha1").agg(F.max(id_col).alias("__largest"), F.count("*").alias("__n"), F.min(id_col).alias("__smallest"))
    # a table, so that a payload that many pages have can be split in the join
    groups = written(groups.filter("__smallest < __largest").select("__key", "__sha1", "__largest"), "revisits")
    marked = keyed.join(groups, ["__key", "__sha1"], "left")
    refers = F.when(F.coalesce(F.col(id_col) < F.col("__largest"), F.col("__largest").isNotNull()), F.col("__largest"))
    return marked.withColumn("__refers_to", refers).drop("__key", "__largest", "__size")


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row (and continuations) to ``path``/part-*; the files are plain .warc.gz streams."""

    def closed(members):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["member"])

    def members(batches):
        out, records, size = [], 0, 0
        for b in batches:
            for id_, url, payload, sha1, refers in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                made = list(_members(id_, url, payload or b"", sha1, refers))
                more = sum(map(len, made))
                if out and (records >= file_records or size + more > file_bytes):
                    yield closed(out)
                    out, records, size = [], 0, 0
                out += made
                records, size = records + 1, size + more
        if out:
            yield closed(out)

    long_rows(pages.sparkSession)
    named = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), quoted(payload_col).alias("payload"))
    rows = mark_revisits(named, "id", "payload").select(F.col("id").cast("long"), "url", F.coalesce("payload", F.lit("")).cast("binary"), "__sha1", F.col("__refers_to").cast("long"))
    made = rows.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    made.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


class _Members:
    """Records of a gzip-per-record stream, one at a time."""

    def __init__(self, data: bytes, chunk: int = 1 << 16):
        self.data, self.chunk = memoryview(data), chunk

    def __iter__(self):
        at = 0
        while at < len(self.data):
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                piece = self.data[at : at + self.chunk]
                if not piece:
                    raise ValueError(f"the archive ends within a record at byte {at}")
                parts.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
            yield b"".join(parts)


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    size = int(fields["Content-Length"])
    if len(rest) != size + len(_END) or rest[size:] != _END:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} isn't framed by its Content-Length")
    return fields, rest[:size]


def parse_archive(data: bytes):
    """Response and revisit records of one archive, with continuations joined, as READ_SCHEMA tuples."""
    held = None

    def done(fields, http, payload):
        digest = fields["WARC-Payload-Digest"]
        revisit = fields["WARC-Type"] == "revisit"
        size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        ok = revisit or (_digest(payload) == digest and len(payload) == size)
        number = lambda k: int(fields[k]) if k in fields else None
        return fields["WARC-Record-ID"], number("WARC-Source-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("WARC-Refers-To-Source-ID"), size, base64.b32decode(digest[5:]).hex(), ok, None if revisit else payload

    for record in _Members(data):
        fields, block = _parsed(record)
        if fields["WARC-Type"] == "continuation":
            held[2].append(block)
            continue
        if held:
            yield done(*held[:2], b"".join(held[2]))
        http, _, first = block.partition(b"\r\n\r\n")
        held = (fields, http, [first])
    if held:
        yield done(*held[:2], b"".join(held[2]))


def read_warc(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """Records of all archives under ``path``. With ``strict`` a wrong digest fails the job, else digest_ok says so."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    schema = pa.schema([("record_id", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])

    def records(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for row in parse_archive(content.as_py()):
                    if strict and not row[7]:
                        raise ValueError(f"record {row[0]} doesn't match its digest")
                    rows.append(row if payload else (*row[:8], None))
                    size += len(row[8] or b"") if payload else 0
                    if size > 4 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(records, READ_SCHEMA)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back (without payloads)."""
    spark = pages.sparkSession
    path = made(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    write_warc(pages, path, **columns)
    return read_warc(spark, path, payload=False)
