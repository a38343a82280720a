"""WARC archives compressed with a dictionary: one Zstandard frame a record, all frames of an archive with a dictionary
that is built from the archive's own records and stands in a skippable frame at its head.

Repeated payloads are found from digests alone; a payload travels once, to the archive of its response record. A task
writes an archive under a name of its own and returns a row about it, so of a task that ran twice only the file that
Spark committed counts. Archives are read record by record.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, text_slices

#: Fixed values of the format: little-endian magic numbers of the dictionary's skippable frame and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Payloads from this size on are stored once.
LEAST_SHARED = 100
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: A dictionary's size, and the bound on the bytes of the first records that it is built from.
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORD = 64 << 10, 8 << 20, 64 << 10
LEVEL = 6
#: Bytes that a reader takes at once.
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
MANIFEST = "path string, records long, dictionary_bytes long, archive_bytes long"


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    record_type: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes


def _field(value: str) -> str:
    """A header's value: controls and spaces, which would end it, as percent signs and digits."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode(r: Record, date: str = DATE) -> bytes:
    """A WARC/1.1 record. A revisit has no payload: its digest and length, and the page it refers to, are fields."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r.payload_bytes
    body = head + (r.payload if r.record_type == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{r.page_id} {r.url} {r.record_type} {r.payload_digest}")
    fields = [("WARC-Type", r.record_type), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", None if r.url is None else _field(r.url)), ("WARC-Payload-Digest", f"sha256:{r.payload_digest}"), ("X-Payload-Length", r.payload_bytes), ("X-Page-Id", r.page_id)]
    if r.record_type == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", r.refers_to)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(body))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def decode(data: bytes) -> Record | None:
    """The record in `data`; None for records of other kinds. A payload that differs from its digest is an error."""
    at = data.index(b"\r\n\r\n") + 4
    lines = data[:at].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC/1.1 record: {lines[0][:40]!r}")
    f = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    if f["WARC-Type"] not in ("response", "revisit"):
        return None
    body = data[at : at + int(f["Content-Length"])]
    payload = body[body.index(b"\r\n\r\n") + 4 :]
    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
    if f["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {f['WARC-Record-ID']} differs from its digest")
    number = lambda k: int(f[k]) if k in f else None
    return Record(number("X-Page-Id"), f.get("WARC-Target-URI"), f["WARC-Type"], int(f["X-Payload-Length"]), digest, number("X-Refers-To-Page-Id"), payload)


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on the samples; where they are too few or too short for that, their own bytes are it."""
    samples = [s[:SAMPLE_RECORD] for s in samples]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that may be a URI."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archive(path: str, records: Iterable[bytes]) -> tuple[int, int, int]:
    """Write an archive; returns its records, its dictionary's bytes and its own. The first SAMPLE_BYTES of records
    are held for the dictionary, after that one record."""
    rest, first, held = iter(records), [], 0
    for r in rest:
        first.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES:
            break
    known = build_dictionary(first)
    content = zstandard.ZstdCompressor(level=LEVEL).compress(known.as_bytes())
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    system, name = open_path(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    n, size = 0, 8 + len(content)
    with system.open_output_stream(name, compression=None) as out:
        out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        for part in (first, rest):
            for r in part:
                frame = pack.compress(r)
                out.write(frame)
                n, size = n + 1, size + len(frame)
    return n, len(known.as_bytes()), size


def _dictionary(head: bytes) -> zstandard.ZstdCompressionDict:
    if int.from_bytes(head[:4], "little") == FRAME:  # a dictionary may be stored compressed
        head = zstandard.ZstdDecompressor().decompressobj().decompress(head)
    return zstandard.ZstdCompressionDict(head)


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, one at a time; a file without the leading frame or that ends early is an error."""
    system, name = open_path(path)
    with system.open_input_stream(name, compression=None) as raw:
        magic, size = struct.unpack("<II", raw.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} has no dictionary at its head")
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw.read(size)))
        rest = b""
        while True:
            rest = rest or raw.read(CHUNK)
            if not rest:
                return
            one, out = reader.decompressobj(), io.BytesIO()
            while not one.eof:
                if not rest and not (rest := raw.read(CHUNK)):
                    raise ValueError(f"{path} ends within a record")
                out.write(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            yield out.getvalue()


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(rows, payloads): each page's record as (page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload: of less than LEAST_SHARED bytes, else null, row), written; and (payload_digest, payload), once for each
    larger payload.

    Of equal payloads of that size the least page_id's record is the response (null ids last; of repeated rows of one
    id, that of the least URL, null first, then any one), others revisit it; null pages count as empty.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    size, digest = F.octet_length(payload).cast("long"), F.sha2(payload, 256)
    told = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), digest.alias("payload_digest"), size.alias("payload_bytes"), F.when(size < LEAST_SHARED, payload).alias("payload"))
    # The number that parts repeated rows is written, so that it is the same wherever it is read.
    told = materialize(told.withColumn("row", F.monotonically_increasing_id()), "warc-rows")
    place = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNotNull().alias("b"), "url", "row")
    firsts = told.filter(F.col("payload").isNull()).groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    again = F.coalesce(F.col("first_row") != F.col("row"), F.lit(False))
    rows = told.join(firsts, "payload_digest", "left").select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), "payload_bytes", "payload_digest", F.when(again, F.col("first_id")).alias("refers_to"), "payload", "row")
    payloads = pages.select(digest.alias("payload_digest"), payload.alias("payload")).filter(F.octet_length("payload") >= LEAST_SHARED)
    return materialize(rows, "warc-plan"), payloads.groupBy("payload_digest").agg(F.first("payload").alias("payload"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record a row of pages into archives in `folder` (a path or URI that all executors share), and return
    the archives that count: (path, records, dictionary_bytes, archive_bytes)."""
    rows, payloads = plan_records(pages, page_id, url, html)
    large = F.col("payload").isNull() & (F.col("record_type") == "response")  # one a digest
    # Payloads are written where the shuffle by their digest leaves them: they don't travel again.
    stored = rows.filter(large).drop("payload").hint("merge").join(payloads, "payload_digest").select(*Record._fields)
    small = rows.filter(~large).repartition("row").select(*Record._fields)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (r for b in batches for part in text_slices([b], "payload") for r in zip(*(part.column(f).to_pylist() for f in Record._fields)))

        def share(r: tuple | None) -> Iterator[bytes]:
            nonlocal held
            while r is not None:
                held += len(r[-1] or b"")
                yield encode(Record(*r[:-1], r[-1] or b""), date)
                r = next(rest, None) if held < archive_bytes else None

        while (first := next(rest, None)) is not None:
            held, path = 0, f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
            told = write_archive(path, share(first))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, *told)], ["path", "records", "dictionary_bytes", "archive_bytes"])

    return materialize(stored.unionByName(small).mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (path): (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload).
    Payloads are checked against their digests; a revisit's is empty. A task reads whole archives, record by record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], list(Record._fields))
        for b in batches:
            for path in b.column("path").to_pylist():
                for r in filter(None, map(decode, read_archive(path))):
                    out.append(r)
                    held += len(r.payload) + 256
                    if held > CHUNK:
                        yield batch()
                        out, held = [], 0
        if out:
            yield batch()

    n = max(1, min(archives.count(), 1 << 16))
    return archives.select("path").repartition(n, "path").mapInArrow(read, RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives, beside the tables that all executors share."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
