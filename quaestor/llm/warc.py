"""Web archives of Zstandard-compressed WARC records: writer and reader.

An archive begins with a skippable frame that holds the compression dictionary; each record follows as a frame of its own.
Of records with equal payloads the one of the smallest page is a response, the others revisit it. Tasks write whole
archives, of bounded size, to a shared folder under names of their own; only the archives of tasks that succeeded
are listed, so a task may run twice. The reader takes an archive in chunks, decodes a frame at a time and checks headers,
lengths and digests.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import shared_path, stored

#: Shorter payloads are never revisits.
LEAST_REVISITED = 100
#: Payload bytes of an archive, from which on another is begun, and payload bytes that its dictionary is trained on.
ARCHIVE_BYTES, SAMPLE_BYTES = 32 << 20, 1 << 20
DICTIONARY_BYTES = 16 << 10
LEVEL = 3
CHUNK = 1 << 20

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records are dated alike: the table has no capture times.
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)


def _record_id(page: int | None) -> str:
    return f"<urn:pages:{'none' if page is None else page}>"


def _page_of(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:pages:(none|-?\d+)>", record_id)
    if not found:
        raise ValueError(f"unknown record id {record_id!r}")
    return None if found[1] == "none" else int(found[1])


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on sample records; where they are too few, their beginning itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"\n" + b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    """An archive that is being written; its dictionary is trained on the first records."""

    def __init__(self, folder: str):
        name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.system, self.path = _file_system(name)
        self.name, self.file, self.waiting = name, None, []
        self.payload = self.records = self.written = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        self.payload += len(data)
        if self.file is None:
            self.waiting.append(data)
            if self.payload >= SAMPLE_BYTES:
                self._begin()
        else:
            self._frame(data)

    def _begin(self) -> None:
        dictionary = _dictionary(self.waiting)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = self.system.open_output_stream(self.path, compression=None)
        held = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        self._write(struct.pack("<II", SKIPPABLE, len(held)) + held)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        for data in self.waiting:
            self._frame(data)
        self.waiting = []

    def _frame(self, data: bytes) -> None:
        self._write(self.compressor.compress(data))

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.written += len(data)

    def close(self) -> tuple[str, int, int]:
        if self.file is None:
            self._begin()
        self.file.close()
        return self.name, self.records, self.written


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    done, archive = [], None
    for batch in batches:
        for row in zip(*(batch.column(x) for x in ("page_id", "url", "html", "digest", "first", "revisit")), strict=True):
            page, url, html, digest, first, revisit = (x.as_py() for x in row)
            archive = archive or _Archive(folder)
            archive.add(record(page, url, html.encode(), digest, first, revisit))
            if archive.payload >= ARCHIVE_BYTES:
                done.append(archive.close())
                archive = None
    if archive:
        done.append(archive.close())
    names, records, sizes = zip(*done, strict=True) if done else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "n_records", "n_bytes"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the written archives.

    A null html is an empty payload. Equal payloads of at least ``LEAST_REVISITED`` bytes: rows of the smallest page_id are
    responses (all of them, if it occurs twice; rows without a page_id, if there are no others), the rest revisit it.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "long": F.octet_length("html") >= LEAST_REVISITED})
    first = rows.where("long").groupBy("digest").agg(F.min("page_id").alias("first"))
    linked = rows.where("long").join(first, "digest").withColumn("revisit", ~F.col("page_id").eqNullSafe(F.col("first")))
    single = rows.where("not long").withColumns({"first": F.lit(None).cast("long"), "revisit": F.lit(False)})
    columns = ["page_id", "url", "html", "digest", "first", "revisit"]
    records = linked.select(*columns).unionByName(single.select(*columns))
    return stored(records.mapInArrow(lambda batches: _written(batches, folder), MANIFEST), "archives")


def frames(path: str) -> Iterator[bytes]:
    """Content of each frame of an archive, decoded with the dictionary of its leading skippable frame."""
    system, place = _file_system(path)
    with system.open_input_stream(place, compression=None) as file:
        head = file.read(8)
        if len(head) < 8 or struct.unpack("<II", head)[0] != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary frame")
        size = struct.unpack("<II", head)[1]
        held = file.read(size)
        if len(held) != size:
            raise ValueError(f"{path}: the dictionary frame is cut short")
        if held.startswith(ZSTD_FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        rest = b""
        while rest := rest or file.read(CHUNK):
            one, parts = decompressor.decompressobj(), []
            while not one.eof:
                if not rest:
                    rest = file.read(CHUNK)
                    if not rest:
                        raise ValueError(f"{path}: a frame is cut short")
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            yield b"".join(parts)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"malformed header line {line!r}")
        out[name.strip().decode().lower()] = value.strip().decode()
    return out


def parsed(data: bytes) -> dict:
    """Fields and payload of a record; an error where headers, lengths or the digest don't agree."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or version != VERSION:
        raise ValueError(f"not a record of {VERSION.decode()}: {version[:40]!r}")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{fields['warc-record-id']}: {len(rest) - 4} bytes of content, {length} announced")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not found or not status.startswith(b"HTTP/"):
        raise ValueError(f"{fields['warc-record-id']}: no HTTP header")
    size = int(_fields(lines)["content-length"])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{fields['warc-record-id']}: length or digest of the payload differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"{fields['warc-record-id']}: malformed {kind}")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload.decode() if kind == "response" else None,
    }


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}

    def told(rows: list[dict]) -> pa.RecordBatch:
        names = [x for x in rows[0] if with_payload or x != "payload"]
        return pa.RecordBatch.from_arrays([pa.array([row[x] for row in rows], types.get(x, pa.string())) for x in names], names=names)

    for batch in batches:
        for path, announced in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
            rows, count, size = [], 0, 0
            for data in frames(path):
                rows.append(parsed(data))
                count, size = count + 1, size + (len(data) if with_payload else 200)
                if size >= CHUNK:
                    yield told(rows)
                    rows, size = [], 0
            if count != announced:
                raise ValueError(f"{path}: {count} records, {announced} announced")
            if rows:
                yield told(rows)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of ``archives`` (path, n_records): page_id, url, record_type, refers_to, length and digest of the full
    payload, and the payload (null for revisits) unless it isn't wanted."""
    partitions = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = RECORDS if with_payload else RECORDS.removesuffix(", payload string")
    return archives.select("path", "n_records").repartition(partitions).mapInArrow(lambda batches: _read(batches, with_payload), schema)


def archived(pages: DataFrame) -> DataFrame:
    """The records of ``pages``, written to archives in the shared folder and read back, without their payloads."""
    return read_archives(write_archives(pages, shared_path(pages.sparkSession, "warc")), with_payload=False)


SQL = f"""
WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first, true AS known FROM q WHERE n >= {LEAST_REVISITED} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN known AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN known AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d AND q.n >= {LEAST_REVISITED}
"""
