"""WARC archives, dictionary-compressed: each archive starts with a skippable
Zstandard frame holding a dictionary built from its own records, followed by
one frame per record, so any record can be read alone.

Writing is one shuffle of the pages: a narrow aggregation finds, per payload
digest, the page that keeps the payload; a join by page brings that to the
rows, and each partition streams its records into archives of at most
``ARCHIVE_BYTES`` (before compression). A task writes under a name of its own
and renames the finished file, so a lost or repeated task leaves either a
whole archive or none. Reading back streams each archive frame by frame.
Archives lie in a folder that all executors share, named by a URI that
``pyarrow.fs`` can open.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C

ARCHIVE_BYTES = 512 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 48 << 10
LEVEL = 3
# Fixed values of the formats: the skippable frame's magic number, the revisit profile.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages carry no capture time


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(uri: str):
    if re.match(r"file:", uri):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _record_id(page) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}").urn


def _one_line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """A response record, or a revisit of page ``refers_to``. The page id
    travels in a header of its own ("null" for a null id); the HTTP
    Content-Length gives the full payload's size in both kinds."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "null" if page is None else str(page)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{_record_id(name)}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_one_line(url) if url else f'urn:page:{name}'}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Page-ID: {name}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
        body = http
    else:
        body = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info(date: str = DATE) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo').urn}>\r\nWARC-Date: {date}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the records are too few or too alike to
    train on, their bytes themselves serve as one."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY_BYTES]


class Archive:
    """One archive file. Records are held back until ``SAMPLE_BYTES`` of them
    have come, then the dictionary is built and records stream through."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.temp = fs, path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.held, self.size, self.records, self.packer = [], 0, 0, None
        self.file = fs.open_output_stream(self.temp, compression=None)

    def _start(self):
        raw = dictionary(self.held)
        self.file.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
        for x in [info(), *self.held]:
            self.file.write(self.packer.compress(x))
        self.held = []

    def add(self, data: bytes):
        self.size += len(data)
        self.records += 1
        if self.packer is None:
            self.held.append(data)
            if self.size >= SAMPLE_BYTES:
                self._start()
        else:
            self.file.write(self.packer.compress(data))

    def close(self) -> int:
        if self.packer is None:
            self._start()
        self.file.close()
        self.fs.move(self.temp, self.path)
        return self.fs.get_file_info(self.path).size


def frames(stream, block: int = 1 << 14):
    """The records of an archive, one at a time."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    raw = stream.read(size)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    left = stream.read(block)
    while left:
        one, parts = unpack.decompressobj(), []
        while True:
            parts.append(one.decompress(left))
            if one.eof:
                left = one.unused_data or stream.read(block)
                break
            left = stream.read(block)
            if not left:
                raise ValueError("truncated archive")
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length")
    return fields, rest[:n]


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``path``; returns one row per archive
    (archive, records, bytes), staged, so the writing has happened.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with
    the largest id are responses and the others revisit that page; smaller
    payloads are all responses. A null payload is empty; a null url becomes
    ``urn:page:<id>``; a null id ranks below all others and refers like any
    row. Repeated rows get a record each. An empty table writes nothing."""
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    src = src.withColumn("digest", F.sha1("payload"))
    ids = src.select("id", "digest", (F.octet_length("payload") >= min_bytes).alias("alike")).distinct()
    keeper = ids.groupBy("digest").agg(F.max("id").alias("keeper"))
    refer = ids.join(keeper, "digest").select(
        F.col("id").alias("_id"), F.col("digest").alias("_digest"),
        F.when(F.col("alike") & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))
    rows = src.join(refer, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    scratch = C.Scratch(pages.sparkSession, "warc")

    def run(batches):
        fs, folder = _filesystem(path)
        fs.create_dir(folder, recursive=True)
        part, k, archive, done = TaskContext.get().partitionId(), 0, None, []

        def finish():
            done.append((f"{path}/{name}", archive.records, archive.close()))

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if archive is None:
                    name = f"pages-{part:06d}-{k:04d}.warc.zst"
                    archive, k = Archive(fs, f"{folder}/{name}"), k + 1
                archive.add(record(page, url, payload.encode(), refers))
                if archive.size >= ARCHIVE_BYTES:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())],
            ["archive", "records", "bytes"])

    return scratch.stage(rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "archive string, records bigint, bytes bigint"), "archives")


def read(archives: DataFrame, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """The records of the archives named in column ``archive``: ``page_id``
    (cast to ``id_type``), ``url``, ``record_type``, ``payload_bytes``,
    ``payload_digest`` (base32 SHA-1 of the full payload; checked against the
    payload of every response), ``refers_to`` and, if asked for, ``payload``
    (null for revisits). The archives are dealt to as many partitions as there
    are archives, so they are read in parallel whatever the planner makes of
    the small table of their names."""
    schema = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"
    names = [x.split()[0] for x in schema.split(", ")] + ["payload"] * payloads
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()] * payloads

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = _filesystem(archive)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        fields, block = parse(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole = fields["WARC-Type"] == "response"
                        if whole and (len(payload) != size or digest(payload) != said):
                            raise ValueError(f"payload of {fields['X-Page-ID']} is damaged")
                        page = fields["X-Page-ID"]
                        row = [None if page == "null" else page, fields["WARC-Target-URI"], fields["WARC-Type"], size, said, fields.get("X-Refers-To-Page-ID")]
                        rows.append(row + [payload if whole else None] * payloads)
                        held += len(payload) * payloads + 1000
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # a stated number of partitions is not coalesced
    out = archives.select("archive").repartition(max(archives.count(), 1), "archive").mapInArrow(run, schema + ", payload binary" * payloads)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
