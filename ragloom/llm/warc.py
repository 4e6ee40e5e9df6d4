"""WARC archives compressed with Zstandard: one frame a record, and the dictionary in a leading skippable frame.

Writing and reading run inside tasks: a task streams its rows into archives of bounded size, and a task that reads holds one
archive at a time. Every attempt of a task writes under names of its own, and the manifest, which Spark commits, lists only those
of the attempts that counted: what a lost or repeated attempt has left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import lookup, shared_dir, written

#: Magic number of the skippable frame that holds the dictionary, and the marks of a plain frame and of a trained dictionary (fixed values).
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: Uncompressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on at most so many payloads (the smallest by hash), each up to so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16384, 32768
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: The date of all records, so that rewriting gives equal bytes.
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def record_id(page_id: int | None, digest: str) -> str:
    """Identity of a record: its page and its payload's digest. Rows that repeat both are one record written again."""
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}>"


def _page_of(identifier: str) -> tuple[int | None, str]:
    """(page, digest) of a record's identity."""
    prefix, _, rest = identifier.strip("<>").partition("urn:x-page:")
    number, _, digest = rest.partition(":")
    if prefix or not digest:
        raise WarcError(f"not a page's record id: {identifier}")
    return None if number == "none" else int(number), digest


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit that keeps the HTTP header (with the payload's length) and leaves the payload out."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    header = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        header.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    header.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        header += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    header += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record. Raises WarcError where version, headers, lengths or the payload's digest are wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC version line: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"Content-Length {fields['content-length']}, but {len(rest) - 4} bytes follow")
    out = {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "payload": None, "payload_bytes": None, "payload_digest": None, "refers_to": fields.get("warc-refers-to")}
    if out["record_type"] in ("response", "revisit"):
        http, found, payload = rest[:-4].partition(b"\r\n\r\n")
        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
        digest = fields.get("warc-payload-digest", "")
        if not found or not http.startswith(b"HTTP/") or length is None or not digest.startswith("sha1:"):
            raise WarcError("the HTTP header or the payload's digest is missing")
        if out["record_type"] == "response" and (len(payload) != length or payload_digest(payload) != digest[5:]):
            raise WarcError("the payload does not match its length or digest")
        if out["record_type"] == "revisit" and (payload or not out["refers_to"]):
            raise WarcError("a revisit has a payload or refers to nothing")
        if out["record_type"] == "revisit" and _page_of(out["refers_to"])[1] != digest[5:]:
            raise WarcError("a revisit refers to a record with another payload")
        out |= {"payload": payload if out["record_type"] == "response" else None, "payload_bytes": length, "payload_digest": digest[5:]}
    return out


class ArchiveWriter:
    """Builds one archive: dictionary frame, warcinfo, then a frame a record."""

    def __init__(self, dictionary: bytes | None) -> None:
        self.out, self.size, self.records = io.BytesIO(), 0, 0
        if dictionary:
            self.out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=given, write_checksum=True, write_content_size=True)
        block = b"software: ragloom\r\nformat: WARC File Format 1.1\r\n"
        name = uuid.uuid5(_SPACE, "warcinfo")
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
        self.add(head.encode() + block + b"\r\n\r\n")

    def add(self, record: bytes) -> None:
        self.out.write(self.zstd.compress(record))
        self.size += len(record)
        self.records += 1


def load_dictionary(data: memoryview) -> tuple[bytes | None, int]:
    """(dictionary, bytes to skip) of an archive. The dictionary itself may be compressed."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None, 0
    (size,) = struct.unpack_from("<I", data, 4)
    if 8 + size > len(data):
        raise WarcError("the dictionary frame is cut off")
    raw = bytes(data[8 : 8 + size])
    mark = struct.unpack_from("<I", raw)[0] if len(raw) >= 4 else 0
    if mark == FRAME:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        mark = struct.unpack_from("<I", raw)[0] if len(raw) >= 4 else 0
    if mark != DICTIONARY:
        raise WarcError("the leading frame holds no dictionary")
    return raw, 8 + size


def read_frames(data: bytes, piece: int = 16384) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame of an archive; input is fed in pieces, so that the rest is not copied for each frame."""
    view = memoryview(data)
    dictionary, at = load_dictionary(view)
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    zstd = zstandard.ZstdDecompressor(dict_data=given) if given else zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 4 or struct.unpack_from("<I", view, at)[0] != FRAME:
            raise WarcError(f"no frame at byte {at}")
        begin, frame, parts = at, zstd.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise WarcError(f"the frame at byte {begin} is cut off")
            parts.append(frame.decompress(view[at : at + piece]))
            at = min(at + piece, len(view))
        at -= len(frame.unused_data)
        yield begin, b"".join(parts)


def record_plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with record_type and refers_to.

    Of equal payloads of at least ``least_bytes`` the row with the largest page_id is the response and the others revisit it; rows
    that repeat that page_id too are responses. Null html is an empty payload; a null page_id is never the largest. Only digests are
    shuffled to find equal payloads; a payload itself moves only where more payloads than BROADCAST_ROWS repeat.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("same", F.sha2("payload", 256))
    repeated = base.groupBy("same").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    joined = lookup(base, written(repeated, "warc-repeated"), "same", "n")
    revisit = F.col("first_id").isNotNull() & (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def trained_dictionary(pages: DataFrame) -> bytes | None:
    """A dictionary from a bounded sample of payloads; None where there are too few to train one."""
    key = F.xxhash64("page_id", "html")
    filled = pages.where(F.length("html") > 0)
    # The share is drawn before the order, so that what reaches the driver does not grow with the tasks.
    drawn = filled.where(F.pmod(key, F.lit(max(1, filled.count() // (2 * SAMPLE_ROWS)))) == 0)
    sample = drawn.select(F.substring("html", 1, SAMPLE_BYTES).alias("h"), key.alias("k")).orderBy("k", "h").limit(SAMPLE_ROWS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["h"].encode()[:SAMPLE_BYTES] for r in sample], level=3).as_bytes() if len(sample) >= 16 else None
    except zstandard.ZstdError:
        return None


def _opened(folder: str):
    """(file system, path) of a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_archives(records: DataFrame, folder: str, dictionary: bytes | None) -> DataFrame:
    """Writes the planned records as ``*.warc.zst`` below a folder that all executors reach; returns the manifest (archive, records, bytes)."""
    given = records.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        part, attempt, count = TaskContext.get().partitionId(), uuid.uuid4().hex[:16], 0

        def done(archive: ArchiveWriter) -> pa.RecordBatch:
            nonlocal count
            name = f"pages-{part:06d}-{count:05d}-{attempt}.warc.zst"
            data, count = archive.out.getvalue(), count + 1
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([archive.records], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        archive = None
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page_id, url, payload, kind, refers_to = (c[i].as_py() for c in columns)
                archive = archive or ArchiveWriter(given.value)
                archive.add(make_record(kind, page_id, url, payload, refers_to))
                if archive.size >= ARCHIVE_BYTES:
                    yield done(archive)
                    archive = None
        if archive:
            yield done(archive)

    plan = records.select("page_id", "url", "payload", "record_type", "refers_to")
    return written(plan.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


_READ = T.StructType([T.StructField(n, t) for n, t in (("archive", T.StringType()), ("offset", T.LongType()), ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()))])


def _records(name: str, content: bytes, payloads: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one archive, in batches of bounded size."""
    rows, held = [], 0
    for offset, raw in read_frames(content):
        record = parse_record(raw)
        if record["record_type"] not in ("response", "revisit"):
            continue
        refers_to = _page_of(record["refers_to"])[0] if record["refers_to"] else None
        rows.append((name, offset, _page_of(record["record_id"])[0], record["url"], record["record_type"], record["payload_bytes"], record["payload_digest"], refers_to, record["payload"] if payloads else None))
        held += len(raw)
        if held > 4 << 20:
            yield _batch(rows)
            rows, held = [], 0
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_READ.fieldNames())


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row a response or revisit record of archives given as (path, content), as Spark's binaryFile source reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _records(path.as_py(), content.as_py(), payloads)

    return archives.select("path", "content").mapInArrow(run, _READ)


def read_listed(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row a response or revisit record of the archives that a manifest lists; other files in the folder are not looked at."""
    listed = manifest.count()
    tasks = max(1, min(listed, 3 * manifest.sparkSession.sparkContext.defaultParallelism), listed // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as file:
                    content = file.read()
                yield from _records(name, content, payloads)

    return manifest.select("archive").repartition(tasks, "archive").mapInArrow(run, _READ)


def dangling(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest) of revisits for which no response with that page and digest was read, each once."""
    wanted = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return wanted.join(held, ["refers_to", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages as archives, reads these back: page_id, payload_bytes, payload_digest, record_type, refers_to, archive.

    No pages give no archives and no rows. Raises WarcError where a revisit refers to a response that is not there.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/ragloom-warc-{uuid.uuid4().hex}"
    manifest = write_archives(record_plan(pages), folder, trained_dictionary(pages))
    records = written(read_listed(manifest, folder, payloads=False).drop("payload"), "warc-records")
    lost = dangling(records).first()
    if lost:
        raise WarcError(f"no response of page {lost['refers_to']} for its revisits")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive")
