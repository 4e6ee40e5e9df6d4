"""Archives as a partitioned source: planned from central directories by range reads, split by bytes, pruned by path before a byte is read.

    spark.dataSource.register(ZipDocuments)
    spark.read.format("zipdocs").option("path", folder).option("glob", "**/*.md").load()

An archive up to ``partitionBytes`` is read whole by the task that opens it (small ones share a task). Of a larger one only the
central directory is read while planning, and its matching entries are dealt to tasks by their compressed bytes; a task then
reads the byte ranges of its own entries. A task holds one entry and one batch at a time, never an archive.
"""

from __future__ import annotations

import datetime
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ragloom.functions import text

ENTRIES = "archive string, position long, sourcePath string, content binary, uncompressedSize long, compressedSize long, lastModified timestamp, directory boolean"
#: Bytes of entries that one batch holds at most (one larger entry stands alone).
BATCH_BYTES = 8 << 20
#: Compressed bytes of one task's entries, unless the option ``partitionBytes`` says otherwise.
PARTITION_BYTES = 64 << 20
_LOCAL = struct.Struct("<4s5H3I2H")


class ArchiveError(ValueError):
    """The archive is corrupt, too large or has unsafe names; none of its entries is used."""


def is_safe_name(name: str) -> bool:
    """False for absolute names, NUL bytes and names that climb out of the archive's root at any step."""
    plain, depth = name.replace("\\", "/"), 0
    for part in plain.split("/"):
        depth += {"": 0, ".": 0, "..": -1}.get(part, 1)
        if depth < 0:
            return False
    return not plain.startswith("/") and "\0" not in name


def check_entry_name(name: str) -> None:
    if not is_safe_name(name):
        raise ArchiveError(f"unsafe entry name: {name!r}")


@dataclass
class Part(InputPartition):
    """What one task reads: whole small archives, or some entries (position, name, offset, sizes, method, checksum, time) of a large one."""

    archives: list[str] = field(default_factory=list)
    archive: str | None = None
    entries: list[tuple] = field(default_factory=list)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (any that Arrow knows; s3a is s3), and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("s3a://"):
        path = "s3" + path[3:]
    return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives at or below a path, in order of their names. They are named as the path is, host and all."""
    files, root = filesystem(path)
    base, mark, query = path.partition("?")
    base, inner = base.rstrip("/"), root.rstrip("/")
    named = lambda p: base[: len(base) - len(inner)] + p + mark + query if base.endswith(inner) else p
    info = files.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise ArchiveError(f"{path} does not exist")
    found = [info] if info.type == pafs.FileType.File else [f for f in files.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".zip")]
    return sorted((named(f.path), f.size) for f in found)


class _Opened:
    """One archive's central directory, checked against the guards, and its entries' bytes by range."""

    def __init__(self, archive: str, max_entries: int, max_bytes: int) -> None:
        files, inner = filesystem(archive)
        self.archive, self.file = archive, files.open_input_file(inner)
        try:
            self.infos = zipfile.ZipFile(self.file).infolist()
        except zipfile.BadZipFile as error:
            raise ArchiveError(f"{archive}: {error}") from error
        if len(self.infos) > max_entries:
            raise ArchiveError(f"{archive}: {len(self.infos)} entries, over {max_entries}")
        total = 0
        for info in self.infos:
            if not info.is_dir():
                check_entry_name(info.orig_filename)
                total += info.file_size
                if total > max_bytes:
                    raise ArchiveError(f"{archive}: over {max_bytes} bytes uncompressed")

    def entries(self) -> Iterator[tuple]:
        for position, i in enumerate(self.infos):
            yield position, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, i.date_time, i.is_dir(), i.flag_bits & 1


def _content(archive: str, file: pa.NativeFile, entry: tuple) -> bytes:
    """One entry's bytes: its local header tells where they begin; size and checksum are those of the central directory."""
    _, name, offset, packed, size, method, checksum, *_, encrypted = entry
    try:
        head = _LOCAL.unpack(file.read_at(_LOCAL.size, offset))
        if head[0] != b"PK\x03\x04" or encrypted:
            raise ArchiveError("no readable local header")
        raw = file.read_at(packed, offset + _LOCAL.size + head[-2] + head[-1])
        if method == zipfile.ZIP_STORED:
            content = raw
        elif method == zipfile.ZIP_DEFLATED:
            unpacker = zlib.decompressobj(-15)
            content = unpacker.decompress(raw, size + 1)  # a byte too many shows in the size
        else:
            raise ArchiveError(f"compression method {method}")
        if len(content) != size or zlib.crc32(content) != checksum:
            raise ArchiveError("wrong size or checksum")
    except (struct.error, zlib.error, OSError, ArchiveError) as error:
        raise ArchiveError(f"{archive}: {name}: {error}") from error
    return content


class ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        options = {name.lower(): value for name, value in options.items()}
        number = lambda name, default: int(options.get(name.lower(), default))
        self.path, self.glob = options["path"], options.get("glob", "**")
        self.max_entries, self.max_bytes = number("maxEntries", 10_000), number("maxBytes", 524_288_000)
        self.partition_bytes, self.with_content = number("partitionBytes", PARTITION_BYTES), str(options.get("content", "true")).lower() == "true"

    def _wanted(self, name: str) -> bool:
        return bool(re.match(text.glob_regex(self.glob).replace(r"\z", r"\Z"), name))

    def partitions(self) -> list[Part]:
        """Small archives together up to ``partitionBytes``; of a large one its matching entries, cut at the same number of bytes."""
        out, small, held = [], [], 0
        for archive, size in _listed(self.path):
            if size > self.partition_bytes and self.with_content:
                part, load = [], 0
                for entry in _Opened(archive, self.max_entries, self.max_bytes).entries():
                    if entry[8] or not self._wanted(entry[1]):
                        continue
                    if part and load + entry[3] > self.partition_bytes:
                        out.append(Part(archive=archive, entries=part))
                        part, load = [], 0
                    part.append(entry)
                    load += entry[3]
                if part:
                    out.append(Part(archive=archive, entries=part))
                continue
            if small and held + size > self.partition_bytes:
                out.append(Part(archives=small))
                small, held = [], 0
            small.append(archive)
            held += size if self.with_content else 0
            if not self.with_content and len(small) >= 64:
                out.append(Part(archives=small))
                small = []
        return [*out, Part(archives=small)] if small or not out else out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for archive, file, entry in self._entries(part):
            content = _content(archive, file, entry) if self.with_content else None
            rows.append((archive, entry[0], entry[1], content, entry[4], entry[3], datetime.datetime(*entry[7], tzinfo=datetime.UTC), entry[8]))
            held += entry[4] if self.with_content else 100
            if held > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _entries(self, part: Part) -> Iterator[tuple]:
        if part.archive is not None:
            files, inner = filesystem(part.archive)
            file = files.open_input_file(inner)
            yield from ((part.archive, file, e) for e in part.entries)
        for archive in part.archives:
            opened = _Opened(archive, self.max_entries, self.max_bytes)
            for entry in opened.entries():
                if not self.with_content or (not entry[8] and self._wanted(entry[1])):
                    yield archive, opened.file, entry


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
    names = [f.split()[0] for f in ENTRIES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


class ZipDocuments(DataSource):
    """Options: path; glob (all files); maxEntries, maxBytes (guards for each archive); partitionBytes; content.

    With content "false" every entry is listed, directories and other paths too, from the central directories alone.
    """

    @classmethod
    def name(cls) -> str:
        return "zipdocs"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: object) -> ZipReader:
        return ZipReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipDocuments)
