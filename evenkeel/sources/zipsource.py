"""ZIP archives of CSV members as a Spark data source: a task for each member, or for a few small ones.

Planning reads the central directory at the end of each archive (Zip64 as well), which has the place and size of every
member; archives are asked side by side. A task then reads its members' byte ranges alone and unpacks them in a stream,
so neither archives nor members are held as a whole, and the members of one large archive are read by many tasks.
The pattern of member names is applied to the directory, so other members are not read. Spark could push conditions as
well, but a table that has once been read with a pushed condition keeps it for later reads without one.

Archives are reached through Arrow's file systems (local or shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import bz2
import fnmatch
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evenkeel.sources.archives import MEMBER_SCHEMA, csv_batches

#: Small members share a task up to so many packed bytes.
TASK_BYTES = 32 << 20
_CHUNK = 1 << 20
#: Archives whose directories are read at the same time.
_AT_ONCE = 32
_LOCAL_HEADER = struct.Struct("<4s5H3I2H")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def reachable(path: str) -> bool:
    """Can Arrow open it? Addresses that only Spark knows cannot be."""
    try:
        file_system(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def archives_below(path: str) -> list[str]:
    """The ``.zip`` files at or below a path, with the address they are opened by."""
    system, place = file_system(path)
    head = path[: len(path) - len(place)] if path.endswith(place) else path.split("//")[0] + "//"
    info = system.get_file_info(place)
    if info.type == pafs.FileType.File:
        return [path]
    found = system.get_file_info(pafs.FileSelector(place, recursive=True))
    return sorted(head + f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".zip"))


@dataclass(frozen=True)
class Member:
    """Where a member's bytes are: local header offset, packed size, method, check sum and unpacked size."""

    archive: str
    name: str
    offset: int
    packed: int
    method: int
    crc: int
    size: int


def members(archive: str, pattern: str) -> list[Member]:
    """The members of an archive that match, from its central directory."""
    system, place = file_system(archive)
    with system.open_input_file(place) as raw, zipfile.ZipFile(raw) as directory:
        found = []
        for info in directory.infolist():
            if not info.is_dir() and fnmatch.fnmatch(info.filename, pattern):
                if info.flag_bits & 1:
                    raise ValueError(f"{archive}: member {info.filename!r} is encrypted")
                found.append(
                    Member(archive, info.filename, info.header_offset, info.compress_size, info.compress_type, info.CRC, info.file_size)
                )
        return found


class _Unpacked(io.RawIOBase):
    """The bytes of a member, read by range and unpacked as they come; checked at their end."""

    def __init__(self, file: pa.NativeFile, member: Member) -> None:
        self.file, self.member = file, member
        file.seek(member.offset)
        header = _LOCAL_HEADER.unpack(file.read(_LOCAL_HEADER.size))
        if header[0] != b"PK\x03\x04":
            raise zipfile.BadZipFile(f"{member.archive}: no member at {member.offset}")
        file.seek(member.offset + _LOCAL_HEADER.size + header[9] + header[10])
        makers = {zipfile.ZIP_DEFLATED: lambda: zlib.decompressobj(-15), zipfile.ZIP_BZIP2: bz2.BZ2Decompressor}
        if member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_LZMA, *makers):
            raise zipfile.BadZipFile(f"{member.archive}: {member.name!r} is packed by method {member.method}")
        self.left, self.ready, self.crc, self.done = member.packed, b"", 0, 0
        self.unpack = makers[member.method]() if member.method in makers else None
        if member.method == zipfile.ZIP_LZMA:
            _, size = struct.unpack("<HH", self._raw(4))
            self.unpack = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[lzma._decode_filter_properties(lzma.FILTER_LZMA1, self._raw(size))])

    def _raw(self, n: int) -> bytes:
        got = self.file.read(min(n, self.left))
        self.left -= len(got)
        return got

    def _more(self) -> bytes:
        if self.unpack is None:
            return self._raw(_CHUNK)
        if getattr(self.unpack, "eof", False):
            return b""
        # A bounded piece at a time, however well it was packed.
        if isinstance(self.unpack, type(zlib.decompressobj())):
            return self.unpack.decompress(self.unpack.unconsumed_tail or self._raw(_CHUNK), _CHUNK)
        return self.unpack.decompress(self._raw(_CHUNK) if self.unpack.needs_input else b"", _CHUNK)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready:
            before = self.left
            self.ready = self._more()
            stuck = not self.ready and self.left == before and not getattr(self.unpack, "unconsumed_tail", b"")
            if stuck:
                if self.done != self.member.size or self.crc != self.member.crc:
                    raise zipfile.BadZipFile(f"{self.member.archive}: {self.member.name!r} is damaged")
                return 0
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        self.crc, self.done = zlib.crc32(buffer[:n], self.crc), self.done + n
        return n


class _Task(InputPartition):
    def __init__(self, members: list[Member]) -> None:
        super().__init__(members)
        self.members = members


class ZipCsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*.csv")
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            found = list(pool.map(lambda a: members(a, self.pattern), archives_below(self.path)))
        tasks: list[list[Member]] = []
        held = 0
        for member in (m for own in found for m in own):
            if not tasks or held + member.packed > self.task_bytes:
                tasks.append([])
                held = 0
            tasks[-1].append(member)
            held += member.packed
        return [_Task(some) for some in tasks]

    def read(self, partition: _Task) -> Iterator[pa.RecordBatch]:
        for member in partition.members if partition is not None else []:
            system, place = file_system(member.archive)
            with system.open_input_file(place) as raw:
                yield from csv_batches(member.archive, member.name, io.BufferedReader(_Unpacked(raw, member), _CHUNK))


class ZipCsv(DataSource):
    """Format ``zip_csv``: options ``path``, ``pattern`` (of members) and ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipCsvReader({k.lower(): v for k, v in self.options.items()})
