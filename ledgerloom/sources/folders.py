"""Data sources for what Spark's own readers and writers pass over: sidecars with a leading point, and ZIP archives.

Both work in tasks, through the file systems that Arrow knows (local, and the
stores that its URIs name); the driver sees names only. A task writes under a
temporary name, and what it wrote gets its own name when the whole write is
committed, or, for a sidecar, at once: a reader never sees half of a file.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SIDECAR = ".state.json"
#: Folders that one task looks into.
FOLDERS = 1000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def _replace(system: fs.FileSystem, path: str, content: bytes) -> None:
    """Writes a file under another name and moves it to its own, at once."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as out:
        out.write(content)
    system.move(temporary, path)


def _state(content: bytes) -> tuple[str, str | None]:
    """State and text of a sidecar that is there."""
    try:
        text = content.decode()
        return ("ok", text) if isinstance(json.loads(text), dict) else ("corrupt", None)
    except ValueError:  # no UTF-8, or no JSON
        return "corrupt", None


@dataclass
class Folders(InputPartition):
    """Folders, or archives of them, that one task reads."""

    names: tuple[str, ...]


class SidecarReader(DataSourceReader):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name

    def partitions(self) -> list[Folders]:
        system, root = _at(self.path)
        names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory)
        return [Folders(tuple(names[k : k + FOLDERS])) for k in range(0, len(names), FOLDERS)] or [Folders(())]

    def read(self, partition: Folders) -> Iterator[tuple]:
        system, root = _at(self.path)
        for name in partition.names:
            file = f"{root}/{name}/{self.name}"
            if system.get_file_info(file).type != fs.FileType.File:
                yield name, "absent", None
                continue
            with system.open_input_file(file) as f:
                yield name, *_state(f.read())


class SidecarWriter(DataSourceWriter):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, root = _at(self.path)
        for row in iterator:
            system.create_dir(f"{root}/{row['folder']}", recursive=True)
            if row["content"] is not None:
                _replace(system, f"{root}/{row['folder']}/{self.name}", row["content"].encode())
        return WriterCommitMessage()


class Sidecars(DataSource):
    """Format ``sidecars``: (folder, state, content) of the folders in ``path``, by the file ``name`` in each (.state.json).

    The state is ok for a JSON object, whose text is the content, absent, or
    corrupt. Writing takes (folder, content): each file is replaced whole, a null
    content makes the folder only. A row that is written twice leaves the same.
    """

    @classmethod
    def name(cls) -> str:
        return "sidecars"

    def schema(self) -> str:
        return "folder string, state string, content string"

    def reader(self, schema: StructType) -> SidecarReader:
        return SidecarReader(self.options["path"], self.options.get("name", SIDECAR))

    def writer(self, schema: StructType, overwrite: bool) -> SidecarWriter:
        return SidecarWriter(self.options["path"], self.options.get("name", SIDECAR))


#: Folders of one archive of sidecars, about.
PACKED = 10_000


def pack(sidecars: DataFrame, path: str, archives: int) -> None:
    """Writes (folder, content) in format ``packedsidecars``: a folder's archive is the one of ``archives`` that its name's hash gives."""
    number = F.crc32(F.encode("folder", "UTF-8")) % archives
    dealt = sidecars.select(F.concat_ws("-", F.lit(archives), number).alias("archive"), "folder", "content")
    dealt.repartition("archive").sortWithinPartitions("archive").write.format("packedsidecars").mode("append").save(path)


class PackedWriter(DataSourceWriter):
    def __init__(self, path: str, name: str):
        self.path, self.name, self.run = path, name, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Parts:
        system, root = _at(self.path)
        system.create_dir(f"{root}/_{self.run}", recursive=True)
        files = []
        for archive, rows in itertools.groupby(iterator, key=lambda r: r["archive"]):
            file = f"{root}/_{self.run}/{uuid.uuid4().hex}.zip"
            with system.open_output_stream(file) as out, zipfile.ZipFile(out, "w") as packed:
                for row in rows:
                    name = f"{row['folder']}/" if row["content"] is None else f"{row['folder']}/{self.name}"
                    packed.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), row["content"] or "")
            files.append((archive, file))
        return Parts(files)

    def commit(self, messages: list[Parts | None]) -> None:
        system, root = _at(self.path)
        there = [x.base_name.split("-") for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".zip")]
        files = [f for m in messages if m for f in m.files]
        if len({x[0] for x in there} | {archive.split("-")[0] for archive, _ in files}) > 1:
            raise ValueError(f"{self.path} is dealt over another number of archives")
        run = max((int(x[2]) for x in there), default=-1) + 1
        for k, (archive, file) in enumerate(files):
            system.move(file, f"{root}/{archive}-{run:06d}-{k}.zip")
        if files:
            system.delete_dir(f"{root}/_{self.run}")

    def abort(self, messages: list[Parts | None]) -> None:
        system, root = _at(self.path)
        if system.get_file_info(f"{root}/_{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.run}")


class PackedReader(DataSourceReader):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name

    def partitions(self) -> list[Folders]:
        system, root = _at(self.path)
        archives: dict[str, list[tuple]] = {}
        for x in system.get_file_info(fs.FileSelector(root)):
            if x.base_name.endswith(".zip"):
                archives.setdefault(x.base_name.rsplit("-", 2)[0], []).append((x.base_name.rsplit("-", 2)[1], x.path))
        return [Folders(tuple(file for _, file in sorted(files))) for _, files in sorted(archives.items())] or [Folders(())]

    def read(self, partition: Folders) -> Iterator[tuple]:
        system, _ = _at(self.path)
        found: dict[str, bytes | None] = {}  # the folders of one archive
        for file in partition.names:
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as packed:
                for entry in packed.infolist():
                    folder, _, name = entry.filename.rpartition("/")
                    found.setdefault(folder, None)
                    if name == self.name:
                        found[folder] = packed.read(entry)
        for folder, content in found.items():
            yield (folder, "absent", None) if content is None else (folder, *_state(content))


class PackedSidecars(DataSource):
    """Format ``packedsidecars``: as ``sidecars``, with the folders in ZIP archives in ``path``, for millions of them.

    A file and a folder for each document take blocks of the disk and the names
    of all must be listed by one process; here both grow with the archives.
    :func:`pack` writes it. Of a folder's sidecars in several writes the last holds.
    """

    @classmethod
    def name(cls) -> str:
        return "packedsidecars"

    def schema(self) -> str:
        return "folder string, state string, content string"

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(self.options["path"], self.options.get("name", SIDECAR))

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], self.options.get("name", SIDECAR))


@dataclass
class Parts(WriterCommitMessage):
    """The archives that a task wrote: number and file of each."""

    files: list[tuple[str, str]]


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its file, and how many members it holds."""

    file: str
    members: int


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Part:
        system, root = _at(self.path)
        system.create_dir(f"{root}/_{self.run}", recursive=True)
        file, members = f"{root}/_{self.run}/{uuid.uuid4().hex}.zip", 0
        with system.open_output_stream(file) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for row in iterator:
                # a fixed time, so that a task that runs again makes the same bytes
                entry = zipfile.ZipInfo(row["name"], (1980, 1, 1, 0, 0, 0))
                entry.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(entry, bytes(row["content"]))
                members += 1
        return Part(file, members)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = _at(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if x.base_name.endswith(".zip"):
                    system.delete_file(x.path)
        for k, part in enumerate(m for m in messages if m and m.members):
            system.move(part.file, f"{root}/archive-{self.run[:8]}-{k:05d}.zip")
        system.delete_dir(f"{root}/_{self.run}")  # with what attempts left that weren't committed

    def abort(self, messages: list[Part | None]) -> None:
        system, root = _at(self.path)
        if system.get_file_info(f"{root}/_{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.run}")


@dataclass
class ArchiveFile(InputPartition):
    """An archive that one task reads."""

    file: str


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ArchiveFile]:
        system, root = _at(self.path)
        return [ArchiveFile(x.path) for x in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda x: x.path) if x.base_name.endswith(".zip")] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        if partition.file:
            system, _ = _at(self.path)
            with system.open_input_file(partition.file) as f, zipfile.ZipFile(f) as archive:
                for entry in archive.infolist():
                    yield entry.filename, archive.read(entry)


class Archives(DataSource):
    """Format ``ziparchive``: members (name, content) of the ZIP archives in the folder ``path``.

    Each task writes an archive of its own, whole with its directory; they get
    their names together when all have ended, and archives of attempts that
    failed go. With one partition it is one archive. Members are read by archive.
    """

    @classmethod
    def name(cls) -> str:
        return "ziparchive"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats ``sidecars``, ``packedsidecars`` and ``ziparchive`` known to a session."""
    for source in (Sidecars, PackedSidecars, Archives):
        spark.dataSource.register(source)
