"""Data sources of one's own: mail folders and mbox files as tables and streams, and reports that appear all or not at all.

    spark.dataSource.register(MailSource); spark.read.format("mail").load(path)
    spark.dataSource.register(ReportSink); df.write.format("reports").mode("append").save(folder)

Paths are whatever Arrow's file systems open (a plain path, file:, s3:, gs:, hdfs:);
what only Spark's readers open goes through ``mail.read_folder``.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .mail import MAX_BYTES

#: Bytes that a task reads, about: a part of one mbox file or several small files.
SPLIT = 32 << 20
#: Bytes of a mailbox that are read at a time.
READ = 1 << 20

def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path[5:] if path.startswith("file:") else path)


@dataclass
class Part(InputPartition):
    """Files to be read whole, or bytes of one mailbox: messages that start in them."""

    files: list[str] = field(default_factory=list)
    mailbox: str | None = None
    start: int = 0
    end: int = 0


def _listed(path: str, pattern: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of the files, in order."""
    from pyarrow import fs

    system, at = opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    kept = [f for f in found if f.type == fs.FileType.File and (f is info or fnmatch.fnmatch(f.base_name, pattern)) and not f.base_name.startswith(("_", "."))]
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in kept)


def planned(files: list[tuple[int, str, int]]) -> list[Part]:
    """Parts of about SPLIT bytes: large mailboxes in several, small files together."""
    parts, held, size = [], [], 0
    for _, path, length in files:
        if path.lower().endswith((".mbox", ".mbx")):
            parts += [Part(mailbox=path, start=at, end=min(at + SPLIT, length)) for at in range(0, length, SPLIT)]
            continue
        held.append(path)
        size += min(length, MAX_BYTES)
        if size >= SPLIT:
            parts.append(Part(files=held))
            held, size = [], 0
    return [*parts, Part(files=held)] if held else parts


def split_mailbox(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, message) of messages that start in [start, end); of one over the limit only the first MAX_BYTES + 1 bytes are kept.

    A message starts at a line "From " at the file's start or behind an empty line.
    """
    at = max(0, start - 4)  # the empty line before may lie in the part before
    stream.seek(at)
    reader = io.BufferedReader(stream, READ)
    blank, fresh, place, body = at == 0, True, None, bytearray()
    while line := reader.readline(READ):
        if fresh and blank and at >= start and line.startswith(b"From "):
            if place is not None:
                yield place, _unquoted(bytes(body))
            place, body = at, bytearray()
            if at >= end:
                return
        elif place is not None:
            body.extend(line[: max(0, MAX_BYTES + 1 - len(body))])
        elif at >= end:
            return
        blank, fresh = fresh and line in (b"\n", b"\r\n"), line.endswith(b"\n")
        at += len(line)
    if place is not None:
        yield place, _unquoted(bytes(body))


def _unquoted(body: bytes) -> bytes:
    """A message without the empty line that parts it from the next, and with its quoted From lines as they were."""
    body = body[:-2] if body.endswith(b"\r\n\r\n") else body[:-1] if body.endswith(b"\n\n") else body
    return re.sub(rb"(?m)^>(>*From )", rb"\1", body)


def _read(part: Part) -> Iterator[tuple[str, int, bytes]]:
    system, _ = opened(part.mailbox or part.files[0])
    if part.mailbox is not None:
        with system.open_input_file(opened(part.mailbox)[1]) as stream:
            for place, content in split_mailbox(stream, part.start, part.end):
                yield part.mailbox, place, content
        return
    for path in part.files:
        with system.open_input_file(opened(path)[1]) as stream:
            yield path, 0, stream.read(MAX_BYTES + 1)


class MailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")

    def partitions(self) -> list[Part]:
        return planned(_located(self.path, self.pattern)) or [Part()]

    def read(self, part: Part) -> Iterator[tuple]:
        return _read(part) if part.files or part.mailbox is not None else iter(())


class MailStream(DataSourceStreamReader):
    """Files as they come, in order of change and path; a file that changes later comes again as a whole."""

    def __init__(self, options: dict):
        self.path, self.pattern, self.most = options["path"], options.get("pattern", "*"), int(options.get("maxfilespertrigger", 1000))
        self.reached: list | None = None

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        after = self.reached or [0, ""]
        new = [f for f in _located(self.path, self.pattern) if [f[0], f[1]] > after][: self.most]
        self.reached = [new[-1][0], new[-1][1]] if new else after
        return {"changed": self.reached[0], "path": self.reached[1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = ([x["changed"], x["path"]] for x in (start, end))
        self.reached = max(self.reached or high, high)
        return planned([f for f in _located(self.path, self.pattern) if low < [f[0], f[1]] <= high])

    def read(self, part: Part) -> Iterator[tuple]:
        return _read(part)


def _located(path: str, pattern: str) -> list[tuple[int, str, int]]:
    """Files with their paths as the option names them, so that tasks open them in the same file system."""
    root = path.partition("://")[0] + "://" if "://" in path else ""
    return [(changed, f if f.startswith(root) else root + f, size) for changed, f, size in _listed(path, pattern)]


class MailSource(DataSource):
    """path, place (of a message in its mailbox), content of raw messages; options: path (a folder, file or mailbox), pattern of file names, maxFilesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return "path string, place bigint, content binary"

    def reader(self, schema: StructType) -> MailReader:
        return MailReader(self.options)

    def streamReader(self, schema: StructType) -> MailStream:
        return MailStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote: their names, and where they wait."""

    folder: str
    names: list[str]


class ReportWriter(DataSourceWriter):
    """A file for each row: name and content. Tasks write below a folder of the job; only what successful attempts wrote is moved to its place, by one rename each."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.waiting = posixpath.join(opened(self.path)[1], f"_temporary-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Written:
        system, _ = opened(self.path)
        own, names = posixpath.join(self.waiting, uuid.uuid4().hex), set()
        system.create_dir(own)
        for row in rows:
            name = row["name"]
            if not name or "/" in name or "\\" in name or name.startswith((".", "_")):
                raise ValueError(f"not a report's name: {name!r}")
            with system.open_output_stream(posixpath.join(own, name), compression=None) as stream:
                stream.write(row["content"])
            names.add(name)
        return Written(own, sorted(names))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, at = opened(self.path)
        system.create_dir(at)
        if self.overwrite:
            old = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
            for path in old:
                system.delete_file(path)
        for message in messages:
            for name in message.names if message is not None else ():
                system.move(posixpath.join(message.folder, name), posixpath.join(at, name))
        self._cleared()

    def abort(self, messages: list) -> None:
        self._cleared()

    def _cleared(self) -> None:
        from pyarrow import fs

        system, _ = opened(self.path)
        if system.get_file_info(self.waiting).type == fs.FileType.Directory:
            system.delete_dir(self.waiting)


class ReportSink(DataSource):
    """Rows of name and content as files of a folder, all of them or none; a name that stands on several rows (equal messages) is one file."""

    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options, overwrite)
