"""N-Triples inside ZIP archives as a Spark data source, read and written.

A stored member is read in ranges of bytes, a deflated one as a whole; archives are opened through Arrow's file systems,
so a path may be any that these know (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "subject string, predicate string, object string, is_literal boolean, tag string"
#: Name of the file that lists what a write has committed; a folder without it is read whole.
COMMITTED = "_committed"
PIECE = 1 << 20

_NODE = r"(?:<([^>]*)>|(_:\S+))"
_LINE = re.compile(rf'\s*{_NODE}\s*<([^>]*)>\s*(?:{_NODE}|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$')
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))")
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescaped(text: str) -> str:
    """A literal without its escapes."""
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


def escaped(text: str) -> str:
    """A literal as N-Triples write it, on one line."""
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")


def parsed(line: str) -> tuple | None:
    """(subject, predicate, object, is_literal, tag) of a line; None for blank lines, remarks and what is no triple.

    ``tag`` is the language or the type of a literal.
    """
    m = _LINE.match(line)
    if not m:
        return None
    literal = m[6] is not None
    return (m[1] if m[1] is not None else m[2], m[3], unescaped(m[6]) if literal else m[4] if m[4] is not None else m[5], literal, m[7] or m[8])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Span(InputPartition):
    """A member of an archive as a whole, or of a stored one the lines that begin in the bytes ``low`` to ``high`` of its ``size``, from ``start`` in the file."""

    archive: str
    member: str
    start: int | None = None
    size: int = 0
    low: int = 0
    high: int = 0


def lines_of(file, span: Span) -> Iterator[bytes]:
    """Lines that begin within the range, each to its end, though that lies beyond; so every line is in one range."""
    at = max(span.low - 1, 0)  # the byte before tells whether a line begins at ``low``
    file.seek(span.start + at)
    held, left, begun = b"", span.size - at, span.low == 0
    while left > 0:
        piece = file.read(min(PIECE, left))
        if not piece:
            raise EOFError(f"{span.archive} is cut short in {span.member}")
        left -= len(piece)
        *whole, rest = (held + piece).split(b"\n")
        for line in whole:
            if begun:
                if at >= span.high:
                    return
                yield line
            begun = True
            at += len(line) + 1
        held = rest
        if begun and at >= span.high:
            return
    if held and begun and at < span.high:
        yield held


def spans_of(path: str, split: int) -> list[Span]:
    """Ranges of all members of the archives under ``path`` (a file or a folder), from their directories."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        archives = [inner]
    else:
        held = f"{inner.rstrip('/')}/{COMMITTED}"
        if system.get_file_info(held).type == fs.FileType.File:
            archives = [f"{inner.rstrip('/')}/{name}" for name in json.loads(system.open_input_file(held).read())]
        else:
            archives = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.base_name.lower().endswith(".zip"))
    out = []
    for archive in archives:
        with system.open_input_file(archive) as file, zipfile.ZipFile(file) as z:
            for member in z.infolist():
                if member.is_dir() or not member.file_size:
                    continue
                if member.compress_type == zipfile.ZIP_STORED and not member.flag_bits & 1:
                    file.seek(member.header_offset + 26)  # lengths of the name and extra field stand before the data
                    name, extra = (int.from_bytes(file.read(2), "little") for _ in range(2))
                    start = member.header_offset + 30 + name + extra
                    out += [Span(archive, member.filename, start, member.file_size, low, min(low + split, member.file_size)) for low in range(0, member.file_size, split)]
                else:
                    out.append(Span(archive, member.filename))
    return out


def batches_of(rows: Iterator[tuple], rows_each: int = 8192) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string()), ("is_literal", pa.bool_()), ("tag", pa.string())])
    held = []
    for row in rows:
        held.append(row)
        if len(held) == rows_each:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class TripleReader(DataSourceReader):
    def __init__(self, path: str, split: int, strict: bool):
        self.path, self.split, self.strict = path, split, strict

    def partitions(self) -> list[Span]:
        return spans_of(self.path, self.split)

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:  # Spark's one partition where there is none
            return
        system, _ = opened(self.path)
        with system.open_input_file(span.archive) as file:
            if span.start is None:
                with zipfile.ZipFile(file) as z, z.open(span.member) as member:
                    yield from batches_of(self.triples(member))
            else:
                yield from batches_of(self.triples(lines_of(file, span)))

    def triples(self, lines: Iterator[bytes]) -> Iterator[tuple]:
        for line in lines:
            text = line.decode("utf-8")
            row = parsed(text)
            if row:
                yield row
            elif self.strict and text.strip() and not text.lstrip().startswith("#"):
                raise ValueError(f"not a triple: {text[:80]!r}")


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class TripleWriter(DataSourceArrowWriter):
    """An archive a task, in members of about ``split`` bytes; the list of committed archives is written last, so a failed or doubled task leaves files that nobody reads."""

    def __init__(self, path: str, split: int, stored: bool):
        self.path, self.split, self.stored = path, split, stored

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = opened(self.path)
        name, members, size = None, 0, 0
        file = archive = member = None
        for batch in iterator:
            for s, p, o, literal, tag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    system.create_dir(inner, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.zip"
                    file = system.open_output_stream(f"{inner.rstrip('/')}/{name}")
                    archive = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED if self.stored else zipfile.ZIP_DEFLATED)
                if member is None:
                    member, members, size = archive.open(f"{members:06d}.nt", "w", force_zip64=True), members + 1, 0
                suffix = f"@{tag}" if tag and ":" not in tag else f"^^<{tag}>" if tag else ""
                node = lambda v: v if v.startswith("_:") else f"<{v}>"
                line = f'{node(s)} <{p}> {chr(34) + escaped(o) + chr(34) + suffix if literal else node(o)} .\n'.encode()
                member.write(line)
                size += len(line)
                if size >= self.split:
                    member.close()
                    member = None
        if member is not None:
            member.close()
        if archive is not None:
            archive.close()
            file.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner.rstrip('/')}/{COMMITTED}") as out:
            out.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{inner.rstrip('/')}/{m.name}")


class ZippedTriples(DataSource):
    """Format ``zipped_triples``: options path, split (bytes of a range or member), strict (raise on lines that are no triples), stored (write without deflating)."""

    @classmethod
    def name(cls) -> str:
        return "zipped_triples"

    def schema(self) -> str:
        return SCHEMA

    def _option(self, name: str, default: str) -> str:
        return self.options.get(name, default)

    def reader(self, schema) -> TripleReader:
        return TripleReader(self.options["path"], int(self._option("split", str(64 << 20))), self._option("strict", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> TripleWriter:
        if [f.name for f in schema.fields] != ["subject", "predicate", "object", "is_literal", "tag"]:
            raise ValueError(f"columns must be those of {SCHEMA}")
        return TripleWriter(self.options["path"], int(self._option("split", str(64 << 20))), self._option("stored", "true").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZippedTriples)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Triples of the archives under ``path``: subject, predicate, object, is_literal, tag."""
    register(spark)
    return spark.read.format("zipped_triples").options(**{k: str(v) for k, v in options.items()}).load(path)


def write(triples: DataFrame, path: str, **options) -> None:
    """Triples, none with a null but for ``tag``, as archives under a new folder ``path``."""
    register(triples.sparkSession)
    triples.write.format("zipped_triples").options(**{k: str(v) for k, v in options.items()}).mode("append").save(path)
