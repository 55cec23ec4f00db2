"""CSV in gzip files of several members, read by several tasks: a Python data source.

A gzip file may be many compressed streams one after the other, as when daily extracts are appended. Spark reads such a file in one
task. Here a file is cut into ranges of bytes; a task finds the first member that begins in its range (the bytes of a header, then a
trial inflation) and reads all members that begin before its end, each as a stream, so memory does not grow with the members.

A member holds whole records: it ends after a line break outside of quotes, or at the end of the file. That is checked (so is the number of fields), and raises if
it does not hold; such a file must be read by ``filings.read_raw_contributions``. The first record of a file is its header, members that
repeat it are told by it. Bytes that are no UTF-8 become U+FFFD, empty fields without quotes null.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from donorloom.operators.shared import ship_package

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 64 << 20
_CHUNK = 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def _begins(file, at: int) -> bool:
    """Whether a member begins at a place: its header and first kilobytes can be inflated."""
    file.seek(at)
    head = file.read(4096)
    if head[:3] != MAGIC or len(head) < 10 or head[3] & 0xE0:
        return False
    try:
        zlib.decompressobj(31).decompress(head)
    except zlib.error:
        return False
    return True


def next_member(file, start: int, end: int) -> int | None:
    """Place of the first member that begins at ``start`` or later, before ``end``."""
    at = start
    while at < end:
        file.seek(at)
        block = file.read(min(_CHUNK, end - at) + len(MAGIC) - 1)
        i = block.find(MAGIC)
        while 0 <= i < end - at:
            if _begins(file, at + i):
                return at + i
            i = block.find(MAGIC, i + 1)
        at += _CHUNK
    return None


class Member(io.RawIOBase):
    """The text of one member as valid UTF-8; afterwards ``after`` is the place of what follows it, and ``whole`` whether it ends
    after a record."""

    def __init__(self, file, start: int):
        self.file, self.after, self.whole = file, start, True
        self.inflate, self.decode = zlib.decompressobj(31), codecs.getincrementaldecoder("utf-8")("replace")
        self.held, self.quotes, self.last = b"", 0, b"\n"

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held and not self.inflate.eof:
            self.file.seek(self.after)
            read = self.file.read(_CHUNK)
            raw = self.inflate.decompress(read) if read else b""
            self.after += len(read) - len(self.inflate.unused_data)
            if not read:
                raise EOFError("a gzip member ends early")
            self.quotes += raw.count(b'"')
            self.last = raw[-1:] or self.last
            self.held = self.decode.decode(raw, self.inflate.eof).encode("utf-8")
            self.whole = self.last == b"\n" and self.quotes % 2 == 0
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def _batches(file, start: int, names: list[str], first: bool) -> Iterator[tuple[pa.RecordBatch | None, Member]]:
    """Records of a member as batches of text columns; at last the member itself, read to its end."""
    member = Member(file, start)
    text = io.BufferedReader(member, _CHUNK)
    if text.peek(1):
        options = pc.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False)
        rows = pc.open_csv(text, pc.ReadOptions(column_names=names, block_size=_CHUNK), pc.ParseOptions(newlines_in_values=True), options)
        top = True
        for b in rows:
            if top and b.num_rows and [c[0].as_py() for c in b.columns] == names:
                b = b.slice(1)  # the header
            elif top and first:
                raise ValueError("a file without a header")
            top = False
            yield b, member
    yield None, member


def _header(file) -> list[str]:
    with io.TextIOWrapper(io.BufferedReader(Member(file, 0)), "utf-8", newline="") as text:
        return next(csv.reader(text), [])


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns, self.files = schema.names, json.loads(options["files"])
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return [Range(path, at, min(at + self.size, length)) for path, length in self.files for at in range(0, length, self.size)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        with _open(partition.path) as file:
            at = next_member(file, partition.start, partition.end)
            if at is None:
                return
            length, names = file.size(), _header(file)
            while at is not None and at < partition.end:
                for b, member in _batches(file, at, names, at == 0):
                    if b is not None and b.num_rows:
                        yield pa.RecordBatch.from_arrays([b.column(names.index(c)) if c in names else pa.nulls(b.num_rows, pa.string()) for c in self.columns], names=self.columns)
                if not member.whole and member.after < length:
                    raise ValueError(f"a member of {partition.path} ends within a record; read the file as one stream")
                at = member.after if member.after < length and _begins(file, member.after) else next_member(file, member.after, partition.end)


class GzipCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_csv"

    def reader(self, schema) -> _Reader:
        return _Reader(schema, self.options)


def read_gzip_csv(spark: SparkSession, path: str, columns: tuple[str, ...], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the gzip files at ``path`` (a file, a folder or a pattern), the columns by name as text; missing ones null."""
    ship_package(spark)
    spark.dataSource.register(GzipCsv)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files, tops = [], found.globStatus(where)
    if not tops:
        raise FileNotFoundError(path)
    for top in tops:
        for f in found.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                files.append((f.getPath().toString(), f.getLen()))
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("gzip_csv").schema(schema).option("files", json.dumps(files)).option("rangeBytes", range_bytes).load()
