"""Backup files (SMS, MMS and call-log XML) as rows of raw elements.

Files are cut into elements by a byte scanner before anything is decoded, so the
hash of an element covers the bytes as they were, and a bad character reference
in one element cannot take others with it. The scanner reads chunks and keeps
only the element it is in; it knows comments, CDATA, processing instructions and
quoted attributes. Each element is then decoded on its own.

A file with a syntax error gives the elements before it and one row of kind
"error"; rows after it are not looked for.
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from missive.schema import RAW

KINDS = (b"sms", b"mms", b"call")
CHUNK = 1 << 20
#: Bytes of a file that go to Python in one row: a batch has up to 10 000 of them.
SENT = 1 << 12

NAME = re.compile(rb"[^\s/><]+")
_SURROGATE = re.compile(rb"&#(?:x0*[dD][89a-fA-F][0-9a-fA-F]{2}|0*5(?:5[3-9][0-9]{2}|529[6-9]|6[0-9]{3}|7[0-2][0-9]{2}|73[0-3][0-9]|734[0-3]));")


class Malformed(ValueError):
    """The file is not well-formed from here on."""


class Scanner:
    """Elements of the wanted kinds from a stream of byte chunks: (kind, start, stop, raw)."""

    def __init__(self, chunks: Iterable[bytes]):
        self._chunks = iter(chunks)
        self._held = bytearray()
        self._base = 0  # offset in the file of what is held
        self.count: int | None = None  # what the root says it holds

    def _more(self) -> bool:
        chunk = next(self._chunks, None)
        if chunk is None:
            return False
        self._held += chunk
        return True

    def _find(self, what: bytes, start: int) -> int:
        """Place of `what` from start on, reading on as needed; -1 at the end."""
        while True:
            at = self._held.find(what, start)
            if at >= 0:
                return at
            start = max(start, len(self._held) - len(what) + 1)
            if not self._more():
                return -1

    def _starts(self, what: bytes, at: int) -> bool:
        while len(self._held) < at + len(what) and self._more():
            pass
        return self._held[at : at + len(what)] == what

    def _tag_end(self, at: int) -> int:
        """Place after the > that ends a tag; quotes may hold others."""
        quote = 0
        while True:
            while at >= len(self._held):
                if not self._more():
                    raise Malformed("tag without end")
            byte = self._held[at]
            if quote:
                end = self._find(bytes([quote]), at)
                if end < 0:
                    raise Malformed("attribute without end")
                at, quote = end + 1, 0
                continue
            if byte == 0x3E:
                return at + 1
            if byte in b"\"'":
                quote = byte
            at += 1

    def __iter__(self) -> Iterator[tuple[str, int, int, bytes]]:
        depth, at, begun, kind, inner = 0, 0, -1, b"", 0
        while True:
            at = self._find(b"<", at)
            if at < 0:
                if depth:
                    raise Malformed("element without end")
                return
            if begun < 0 and at > CHUNK:
                del self._held[:at]
                self._base, at = self._base + at, 0
            for opening, closing in ((b"<!--", b"-->"), (b"<![CDATA[", b"]]>"), (b"<?", b"?>")):
                if self._starts(opening, at):
                    end = self._find(closing, at + len(opening))
                    if end < 0:
                        raise Malformed("markup without end")
                    end += len(closing)
                    break
            else:
                end = self._tag_end(at + 1)
                if self._starts(b"<!", at):
                    pass
                elif self._starts(b"</", at):
                    depth -= 1
                    if depth < 0:
                        raise Malformed("end tag without element")
                    if begun >= 0 and depth == inner:
                        yield kind.decode(), self._base + begun, self._base + end, bytes(self._held[begun:end])
                        begun = -1
                else:
                    match = NAME.match(self._held, at + 1, end)
                    if not match or self._held[match.end()] == 0x3C:
                        raise Malformed("tag without name")
                    name = bytes(match[0]).rpartition(b":")[2]
                    single = self._held[end - 2] == 0x2F
                    if begun < 0 and name in KINDS:
                        kind, begun, inner = name, at, depth
                        if single:
                            yield kind.decode(), self._base + at, self._base + end, bytes(self._held[at:end])
                            begun = -1
                    elif begun < 0 and name == b"smses":
                        said = re.search(rb"""\scount\s*=\s*["']([0-9]+)["']""", bytes(self._held[at:end]))
                        self.count = int(said[1]) if said else self.count
                    depth += not single
            at = end


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _plain(raw: bytes) -> bytes:
    """An element without name prefixes, and with replacement characters for references
    to surrogates, which no XML text may hold."""
    return _PREFIX.sub(rb"\1", _SURROGATE.sub("\ufffd".encode(), raw))


_PREFIX = re.compile(rb"(</?)[A-Za-z_][\w.-]*:")
_PART_NAMES = ("seq", "ct", "name", "chset", "cl", "text", "data")
_ADDR_NAMES = ("address", "type", "charset")


def _fields(element: ET.Element) -> tuple[dict[str, str], list[dict], list[dict]]:
    within = lambda outer, inner, names: [{n: e.get(n) for n in names} for o in element if o.tag == outer for e in o if e.tag == inner]
    return {_local(k) if ":" in k or "}" in k else k: v for k, v in element.items()}, within("parts", "part", _PART_NAMES), within("addrs", "addr", _ADDR_NAMES)


def decode(raw: bytes) -> tuple[dict[str, str], list[dict], list[dict]]:
    """Attributes, parts and addresses of one element. References to surrogates are
    read as replacement characters."""
    return _fields(ET.fromstring(_plain(raw)))


def decode_all(raws: list[bytes]) -> list[tuple[dict[str, str], list[dict], list[dict]] | Exception]:
    """What decode says of each element, or its error. They are parsed as one document; if
    that has an error, each by itself."""
    try:
        root = ET.fromstring(b"<all>%b</all>" % _plain(b"".join(raws)))
        if len(root) == len(raws):
            return [_fields(e) for e in root]
    except (ET.ParseError, UnicodeDecodeError):
        pass
    out = []
    for raw in raws:
        try:
            out.append(decode(raw))
        except (ET.ParseError, UnicodeDecodeError) as e:
            out.append(e)
    return out


def records(chunks: Iterable[bytes], name: str) -> Iterator[dict]:
    """Rows of RAW for one file."""
    ordinal, stop = 0, 0
    blank = {"file": name, "raw": None, "attrs": {}, "parts": [], "addrs": []}
    try:
        for kind, start, stop, raw in Scanner(chunks):
            attrs, parts, addrs = decode(raw)
            yield blank | {"ordinal": ordinal, "kind": kind, "start": start, "stop": stop, "raw": raw, "attrs": attrs, "parts": parts, "addrs": addrs, "status": "ok"}
            ordinal += 1
    except (Malformed, ET.ParseError, UnicodeDecodeError) as e:
        yield blank | {"ordinal": ordinal, "kind": "error", "start": stop, "stop": stop, "status": str(e)}


_PART = pa.struct([(n, pa.string()) for n in ("seq", "ct", "name", "chset", "cl", "text", "data")])
_ADDR = pa.struct([(n, pa.string()) for n in ("address", "type", "charset")])
ARROW = pa.schema(
    [("file", pa.string()), ("ordinal", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("raw", pa.binary()), ("attrs", pa.map_(pa.string(), pa.string()))]
    + [("parts", pa.list_(_PART)), ("addrs", pa.list_(_ADDR)), ("status", pa.string())]
)


def batches(rows: Iterator[dict], most: int = 8 << 20, schema: pa.Schema = ARROW) -> Iterator[pa.RecordBatch]:
    """Record batches of RAW rows, of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        row["attrs"] = list(row["attrs"].items())
        held.append(row)
        size += 2 * len(row["raw"] or b"")
        if size >= most or len(held) >= 5000:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _split(contents: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of files that come in chunks, each file's together and in order."""
    each = (row for batch in contents for row in zip(*(batch.column(c) for c in ("path", "first", "chunk")), strict=True))
    row = next(each, None)
    while row is not None:
        path = row[0].as_py()

        def chunks(first: bytes) -> Iterator[bytes]:
            nonlocal row
            yield first
            while (row := next(each, None)) is not None and not row[1].as_py():
                yield row[2].as_py()

        found = chunks(row[2].as_py())
        yield from batches(records(found, path))
        for _ in found:  # what follows an error
            pass


def files(spark: SparkSession, path: str) -> DataFrame:
    """XML files under a path, name in any case; dot files and logs are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.filter(F.lower(name).endswith(".xml") & ~name.startswith("."))


def read_backups(spark: SparkSession, path: str) -> DataFrame:
    """Raw elements of all backup files under a path, on any store that Spark reads."""
    return split(files(spark, path))


def chunked(found: DataFrame) -> DataFrame:
    """files(path, content) in chunks(path, first, chunk), each file's together and in order; a
    null content is one without bytes."""

    def cut(content: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.octet_length(content) - 1, F.lit(0)), F.lit(SENT))
        return F.transform(at, lambda i: F.struct((i == 0).alias("first"), F.substring(content, i + 1, F.lit(SENT)).alias("chunk")))

    # a variable, as a column's bytes would be copied whole for every chunk
    chunks = F.get(F.transform(F.array(F.coalesce("content", F.lit(b""))), cut), F.lit(0))
    return found.select("path", F.explode(chunks).alias("part")).select("path", "part.*")


def split(found: DataFrame) -> DataFrame:
    """Raw elements of files(path, content). What a task holds in Python does not grow with its files."""
    return chunked(found).mapInArrow(_split, RAW)


def file_hashes(found: DataFrame) -> DataFrame:
    """H1: SHA-256 of each file's bytes."""
    return found.select(F.col("path").alias("file"), F.sha2("content", 256).alias("file_hash"))


def backup_files(spark: SparkSession, path: str) -> DataFrame:
    """What lies in a backup folder: name, size and time, without reading it."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(~name.startswith(".") & ~F.lower(name).endswith(".log"))


def checked_path(path: str | None) -> str:
    """A path that names an existing file; blank, missing and folders are refused."""
    if not path or not path.strip():
        raise ValueError("path is required")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    return path


class BackupSource(DataSource):
    """spark.read.format("missive_backup").load(path): like read_backups, for files
    over the size of a binary column on a file system that every task can open."""

    @classmethod
    def name(cls) -> str:
        return "missive_backup"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            names = sorted(n for n in os.listdir(self.path) if n.lower().endswith(".xml") and not n.startswith("."))
            return [InputPartition(os.path.join(self.path, n)) for n in names]
        return [InputPartition(checked_path(self.path))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            yield from batches(records(iter(lambda: f.read(CHUNK), b""), partition.value))
