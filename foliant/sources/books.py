"""Books out, archives in: a sink that writes one file a book, and a source that reads archives by ranges of bytes."""

from __future__ import annotations

import hashlib
import io
import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import groupby
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

EPUB, MIMETYPE = "application/epub+zip", b"application/epub+zip"
SINK, SOURCE = "foliant_books", "foliant_archives"
BOOKS = "project_id long, filename string, media_type string, part long, member string, content binary"
MANIFEST = pa.schema([("project_id", pa.int64()), ("filename", pa.string()), ("media_type", pa.string()), ("parts", pa.int64()), ("size", pa.int64()), ("sha256", pa.string()), ("status", pa.string())])
PER_PARTITION = 64  # archives that one task lists
BROKEN = (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, RuntimeError, NotImplementedError, TypeError, ValueError, EOFError, zlib.error, OSError)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


# --- one file a book --------------------------------------------------------------------------------------------


class Measured(io.RawIOBase):
    """A stream that counts and hashes what goes into a file."""

    def __init__(self, stream):
        self.stream, self.size, self.sha = stream, 0, hashlib.sha256()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        raw = bytes(data)
        self.stream.write(raw)
        self.sha.update(raw)
        self.size += len(raw)
        return len(raw)


@contextmanager
def entries_of(out: Measured, media_type: str):
    """A function that puts (member, content) into a book: into its archive, or one after the other."""
    if media_type != EPUB:
        yield lambda member, content: out.write(content)
        return
    with zipfile.ZipFile(out, "w") as box:

        def put(member: str, content: bytes, kind: int = zipfile.ZIP_DEFLATED) -> None:
            info = zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0))  # the same bytes whenever it is written
            info.compress_type = kind
            box.writestr(info, content)

        put("mimetype", MIMETYPE, zipfile.ZIP_STORED)
        yield put


@dataclass
class Written(WriterCommitMessage):
    folder: str = ""


class BookWriter(DataSourceArrowWriter):
    """Each task writes whole books, one open at a time and streamed, into a folder of its own with their part of the
    manifest. When all have ended, commit moves the folders' files in place; after a failure nothing is left."""

    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        folder = f"{root}/{self.run}/{uuid.uuid4().hex}"
        store.create_dir(folder)
        rows = (row for batch in iterator for row in batch.to_pylist())
        done = []
        for name, book in groupby(rows, key=lambda r: r["filename"]):
            with store.open_output_stream(f"{folder}/{name}") as stream:
                out, parts, first = Measured(stream), 0, None
                book = iter(book)
                first = next(book)
                with entries_of(out, first["media_type"]) as put:
                    while first is not None:
                        put(first["member"], first["content"] or b"")
                        parts, last, first = parts + 1, first, next(book, None)
            done.append({"project_id": last["project_id"], "filename": name, "media_type": last["media_type"], "parts": parts, "size": out.size, "sha256": out.sha.hexdigest(), "status": "ready"})
        if done:
            pq.write_table(pa.Table.from_pylist(done, MANIFEST), f"{folder}/{uuid.uuid4().hex}.manifest", filesystem=store)
        return Written(folder=folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for kind in ("books", "manifest"):
            store.create_dir(f"{root}/{kind}")
        for message in messages:
            files = store.get_file_info(fs.FileSelector(message.folder)) if message is not None else []
            for f in sorted(files, key=lambda f: f.base_name.endswith(".manifest")):
                to = f"manifest/{f.base_name.removesuffix('.manifest')}.parquet" if f.base_name.endswith(".manifest") else f"books/{f.base_name}"
                store.move(f.path, f"{root}/{to}")
        store.delete_dir(f"{root}/{self.run}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


class BookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def schema(self) -> str:
        return BOOKS

    def writer(self, schema, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"])


def write_books(books: DataFrame, path: str) -> DataFrame:
    """``BOOKS`` as files under ``path``/books, each in the order of its parts, and their manifest, which is returned. The
    rows are worked out once. A book is written by one task, which holds one part of it at a time."""
    spark = books.sparkSession
    spark.dataSource.register(BookSink)
    shaped = books.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in BOOKS.split(", ")])
    shaped.repartition("filename").sortWithinPartitions("filename", "part").write.format(SINK).mode("append").save(path)
    return spark.read.schema(spark.createDataFrame([], "project_id long, filename string, media_type string, parts long, size long, sha256 string, status string").schema).parquet(f"{path}/manifest")


# --- archives by ranges of bytes -----------------------------------------------------------------------------------


class Ranges(io.RawIOBase):
    """A file that is read where it is asked for, and how many bytes were."""

    def __init__(self, file):
        self.file, self.size, self.read_bytes, self.at = file, file.size(), 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + {0: 0, 1: self.at, 2: self.size}[whence]
        if self.at < 0:
            raise OSError("negative seek")
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        left = max(self.size - self.at, 0)
        raw = self.file.read_at(left if n is None or n < 0 else min(n, left), self.at)
        self.at, self.read_bytes = self.at + len(raw), self.read_bytes + len(raw)
        return raw


@contextmanager
def archive(path: str):
    """(the archive, its ranges): its directory is found from the end of the file, and members where it says."""
    store, inner = opened(path)
    with store.open_input_file(inner) as file:
        ranges = Ranges(file)
        with zipfile.ZipFile(ranges) as box:
            yield box, ranges


MEMBERS = "path string, file_size long, name string, size long, packed long, is_archive boolean, reason string, bytes_read long"


@dataclass
class Paths(InputPartition):
    paths: list[tuple[str, int]] = field(default_factory=list)

    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


class ArchiveReader(DataSourceReader):
    """Lists archives: partitions are runs of files, and of each its end alone is read."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Paths]:
        store, root = opened(self.path)
        where = self.path.rstrip("/").removesuffix(root.rstrip("/"))  # names the store, where it isn't the local one
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((where + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix))
        return [Paths(files[k : k + PER_PARTITION]) for k in range(0, len(files), PER_PARTITION)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
        for path, size in partition.paths:
            try:
                with archive(path) as (box, ranges):
                    members = [(m.filename, m.file_size, m.compress_size, True, None) for m in box.infolist() if not m.is_dir()]
                    cost = ranges.read_bytes
                members = members or [(None, None, None, True, None)]
            except BROKEN as e:
                members, cost = [(None, None, None, False, f"{type(e).__name__}: {e}")], min(size, 22)
            rows = [(path, size, *m, cost) for m in members]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("suffix", ".epub"))


def list_archives(spark: SparkSession, path: str, suffix: str = ".epub") -> DataFrame:
    """``MEMBERS`` of all archives under ``path``: what ``screen_archives`` takes. An archive without members has one row
    without a name; a file that is none, or is broken, has one with a reason."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(SOURCE).option("suffix", suffix).load(path)


def spine_of(box: zipfile.ZipFile) -> list[str]:
    """An EPUB's documents in reading order, without navigation and repeats."""
    local = lambda e: e.tag.rpartition("}")[2]
    container = ElementTree.fromstring(box.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in container.iter() if local(e) == "rootfile")
    package = list(ElementTree.fromstring(box.read(opf)).iter())
    items = {e.get("id"): e for e in package if local(e) == "item"}
    there = set(box.namelist())
    out: dict[str, None] = {}
    for ref in (e.get("idref") for e in package if local(e) == "itemref"):
        item = items.get(ref)
        if item is not None and "nav" not in (item.get("properties") or "").split():
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(item.get("href"))))
            if name in there:
                out[name] = None
    return list(out)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(path, spine_ord, file, html, reason) of every EPUB under ``path``. Archives are listed and their spines read; then
    the documents are dealt out evenly, whichever archive they are in, and read by their range. An archive or document
    that can't be read is a row with a reason."""
    archives = list_archives(spark, path).groupBy("path").agg(F.max("reason").alias("reason"))

    def spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, reason in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(None, None, reason)]
                if reason is None:
                    try:
                        with archive(at) as (box, _):
                            rows = [(k, name, None) for k, name in enumerate(spine_of(box))]
                    except BROKEN as e:
                        rows = [(None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string())))], ["path", "spine_ord", "file", "reason"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in groupby(batch.to_pylist(), key=lambda r: r["path"]):
                rows = list(rows)
                for r in rows:
                    r["html"] = None
                wanted = [r for r in rows if r["file"] is not None]
                try:
                    if wanted:
                        with archive(at) as (box, _):
                            for r in wanted:
                                try:
                                    r["html"] = box.read(r["file"]).decode("utf-8", "replace")
                                except BROKEN as e:
                                    r["reason"] = f"{type(e).__name__}: {e}"
                except BROKEN as e:
                    for r in wanted:
                        r["reason"] = f"{type(e).__name__}: {e}"
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in (("path", pa.string()), ("spine_ord", pa.int32()), ("file", pa.string()), ("html", pa.string()), ("reason", pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "spine_ord", "file", "html", "reason"])

    found = archives.mapInArrow(spines, "path string, spine_ord int, file string, reason string")
    dealt = found.repartition(F.col("path"), F.floor(F.coalesce("spine_ord", F.lit(0)) / 16)).sortWithinPartitions("path", "spine_ord")
    return dealt.mapInArrow(documents, "path string, spine_ord int, file string, html string, reason string")
