"""Files in, tables out: Markdown, EPUB, glossary CSV, fingerprints, ledgers and exports."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .books import EPUB, spine_of, write_books

MARKDOWN = ("md", "markdown", "mdown")
MEMBERS, EXPANDED, RATIO, LARGE = 20_000, 1 << 30, 200.0, 1 << 20
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def read_markdown(files: DataFrame) -> DataFrame:
    """(path, text, reason) of (path, content): UTF-8 without its mark; other suffixes get a reason and no text."""
    good = suffix(F.col("path")).isin(*MARKDOWN)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.select("path", F.when(good, text).alias("text"), F.when(~good, F.concat(F.lit("unsupported suffix: "), suffix(F.col("path")))).alias("reason"))


def source_fingerprint(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def changed_sources(now: DataFrame, projects: DataFrame) -> DataFrame:
    """Sources (source_path, source_lang, target_lang, fingerprint) that are new or differ from the newest project's."""
    keys = ["source_path", "source_lang", "target_lang"]
    order = Window.partitionBy(*keys).orderBy(F.desc("id"))
    newest = projects.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*keys, F.col("id").alias("project_id"), F.col("fingerprint").alias("old"))
    return now.join(newest, keys, "left").where(~F.col("fingerprint").eqNullSafe(F.col("old")))


def _members(content: bytes) -> list[tuple[str, int, int]] | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(m.filename, m.file_size, m.compress_size) for m in z.infolist() if not m.is_dir()]
    except zipfile.BadZipFile:
        return None


def archive_members(files: DataFrame) -> DataFrame:
    """(path, name, size, packed, is_archive) of every member; a file without members has one row without a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, _members(c or b"")) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(p, *m, members is not None) for p, members in found for m in (members or [(None, None, None)])]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "name", "size", "packed", "is_archive"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, size long, packed long, is_archive boolean")


def screen_archives(members: DataFrame, most_members: int = MEMBERS, most_bytes: int = EXPANDED, most_ratio: float = RATIO) -> DataFrame:
    """(path, members, bytes, verdict) of archives: ok, or the first fault."""
    name = F.replace("name", F.lit("\\"), F.lit("/"))
    unsafe = name.startswith("/") | F.array_contains(F.split(name, "/"), "..")
    bomb = (F.col("size") > LARGE) & (F.col("size") / F.greatest("packed", F.lit(1)) > most_ratio)
    own = members.groupBy("path").agg(F.count("name").alias("members"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max(F.coalesce(unsafe, F.lit(False))).alias("_u"), F.max(F.coalesce(bomb, F.lit(False))).alias("_b"), F.max(~F.col("is_archive")).alias("_z"))
    verdict = F.when(F.col("_z"), "not an archive").when(F.col("members") > most_members, "too many members").when(F.col("_u"), "unsafe path").when(F.col("bytes") > most_bytes, "too large").when(F.col("_b"), "suspicious ratio").otherwise("ok")
    return own.select("path", "members", "bytes", verdict.alias("verdict"))


def spine(content: bytes) -> list[tuple[int, str, str]]:
    """(position, file, xhtml) of an EPUB's reading order, without navigation and repeats."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        return [(k, name, box.read(name).decode("utf-8", "replace")) for k, name in enumerate(spine_of(box))]


def read_epub(files: DataFrame) -> DataFrame:
    """(path, spine_ord, file, html, reason) of every EPUB; one that can't be read is a row with a reason alone. Screen
    archives first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(*r, None) for r in spine(content or b"")]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, RuntimeError, NotImplementedError, TypeError, zlib.error) as e:
                    rows = [(None, None, None, f"{type(e).__name__}: {e}")]
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["path", "spine_ord", "file", "html", "reason"])

    return files.select("path", "content").mapInArrow(run, "path string, spine_ord int, file string, html string, reason string")


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return glossary_rows(raw)


def glossary_rows(raw: DataFrame) -> DataFrame:
    """Rows of a glossary file with ``reason``: null for good ones. Headers are trimmed and in lower case."""
    named = raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])
    if not {"source_term", "target_term"} <= set(named.columns):
        raise ValueError("the header must include source_term,target_term")
    for c in ("note", "case_sensitive", "enabled"):
        if c not in named.columns:
            named = named.withColumn(c, F.lit(None).cast("string"))

    def flag(c: str, default: bool) -> Column:
        low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
        return F.when(F.coalesce(c, F.lit("")) == "", default).when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)

    term = lambda c: F.trim(F.coalesce(c, F.lit("")))
    out = named.select(term("source_term").alias("source_term"), term("target_term").alias("target_term"), F.nullif(F.trim("note"), F.lit("")).alias("note"), flag("case_sensitive", False).alias("case_sensitive"), flag("enabled", True).alias("enabled"))
    size = lambda c: ~F.length(c).between(1, 1000)
    reason = F.when(size("source_term"), "source_term").when(size("target_term"), "target_term").when(F.length("note") > 4000, "note").when(F.col("case_sensitive").isNull(), "case_sensitive").when(F.col("enabled").isNull(), "enabled")
    return out.withColumn("reason", reason)


def book_rows(projects: DataFrame, rendered: DataFrame, timestamp: str) -> DataFrame:
    """Rows of the book sink for rendered books in parts, so that no value holds a whole book. Projects have title and
    source_type; parts (project_id, part, and text, or member and content) are chapters of a Markdown book or members
    of an EPUB."""
    stem = F.regexp_replace(F.regexp_replace("title", "(?U)[^\\w一-鿿.-]+", "-"), "^[-.]+|[-.]+$", "")
    stem = F.lower(F.coalesce(F.nullif(F.substring(stem, 1, 80), F.lit("")), F.lit("translation")))
    epub = F.col("source_type") == "epub"
    own = projects.select(F.col("id").alias("project_id"), "title", "source_type")
    for c, kind in (("text", "string"), ("member", "string"), ("content", "binary")):
        if c not in rendered.columns:
            rendered = rendered.withColumn(c, F.lit(None).cast(kind))
    out = rendered.join(own, "project_id")
    name = F.concat(stem, F.lit("-p"), F.col("project_id").cast("string"), F.lit(f"-{timestamp}."), F.when(epub, "epub").otherwise("md"))
    kind = F.when(epub, EPUB).otherwise("text/markdown")
    return out.select("project_id", name.alias("filename"), kind.alias("media_type"), "part", "member", F.coalesce("content", F.encode("text", "UTF-8")).alias("content"))


def export_sink(projects: DataFrame, rendered: DataFrame, path: str, timestamp: str) -> DataFrame:
    """A file for each book under its own name, and the manifest of what was written."""
    return write_books(book_rows(projects, rendered, timestamp), path)


def package_members(documents: DataFrame, folder: str = "OEBPS") -> DataFrame:
    """Members of an EPUB for each project from its documents (project_id, ord, file, html) in reading order: the
    container, the package and the documents, as rows of ``export_sink``."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    files = F.array_sort(F.collect_list(F.struct("ord", "file")))
    items = F.array_join(F.transform("f", lambda x: F.format_string('<item id="i%d" href="%s" media-type="application/xhtml+xml"/>', x["ord"], esc(x["file"]))), "")
    refs = F.array_join(F.transform("f", lambda x: F.format_string('<itemref idref="i%d"/>', x["ord"])), "")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><manifest>'
    package = F.concat(F.lit(head), items, F.lit("</manifest><spine>"), refs, F.lit("</spine></package>"))
    box = f'<?xml version="1.0" encoding="UTF-8"?>\n<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="{folder}/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    made = documents.groupBy("project_id").agg(files.alias("f"))
    heads = F.array(F.struct(F.lit(-2).cast("long").alias("part"), F.lit("META-INF/container.xml").alias("member"), F.lit(box).alias("text")), F.struct(F.lit(-1).cast("long").alias("part"), F.lit(f"{folder}/package.opf").alias("member"), package.alias("text")))
    pages = documents.select("project_id", F.col("ord").cast("long").alias("part"), F.concat(F.lit(f"{folder}/"), "file").alias("member"), F.coalesce("html", F.lit("")).alias("text"))
    return made.select("project_id", F.inline(heads)).unionByName(pages)
