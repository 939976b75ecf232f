"""Blocks to segments, and segments back to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.helpers import split_text
from ..sources.scratch import written
from .render import restore_links

BLOCK_KEYS = ("source_type", "file", "xpath", "token_index", "chapter_ord", "block_index")


def ordinals(rows: DataFrame, order: list[str], project: str = "project_id", chapter: str = "chapter_ord") -> DataFrame:
    """``ord``: each row's place in its project, by chapter and ``order``. Chapters' counts are summed first, so rows are
    sorted by chapter and no task gets a whole project."""
    over = Window.partitionBy(project).orderBy(chapter).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(project, chapter).agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    inside = Window.partitionBy(project, chapter).orderBy(*order)
    return rows.join(base, [project, chapter]).withColumn("ord", F.col("_base") + F.row_number().over(inside) - 1).drop("_base")


def assign_chapters(blocks: DataFrame, project: str = "project_id") -> DataFrame:
    """Markdown blocks (token_index, kind, level, text): a heading of level 1 or 2 opens a chapter with its text as
    title, blank ones "Untitled"; blocks before the first make a chapter without title. Ords count from 0."""
    top = (F.col("kind") == "heading") & (F.col("level") <= 2)
    order = Window.partitionBy(project).orderBy("token_index")
    wide = blocks.withColumn("_top", top).withColumn("_run", F.sum(F.col("_top").cast("int")).over(order))
    whole = Window.partitionBy(project, "_run")
    title = F.when(F.col("_run") > 0, F.first(F.when(F.col("_top"), F.when(T.is_blank(F.col("text")), "Untitled").otherwise(T.strip(F.col("text")))), ignorenulls=True).over(whole))
    href = F.first(F.when(F.col("_top"), F.concat(F.lit("heading-"), F.col("token_index"))), ignorenulls=True).over(whole)
    ord_ = F.dense_rank().over(Window.partitionBy(project).orderBy("_run")) - 1
    return wide.withColumns({"chapter_title": title, "chapter_href": href, "chapter_ord": ord_}).drop("_top", "_run")


def assign_epub_chapters(blocks: DataFrame, project: str = "project_id") -> DataFrame:
    """Blocks of EPUBs (spine_ord, file, token_index, kind, text): each document with a block is a chapter, named by its
    first heading that says something. Documents are counted first, so no task sorts a book's blocks."""
    said = F.when((F.col("kind") == "heading") & ~T.is_blank(F.col("text")), F.struct("token_index", F.col("text").alias("t")))
    own = blocks.groupBy(project, "spine_ord").agg(F.min(said).alias("_h"))
    order = Window.partitionBy(project).orderBy("spine_ord")
    own = own.select(project, "spine_ord", F.col("_h.t").alias("chapter_title"), (F.row_number().over(order) - 1).alias("chapter_ord"))
    return blocks.join(own, [project, "spine_ord"]).withColumn("chapter_href", F.col("file"))


def chapter_table(sources: DataFrame, blocks: DataFrame, project: str = "project_id") -> DataFrame:
    """(project, chapter_ord, chapter_title, chapter_href) of each of ``sources``: the chapters of its ``blocks``, or, of a
    source without any, one that is empty and has no title."""
    own = blocks.groupBy(project, "chapter_ord").agg(F.first("chapter_title").alias("chapter_title"), F.first("chapter_href").alias("chapter_href"))
    return sources.select(project).distinct().join(own, project, "left").withColumn("chapter_ord", F.coalesce("chapter_ord", F.lit(0)))


def translatable_blocks(blocks: DataFrame, project: str = "project_id") -> DataFrame:
    """Blocks with text to translate; block_index counts all of a chapter's blocks."""
    order = Window.partitionBy(project, "chapter_ord").orderBy("token_index")
    return blocks.withColumn("block_index", F.row_number().over(order) - 1).where(F.col("translatable") & ~T.is_blank(F.col("text")))


def split_parts(blocks: DataFrame, most: int = 1500, markdown: bool = False) -> DataFrame:
    """A row for each piece of at most ``most`` characters, with part_index and part_count. Texts that fit, nearly
    all, never leave the JVM."""
    text = F.col("text")
    parts = F.when(F.length(text) <= most, F.array(text)).otherwise(split_text(most, markdown)(F.when(F.length(text) > most, text)))
    wide = blocks.withColumn("_parts", parts).withColumn("part_count", F.size("_parts"))
    out = wide.select("*", F.posexplode("_parts").alias("part_index", "_part")).drop("_parts", "text")
    return out.withColumnRenamed("_part", "text")


def segment_documents(blocks: DataFrame, path: Column, most: int = 1500, markdown: bool = True, project: str = "project_id") -> DataFrame:
    """Pending segments of translatable blocks (chapter_ord, block_index, text): pieces in order, their hash and
    their stable key from ``path``. Texts are split once: the pieces are written, and counted and numbered from there.
    One shuffle by project and chapter serves the order."""
    pieces = written(split_parts(blocks, most, markdown), "pieces")
    pieces = ordinals(pieces, ["block_index", "part_index"], project)
    key = T.stable_key(F.col("chapter_ord"), F.col("block_index"), path, F.col("part_index"), F.col("part_count"))
    return pieces.withColumns({"src_hash": T.source_hash(F.col("text")), "stable_key": key, "status": F.lit("pending")})


def regroup_blocks(segments: DataFrame, text: Column, project: str = "project_id", keys: tuple[str, ...] = BLOCK_KEYS) -> DataFrame:
    """Whole blocks again: parts in the order of part_index, joined by nothing; first_ord keeps blocks in order."""
    parts = F.array_sort(F.collect_list(F.struct("part_index", "ord", text.alias("text"))))
    grouped = segments.groupBy(project, *keys).agg(parts.alias("_parts"), F.min("ord").alias("first_ord"))
    return grouped.withColumn("text", F.array_join(F.transform("_parts", lambda p: p["text"]), "")).drop("_parts")


def block_translation(segments: DataFrame, include_untranslated: bool, project: str = "project_id", keys: tuple[str, ...] = BLOCK_KEYS) -> DataFrame:
    """Each block's translation: targets of completed parts with their sources' link targets, sources of others if asked for; null if none is
    translated and sources aren't asked for."""
    ready = T.completed(F.col("status")) & F.col("target_text").isNotNull()
    linked = ready & F.contains("target_text", F.lit("]("))  # only these go to Python
    target = F.when(linked, restore_links(F.when(linked, F.col("source_text")), F.when(linked, F.col("target_text")))).otherwise(F.col("target_text"))
    text = F.when(ready, target).otherwise(F.col("source_text") if include_untranslated else F.lit(""))
    grouped = regroup_blocks(segments, text, project, keys)
    if include_untranslated:
        return grouped
    some = segments.groupBy(project, *keys).agg(F.max(ready).alias("_some"))
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (project, *keys)]
    joined = grouped.alias("g").join(some.alias("s"), same)
    return joined.select("g.*", "_some").withColumn("text", F.when(F.col("_some"), F.col("text"))).drop("_some")
