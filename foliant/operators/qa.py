"""Quality checks of translated segments and rendered documents."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.helpers import vectorized
from ..sources.blocks import plain, scan
from ..sources.scratch import small_batches
from .glossary import glossary_mismatches

ISSUE = ["project_id", "segment_id", "stable_key", "code", "severity", "detail", "details"]
LOW, HIGH, LEAST, RESIDUAL = 0.3, 3.0, 4, 0.35


def missing(segments: DataFrame) -> DataFrame:
    """With ``missing``: not completed or without a text; no other check of the target then counts."""
    return segments.withColumn("missing", ~T.completed(F.col("status")) | T.is_blank(F.col("target_text")))


def _details(**values: Column) -> Column:
    """Names and values of an issue, all as text."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _issue(code: str, severity: str, detail: Column, **details: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"), _details(**details).alias("details"))


def missing_translation() -> tuple[Column, Column]:
    return F.col("missing"), _issue("missing_translation", "error", F.col("status"), status=F.col("status"))


def length_ratio() -> tuple[Column, Column]:
    a, b = T.compact_length(F.col("source_text")), T.compact_length(F.col("target_text"))
    ratio = b / a
    return ~F.col("missing") & (a >= LEAST) & ((ratio < LOW) | (ratio > HIGH)), _issue("length_ratio", "warn", F.format_string("%.4f", F.bround(ratio, 4)), ratio=F.format_string("%.4f", F.bround(ratio, 4)), minimum=F.lit(LOW), maximum=F.lit(HIGH), source_length=a, target_length=b)


def placeholder_missing() -> tuple[Column, Column]:
    lost = T.multiset_minus(T.placeholders(F.col("source_text")), T.placeholders(F.col("target_text")))
    return ~F.col("missing") & (F.size(lost) > 0), _issue("placeholder_missing", "warn", F.array_join(lost, "|"), missing=F.to_json(lost))


def english_residual() -> tuple[Column, Column]:
    runs = T.english_runs(F.col("target_text"))
    letters = F.length(F.regexp_replace(F.col("target_text"), "[^A-Za-z]", ""))
    return ~F.col("missing") & (F.size(runs) > 0) & (letters / F.greatest(T.compact_length(F.col("target_text")), F.lit(1)) >= RESIDUAL), _issue("english_residual", "warn", F.array_join(F.slice(runs, 1, 3), "|"), runs=F.to_json(F.slice(runs, 1, 3)))


def struct_path() -> tuple[Column, Column]:
    """Segments carry source_type, file, xpath and token_index of their path."""
    kind = F.col("source_type")
    bad = kind.isNull() | ((kind == "epub") & (F.col("file").isNull() | F.col("xpath").isNull())) | ((kind == "md") & F.col("token_index").isNull())
    return bad, _issue("invalid_structure_path", "error", F.coalesce(kind, F.lit("")), source_type=F.coalesce(kind, F.lit("")))


ROW_RULES = {"qa_missing": missing_translation, "qa_length_ratio": length_ratio, "qa_placeholders": placeholder_missing, "qa_english_residual": english_residual, "qa_struct_path": struct_path}


def row_issues(segments: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Issues of all row rules from one projection; nothing is shuffled."""
    found = [F.when(bad, issue) for bad, issue in (ROW_RULES[r]() for r in rules or ROW_RULES)]
    wide = missing(segments).withColumn("_i", F.explode(F.array_compact(F.array(*found))))
    return wide.select("project_id", F.col("id").alias("segment_id"), "stable_key", "_i.code", "_i.severity", "_i.detail", "_i.details")


def glossary_issues(segments: DataFrame, terms: DataFrame) -> DataFrame:
    wide = glossary_mismatches(missing(segments).where("not missing").drop("missing"), terms)
    return wide.select("project_id", F.col("id").alias("segment_id"), "stable_key", F.lit("glossary_mismatch").alias("code"), F.lit("warn").alias("severity"), F.col("source_term").alias("detail"), _details(glossary_term_id=F.col("term_id"), source_term=F.col("source_term"), target_term=F.col("target_term")).alias("details"))


def qa_report(*issues: DataFrame) -> DataFrame:
    """Counts by severity for each project."""
    every = issues[0]
    for i in issues[1:]:
        every = every.unionByName(i)
    return every.groupBy("project_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")], F.count("*").alias("total"))


INLINE = re.compile(r"(?P<code>(?P<t>`+)(?P<c>.*?)(?P=t))|!\[[^\]]*\]\((?P<img>[^)]*)\)|\[(?P<label>[^\]]*)\]\((?P<href>[^)]*)\)|<(?P<auto>https?://[^>\s]+)>", re.S)


def signature_of(text: str) -> list[str]:
    """Structure alone: containers as they open and close, kinds of blocks in them, and targets of links, images and code;
    words don't count."""
    out: list[str] = []

    def emit(kind: str, a: int, b: int, words: str, within, tag: str = "p", info: str = "", wide: int = 0, **_) -> None:
        if kind in ("open", "close"):
            out.append(f"{kind}:{words}")
            return
        if kind in ("code", "raw"):
            out.append(f"{kind}:{info}:{words}")
            return
        out.append("rule" if kind == "rule" else f"{tag}:{wide}" if kind == "row" else tag)
        out.extend(f"code:{m['c']}" if m["code"] else f"image:{m['img']}" if m["img"] is not None else f"link:{m['href'] if m['href'] is not None else m['auto']}" for m in INLINE.finditer(words))

    scan([(k, plain(line)) for k, line in enumerate((text or "").splitlines())], emit)
    return out


@vectorized("array<string>")
def signature(s: pd.Series) -> pd.Series:
    return s.map(signature_of)


def markdown_structure(rendered: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Documents whose structure changed: the first index that differs, and both lengths."""
    small_batches(rendered.sparkSession)
    wide = rendered.withColumns({"_a": signature(F.col(source)), "_b": signature(F.col(target))})
    pairs = F.arrays_zip(F.col("_a").alias("a"), F.col("_b").alias("b"))
    first = F.array_position(F.transform(pairs, lambda p: ~p["a"].eqNullSafe(p["b"])), True) - 1
    wide = wide.withColumns({"first_difference": first, "source_length": F.size("_a"), "target_length": F.size("_b"), "source_token": F.get("_a", first.cast("int")), "target_token": F.get("_b", first.cast("int"))})
    return wide.where("first_difference >= 0").drop("_a", "_b")


@vectorized("string")
def xml_error(s: pd.Series) -> pd.Series:
    """Why a document isn't well-formed XML, null if it is."""

    def check(text: str | None) -> str | None:
        parser = expat.ParserCreate()
        try:
            parser.Parse(text or "", True)
        except expat.ExpatError as e:
            return str(e)
        return None

    return s.map(check)


def xhtml_structure(projects: DataFrame, rendered: DataFrame) -> DataFrame:
    """(project_id, documents, damaged, error): a project without documents is an error as well."""
    small_batches(rendered.sparkSession)
    own = rendered.withColumn("_e", xml_error(F.col("xhtml"))).groupBy("project_id").agg(F.count("*").alias("documents"), F.count("_e").alias("damaged"))
    out = projects.select(F.col("id").alias("project_id")).join(own, "project_id", "left").na.fill(0)
    return out.withColumn("error", (F.col("documents") == 0) | (F.col("damaged") > 0))


def structure_issues(markdown: DataFrame | None = None, xhtml: DataFrame | None = None, unreadable: DataFrame | None = None) -> DataFrame:
    """Issues of whole projects, for the union of ``qa_report``: rows of ``markdown_structure`` (project_id and more),
    rows of ``xhtml_structure`` that are errors, and projects (project_id) whose source can't be read."""
    found = []
    if markdown is not None:
        found.append(markdown.select("project_id", F.lit("tokens differ").alias("detail"), _details(source_token_count=F.col("source_length"), rendered_token_count=F.col("target_length"), first_mismatch=F.col("first_difference"), source_token=F.col("source_token"), rendered_token=F.col("target_token")).alias("details")))
    if xhtml is not None:
        found.append(xhtml.where("error").select("project_id", F.when(F.col("documents") == 0, "no documents").otherwise("not well-formed").alias("detail"), _details(documents=F.col("documents"), damaged=F.col("damaged")).alias("details")))
    if unreadable is not None:
        found.append(unreadable.select("project_id", F.lit("source not found").alias("detail"), _details(reason=F.lit("source_not_found")).alias("details")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.select("project_id", F.lit(None).cast("long").alias("segment_id"), F.lit(None).cast("string").alias("stable_key"), F.lit("structure_damage").alias("code"), F.lit("error").alias("severity"), "detail", "details")
