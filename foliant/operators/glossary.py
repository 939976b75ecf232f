"""Glossary terms: matching, import and search."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions import text as T
from ..sources.scratch import written
from .search import indexed_search
from .spread import salted_join

#: Characters of segments, and terms, that meet in one group: what a task holds at once, whatever a project's size.
CHARS, TERMS = 2_000_000, 20_000
GROUPS = ("project_id", "_split", "_shard")
TERM = ("term_id", "source_term", "target_term", "note", "case_sensitive")


@lru_cache(maxsize=4)
def automata(terms: tuple[tuple[str, bool], ...]) -> tuple:
    """Two automata of the terms (text, case sensitive), one for texts as they are and one for folded texts. Each finds
    every place where any term ends in one pass over a text; a place gives the numbers of the terms and their length."""
    made = []
    for sensitive in (True, False):
        found: dict[str, list[int]] = {}
        for k, (term, exact) in enumerate(terms):
            if exact == sensitive:
                found.setdefault(term if exact else term.casefold(), []).append(k)
        machine = ahocorasick.Automaton()
        for term, numbers in found.items():
            machine.add_word(term, (len(term), numbers))
        if found:
            machine.make_automaton()
        made.append(machine if found else None)
    return tuple(made)


def places(text: str, machines: tuple) -> dict[int, list[int]]:
    """Where each term begins in ``text``, overlapping places included. Folding may make a text longer; the character
    that gave a folded one is what counts."""
    out: dict[int, list[int]] = {}
    exact, folded = machines
    if exact is not None:
        for end, (size, numbers) in exact.iter(text):
            for k in numbers:
                out.setdefault(k, []).append(end - size + 1)
    if folded is not None:
        low = text.casefold()
        home = None if len(low) == len(text) else np.repeat(np.arange(len(text)), [len(c.casefold()) for c in text])
        for end, (size, numbers) in folded.iter(low):
            at = end - size + 1
            for k in numbers:
                out.setdefault(k, []).append(at if home is None else int(home[at]))
    return {k: sorted(set(v)) for k, v in out.items()}


def _shape(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(project_id, _shards, _splits) of projects with terms and segments: into how many groups each is dealt. A row a project:
    written, so that its size is known before texts are shuffled to meet it."""
    shards = F.ceil(F.count("*") / TERMS).cast("int")
    splits = F.ceil(F.sum(F.length("source_text")) / CHARS + F.lit(1e-9)).cast("int")
    shape = terms.groupBy("project_id").agg(shards.alias("_shards")).join(segments.groupBy("project_id").agg(splits.alias("_splits")), "project_id")
    return written(shape.withColumn("_splits", F.coalesce("_splits", F.lit(1))), "shape")


def _live(terms: DataFrame) -> DataFrame:
    live = terms.where(F.col("enabled") & (F.length("source_term") > 0))
    return live.select("project_id", F.col("id").alias("term_id"), "source_term", "target_term", "note", "case_sensitive")


def _dealt(segments: DataFrame, live: DataFrame, shape: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and terms by ``GROUPS``. A project's segments are dealt into groups of ``CHARS`` characters and its
    terms into groups of ``TERMS``; texts of projects without terms are not moved."""
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = salted_join(segments.where("source_text IS NOT NULL"), shape, "project_id", "id")
    left = left.withColumn("_split", F.pmod(F.xxhash64("id", "source_text"), F.col("_splits")).cast("int")).withColumn("_shard", upto("_shards")).drop("_splits", "_shards")
    right = salted_join(live, shape, "project_id", "term_id")
    right = right.withColumn("_shard", F.pmod(F.xxhash64("source_term", "term_id"), F.col("_shards")).cast("int")).withColumn("_split", upto("_splits")).drop("_splits", "_shards")
    return left, right


def term_places(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Segments (id, project_id, source_text and more) with each enabled term of their project that their source holds
    as a substring, and ``starts``, its places. Where a group of segments and one of terms meet, one pass of an automaton
    over each text finds all its terms. Time grows with the texts and what is found, not with texts times terms."""
    live = _live(terms)
    left, right = _dealt(segments, live, _shape(segments, live))
    kinds = {f.name: f for f in right.schema.fields}
    schema = ty.StructType([*segments.schema.fields, *(kinds[c] for c in TERM), ty.StructField("starts", ty.ArrayType(ty.IntegerType()))])
    own = segments.columns

    def meet(texts: pa.Table, glossary: pa.Table) -> pa.Table:
        pairs: tuple[list[int], list[int], list[list[int]]] = ([], [], [])
        if len(texts) and len(glossary):
            machines = automata(tuple(zip(glossary.column("source_term").to_pylist(), glossary.column("case_sensitive").to_pylist(), strict=True)))
            for n, text in enumerate(texts.column("source_text").to_pylist()):
                for k, starts in places(text, machines).items():
                    pairs[0].append(n), pairs[1].append(k), pairs[2].append(starts)
        mine = texts.select(own).take(pa.array(pairs[0], pa.int64()))
        found = glossary.select(list(TERM)).take(pa.array(pairs[1], pa.int64()))
        return pa.table([*mine.columns, *found.columns, pa.array(pairs[2], pa.list_(pa.int32()))], names=[*own, *TERM, "starts"])

    return left.groupBy(*GROUPS).cogroup(right.groupBy(*GROUPS)).applyInArrow(meet, schema)


def terms_in(text: str, machines: tuple) -> list[int]:
    """Numbers of the terms that ``text`` has, ascending; their places are not kept."""
    exact, folded = machines
    met = {} if exact is None else {numbers[0]: numbers for _, (_, numbers) in exact.iter(text)}
    if folded is not None:
        met.update({numbers[0]: numbers for _, (_, numbers) in folded.iter(text.casefold())})
    return sorted(k for numbers in met.values() for k in numbers)


def _listed(left: DataFrame, right: DataFrame, own: list[str], every: bool) -> DataFrame:
    """``own`` columns and ``terms`` of dealt segments that have any of their group's, or of ``every`` one."""
    names = TERM[:4]
    item = f"struct<{', '.join(f'{c}: {right.schema[c].dataType.simpleString()}' for c in names)}>"
    schema = ty.StructType([*(left.schema[c] for c in own), *ty.StructType.fromDDL(f"terms array<{item}>").fields])

    def meet(texts: pa.Table, glossary: pa.Table) -> pa.Table:
        rows, numbers, ends = [], [], [0]
        if len(texts) and len(glossary):
            glossary = glossary.sort_by("term_id")
            machines = automata(tuple(zip(glossary.column("source_term").to_pylist(), glossary.column("case_sensitive").to_pylist(), strict=True)))
            for n, text in enumerate(texts.column("source_text").to_pylist()):
                found = terms_in(text, machines)
                if found or every:
                    rows.append(n), numbers.extend(found), ends.append(len(numbers))
        elif every:
            rows, ends = list(range(len(texts))), [0] * (len(texts) + 1)
        found = glossary.select(list(names)).take(pa.array(numbers, pa.int64())).combine_chunks()
        items = pa.StructArray.from_arrays([found.column(c).combine_chunks() for c in names], list(names))
        none = pa.array([a == z for a, z in zip(ends, ends[1:], strict=False)], pa.bool_())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=pa.list_(pa.field("element", items.type)), mask=none)
        mine = texts.select(own).take(pa.array(rows, pa.int64()))
        return pa.table([*mine.columns, lists], names=[*own, "terms"])

    return left.groupBy(*GROUPS).cogroup(right.groupBy(*GROUPS)).applyInArrow(meet, schema)


def term_lists(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, terms): of each segment with any the terms of ``glossary_matches``, by their id, in one row. Neither texts nor
    places leave the task that finds the terms."""
    live, own = _live(terms.where(~T.is_blank(F.col("source_term")))), segments.select("id", "project_id", "source_text")
    return _gathered(own, live, _shape(own, live))


def _gathered(segments: DataFrame, live: DataFrame, shape: DataFrame) -> DataFrame:
    lists = _listed(*_dealt(segments, live, shape), ["id"], False).groupBy("id").agg(F.collect_list("terms").alias("l"))
    return lists.select("id", F.when(F.size("l") == 1, F.col("l")[0]).otherwise(F.array_sort(F.flatten("l"))).alias("terms"))


def with_terms(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """All of ``segments`` with ``terms`` as in ``term_lists``, null without any. As long as no project has more than one
    group of terms, a segment comes back whole from the only group that it meets, and neither lists nor texts are
    shuffled again to meet each other."""
    live, own = _live(terms.where(~T.is_blank(F.col("source_term")))), segments.columns
    shape = _shape(segments, live)
    if (shape.agg(F.max("_shards")).first()[0] or 0) > 1:
        lists = _gathered(segments.select("id", "project_id", "source_text"), live, shape)
        return segments.join(lists, "id", "left").select(*own, "terms")
    dealt = _listed(*_dealt(segments, live, shape), own, True)
    none = F.lit(None).cast(dealt.schema["terms"].dataType).alias("terms")
    apart = salted_join(segments, shape.withColumn("_there", F.lit(True)), "project_id", "id", how="left").where("source_text IS NULL OR _there IS NULL")
    return dealt.unionByName(apart.select(*own, none))


def glossary_matches(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each segment and term, with the places of the term; blank terms never match."""
    return term_places(segments, terms.where(~T.is_blank(F.col("source_term"))))


def glossary_mismatches(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms in a source whose target term is missing in the target."""
    wide = term_places(segments, terms)
    there = F.when(F.col("case_sensitive"), F.contains("target_text", "target_term")).otherwise(F.contains(T.casefold(F.col("target_text")), T.casefold(F.col("target_term"))))
    return wide.where(~F.coalesce(there, F.lit(False)))


def glossary_import(terms: DataFrame, batch: DataFrame, overwrite: bool = False) -> DataFrame:
    """The batch with an ``action``: duplicate (twice in the batch), conflict, update or create."""
    n = batch.groupBy("project_id", "source_term").agg(F.count("*").alias("_n"))
    old = terms.select("project_id", "source_term", F.lit(True).alias("_old"))
    wide = batch.join(n, ["project_id", "source_term"]).join(old, ["project_id", "source_term"], "left")
    action = F.when(F.col("_n") > 1, "duplicate").when(F.col("_old").isNotNull(), "update" if overwrite else "conflict").otherwise("create")
    return wide.withColumn("action", action).drop("_n", "_old")


def glossary_search(terms: DataFrame, project_id: int | None = None, search: str = "", enabled_only: bool = False, notes: bool = False, index: str | None = None) -> DataFrame:
    """Terms by id; a search in terms (and notes) may use an ``index`` of their grams."""
    out = indexed_search(terms.sparkSession, index, search) if search and index else terms
    out = out if project_id is None else out.where(F.col("project_id") == project_id)
    if enabled_only:
        out = out.where("enabled")
    if search and not index:
        hit: Column = T.contains_folded(F.col("source_term"), search) | T.contains_folded(F.col("target_term"), search)
        if notes:
            hit = hit | F.coalesce(T.contains_folded(F.col("note"), search), F.lit(False))
        out = out.where(hit)
    return out.orderBy("id")
