"""The ledger of segments: merging new drafts, choosing work, edits, results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.helpers import restore_markers

PROVIDER_ERROR = "Translation provider request failed"
CLEARED = ("target_text", "error_msg", "token_in", "token_out", "provider")
#: What a row counts by; changes carry it as it was, in ``old``.
COUNTED = ("chapter_id", "status", "token_in", "token_out", "src_hash", "provider")


def ledger_merge(stored: DataFrame, drafts: DataFrame, now: str) -> DataFrame:
    """Drafts against the stored ledger on (project_id, stable_key), with an ``action``: insert, keep (the same hash:
    place refreshed, work kept), reset (another hash: work dropped) or delete (no longer in the drafts). ``old`` is what
    the stored row counted as, null for a new one."""
    s, d = stored.alias("s"), drafts.alias("d")
    both = s.join(d, (F.col("s.project_id") == F.col("d.project_id")) & (F.col("s.stable_key") == F.col("d.stable_key")), "full_outer")
    action = (
        F.when(F.col("s.stable_key").isNull(), "insert")
        .when(F.col("d.stable_key").isNull(), "delete")
        .when(F.col("s.src_hash") == F.col("d.src_hash"), "keep")
        .otherwise("reset")
    )
    new = F.col("action").isin("insert", "reset")
    wide = both.withColumn("action", action)
    place = lambda c: F.when(F.col("action") == "delete", F.col(f"s.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
    work = lambda c: F.when(~new, F.col(f"s.{c}")).alias(c)
    return wide.select(
        "action",
        F.coalesce("d.project_id", "s.project_id").alias("project_id"),
        F.coalesce("d.stable_key", "s.stable_key").alias("stable_key"),
        *[place(c) for c in ("chapter_id", "ord", "source_text", "src_hash")],
        *[work(c) for c in CLEARED],
        F.when(new, "pending").otherwise(F.col("s.status")).alias("status"),
        F.when(new, F.lit(now)).otherwise(F.col("s.updated_at")).alias("updated_at"),
        F.when(F.col("s.stable_key").isNotNull(), F.struct(*[F.col(f"s.{c}") for c in COUNTED])).alias("old"),
    )


def chapter_merge(stored: DataFrame, drafts: DataFrame) -> DataFrame:
    """Chapters on (project_id, ord): title and href from the drafts, summary kept; missing ones deleted."""
    s, d = stored.alias("s"), drafts.alias("d")
    both = s.join(d, (F.col("s.project_id") == F.col("d.project_id")) & (F.col("s.ord") == F.col("d.ord")), "full_outer")
    action = F.when(F.col("s.ord").isNull(), "insert").when(F.col("d.ord").isNull(), "delete").otherwise("update")
    take = lambda c: F.when(F.col("d.ord").isNull(), F.col(f"s.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
    return both.select(action.alias("action"), F.coalesce("d.project_id", "s.project_id").alias("project_id"), F.coalesce("d.ord", "s.ord").alias("ord"), take("title"), take("href"), F.col("s.summary").alias("summary"))


def chapter_signature(segments: DataFrame) -> DataFrame:
    """A digest of each chapter's ordered keys and hashes: compared instead of the lists themselves."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "stable_key", "src_hash")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["stable_key"], r["src_hash"])), "\n")
    return segments.groupBy("project_id", "chapter_id").agg(F.sha1(text.cast("binary")).alias("signature"))


def invalidate_summaries(chapters: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Chapters with ``changed``; a changed chapter's summary is null."""
    a, b = chapter_signature(before), chapter_signature(after).withColumnRenamed("signature", "fresh")
    both = a.join(b, ["project_id", "chapter_id"], "full_outer").select("project_id", F.col("chapter_id").alias("id"), (~F.col("signature").eqNullSafe(F.col("fresh"))).alias("_changed"))
    out = chapters.join(both, ["project_id", "id"], "left").withColumn("changed", F.coalesce("_changed", F.lit(False))).drop("_changed")
    return out.withColumn("summary", F.when(~F.col("changed"), F.col("summary")))


def recover_processing(segments: DataFrame) -> DataFrame:
    stuck = F.col("status") == "processing"
    return segments.withColumns({"error_msg": F.when(~stuck, F.col("error_msg")), "status": F.when(stuck, "pending").otherwise(F.col("status"))})


def recover_projects(projects: DataFrame) -> DataFrame:
    """Projects that a stopped run left translating are ready again."""
    return projects.withColumn("status", F.when(F.col("status") == "translating", "ready").otherwise(F.col("status")))


def select_candidates(segments: DataFrame, ids: DataFrame | None = None, chapter_id: int | None = None, retry_errors: bool = True, force: bool = False) -> DataFrame:
    """Eligible segments. No ``ids`` table means all, an empty one none; ids that repeat or are foreign do nothing."""
    states = ["pending"] + ["error"] * retry_errors + ["done", "reviewed"] * force
    out = segments.where(F.col("status").isin(states))
    if chapter_id is not None:
        out = out.where(F.col("chapter_id") == chapter_id)
    return out if ids is None else out.join(ids.select("id"), "id", "left_semi")


def selectable_ids(segments: DataFrame, most: int = 10_000, chapter_id: int | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Ids by (ord, id) that aren't being processed; refused beyond ``most``. The guard reads one row more."""
    out = segments.where(F.col("status") != "processing")
    if chapter_id is not None:
        out = out.where(F.col("chapter_id") == chapter_id)
    if statuses is not None:
        out = out.where(F.col("status").isin(statuses))
    if out.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} segments match")
    return out.orderBy("ord", "id").select("id", "ord")


def apply_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviewers' edits (segment_id, new_text, new_status, has_text) as (segment columns, rejected, to_tm, old)."""
    wide = segments.join(edits, segments["id"] == edits["segment_id"])
    text = F.when(F.col("has_text"), F.col("new_text")).otherwise(F.col("target_text"))
    state = F.coalesce("new_status", F.when(F.col("has_text"), F.when(T.is_blank(text), "pending").otherwise("done")).otherwise(F.col("status")))
    rejected = F.when(F.col("status") == "processing", "processing").when(T.completed(state) & T.is_blank(text), "blank")
    changed = F.col("has_text") & ~F.col("new_text").eqNullSafe(F.col("target_text"))
    wide = wide.withColumns({"_text": text, "_state": state, "rejected": rejected, "_changed": changed})
    ok = F.col("rejected").isNull()
    to_tm = ok & F.col("_changed") & T.completed(F.col("_state"))
    clear = ok & F.col("_state").isin("done", "reviewed", "pending")
    return wide.withColumns({
        "old": F.struct(*COUNTED),
        "to_tm": to_tm,
        "target_text": F.when(ok, F.col("_text")).otherwise(F.col("target_text")),
        "error_msg": F.when(~clear, F.col("error_msg")),
        "status": F.when(ok, F.col("_state")).otherwise(F.col("status")),
    }).drop("_text", "_state", "_changed", *edits.columns)


def bulk_action(segments: DataFrame, action: str, ids: DataFrame | None = None, chapter_id: int | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Rows in scope with ``updated``: mark_reviewed touches completed rows with a text, set_pending and retranslate
    clear the work of all rows. ``old`` is what a row counted as."""
    out = segments.withColumn("old", F.struct(*COUNTED))
    if ids is not None:
        out = out.join(ids.select("id"), "id", "left_semi")
    if chapter_id is not None:
        out = out.where(F.col("chapter_id") == chapter_id)
    if statuses is not None:
        out = out.where(F.col("status").isin(statuses))
    if action == "mark_reviewed":
        hit = T.completed(F.col("status")) & ~T.is_blank(F.col("target_text"))
        return out.withColumn("updated", hit).withColumns({"error_msg": F.when(~F.col("updated"), F.col("error_msg")), "status": F.when(F.col("updated"), "reviewed").otherwise(F.col("status"))})
    if action not in ("set_pending", "retranslate"):
        raise ValueError(f"no action {action}")
    none = {c: F.lit(None).cast(segments.schema[c].dataType) for c in CLEARED}
    return out.withColumns(none | {"status": F.lit("pending"), "updated": F.lit(True)})


def apply_results(segments: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses (segment_id, text, in_tokens, out_tokens, model, error, replacements, n_slots) merged: ``outcome`` is
    skipped for rows that no longer wait, error for failed, blank or damaged ones, else done."""
    wide = segments.join(responses, segments["id"] == responses["segment_id"])
    fixed = restore_markers(F.col("text"), F.col("replacements"), F.col("n_slots"))
    wide = wide.withColumn("_r", fixed)
    bad = F.col("error").isNotNull() | T.is_blank(F.col("text")) | F.col("_r.error").isNotNull()
    outcome = F.when(F.col("status") != "processing", "skipped").when(bad, "error").otherwise("done")
    wide = wide.withColumn("outcome", outcome)
    done, failed = F.col("outcome") == "done", F.col("outcome") == "error"
    return wide.withColumns({
        "old": F.struct(*COUNTED),
        "target_text": F.when(done, F.col("_r.text")).otherwise(F.col("target_text")),
        "error_msg": F.when(failed, PROVIDER_ERROR).when(~done, F.col("error_msg")),
        "token_in": F.when(done, F.col("in_tokens")).otherwise(F.col("token_in")),
        "token_out": F.when(done, F.col("out_tokens")).otherwise(F.col("token_out")),
        "provider": F.when(done, F.col("model")).otherwise(F.col("provider")),
        "status": F.when(F.col("outcome") == "skipped", F.col("status")).otherwise(F.col("outcome")),
    }).drop("_r", *responses.columns)


def purge_project(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of projects that stay."""
    return table.join(gone.select("project_id").distinct(), "project_id", "left_anti")


def purge_projects(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All ``tables`` that hang on projects without the rows of those that go, and (name, removed) of each. A table of
    projects has their key as id; the translation memory is shared and isn't given here."""
    ids = gone.select("project_id").distinct()
    left, counts = {}, []
    for name, table in tables.items():
        key = "project_id" if "project_id" in table.columns else "id"
        named = ids.withColumnRenamed("project_id", key)
        left[name] = table.join(named, key, "left_anti")
        counts.append(table.join(named, key, "left_semi").agg(F.lit(name).alias("name"), F.count("*").alias("removed")))
    return left, reduce(DataFrame.unionByName, counts)


def project_status(projects: DataFrame, segments: DataFrame, stopped: bool = False) -> DataFrame:
    """(project_id, status): ready while the run was stopped or work is open, else done."""
    open_ = segments.groupBy("project_id").agg(F.max(F.col("status").isin("pending", "processing", "error")).alias("_open"))
    out = projects.select(F.col("id").alias("project_id")).join(open_, "project_id", "left")
    return out.select("project_id", F.when(F.lit(stopped) | F.coalesce("_open", F.lit(False)), "ready").otherwise("done").alias("status"))
