"""Logs: ingest, retention and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEVELS = ("debug", "info", "warning", "error")


def ingest_logs(raw: DataFrame) -> DataFrame:
    """Known levels, event types of 64 and messages of 1000 characters; works on batches and on streams."""
    short = lambda c, n, other: F.coalesce(F.nullif(F.substring(T.strip(F.col(c)), 1, n), F.lit("")), F.lit(other))
    return raw.withColumns({
        "level": F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise("info"),
        "event_type": short("event_type", 64, "runtime.event"),
        "message": short("message", 1000, "Runtime event"),
    })


def trim_logs(logs: DataFrame, cutoff: str, most: int = 2000) -> DataFrame:
    """Rows not older than ``cutoff``, the newest ``most`` of each project; Spark keeps no more than those a task."""
    order = Window.partitionBy("project_id").orderBy(F.desc("id"))
    return logs.where(F.col("created_at") >= cutoff).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def clear_logs(logs: DataFrame, projects: DataFrame) -> DataFrame:
    return logs.join(projects.select("project_id").distinct(), "project_id", "left_anti")


def retain_audit(events: DataFrame, cutoff: str | None) -> DataFrame:
    """(kept, removed) of rows by their age; no cutoff keeps all."""
    old = F.lit(False) if cutoff is None else F.col("created_at") < cutoff
    return events.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("removed"))


def event_history(events: DataFrame, cursor: int | None, most: int = 500) -> DataFrame:
    """The last ``most`` events of each project with ids beyond the cursor; nothing without one."""
    order = Window.partitionBy("project_id").orderBy(F.desc("id"))
    last = events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return last.where(F.lit(False) if cursor is None else F.col("id") > cursor)
