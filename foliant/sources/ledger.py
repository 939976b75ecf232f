"""The stored ledger: a bucketed, sorted table in which projects are replaced and merged without touching the others."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import ledger_merge
from .scratch import passing_shuffles, place, remove, written

GROUP = "project_group"
GROUPS, BUCKETS = 64, 64
#: Bytes of Parquet that a bucket holds at the most when a ledger is made.
LARGEST = 32 << 20
#: Projects of one import that are broadcast at the most: 8 MB of numbers.
FEW = 1_000_000


def group_of(project_id: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(project_id), F.lit(groups)).cast("int")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _size(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def open_ledger(spark: SparkSession, path: str, schema: T.StructType | None = None, groups: int = GROUPS, buckets: int = BUCKETS) -> tuple[str, int, int]:
    """(table, groups, buckets) of the ledger at ``path``; with ``schema`` one is made where none is. Rows lie in folders by
    groups of projects, and in each by buckets of (project_id, stable_key), sorted: joins on that key find them in
    place, and a project that holds most rows is spread over all buckets. Its shape is kept beside it, so that any
    session can open it."""
    name = f"ledger_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    if not _there(spark, f"{path}/spec"):
        if schema is None:
            raise FileNotFoundError(f"no ledger at {path}")
        kept = json.dumps({"schema": schema.json(), "groups": groups, "buckets": buckets})
        spark.createDataFrame([(kept,)], "value string").coalesce(1).write.text(f"{path}/spec")
    shape = json.loads(spark.read.text(f"{path}/spec", wholetext=True).first()["value"])
    if not spark.catalog.tableExists(name):  # the table is a name for the files: making it writes and removes nothing
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(shape["schema"])))
        key = "project_id, stable_key"
        spark.sql(f"CREATE TABLE {name} ({fields}, {GROUP} INT) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY ({GROUP}) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {shape['buckets']} BUCKETS LOCATION '{path}/rows'")
        if _there(spark, f"{path}/rows"):
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name, shape["groups"], shape["buckets"]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(open_ledger(spark, path)[0]).drop(GROUP)


def _projects(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """The projects of ``rows``, written, and their groups, which are GROUPS at the most. Up to ``FEW`` are for broadcast: the
    stored rows that meet them stay in their buckets."""
    found = written(rows.select("project_id", GROUP).distinct(), "projects")
    touched = sorted(r[GROUP] for r in found.select(GROUP).distinct().collect())
    return F.broadcast(found.select("project_id")) if found.count() <= FEW else found.select("project_id"), touched


def _replace(spark: SparkSession, ledger: tuple[str, int, int], projects: DataFrame, touched: list[int], rows: DataFrame) -> None:
    """``projects``, all in the groups ``touched``, hold ``rows`` from now on, which were written elsewhere before and go to
    their buckets. The others' rows are read in their buckets from the very folders that are filled anew and don't move
    between tasks. Spark fills new folders and puts them in place when all tasks are done, so a write that fails leaves
    what was there."""
    name, _, buckets = ledger
    columns = spark.table(name).columns
    others = spark.table(name).where(F.col(GROUP).isin(touched)).join(projects, "project_id", "left_anti").select(*columns)
    if projects.count() > FEW:  # too many for broadcast, so the rows that they met have left their buckets
        others = others.repartition(buckets, "project_id", "stable_key")
    both = others.unionByName(rows.select(*columns).repartition(buckets, "project_id", "stable_key"))
    # folders that get rows are replaced, no others; a task reads a bucket's files together, so they don't get more
    conf = {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        with passing_shuffles(spark):
            both.write.mode("overwrite").insertInto(name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    spark.catalog.refreshTable(name)


def write_ledger(rows: DataFrame, path: str, groups: int = GROUPS, buckets: int = BUCKETS) -> None:
    """The projects in ``rows`` hold ``rows`` from now on, all other projects what they held. The first ``rows`` make the
    ledger: with ``buckets``, or as many more as keep each of them, which is a task's share, within ``LARGEST``."""
    spark = rows.sparkSession
    made = written(rows, "incoming")
    ledger = open_ledger(spark, path, rows.schema, groups, max(buckets, -(-_size(spark, place(made)) // LARGEST)))
    new = made.withColumn(GROUP, group_of(F.col("project_id"), ledger[1]))
    projects, touched = _projects(new)
    _replace(spark, ledger, projects, touched, new)
    remove(made)
    remove(projects)


def stored_side(spark: SparkSession, path: str, projects: DataFrame, touched: list[int]) -> DataFrame:
    """Stored rows of ``projects`` as they lie in their buckets; other groups are not read."""
    return spark.table(open_ledger(spark, path)[0]).where(F.col(GROUP).isin(touched)).join(projects, "project_id", "left_semi")


def merge_ledger(spark: SparkSession, path: str, drafts: DataFrame, now: str) -> DataFrame:
    """``ledger_merge`` of ``drafts`` (whole projects) into the stored ledger. Only the drafts move to the stored rows'
    buckets. Gives the merged rows with their actions."""
    ledger = open_ledger(spark, path)
    new = written(drafts.withColumn(GROUP, group_of(F.col("project_id"), ledger[1])), "incoming")
    projects, touched = _projects(new)
    merged = written(ledger_merge(stored_side(spark, path, projects, touched), new.drop(GROUP), now), "merged")
    remove(new)
    columns = [c for c in spark.table(ledger[0]).columns if c != GROUP]
    extra = [F.lit(None).cast(spark.table(ledger[0]).schema[c].dataType).alias(c) for c in columns if c not in merged.columns]
    ours = merged.where("action <> 'delete'").select("*", *extra).select(*columns).withColumn(GROUP, group_of(F.col("project_id"), ledger[1]))
    _replace(spark, ledger, projects, touched, ours)
    remove(projects)
    return merged
