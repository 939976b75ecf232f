"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path where the driver and all executors see it; a temporary one in local mode alone."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="foliant-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it has ended: they stay else until the driver happens to collect its
    garbage, and a job of several tables keeps those of all."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: computed once, and safe from lost executors. Its shuffles go when it is there."""
    path = shared(df.sparkSession, name)
    with passing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(table: DataFrame) -> str:
    """The folder of a table that ``written`` made."""
    return next(d for f in table.inputFiles() if re.search(r"-[0-9a-f]{32}$", d := f.rsplit("/", 1)[0]))


def remove(table: DataFrame) -> None:
    """Deletes a table that ``written`` made, when nothing will read it again."""
    spark = table.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(place(table))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, most: int = 4) -> None:
    """Arrow batches of at most ``most`` MB from here on, where the session allows larger ones: what Python makes of whole
    documents takes many times their size, and 10,000 documents are a batch else."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    size = int(re.sub(r"\D", "", now)) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(re.sub(r"[\d\sb]", "", now.lower())[:1], 1)
    if size <= 0 or size > most << 20:
        spark.conf.set(key, f"{most}m")
