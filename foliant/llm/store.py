"""Tables that cut lineage: written once to the folder that every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder of our own only in local mode, where that is unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("foliant.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("foliant.scratch.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back. It is computed once, later reads can
    prune its columns, and a lost executor costs nothing that was written."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(table: DataFrame, name: str) -> None:
    """Deletes a table that ``written`` made under ``name``, when nothing will read it again."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if f"/{name}-" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free(columns: list[str], *names: str) -> list[str]:
    """Each name with underscores added until no column has it, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle has in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, most: int = 4) -> None:
    """Arrow batches of at most ``most`` MB from here on, where the session allows larger ones: rows that carry whole texts or
    sets fill 64 MB else, which a task holds several times over, in the JVM and in its Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    size = int(re.sub(r"\D", "", now)) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(re.sub(r"[\d\sb]", "", now.lower())[:1], 1)
    if size <= 0 or size > most << 20:
        spark.conf.set(key, f"{most}m")


#: A key is hot when it holds more than 1/HOT of all rows, and LEAST rows at the least.
HOT, LEAST = 10_000, 1000


def attach(rows: DataFrame, keyed: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has a row a key and, as ``n``, how many of ``rows`` the key has. Hot
    keys, fewer than HOT whatever the corpus, are broadcast and their rows stay where they are; only the others are
    shuffled, so no task gets the rows of a hub, a giant class or the empty text."""
    total, most = keyed.agg(F.sum(n), F.max(n)).first()
    bar = max((total or 0) // HOT, LEAST)
    plain = keyed.drop(n)
    if (most or 0) <= bar:
        return rows.join(plain, list(keys))
    hot, cold = keyed.where(F.col(n) > bar).drop(n), keyed.where(F.col(n) <= bar).drop(n)
    names = hot.select(*keys)
    return rows.join(F.broadcast(hot), list(keys)).unionByName(rows.join(F.broadcast(names), list(keys), "left_anti").join(cold, list(keys)))
