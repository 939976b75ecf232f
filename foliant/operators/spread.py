"""Joins in which one key may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
#: A key is hot when it holds more than 1/HOT of all rows, and LEAST rows at the least.
HOT, LEAST = 2000, 1000


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, by: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has a row a key and few of them, such as projects. Where Spark
    shuffles, each key is spread over ``salts`` tasks by a hash of ``by``; ``keyed`` is copied as often."""
    many = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(many, [key, "_salt"], how).drop("_salt")


def hot_join(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str = "n", how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has a row a key and, as ``n``, how many of ``rows`` the key has. Keys
    that hold more than 1/HOT of all rows, fewer than HOT of them whatever the input, are broadcast and their rows stay
    where they are; only the others are shuffled."""
    total, most = keyed.agg(F.sum(n), F.max(n)).first()
    bar = max((total or 0) // HOT, LEAST)
    plain = keyed.drop(n)
    if (most or 0) <= bar:
        return rows.join(plain, keys, how)
    hot, cold = keyed.where(F.col(n) > bar).drop(n), keyed.where(F.col(n) <= bar).drop(n)
    here = rows.join(F.broadcast(hot), keys)
    return here.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))
