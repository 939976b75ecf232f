"""Pages of rows: filters, order, totals, and merging of pages that overlap."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import shared, written


#: Rows up to which a page is the end of a running top list; further pages look for their range of the order.
SHALLOW = 10_000
#: Blocks of at most this many rows are what an indexed search opens; there are some FOLDERS folders of them.
BLOCK, FOLDERS = 65_536, 1024
GRAM = 3
#: Characters whose grams a task sorts at once.
CHARS = 1_000_000


def page_of(rows: DataFrame, order: list[Column], page: int, size: int, shallow: int | None = None) -> DataFrame:
    """One page in order, with the total and the number of pages. The sort of an early page keeps a page's rows a task,
    and nothing runs before the result is asked for. A page beyond ``shallow`` rows is looked up by ranges."""
    if page * size > (SHALLOW if shallow is None else shallow):
        path = shared(rows.sparkSession, "ranges")
        write_ranges(rows, order, path)
        return range_page(rows.sparkSession, path, order, page, size)
    total = rows.agg(F.count("*").alias("total"))  # one row
    cut = rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))
    return cut.withColumn("pages", F.ceil(F.col("total") / size))


def write_ranges(rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> None:
    """Rows in folders by ranges of ``order``, unsorted, and how many each has. Written once, it serves every page."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    spark = rows.sparkSession
    made = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
    made.groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def range_page(spark: SparkSession, path: str, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of what ``write_ranges`` wrote: the ranges' counts say where it lies, and only the one or few ranges that
    hold it are opened and sorted. The total is the counts' sum."""
    counts = sorted((r["_range"], r["n"]) for r in spark.read.parquet(f"{path}/counts").collect())  # a row a range
    first, total = (page - 1) * size, sum(n for _, n in counts)
    before, wanted, skip = 0, [], 0
    for k, n in counts:
        if before < first + size and before + n > first:
            skip = skip if wanted else first - before
            wanted.append(k)
        before += n
    schema = spark.read.parquet(f"{path}/rows").schema
    found = spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("_range").isin(wanted))
    cut = found.orderBy(*order).offset(max(skip, 0)).limit(size).drop("_range")
    return cut.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(-(-total // size)).cast("long")})


# --- an index of letters ------------------------------------------------------------------------------------------


def write_gram_index(rows: DataFrame, path: str, columns: list[str], key: str = "id", block: int = BLOCK, buckets: int = 64) -> None:
    """``rows`` as they come, by ``key`` inside each task, in folders of ``block`` rows, or of more so that there are some
    ``FOLDERS`` of them; and beside them postings: for each three-letter gram of ``columns`` and run of ``block`` rows,
    which of them hold it. Neither texts nor single occurrences are shuffled: each batch of rows makes its own postings,
    two bytes a row or a bit for each row of the run, whichever is less. Postings are sorted by gram inside buckets of
    grams, so a search opens few of their row groups."""
    if not 0 < block <= BLOCK:
        raise ValueError(f"blocks of 1 to {BLOCK} rows")
    spark = rows.sparkSession
    most = max(block, -(-rows.count() // FOLDERS))
    place = F.monotonically_increasing_id()  # a task's number and a row's in it
    dealt = rows.sortWithinPartitions(key).withColumn("_at", place)
    task, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    dealt = dealt.withColumns({"_block": task * F.lit(1 << 20) + F.floor(row / most), "_run": F.floor(row / block).cast("int"), "_row": (row % block).cast("int")}).drop("_at")
    dealt.write.mode("overwrite").partitionBy("_block").parquet(f"{path}/rows")
    kept = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"c{k}") for k, c in enumerate(columns)]
    posted = kept.select("_block", "_run", "_row", *low).mapInArrow(_postings(block), "gram string, _block long, _run int, held binary")
    posted = posted.withColumn("_bucket", _bucket(F.col("gram"), buckets)).repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "gram", "_block", "_run")
    posted.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/postings")
    shape = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(block).alias("block"), F.array(*map(F.lit, columns)).alias("columns"))
    shape.coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def _postings(block: int):
    """For batches of (_block, _run, _row, texts): a row for each gram of a run's rows, with those rows."""

    def post(batches):
        for batch in batches:
            home = [batch.column(k).to_numpy() for k in (0, 1)]
            cuts = np.flatnonzero((np.diff(home[0]) != 0) | (np.diff(home[1]) != 0)) + 1
            row, texts = batch.column(2).to_numpy(), [c.to_pylist() for c in batch.columns[3:]]
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                while a < z:  # a part of the run with some CHARS characters, or one long row
                    b, size = a, 0
                    while b < z and (b == a or size < CHARS):
                        size, b = size + sum(len(c[b]) for c in texts), b + 1
                    grams, held = grams_of([c[a:b] for c in texts], row[a:b], block)
                    if grams:
                        n = len(grams)
                        yield pa.record_batch([pa.array(grams, pa.string()), pa.array(np.full(n, home[0][a])), pa.array(np.full(n, home[1][a], np.int32)), pa.array(held, pa.binary())], names=["gram", "_block", "_run", "held"])
                    a = b

    return post


def grams_of(texts: list[list[str]], row: np.ndarray, block: int) -> tuple[list[str], list[bytes]]:
    """The different grams of columns of texts, and the rows that hold each in any column."""
    flat = [t for column in texts for t in column]
    code = np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.tile(row.astype(np.int64), len(texts)), [len(t) for t in flat])
    text = np.repeat(np.arange(len(flat)), [len(t) for t in flat])
    if len(code) < GRAM:
        return [], []
    signs, small = np.unique(code, return_inverse=True)
    small, within = small.astype(np.int64), text[: 1 - GRAM] == text[GRAM - 1 :]
    gram = small[: 1 - GRAM]
    for k in range(1, GRAM):
        gram = gram * len(signs) + small[k : len(small) - GRAM + 1 + k]
    if len(signs) ** GRAM * block < 1 << 62:
        both = np.unique(gram[within] * block + of[: 1 - GRAM][within])
        found, where = both // block, both % block
    else:
        both = np.unique(np.stack([gram[within], of[: 1 - GRAM][within]]), axis=1)
        found, where = both
    if not len(found):
        return [], []
    starts = np.flatnonzero(np.r_[True, np.diff(found) != 0])
    ends, kinds, letters = np.r_[starts[1:], len(found)], found[starts], []
    for _ in range(GRAM):
        letters.append(signs[kinds % len(signs)])
        kinds = kinds // len(signs)
    spelt = np.stack(letters[::-1], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    short = where.astype("<u2").tobytes()
    wide = -(-block // 8)

    def bits(a: int, z: int) -> bytes:
        out = np.zeros(wide * 8, bool)
        out[where[a:z]] = True
        return np.packbits(out, bitorder="little").tobytes()

    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    return [spelt[k : k + GRAM] for k in range(0, len(spelt), GRAM)], [short[2 * a : 2 * z] if 2 * (z - a) < wide else bits(a, z) for a, z in spans]


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _meet(block: int):
    """Whether some row of a run is in the postings of all ``n`` grams: postings are (gram, held), several of a gram where a
    run was cut."""
    wide = -(-block // 8)

    def meet(postings: pd.Series, n: pd.Series) -> pd.Series:
        def some(found, n: int) -> bool:
            rows: dict[str, np.ndarray] = {}
            for p in found:
                own = rows.setdefault(p["gram"], np.zeros(wide * 8, bool))
                held = p["held"]
                if len(held) == wide:
                    own |= np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little").astype(bool)
                else:
                    own[np.frombuffer(held, "<u2")] = True
            return len(rows) == n and bool(np.logical_and.reduce(list(rows.values())).any())

        return pd.Series([some(p, k) for p, k in zip(postings, n, strict=True)])

    return F.pandas_udf(meet, "boolean")


def gram_candidates(spark: SparkSession, path: str, low: list[str], buckets: int, block: int) -> DataFrame:
    """(_block, _run) with a row that holds every gram of ``low``: what is still to be verified."""
    places = spark.createDataFrame([(g,) for g in low], "gram string").select("gram", _bucket(F.col("gram"), buckets).alias("b"))
    opened = sorted({r["b"] for r in places.collect()})  # as many as the needle has letters, at the most
    posted = spark.read.parquet(f"{path}/postings").where(F.col("_bucket").isin(opened) & F.col("gram").isin(low))
    # runs that lack a gram drop out before any posting is opened
    whole = posted.groupBy("_block", "_run").agg(F.collect_list(F.struct("gram", "held")).alias("found"), F.size(F.collect_set("gram")).alias("n")).where(F.col("n") == len(low))
    return whole.where(_meet(block)(F.col("found"), F.col("n"))).select("_block", "_run")


def indexed_search(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """The rows that hold ``needle`` in any of the indexed columns, in any case of letters, as a scan finds them. Rows
    come from the runs that have candidates alone, and are verified. A needle of fewer than three letters has no
    gram: it scans."""
    shape = spark.read.parquet(f"{path}/shape").first()
    rows = spark.read.parquet(f"{path}/rows")
    hit = F.lit(False)
    for c in shape["columns"]:
        hit = hit | F.coalesce(T.contains_folded(F.col(c), needle), F.lit(False))
    folded = spark.range(1).select(F.lower(F.lit(needle)).alias("t")).first()["t"]
    low = sorted({folded[k : k + GRAM] for k in range(len(folded) - GRAM + 1)})
    if low:
        found = written(gram_candidates(spark, path, low, shape["buckets"], shape["block"]), "candidates")
        blocks = [r["_block"] for r in found.select("_block").distinct().collect()]  # a number for each folder
        rows = rows.where(F.col("_block").isin(blocks)).join(found, ["_block", "_run"], "left_semi")
    return rows.where(hit).drop("_block", "_run", "_row")


def segment_page(segments: DataFrame, project_id: int | None = None, chapter_id: int | None = None, statuses: list[str] | None = None, search: str = "", page: int = 1, size: int = 50, index: str | None = None) -> DataFrame:
    """A page of segments by ord; with ``index``, written by ``write_gram_index``, a search reads what it finds there."""
    out = indexed_search(segments.sparkSession, index, search) if search and index else segments
    if project_id is not None:
        out = out.where(F.col("project_id") == project_id)
    if chapter_id is not None:
        out = out.where(F.col("chapter_id") == chapter_id)
    if statuses is not None:
        out = out.where(F.col("status").isin(statuses))
    if search and not index:
        out = out.where(T.contains_folded(F.col("source_text"), search) | F.coalesce(T.contains_folded(F.col("target_text"), search), F.lit(False)))
    return page_of(out, [F.col("ord"), F.col("id")], page, size)


def project_page(projects: DataFrame, progress: DataFrame, search: str = "", sort: str = "updated", page: int = 1, size: int = 20) -> DataFrame:
    out = projects.join(progress.select(F.col("project_id").alias("id"), "total", "completed", "percent").withColumnRenamed("total", "segments"), "id", "left")
    if search:
        out = out.where(T.contains_folded(F.concat_ws(" ", "title", "model"), search))
    order = {"updated": [F.desc("updated_at"), F.desc("id")], "title": [F.col("title"), F.col("id")], "progress": [F.desc("percent"), F.desc("id")]}[sort]
    return page_of(out, order, page, size)


def log_page(logs: DataFrame, project_id: int, level: str | None = None, event_type: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    out = logs.where(F.col("project_id") == project_id)
    if level is not None:
        out = out.where(F.col("level") == level)
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    return page_of(out, [F.desc("id")], page, size)


def merge_log_pages(pages: list[DataFrame], newest_wins: bool = True) -> DataFrame:
    """All pages' rows, one for each id: of the last page that has it, or of the first one."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_page", F.lit(k)) for k, p in enumerate(pages)])
    order = Window.partitionBy("id").orderBy(F.desc("_page") if newest_wins else F.col("_page"))
    return every.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_page").orderBy(F.desc("id"))
