"""A ledger derived from the given tables by formula, in Spark and in SQL, for queries and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tm as M
from ..sources.scratch import written

NOW = "2026-06-01T00:00:00.000Z"
STATES = ["pending", "processing", "done", "done", "error", "reviewed", "done"]
LANGS = ["en", "fr", "de", "es"]
MODELS = ["gpt-5-mini", "x/gpt-4o-2026", "deepseek-v4-pro", "unknown-model", ""]


class Base:
    """Derived tables of one scale; each is built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Lines with a word, with their place among all lines and among those."""
        docs = self.table("documents").where("text is not null")
        every = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("body")))
        seen = F.filter(every, lambda x: ~T.is_blank(x["body"]))
        rows = docs.select("doc_id", F.substring("source", 4, 10).cast("long").alias("project_id"), F.posexplode(seen).alias("rank", "x"))
        return rows.select("doc_id", "project_id", "x.line", "x.body", "rank")

    def segments(self) -> DataFrame:
        """A chapter is a document here, so a line's place in its project is its place in the document after the lines of
        the documents before it: only counts are shuffled."""
        over = Window.partitionBy("project_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
        sizes = self.lines().groupBy("doc_id", "project_id").agg(F.count("*").alias("n"))
        base = sizes.select("doc_id", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
        s = self.lines().join(base, "doc_id").withColumn("ord", F.col("base") + F.col("rank").cast("long")).drop("base", "rank")
        pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("ord") % n + 1).cast("int"))
        mark = F.when(F.col("ord") % 11 == 0, " {name}").when(F.col("ord") % 11 == 1, " %s").when(F.col("ord") % 11 == 2, " <b>").otherwise("")
        s = s.withColumns({"source_text": F.concat("body", mark), "status": pick(STATES, 7)})
        k, src = F.col("ord") % 5, F.col("source_text")
        target = F.when(k == 0, F.upper(src)).when(k == 1, F.concat(F.lit("ZH "), src)).when(k == 2, F.substring(src, 1, 12)).when(k == 3, src).otherwise("")
        done = T.completed(F.col("status"))
        return s.select(
            (F.col("doc_id") * 100000 + F.col("line")).alias("id"), "project_id", F.col("doc_id").alias("chapter_id"), "ord",
            F.format_string("%04d:%05d", F.col("doc_id"), F.col("line")).alias("stable_key"),
            "source_text", F.when(done, target).alias("target_text"), T.source_hash(src).alias("src_hash"), "status",
            F.when(F.col("status") == "error", "boom").alias("error_msg"),
            F.when(done, F.length(src).cast("long")).alias("token_in"), F.when(done, F.length(target).cast("long")).alias("token_out"),
            F.when(done & (F.col("ord") % 3 == 0), "m").alias("provider"),
            F.format_string("2026-05-%02dT00:00:00.000Z", F.col("ord") % 28 + 1).alias("updated_at"),
        )

    def projects(self) -> DataFrame:
        p = self.table("documents").select(F.substring("source", 4, 10).cast("long").alias("id")).distinct()
        at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("id") % len(xs) + 1).cast("int"))
        return p.select(
            "id", F.format_string("Book %02d: A/B", F.col("id")).alias("title"), at(LANGS).alias("source_lang"), F.lit("zh-CN").alias("target_lang"),
            F.when(F.col("id") % 5 == 0, "epub").otherwise("md").alias("source_type"), at(["ready", "translating", "done", "parsing", "error"]).alias("status"),
            at(MODELS).alias("model"), (F.col("id") % 2 == 0).alias("summaries"),
            F.when(F.col("id") % 4 == 1, 1.5).alias("input_price"), F.when(F.col("id") % 8 == 1, 2.5).alias("output_price"),
            F.when(F.col("id") % 3 > 0, F.col("id") % 6).alias("model_profile_id"), F.when(F.col("id") % 4 > 0, F.col("id") % 7).alias("prompt_template_id"),
            (F.col("id") % 12).cast("int").alias("max_concurrency"),
            F.format_string("2026-05-%02dT00:00:00.000Z", F.col("id") % 9 + 1).alias("updated_at"),
            F.concat(F.lit("/books/"), (F.col("id") % 8).cast("string")).alias("source_path"), F.concat(F.lit("fp"), F.col("id").cast("string")).alias("fingerprint"),
        )

    def chapters(self) -> DataFrame:
        order = Window.partitionBy("project_id").orderBy("doc_id")
        d = self.table("documents").where("text is not null").select("doc_id", F.substring("source", 4, 10).cast("long").alias("project_id"), F.substring("text", 1, 20).alias("title"))
        summary = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.concat(F.lit("S"), F.col("doc_id").cast("string")))
        return d.select(F.col("doc_id").alias("id"), "project_id", (F.row_number().over(order).cast("long") - 1).alias("ord"), "title", F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("href"), summary.alias("summary"))

    def glossary(self) -> DataFrame:
        b = self.table("benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where(F.length("word") >= 2)
        g = b.select((F.col("item_id") * 1000 + F.col("pos")).cast("long").alias("id"), (F.col("item_id") % 20).cast("long").alias("project_id"), F.col("word").alias("source_term"))
        g = g.groupBy("project_id", "source_term").agg(F.min("id").alias("id"))
        return g.select("id", "project_id", "source_term", F.upper("source_term").alias("target_term"), F.when(F.col("id") % 5 == 0, "note").alias("note"), (F.col("id") % 3 == 0).alias("case_sensitive"), (F.col("id") % 4 != 0).alias("enabled"))

    def languages(self) -> DataFrame:
        """Segments with their languages, written once: queries on the memory read them several times."""
        if "languages" not in self.kept:
            self.kept["languages"] = written(M.with_languages(self.segments(), self.projects()), "ledger")
        return self.kept["languages"]

    def memory(self) -> DataFrame:
        """Texts whose hash begins with an even digit."""
        s = self.languages().where(F.substring("src_hash", 1, 1).isin(*"02468ace"))
        g = s.groupBy(*M.KEYS).agg(F.min("source_text").alias("source_text"))
        return g.select(*M.KEYS, "source_text", F.concat(F.lit("TM:"), F.col("source_text")).alias("target_text"), (F.length("source_text") % 5).cast("long").alias("hit_count"), F.lit("2026-01-01T00:00:00.000Z").alias("updated_at"))

    def logs(self) -> DataFrame:
        e = self.table("events")
        kind = F.element_at(F.array(*map(F.lit, ["info", "error", "LOUD", "warning", "debug"])), (F.col("event_id") % 5 + 1).cast("int"))
        return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).cast("long").alias("project_id"), kind.alias("level"), F.concat(F.lit("  "), F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 > 0, F.col("props")).otherwise("  ").alias("message"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))

    def events(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, ["segment_delta", "segment_delta", "segment_done", "segment_error", "segment_reset", "segment_updated"])), (F.col("event_id") % 6 + 1).cast("int"))
        return self.table("events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 20).cast("long").alias("project_id"), F.col("user_id").cast("long").alias("segment_id"), kind.alias("type"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("delta"), F.when(F.col("event_id") % 6 == 5, F.concat(F.lit("T"), F.col("event_id").cast("string"))).alias("target_text"), F.when(F.col("event_id") % 6 == 2, "done").when(F.col("event_id") % 6 == 5, "reviewed").alias("status"))


def _at(xs: list[str], key: str) -> str:
    return f"(CASE {key} % {len(xs)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(xs)) + " END)"


#: White space as Python and the Spark side know it, spelled out for RE2.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS = WS.replace("[", "[^", 1)


def normal_sql(c: str) -> str:
    plain = f"translate(nfc_normalize({c}), chr(8216)||chr(8217)||chr(8220)||chr(8221)||chr(8211)||chr(8212)||chr(160), '''''\"\"-- ')"
    return f"trim(regexp_replace({plain}, '{WS}+', ' ', 'g'))"


TABLES = {
    "line": f"""line AS (SELECT doc_id, project_id, i AS line, parts[i + 1] AS body FROM (SELECT doc_id, project_id, parts, unnest(range(len(parts))) AS i
  FROM (SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS project_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
  WHERE regexp_matches(parts[i + 1], '{NON_WS}'))""",
    "segment": f"""segment AS (SELECT doc_id * 100000 + line AS id, project_id, doc_id AS chapter_id, ord, printf('%04d:%05d', doc_id, line) AS stable_key, source_text,
  CASE WHEN status IN ('done', 'reviewed') THEN target END AS target_text, sha1({normal_sql("source_text")}) AS src_hash, status,
  CASE WHEN status = 'error' THEN 'boom' END AS error_msg, CASE WHEN status IN ('done', 'reviewed') THEN length(source_text) END AS token_in,
  CASE WHEN status IN ('done', 'reviewed') THEN length(target) END AS token_out, CASE WHEN status IN ('done', 'reviewed') AND ord % 3 = 0 THEN 'm' END AS provider,
  printf('2026-05-%02dT00:00:00.000Z', ord % 28 + 1) AS updated_at
  FROM (SELECT *, CASE ord % 5 WHEN 0 THEN replace(upper(source_text), chr(7838), 'SS') WHEN 1 THEN 'ZH ' || source_text WHEN 2 THEN substr(source_text, 1, 12) WHEN 3 THEN source_text ELSE '' END AS target
  FROM (SELECT *, body || CASE ord % 11 WHEN 0 THEN ' {{name}}' WHEN 1 THEN ' %s' WHEN 2 THEN ' <b>' ELSE '' END AS source_text, {_at(STATES, "ord")} AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY doc_id, line) - 1 AS ord FROM line))))""",
    "project": f"""project AS (SELECT id, printf('Book %02d: A/B', id) AS title, {_at(LANGS, "id")} AS source_lang, 'zh-CN' AS target_lang, CASE WHEN id % 5 = 0 THEN 'epub' ELSE 'md' END AS source_type,
  {_at(["ready", "translating", "done", "parsing", "error"], "id")} AS status, {_at(MODELS, "id")} AS model, id % 2 = 0 AS summaries,
  CASE WHEN id % 4 = 1 THEN CAST(1.5 AS DOUBLE) END AS input_price, CASE WHEN id % 8 = 1 THEN CAST(2.5 AS DOUBLE) END AS output_price,
  CASE WHEN id % 3 > 0 THEN id % 6 END AS model_profile_id, CASE WHEN id % 4 > 0 THEN id % 7 END AS prompt_template_id, id % 12 AS max_concurrency,
  printf('2026-05-%02dT00:00:00.000Z', id % 9 + 1) AS updated_at, '/books/' || (id % 8) AS source_path, 'fp' || id AS fingerprint
  FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id FROM documents))""",
    "chapter": """chapter AS (SELECT doc_id AS id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY doc_id) - 1 AS ord, title, 'c' || doc_id || '.xhtml' AS href,
  CASE doc_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'S' || doc_id END AS summary
  FROM (SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS project_id, substr(text, 1, 20) AS title FROM documents WHERE text IS NOT NULL))""",
    "glossary": """glossary AS (SELECT id, project_id, source_term, replace(upper(source_term), chr(7838), 'SS') AS target_term, CASE WHEN id % 5 = 0 THEN 'note' END AS note, id % 3 = 0 AS case_sensitive, id % 4 <> 0 AS enabled
  FROM (SELECT project_id, source_term, min(id) AS id FROM (SELECT item_id * 1000 + i AS id, item_id % 20 AS project_id, parts[i + 1] AS source_term
  FROM (SELECT item_id, parts, unnest(range(len(parts))) AS i FROM (SELECT item_id, string_split(text, ' ') AS parts FROM benchmark)) WHERE length(parts[i + 1]) >= 2) GROUP BY ALL))""",
    "lang": "lang AS (SELECT s.*, p.source_lang, p.target_lang FROM segment s JOIN project p ON s.project_id = p.id)",
    "tm": """tm AS (SELECT src_hash, source_lang, target_lang, source_text, 'TM:' || source_text AS target_text, length(source_text) % 5 AS hit_count, '2026-01-01T00:00:00.000Z' AS updated_at
  FROM (SELECT src_hash, source_lang, target_lang, min(source_text) AS source_text FROM lang WHERE substr(src_hash, 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') GROUP BY ALL))""",
    "log": f"""log AS (SELECT event_id AS id, user_id % 20 AS project_id, {_at(["info", "error", "LOUD", "warning", "debug"], "event_id")} AS level, '  ' || event_type AS event_type,
  CASE WHEN event_id % 7 > 0 THEN props ELSE '  ' END AS message, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events)""",
}
NEEDS = {"segment": ["line"], "lang": ["segment", "project"], "tm": ["lang"]}


def with_tables(names: str, body: str) -> str:
    """``body`` behind the derived tables that it uses."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(TABLES[n] for n in order) + "\n" + body
