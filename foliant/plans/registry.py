"""A query for each operator. Each gives (tables, SQL) beside it where DuckDB can check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.helpers import mask_markdown, mask_plain, mask_slots, restore_markers, split_text
from ..operators import context as C
from ..operators import glossary as G
from ..operators import ledger as L
from ..operators import logs as LG
from ..operators import progress as P
from ..operators import qa as Q
from ..operators import render as R
from ..operators import search as S
from ..operators import segmenting as SG
from ..operators import tm as M
from ..sources import blocks as B
from ..sources import books as K
from ..sources import documents as D
from ..sources import ledger as LD
from ..streaming import events as ST
from ..sources.scratch import remove, shared, written
from .base import NON_WS, NOW, WS, Base, normal_sql, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(tables: str = "", sql: str = ""):
    def add(f):
        name = f.__name__.removesuffix("_query")
        QUERIES[name] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if sql:
            SQL[name] = with_tables(tables, sql) if tables else sql
        return f

    return add




def blank(c: str) -> str:
    return f"coalesce(NOT regexp_matches({c}, '{NON_WS}'), true)"


DONE = "status IN ('done', 'reviewed')"

# --- text ---------------------------------------------------------------------------------------------------------


@query("segment", f"SELECT id, {normal_sql('source_text')} AS normal FROM segment")
def normalize_text(b):
    return b.segments().select("id", T.normalize_text(F.col("source_text")).alias("normal"))


@query("", f"SELECT doc_id, sha1({normal_sql('text')}) AS hash FROM documents")
def source_hash(b):
    return b.table("documents").select("doc_id", T.source_hash(F.col("text")).alias("hash"))


@query("segment project", """SELECT s.id, printf('%04d:%05d:', c.ord, s.ord) || substr(sha1(CASE WHEN p.source_type = 'md' THEN '{"source_type":"md","token_index":' || s.ord || '}'
  ELSE '{"file":"c' || s.chapter_id || '.xhtml","source_type":"epub","xpath":"/p[' || s.ord || ']"}' END), 1, 8) || CASE WHEN s.ord % 4 = 0 THEN '#' || (s.ord % 3) ELSE '' END AS stable_key
  FROM segment s JOIN project p ON s.project_id = p.id JOIN (SELECT doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord FROM documents WHERE text IS NOT NULL) c ON c.id = s.chapter_id""")
def stable_key(b):
    s = b.segments().drop("stable_key").join(b.projects().select(F.col("id").alias("project_id"), "source_type"), "project_id").join(b.chapters().select(F.col("id").alias("chapter_id"), F.col("ord").alias("chapter_ord"), "href"), "chapter_id")
    md = F.struct(F.lit("md").alias("source_type"), F.col("ord").alias("token_index"))
    epub = F.struct(F.col("href").alias("file"), F.lit("epub").alias("source_type"), F.concat(F.lit("/p["), F.col("ord").cast("string"), F.lit("]")).alias("xpath"))
    of = lambda path: T.stable_key(F.col("chapter_ord"), F.col("ord"), path, F.col("ord") % 3, F.when(F.col("ord") % 4 == 0, 2).otherwise(1))
    return s.select("id", F.when(F.col("source_type") == "md", of(md)).otherwise(of(epub)).alias("stable_key"))


@query("segment", """SELECT id, printf('%04d:%05d:', chapter_id, ord) || substr(sha1(CASE ord % 3 WHEN 0 THEN '{"source_type":"md","token_index":' || ord || '}' WHEN 1 THEN '{"file":"f","source_type":"epub","xpath":"/p"}'
  ELSE '{"file":"f","page":{"a":null,"b":' || ord || '},"source_type":"pdf","token_index":' || ord || ',"xpath":"/p"}' END), 1, 8) AS stable_key FROM segment""")
def stable_path(b):
    """Keys of whole paths of three kinds of sources."""
    s = b.segments().drop("stable_key")
    kind = F.element_at(F.array(*map(F.lit, ["md", "epub", "pdf"])), (F.col("ord") % 3 + 1).cast("int"))
    path = F.struct(F.lit("/p").alias("xpath"), F.col("source_text").alias("raw_block"), kind.alias("source_type"), F.struct(F.col("ord").alias("b"), F.lit(None).cast("string").alias("a")).alias("page"), F.col("ord").alias("token_index"), F.lit("f").alias("file"), F.col("ord").alias("char_start"))
    s = s.withColumn("path", path)
    return s.select("id", T.stable_key(F.col("chapter_id"), F.col("ord"), F.col("path"), F.lit(0), F.lit(1), s.schema["path"].dataType).alias("stable_key"))


CJK, OTHER = "[^\\x{3400}-\\x{9fff}]", "[\\x{3400}-\\x{9fff}]"
TOKENS = f"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(regexp_replace(text, '{CJK}', '', 'g')) + CAST(ceil(length(regexp_replace(text, '{OTHER}', '', 'g')) / 4.0) AS BIGINT)) END"


@query("", f"SELECT doc_id, CAST({TOKENS} AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def estimate_tokens(b):
    return b.table("documents").where("text is not null").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


PLACE = r"\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|\{[A-Za-z_][\pL\pN_.:-]*\}|%\([A-Za-z_][\pL\pN_]*\)[#0 +\-]?(?:[0-9]+|\*)?(?:\.[0-9]+)?[diouxXeEfFgGcrs%]|%(?:[#0 +\-]?(?:[0-9]+|\*)?(?:\.[0-9]+)?[diouxXeEfFgGcrs%])|\[\[[^\[\]\n]+\]\]|<[A-Za-z][^<>\n]*?>"


@query("segment", f"SELECT id, array_to_string(regexp_extract_all(source_text, '{PLACE}'), '|') AS found FROM segment")
def extract_placeholders(b):
    return b.segments().select("id", F.array_join(T.placeholders(F.col("source_text")), "|").alias("found"))


# --- blocks and segments --------------------------------------------------------------------------------------------


TABLE = "| a | b |\n| --- | --- |\n| "


def _markdown_files(b):
    """Each document as a Markdown file: its first line a heading, every seventh line of a kind of its own. Lines are
    whole."""
    lines = F.split("text", "\n")
    made = F.transform(lines, lambda x, i: F.when(i == 0, F.concat(F.lit("# "), x)).when(i % 7 == 1, F.concat(F.lit("- "), x)).when(i % 7 == 2, F.concat(F.lit("> "), x)).when(i % 7 == 3, F.concat(F.lit("```\n"), x, F.lit("\n```"))).when(i % 7 == 4, F.concat(F.lit("## "), x)).when(i % 7 == 5, F.concat(F.lit(TABLE), F.replace(x, F.lit("|"), F.lit("\\|")), F.lit(" | [l](http://x.y/"), i.cast("string"), F.lit(") |"))).otherwise(x))
    return b.table("documents").where("text is not null").select(F.col("doc_id").alias("project_id"), F.array_join(made, "\n\n").alias("text"))


#: The files' pieces (a line each) with their place and first token, and their blocks with text, place and token.
PIECES = f"""WITH l AS (SELECT doc_id AS project_id, i, parts[i + 1] AS body FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
  k AS (SELECT *, CASE WHEN i = 0 THEN 'h1' WHEN i % 7 = 4 THEN 'h2' WHEN i % 7 = 1 THEN 'list_item' WHEN i % 7 = 2 THEN 'blockquote' WHEN i % 7 = 3 THEN 'code' WHEN i % 7 = 5 THEN 'table_cell' ELSE 'para' END AS kind, CAST(i AS VARCHAR) || ')' AS link, replace(body, '|', chr(92) || '|') AS cell, regexp_matches(body, '{NON_WS}') AS seen FROM l),
  q AS (SELECT *, CASE kind WHEN 'h1' THEN '# ' || body WHEN 'h2' THEN '## ' || body WHEN 'list_item' THEN '- ' || body WHEN 'blockquote' THEN '> ' || body WHEN 'code' THEN '```' || chr(10) || body || chr(10) || '```' WHEN 'table_cell' THEN '{TABLE}'.replace(chr(92) || 'n', chr(10)) || cell || ' | [l](http://x.y/' || link || ' |' ELSE body END AS piece, CASE WHEN kind = 'table_cell' THEN 4 WHEN seen THEN 1 ELSE 0 END AS n FROM k),
  r AS (SELECT *, sum(n) OVER w - n AS t, sum(length(piece) + 2) OVER w - length(piece) - 2 AS off FROM q WINDOW w AS (PARTITION BY project_id ORDER BY i)),
  b AS (SELECT project_id, t AS token_index, CASE WHEN kind IN ('h1', 'h2') THEN 'heading' ELSE kind END AS kind, CASE WHEN kind = 'code' THEN body || chr(10) ELSE body END AS text, off + CASE kind WHEN 'h1' THEN 2 WHEN 'h2' THEN 3 WHEN 'para' THEN 0 ELSE 2 END AS a, length(body) AS m FROM r WHERE n = 1
    UNION ALL SELECT project_id, t, kind, 'a', off + 2, 1 FROM r WHERE n = 4 UNION ALL SELECT project_id, t + 1, kind, 'b', off + 6, 1 FROM r WHERE n = 4
    UNION ALL SELECT project_id, t + 2, kind, body, off + 26, length(cell) FROM r WHERE n = 4 UNION ALL SELECT project_id, t + 3, kind, '[l](http://x.y/' || link, off + 29 + length(cell), 15 + length(link) FROM r WHERE n = 4)""".replace(f"'{TABLE}'.replace(chr(92) || 'n', chr(10))", "'| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| '")


@query("", PIECES + " SELECT project_id, CAST(token_index AS INT) AS token_index, kind, text FROM b")
def markdown_blocks(b):
    return B.markdown_blocks(_markdown_files(b), ["project_id"]).select("project_id", "token_index", "kind", "text")


@query()
def xhtml_blocks(b):
    return B.xhtml_blocks(b.table("pages"), ["page_id"])


@query("", """WITH l AS (SELECT doc_id AS project_id, i, parts[i + 1] AS body FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
  h AS (SELECT project_id, i, trim(body) AS title FROM l WHERE i = 0 OR i % 7 = 4)
  SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY i) - 1 AS chapter_ord, title AS chapter_title FROM h""")
def assign_chapters(b):
    blocks = SG.assign_chapters(B.markdown_blocks(_markdown_files(b), ["project_id"]))
    return blocks.groupBy("project_id", F.col("chapter_ord").cast("long").alias("chapter_ord")).agg(F.first("chapter_title").alias("chapter_title"))


@query("", f"""SELECT project_id, chapter_ord, CAST(i AS INT) AS token_index, body AS text, CAST(i AS INT) AS block_index FROM (SELECT doc_id AS chapter_ord, CAST(substr(source, 4) AS BIGINT) AS project_id, i, parts[i + 1] AS body
  FROM (SELECT doc_id, source, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))) WHERE i % 5 <> 4 AND NOT {blank('body')}""")
def translatable_blocks(b):
    """All lines of all documents as blocks; every fifth isn't to be translated, and blank ones have nothing to say."""
    d = b.table("documents").where("text is not null").select(F.substring("source", 4, 10).cast("long").alias("project_id"), F.col("doc_id").alias("chapter_ord"), F.posexplode(F.split("text", "\n")).alias("token_index", "text")).withColumn("translatable", F.col("token_index") % 5 != 4)
    return SG.translatable_blocks(d).select("project_id", "chapter_ord", "token_index", "text", "block_index")


@query("", "SELECT doc_id, length(text) AS total, sha1(text) AS joined, true AS bounded FROM documents WHERE text IS NOT NULL")
def split_long_text(b):
    d = b.table("documents").where("text is not null").withColumn("p", split_text(1500, False)(F.col("text")))
    return d.select("doc_id", F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("total"), F.sha1(F.array_join("p", "").cast("binary")).alias("joined"), F.forall("p", lambda x: F.length(x) <= 1500).alias("bounded"))


ATOMS = "replace(replace(text, '`', chr(39)), chr(10), ' `code ' || doc_id || ' and more of it` ')"


@query("", f"SELECT doc_id, sha1({ATOMS}) AS joined, true AS whole, length({ATOMS}) > 700 AS cut FROM documents WHERE text IS NOT NULL")
def split_markdown_text(b):
    """Documents with a code span for each line end: no piece ends inside a span."""
    span = F.concat(F.lit(" `code "), F.col("doc_id").cast("string"), F.lit(" and more of it` "))
    made = F.replace(F.replace(F.col("text"), F.lit("`"), F.lit("'")), F.lit("\n"), span)
    d = b.table("documents").where("text is not null").withColumn("p", split_text(700, True)(made))
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("`"), F.lit("")))
    return d.select("doc_id", F.sha1(F.array_join("p", "").cast("binary")).alias("joined"), F.forall("p", lambda x: marks(x) % 2 == 0).alias("whole"), (F.size("p") > 1).alias("cut"))


def _segmented(b):
    lines = b.lines().select("project_id", F.col("doc_id").alias("chapter_ord"), F.col("line").alias("block_index"), F.col("body").alias("text"))
    path = F.struct(F.lit("md").alias("source_type"), F.col("block_index").alias("token_index"))
    return SG.segment_documents(lines, path)


CUT_AT = "CASE WHEN length(rest) <= 1500 THEN rest WHEN regexp_extract(substr(rest, 1, 1500), '(?s)^.*[.!?。！？；;][ \\t]+') <> '' THEN regexp_extract(substr(rest, 1, 1500), '(?s)^.*[.!?。！？；;][ \\t]+') ELSE substr(rest, 1, 1500) END"


@query("line", f""", p AS (SELECT project_id, doc_id, line, 0 AS part, piece, substr(body, length(piece) + 1) AS rest FROM (SELECT *, {CUT_AT} AS piece FROM (SELECT *, body AS rest FROM line))
    UNION ALL SELECT project_id, doc_id, line, part + 1, piece, substr(rest, length(piece) + 1) FROM (SELECT *, {CUT_AT} AS piece FROM (SELECT project_id, doc_id, line, part, rest FROM p WHERE rest <> ''))),
  n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS parts, row_number() OVER (PARTITION BY project_id ORDER BY doc_id, line, part) - 1 AS ord FROM p)
  SELECT project_id, doc_id AS chapter_ord, CAST(line AS INT) AS block_index, part AS part_index, ord, sha1({normal_sql('piece')}) AS src_hash, piece AS text,
  printf('%04d:%05d:', doc_id, line) || substr(sha1('{{"source_type":"md","token_index":' || line || '}}'), 1, 8) || CASE WHEN parts > 1 THEN '#' || part ELSE '' END AS stable_key, 'pending' AS status FROM n""")
def segment_documents(b):
    return _segmented(b).select("project_id", "chapter_ord", "block_index", "part_index", F.col("ord").cast("long").alias("ord"), "src_hash", "text", "stable_key", "status")


SQL["segment_documents"] = SQL["segment_documents"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("line", "SELECT project_id, doc_id AS chapter_ord, CAST(line AS INT) AS block_index, body AS text FROM line")
def regroup_blocks(b):
    return SG.regroup_blocks(_segmented(b), F.col("text"), keys=("chapter_ord", "block_index")).select("project_id", "chapter_ord", "block_index", "text")


@query("segment", f"""SELECT project_id, chapter_id AS chapter_ord, ord // 3 AS block_index, CASE WHEN bool_or({DONE} AND target_text IS NOT NULL) THEN string_agg(CASE WHEN {DONE} AND target_text IS NOT NULL THEN target_text ELSE '' END, '' ORDER BY ord) END AS text
  FROM segment GROUP BY ALL""")
def block_translation(b):
    s = b.segments().withColumns({"chapter_ord": F.col("chapter_id"), "block_index": F.floor(F.col("ord") / 3), "part_index": (F.col("ord") % 3).cast("int")})
    return SG.block_translation(s, False, keys=("chapter_ord", "block_index")).select("project_id", "chapter_ord", "block_index", "text")


# --- ledger -----------------------------------------------------------------------------------------------------------


def _drafts(b):
    """A second import: rows of ord % 10 = 3 are gone, those of ord % 10 = 4 changed, some are new."""
    s = b.segments().where("ord % 10 <> 3")
    old = s.withColumn("source_text", F.when(F.col("ord") % 10 == 4, F.concat("source_text", F.lit(" changed"))).otherwise(F.col("source_text")))
    new = s.where("ord % 10 = 5").withColumns({"stable_key": F.concat("stable_key", F.lit("+")), "ord": F.col("ord") + 1_000_000})
    both = old.unionByName(new)
    return both.select("project_id", "stable_key", "chapter_id", "ord", "source_text", T.source_hash(F.col("source_text")).alias("src_hash"))


DRAFTS = f"""draft AS (SELECT project_id, stable_key, chapter_id, ord, source_text, sha1({normal_sql('source_text')}) AS src_hash FROM (
  SELECT project_id, stable_key, chapter_id, ord, CASE WHEN ord % 10 = 4 THEN source_text || ' changed' ELSE source_text END AS source_text FROM segment WHERE ord % 10 <> 3
  UNION ALL SELECT project_id, stable_key || '+', chapter_id, ord + 1000000, source_text FROM segment WHERE ord % 10 = 5))"""


@query("segment", f""", {DRAFTS}, m AS (SELECT coalesce(d.project_id, s.project_id) AS project_id, coalesce(d.stable_key, s.stable_key) AS stable_key, CASE WHEN s.stable_key IS NULL THEN 'insert' WHEN d.stable_key IS NULL THEN 'delete' WHEN s.src_hash = d.src_hash THEN 'keep' ELSE 'reset' END AS action,
  coalesce(d.source_text, s.source_text) AS source_text, s.target_text, s.status FROM segment s FULL JOIN draft d ON s.project_id = d.project_id AND s.stable_key = d.stable_key)
  SELECT action, project_id, stable_key, source_text, CASE WHEN action IN ('keep', 'delete') THEN target_text END AS target_text, CASE WHEN action IN ('keep', 'delete') THEN status ELSE 'pending' END AS status FROM m""")
def ledger_merge(b):
    return L.ledger_merge(b.segments(), _drafts(b), NOW).select("action", "project_id", "stable_key", "source_text", "target_text", "status")


@query("chapter", """, d AS (SELECT project_id, ord + CASE WHEN ord % 4 = 3 THEN 100000 ELSE 0 END AS ord, title || '!' AS title, href FROM chapter)
  SELECT CASE WHEN s.ord IS NULL THEN 'insert' WHEN d.ord IS NULL THEN 'delete' ELSE 'update' END AS action, coalesce(d.project_id, s.project_id) AS project_id, coalesce(d.ord, s.ord) AS ord, coalesce(d.title, s.title) AS title, s.summary
  FROM chapter s FULL JOIN d ON s.project_id = d.project_id AND s.ord = d.ord""")
def chapter_merge(b):
    c = b.chapters()
    d = c.select("project_id", (F.col("ord") + F.when(F.col("ord") % 4 == 3, 100000).otherwise(0)).alias("ord"), F.concat("title", F.lit("!")).alias("title"), "href")
    return L.chapter_merge(c, d).select("action", "project_id", "ord", "title", "summary")


@query("segment chapter", f""", {DRAFTS}, a AS (SELECT chapter_id, string_agg(stable_key || ':' || src_hash, chr(10) ORDER BY ord) AS g FROM segment GROUP BY 1), z AS (SELECT chapter_id, string_agg(stable_key || ':' || src_hash, chr(10) ORDER BY ord) AS g FROM draft GROUP BY 1),
  x AS (SELECT coalesce(a.chapter_id, z.chapter_id) AS id, a.g IS DISTINCT FROM z.g AS changed FROM a FULL JOIN z ON a.chapter_id = z.chapter_id)
  SELECT c.id, coalesce(changed, false) AS changed, CASE WHEN NOT coalesce(changed, false) THEN summary END AS summary FROM chapter c LEFT JOIN x ON c.id = x.id""")
def invalidate_summaries(b):
    return L.invalidate_summaries(b.chapters(), b.segments(), _drafts(b)).select("id", "changed", "summary")


@query("segment", "SELECT id, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'processing' THEN error_msg END AS error_msg FROM segment")
def recover_processing(b):
    return L.recover_processing(b.segments()).select("id", "status", "error_msg")


@query("segment", "SELECT id, ord FROM segment WHERE status IN ('pending', 'error') AND id % 3 = 0")
def select_candidates(b):
    s = b.segments()
    ids = s.where("id % 3 = 0").select("id").union(s.where("id % 6 = 0").select(F.col("id"))).union(s.select(-F.col("id") - 1))
    return L.select_candidates(s, ids).select("id", "ord")


@query("segment", "SELECT id, ord FROM segment WHERE status = 'pending' AND chapter_id = 5")
def selectable_ids(b):
    return L.selectable_ids(b.segments(), chapter_id=5, statuses=["pending"])


EDITS = """, e AS (SELECT id, status, target_text, error_msg, CASE WHEN id % 4 <> 1 THEN CASE WHEN ord % 9 = 0 THEN ' ' ELSE 'edit ' || ord END END AS new_text, CASE ord % 3 WHEN 1 THEN 'reviewed' WHEN 2 THEN 'pending' END AS new_status, id % 4 <> 1 AS has_text FROM segment WHERE ord % 2 = 0),
  f AS (SELECT *, CASE WHEN has_text THEN new_text ELSE target_text END AS text FROM e), g AS (SELECT *, coalesce(new_status, CASE WHEN has_text THEN CASE WHEN """ + blank("text") + """ THEN 'pending' ELSE 'done' END ELSE status END) AS state FROM f),
  h AS (SELECT *, CASE WHEN status = 'processing' THEN 'processing' WHEN state IN ('done', 'reviewed') AND """ + blank("text") + """ THEN 'blank' END AS rejected FROM g)"""


@query("segment", EDITS + """ SELECT id, rejected, CASE WHEN rejected IS NULL THEN text ELSE target_text END AS target_text, CASE WHEN rejected IS NULL THEN state ELSE status END AS status,
  CASE WHEN NOT (rejected IS NULL AND state IN ('done', 'reviewed', 'pending')) THEN error_msg END AS error_msg, rejected IS NULL AND has_text AND new_text IS DISTINCT FROM target_text AND state IN ('done', 'reviewed') AS to_tm FROM h""")
def apply_edits(b):
    s = b.segments()
    has = F.col("id") % 4 != 1
    text = F.when(F.col("ord") % 9 == 0, " ").otherwise(F.concat(F.lit("edit "), F.col("ord").cast("string")))
    edits = s.where("ord % 2 = 0").select(F.col("id").alias("segment_id"), F.when(has, text).alias("new_text"), F.when(F.col("ord") % 3 == 1, "reviewed").when(F.col("ord") % 3 == 2, "pending").alias("new_status"), has.alias("has_text"))
    return L.apply_edits(s, edits).select("id", "rejected", "target_text", "status", "error_msg", "to_tm")


@query("segment", f"SELECT project_id, count(*) AS matched, count(*) FILTER ({DONE} AND NOT {blank('target_text')}) AS updated FROM segment WHERE status IN ('done', 'reviewed', 'error') GROUP BY 1")
def bulk_action(b):
    out = L.bulk_action(b.segments(), "mark_reviewed", statuses=["done", "reviewed", "error"])
    return out.groupBy("project_id").agg(F.count("*").alias("matched"), F.count_if("updated").alias("updated"))


def _results(b):
    """Answers for every other segment: some fail, some are blank, some lose their marker."""
    s = b.segments().where("ord % 2 = 1")
    m = mask_markdown(F.col("source_text"))
    k = F.col("ord") % 7
    r = s.withColumn("_m", m).select(
        F.col("id").alias("segment_id"), F.when(k == 0, "").when(F.col("ord") % 22 == 1, "lost").otherwise(F.concat(F.lit("T "), F.col("_m.text"))).alias("text"), F.col("ord").alias("in_tokens"), (F.col("ord") + 1).alias("out_tokens"),
        F.lit("model").alias("model"), F.when(F.col("ord") % 5 == 0, "timeout").alias("error"), F.col("_m.replacements").alias("replacements"), F.lit(-1).alias("n_slots"))
    return L.apply_results(b.segments(), r)


RESULTS = """, r AS (SELECT *, CASE WHEN status <> 'processing' THEN 'skipped' WHEN ord % 5 = 0 OR ord % 7 = 0 OR ord % 22 = 1 AND ord % 11 < 3 THEN 'error' ELSE 'done' END AS outcome FROM segment WHERE ord % 2 = 1)"""


@query("segment", RESULTS + " SELECT id, outcome, CASE outcome WHEN 'done' THEN CASE WHEN ord % 22 = 1 THEN 'lost' ELSE 'T ' || source_text END ELSE target_text END AS target_text, CASE outcome WHEN 'skipped' THEN status ELSE outcome END AS status FROM r")
def apply_results(b):
    return _results(b).select("id", "outcome", "target_text", "status")


@query("segment chapter glossary log project", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) FILTER ({k} % 3 = 0 AND {k} IN (SELECT id FROM project)) AS removed, count(*) FILTER (NOT ({k} % 3 = 0 AND {k} IN (SELECT id FROM project))) AS left_over FROM {t}" for t, k in (("segment", "project_id"), ("chapter", "project_id"), ("glossary", "project_id"), ("log", "project_id"), ("project", "id"))))
def purge_project(b):
    gone = b.projects().where("id % 3 = 0").select(F.col("id").alias("project_id"))
    tables = {"segment": b.segments().select("project_id"), "chapter": b.chapters().select("project_id"), "glossary": b.glossary(), "log": b.logs().select("project_id"), "project": b.projects()}
    left, removed = L.purge_projects(tables, gone)
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("left_over")) for name, t in left.items()]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return removed.join(every, "name")


@query("project", "SELECT id, CASE WHEN status = 'translating' THEN 'ready' ELSE status END AS status FROM project")
def recover_projects(b):
    return L.recover_projects(b.projects()).select("id", "status")


@query("segment project", "SELECT p.id AS project_id, CASE WHEN coalesce(bool_or(s.status IN ('pending', 'processing', 'error') AND p.id % 3 > 0), false) THEN 'ready' ELSE 'done' END AS status FROM project p LEFT JOIN segment s ON s.project_id = p.id GROUP BY 1")
def project_status(b):
    """All segments; those of every third project are taken as done."""
    s = b.segments().withColumn("status", F.when(F.col("project_id") % 3 == 0, "done").otherwise(F.col("status")))
    return L.project_status(b.projects(), s)


# --- translation memory -------------------------------------------------------------------------------------------------


@query("lang tm", "SELECT s.id, t.src_hash IS NOT NULL AS hit, coalesce(t.target_text, s.target_text) AS target_text, CASE WHEN t.src_hash IS NULL THEN s.status ELSE 'done' END AS status FROM lang s LEFT JOIN tm t USING (src_hash, source_lang, target_lang) WHERE s.status IN ('pending', 'error')")
def tm_lookup(b):
    return M.tm_lookup(L.select_candidates(b.languages()), b.memory()).select("id", "hit", "target_text", "status")


@query("lang", "SELECT id, row_number() OVER (PARTITION BY source_lang, target_lang, src_hash ORDER BY project_id, ord, id) = 1 AS leader FROM lang WHERE status IN ('pending', 'error')")
def tm_batch_dedup(b):
    return M.tm_batch_dedup(L.select_candidates(b.languages())).select("id", "leader")


@query("lang tm", "SELECT s.id, t.src_hash IS NOT NULL AS hit, coalesce(t.target_text, s.target_text) AS target_text, CASE WHEN t.src_hash IS NULL THEN s.status ELSE 'done' END AS status FROM lang s LEFT JOIN tm t USING (src_hash, source_lang, target_lang) WHERE s.status IN ('pending', 'error')")
def tm_lookup_stored(b):
    """The memory written with its filter, and the batch looked up in it."""
    path = shared(b.spark, "memory")
    M.write_memory(b.memory(), path)
    return M.tm_lookup_stored(L.select_candidates(b.languages()), path).select("id", "hit", "target_text", "status")


def _answers(b):
    """A model that fails or stays silent by the segment's ord."""

    def translate(leads):
        m = leads.withColumn("_m", mask_markdown(F.col("source_text")))
        text = F.when(F.col("ord") % 7 == 0, " ").otherwise(F.concat(F.lit("T "), F.col("_m.text")))
        return m.where("ord % 11 <> 5").select(F.col("id").alias("segment_id"), text.alias("text"), F.col("ord").alias("in_tokens"), (F.col("ord") + 1).alias("out_tokens"), F.lit("model").alias("model"), F.when(F.col("ord") % 3 == 0, "timeout").alias("error"), F.col("_m.replacements").alias("replacements"), F.lit(-1).alias("n_slots"))

    return translate


@query("lang", """, c AS (SELECT *, row_number() OVER (PARTITION BY source_lang, target_lang, src_hash ORDER BY project_id, ord, id) AS k, ord % 3 <> 0 AND ord % 7 <> 0 AND ord % 11 <> 5 AS good FROM lang WHERE status IN ('pending', 'error')),
  f AS (SELECT *, min(k) FILTER (good) OVER (PARTITION BY source_lang, target_lang, src_hash) AS f FROM c), w AS (SELECT source_lang, target_lang, src_hash, 'T ' || source_text AS text FROM f WHERE k = f)
  SELECT id, CASE WHEN k < f OR f IS NULL THEN 'error' WHEN k = f THEN 'done' ELSE 'hit' END AS outcome, CAST(CASE WHEN k <= f OR f IS NULL THEN k END AS INT) AS wave, CASE WHEN k >= f THEN text ELSE target_text END AS target_text, CASE WHEN k >= f THEN 'done' ELSE 'error' END AS status,
  CASE WHEN k = f THEN ord ELSE token_in END AS token_in, CASE WHEN k < f OR f IS NULL THEN 'Translation provider request failed' END AS error_msg FROM f LEFT JOIN w USING (source_lang, target_lang, src_hash)""")
def translate_waves(b):
    """Every key's rows tried in turn until one is translated; the others take its text."""
    return M.translate_waves(L.select_candidates(b.languages()), _answers(b)).select("id", "outcome", "wave", "target_text", "status", "token_in", "error_msg")


@query("lang tm", f"SELECT t.src_hash, t.source_lang, t.hit_count + coalesce(n, 0) AS hit_count, CASE WHEN n IS NULL THEN t.updated_at ELSE '{NOW}' END AS updated_at FROM tm t LEFT JOIN (SELECT src_hash, source_lang, target_lang, count(*) AS n FROM lang WHERE status = 'pending' GROUP BY ALL) h USING (src_hash, source_lang, target_lang)")
def tm_hit_counts(b):
    return M.tm_hit_counts(b.memory(), b.languages().where("status = 'pending'"), NOW).select("src_hash", "source_lang", "hit_count", "updated_at")


def _fresh(b):
    done = b.languages().where((F.col("status") == "reviewed") & (F.col("target_text") != ""))
    return done.select(*M.KEYS, "source_text", "target_text", "updated_at")


@query("lang tm", """, n AS (SELECT src_hash, source_lang, target_lang, source_text, target_text, updated_at FROM lang WHERE status = 'reviewed' AND target_text <> ''),
  a AS (SELECT *, 1 AS fresh, NULL AS hit_count FROM n UNION ALL SELECT src_hash, source_lang, target_lang, source_text, target_text, updated_at, 0, hit_count FROM tm)
  SELECT src_hash, source_lang, target_text, updated_at, coalesce(max(hit_count) OVER (PARTITION BY src_hash, source_lang, target_lang), 0) AS hit_count FROM a QUALIFY row_number() OVER (PARTITION BY src_hash, source_lang, target_lang ORDER BY updated_at DESC, fresh DESC, target_text DESC, source_text DESC) = 1""")
def tm_store(b):
    return M.tm_store(b.memory(), _fresh(b)).select("src_hash", "source_lang", "target_text", "updated_at", "hit_count")


@query("lang tm", f"""SELECT p.id AS project_id, (SELECT count(*) FROM tm) AS global_entries, coalesce(t.n, 0) AS pair_entries, CAST(coalesce(t.h, 0) AS BIGINT) AS pair_hits, coalesce(s.n, 0) AS segments, coalesce(s.m, 0) AS matches, coalesce(s.r, 0) AS reusable, coalesce(s.w, 0) AS without_provider
  FROM project p LEFT JOIN (SELECT source_lang, target_lang, count(*) AS n, sum(hit_count) AS h FROM tm GROUP BY ALL) t USING (source_lang, target_lang)
  LEFT JOIN (SELECT l.project_id, count(*) AS n, count(t.src_hash) AS m, count(t.src_hash) FILTER (status IN ('pending', 'error')) AS r, count(*) FILTER ({DONE} AND provider IS NULL) AS w FROM lang l LEFT JOIN tm t USING (src_hash, source_lang, target_lang) GROUP BY 1) s ON s.project_id = p.id""")
def tm_stats(b):
    return M.tm_stats(b.projects(), b.languages(), b.memory())


@query("lang tm", f""", {DRAFTS}, m AS (SELECT d.project_id, p.source_lang, p.target_lang, d.src_hash, CASE WHEN s.src_hash = d.src_hash THEN s.status ELSE 'pending' END AS status, CASE WHEN s.src_hash = d.src_hash THEN s.provider END AS provider
    FROM draft d JOIN project p ON p.id = d.project_id LEFT JOIN segment s ON s.project_id = d.project_id AND s.stable_key = d.stable_key)
  SELECT p.id AS project_id, (SELECT count(*) FROM tm) AS global_entries, coalesce(t.n, 0) AS pair_entries, CAST(coalesce(t.h, 0) AS BIGINT) AS pair_hits, coalesce(s.n, 0) AS segments, coalesce(s.m, 0) AS matches, coalesce(s.r, 0) AS reusable, coalesce(s.w, 0) AS without_provider
  FROM project p LEFT JOIN (SELECT source_lang, target_lang, count(*) AS n, sum(hit_count) AS h FROM tm GROUP BY ALL) t USING (source_lang, target_lang)
  LEFT JOIN (SELECT l.project_id, count(*) AS n, count(t.src_hash) AS m, count(t.src_hash) FILTER (status IN ('pending', 'error')) AS r, count(*) FILTER ({DONE} AND provider IS NULL) AS w FROM m l LEFT JOIN tm t USING (src_hash, source_lang, target_lang) GROUP BY 1) s ON s.project_id = p.id""")
def kept_tm_stats(b):
    """The memory's statistics after a second import, from counts kept from before it."""
    counts = M.text_counts(b.languages())
    now = M.apply_text_changes(counts, M.text_changes(L.ledger_merge(b.segments(), _drafts(b), NOW), b.projects()))
    return M.tm_stats_of_counts(b.projects(), now, b.memory())


@query("tm", """, f AS (SELECT * FROM tm WHERE source_lang = 'en' AND (contains(lower(source_text), 'the') OR contains(lower(target_text), 'the')))
  SELECT src_hash, hit_count, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 50.0) AS BIGINT) AS pages FROM f ORDER BY hit_count DESC, updated_at DESC, src_hash DESC LIMIT 50 OFFSET 50""")
def tm_page(b):
    return M.tm_page(b.memory(), "en", "zh-CN", "THE", page=2).select("src_hash", "hit_count", F.col("total").cast("long").alias("total"), F.col("pages").cast("long").alias("pages"))


# --- glossary -----------------------------------------------------------------------------------------------------------

FOLD = "replace(lower({}), 'ß', 'ss')".format
MATCH = f"g.enabled AND g.project_id = s.project_id AND CASE WHEN g.case_sensitive THEN contains(s.source_text, g.source_term) ELSE contains({FOLD('s.source_text')}, {FOLD('g.source_term')}) END"


#: Where the term first stands: in a folded text, the number of characters whose folded prefix is no longer than what
#: stands before it.
PLACE_OF = f"""CASE WHEN g.case_sensitive THEN instr(s.source_text, g.source_term) - 1 WHEN length({FOLD('s.source_text')}) = length(s.source_text) THEN instr({FOLD('s.source_text')}, {FOLD('g.source_term')}) - 1
  ELSE len(list_filter(range(1, length(s.source_text) + 1), lambda k: length({FOLD('substr(s.source_text, 1, k)')}) <= instr({FOLD('s.source_text')}, {FOLD('g.source_term')}) - 1)) END"""


@query("segment glossary", f"SELECT s.id, g.id AS term_id, g.target_term, CAST({PLACE_OF} AS INT) AS first FROM segment s JOIN glossary g ON {MATCH}")
def glossary_matches(b):
    found = G.glossary_matches(b.segments().select("id", "project_id", "source_text"), b.glossary())
    return found.select("id", "term_id", "target_term", F.element_at("starts", 1).alias("first"))


@query("glossary", """, n AS (SELECT project_id, source_term FROM glossary WHERE id % 2 = 0 UNION ALL SELECT project_id, source_term || '+' FROM glossary WHERE id % 3 = 0 UNION ALL SELECT project_id, source_term FROM glossary WHERE id % 14 = 0)
  SELECT n.project_id, n.source_term, CASE WHEN count(*) OVER (PARTITION BY n.project_id, n.source_term) > 1 THEN 'duplicate' WHEN g.id IS NOT NULL THEN 'conflict' ELSE 'create' END AS action FROM n LEFT JOIN glossary g ON g.project_id = n.project_id AND g.source_term = n.source_term""")
def glossary_import(b):
    g = b.glossary()
    k = g.select("project_id", "source_term")
    batch = k.where(g["id"] % 2 == 0).union(g.where("id % 3 = 0").select("project_id", F.concat("source_term", F.lit("+")))).union(g.where("id % 14 = 0").select("project_id", "source_term"))
    return G.glossary_import(g, batch)


@query("glossary", "SELECT id, source_term FROM glossary WHERE enabled AND (contains(lower(source_term), 'th') OR contains(lower(target_term), 'th'))")
def glossary_search(b):
    return G.glossary_search(b.glossary(), search="Th", enabled_only=True).select("id", "source_term")


@query("glossary", "SELECT source_term, note, id % 3 = 0 AS case_sensitive, CASE id % 4 WHEN 0 THEN false WHEN 3 THEN NULL ELSE true END AS enabled, CASE WHEN id % 4 = 3 THEN 'enabled' END AS reason FROM glossary")
def read_glossary_csv(b):
    """The glossary as CSV files with untidy headers and flags, written to the shared folder and read from there."""
    g = b.glossary()
    flag = F.element_at(F.array(*map(F.lit, ["Off", "YES", "", "maybe"])), (F.col("id") % 4 + 1).cast("int"))
    raw = g.select(F.concat(F.lit(" "), "source_term").alias(" Source_Term"), F.col("target_term").alias("TARGET_TERM "), F.coalesce("note", F.lit("  ")).alias("note"), F.when(F.col("case_sensitive"), "1").otherwise(F.lit(None)).alias("case_sensitive"), flag.alias("enabled"))
    path = shared(b.spark, "csv")
    raw.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return D.read_glossary_csv(b.spark, path).select("source_term", "note", "case_sensitive", "enabled", "reason")


# --- context and requests -------------------------------------------------------------------------------------------------


@query("segment", f""", d AS (SELECT project_id, ord, source_text, target_text, row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1 AS k FROM segment WHERE {DONE} AND target_text IS NOT NULL),
  s AS (SELECT id, project_id, ord, coalesce(count(*) FILTER ({DONE} AND target_text IS NOT NULL) OVER (PARTITION BY project_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM segment)
  SELECT s.id, string_agg(CAST(d.ord AS VARCHAR), ',' ORDER BY d.ord) FILTER (d.target_text <> '') AS previous FROM s LEFT JOIN d ON d.project_id = s.project_id AND d.k BETWEEN s.r - 3 AND s.r - 1 GROUP BY 1""")
def rolling_context(b):
    return C.rolling_context(b.segments()).select("id", F.array_join(F.transform("previous", lambda p: p["o"].cast("string")), ",").alias("previous"))


@query("segment", f"""SELECT project_id, chapter_id, '{C.HISTORY}' || chr(10) || string_agg('{C.SOURCE}' || source_text || chr(10) || '{C.TARGET}' || target_text, chr(10) ORDER BY ord) AS section FROM segment WHERE {DONE} AND target_text <> '' GROUP BY ALL""")
def history_section(b):
    s = b.segments().where(T.completed(F.col("status")) & (F.col("target_text") != ""))
    g = s.groupBy("project_id", "chapter_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), F.col("source_text").alias("s"), F.col("target_text").alias("t")))).alias("p"))
    return g.select("project_id", "chapter_id", C.history_section(F.col("p")).alias("section"))


@query("glossary", f"SELECT project_id, '{C.GLOSSARY}' || chr(10) || string_agg('- ' || source_term || ' → ' || target_term || CASE WHEN note IS NULL THEN '' ELSE '（' || note || '）' END, chr(10) ORDER BY id) AS section FROM glossary GROUP BY 1")
def glossary_section(b):
    g = b.glossary().groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("id", "source_term", "target_term", "note"))).alias("t"))
    return g.select("project_id", C.glossary_section(F.col("t")).alias("section"))


WHOLE = f"""d AS (SELECT project_id, ord, source_text, target_text, row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1 AS k FROM segment WHERE {DONE} AND target_text IS NOT NULL),
  n AS (SELECT id, project_id, chapter_id, ord, coalesce(count(*) FILTER ({DONE} AND target_text IS NOT NULL) OVER (PARTITION BY project_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM segment),
  h AS (SELECT n.id, '{C.HISTORY}' || chr(10) || string_agg('{C.SOURCE}' || d.source_text || chr(10) || '{C.TARGET}' || d.target_text, chr(10) ORDER BY d.ord) AS history FROM n JOIN d ON d.project_id = n.project_id AND d.k BETWEEN n.r - 3 AND n.r - 1 WHERE d.target_text <> '' GROUP BY 1),
  m AS (SELECT s.id, '{C.GLOSSARY}' || chr(10) || string_agg('- ' || g.source_term || ' → ' || g.target_term || CASE WHEN g.note IS NULL THEN '' ELSE '（' || g.note || '）' END, chr(10) ORDER BY g.id) AS terms FROM segment s JOIN glossary g ON {MATCH} GROUP BY 1),
  w AS (SELECT n.id, array_to_string(list_filter([coalesce(terms, ''), CASE WHEN coalesce(c.summary, '') = '' THEN '' ELSE '{C.SUMMARY}' || chr(10) || c.summary END, coalesce(history, '')], lambda x: x <> ''), chr(10) || chr(10)) AS text
    FROM n LEFT JOIN chapter c ON c.id = n.chapter_id LEFT JOIN h ON h.id = n.id LEFT JOIN m ON m.id = n.id)"""


@query("segment glossary chapter", f", {WHOLE} SELECT id, CASE WHEN {TOKENS} <= 1200 THEN text END AS context, true AS fits FROM w")
def build_context(b):
    """The whole context where all of it fits; beyond that it is cut to what does."""
    s = b.segments().select("id", "project_id", "chapter_id", "ord", "status", "source_text", "target_text")
    s = written(s.join(b.chapters().select(F.col("id").alias("chapter_id"), "summary"), "chapter_id", "left").drop("chapter_id"), "segments")
    rows = written(G.with_terms(s, b.glossary()), "rows")  # whole, before texts are copied into others' contexts
    remove(s)
    made = C.build_context(C.recent(rows, keep=("terms", "summary")))
    return made.select("id", F.when(F.col("complete"), F.col("context")).alias("context"), T.fits(F.col("context"), 1200).alias("fits"))


@query("segment chapter", f"""SELECT chapter_id, text FROM (SELECT s.chapter_id, substr(string_agg(s.source_text, chr(10) || chr(10) ORDER BY s.ord, s.id), 1, 8000) AS text FROM segment s JOIN chapter c ON c.id = s.chapter_id WHERE {blank('c.summary')} AND s.chapter_id IN (SELECT chapter_id FROM segment WHERE status IN ('pending', 'error')) GROUP BY 1)""")
def chapter_summary_source(b):
    s = b.segments()
    return C.chapter_summary_source(b.chapters(), s, L.select_candidates(s))


@query("segment", """SELECT id, source_text AS restored, CASE WHEN NOT regexp_matches(regexp_replace(source_text, ' (\\{name\\}|%s|<b>)$', ''), '[*_`\\[\\]<{}%~$\\\\⟦]|(?i)https?:') THEN regexp_replace(source_text, ' (\\{name\\}|%s|<b>)$', ' ⟦MDP0000⟧') END AS masked FROM segment""")
def mask_markdown_query(b):
    """Every text comes back whole; masked texts are compared where a text has no marks but the one at its end."""
    s = b.segments().withColumn("m", mask_markdown(F.col("source_text"))).withColumn("r", restore_markers(F.col("m.text"), F.col("m.replacements"), F.lit(-1)))
    body = F.regexp_replace("source_text", r" (\{name\}|%s|<b>)$", "")
    return s.select("id", F.col("r.text").alias("restored"), F.when(~body.rlike(r"[*_`\[\]<{}%~$\\⟦]|(?i)https?:"), F.col("m.text")).alias("masked"))


@query("segment", "SELECT id, source_text AS restored, CAST(ord % 11 < 2 AS INT) AS markers FROM segment")
def mask_plain_query(b):
    s = b.segments().withColumn("m", mask_plain(F.col("source_text"))).withColumn("r", restore_markers(F.col("m.text"), F.col("m.replacements"), F.lit(-1)))
    return s.select("id", F.col("r.text").alias("restored"), F.size("m.replacements").alias("markers"))


@query("segment", "SELECT id, source_text AS restored, length(source_text) >= 4 AS has_slots, CASE WHEN ord % 3 = 0 AND (length(source_text) >= 4 OR ord % 11 < 2) THEN 'error' END AS damaged FROM segment")
def restore_markers_query(b):
    """Two slots a text, at its fourth character; every third text comes back without its first marker."""
    slots = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end")), F.struct(F.lit(4).alias("start"), F.length("source_text").alias("end")))
    s = b.segments().withColumn("m", mask_slots(F.col("source_text"), slots))
    lost = F.regexp_replace("m.text", "⟦VAR0000⟧", "")
    s = s.withColumn("r", restore_markers(F.col("m.text"), F.col("m.replacements"), F.lit(2))).withColumn("bad", restore_markers(F.when(F.col("ord") % 3 == 0, lost).otherwise(F.col("m.text")), F.col("m.replacements"), F.lit(2)))
    return s.select("id", F.col("r.text").alias("restored"), F.coalesce(F.size("r.target_slots") == 2, F.lit(False)).alias("has_slots"), F.when(F.col("bad.error").isNotNull(), "error").alias("damaged"))


def _templates(b):
    """Six templates by project: some disabled, one the default."""
    p = b.projects().where("id < 7")
    text = F.concat(F.lit("From {source_lang} ({source_lang_code}) to {target_lang}: {other} "), F.col("id").cast("string"))
    return p.select("id", F.when(F.col("id") == 4, " ").otherwise(text).alias("system_prompt"), F.when(F.col("id") % 2 == 0, "be brief").alias("user_prefix"), (F.col("id") % 3 != 2).alias("enabled"), (F.col("id") == 0).alias("is_default"))


TEMPLATES = """, t AS (SELECT id, CASE WHEN id = 4 THEN ' ' ELSE 'From {source_lang} ({source_lang_code}) to {target_lang}: {other} ' || id END AS prompt, CASE WHEN id % 2 = 0 THEN 'be brief' END AS guidance, id % 3 <> 2 AS enabled FROM project WHERE id < 7)"""
RESOLVED = TEMPLATES + ", r AS (SELECT p.id, p.source_lang, p.target_lang, CASE WHEN t.id IS NOT NULL THEN t.prompt ELSE d.prompt END AS prompt, CASE WHEN t.id IS NOT NULL THEN t.guidance ELSE d.guidance END AS guidance, CASE WHEN t.id IS NOT NULL THEN 'own' WHEN d.id IS NOT NULL THEN 'default' ELSE 'built-in' END AS origin FROM project p LEFT JOIN t ON t.id = p.prompt_template_id AND t.enabled LEFT JOIN t d ON d.id = 0)"
NAMES = "(CASE source_lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGES.items()) + " END)"


@query("project", RESOLVED + " SELECT id, prompt, guidance, origin FROM r")
def resolve_prompt(b):
    return C.resolve_prompt(b.projects(), _templates(b))


@query("project", RESOLVED + f" SELECT id, trim(replace(replace(replace(CASE WHEN trim(prompt) = '' THEN '{C.PROMPT}' ELSE prompt END, '{{source_lang}}', {NAMES}), '{{target_lang}}', '简体中文'), '{{source_lang_code}}', source_lang)) || CASE WHEN guidance IS NULL THEN '' ELSE chr(10) || chr(10) || '{C.GUIDANCE}' || chr(10) || guidance END AS rendered FROM r")
def render_prompt(b):
    p = C.resolve_prompt(b.projects(), _templates(b)).join(b.projects().select("id", "source_lang", "target_lang"), "id")
    return p.select("id", C.render_prompt(F.col("prompt"), F.col("guidance"), F.col("source_lang"), F.col("target_lang")).alias("rendered"))


@query("project", """, f AS (SELECT id, 'profile-' || id AS litellm, id % 2 = 0 AS enabled, id + 2 AS most FROM project WHERE id < 5)
  SELECT p.id, CASE WHEN model_profile_id IS NULL THEN CASE WHEN model = '' THEN 'gpt-5-mini' ELSE model END WHEN f.enabled THEN litellm END AS model, CAST(least(8, max_concurrency, coalesce(most, 8)) AS INT) AS concurrency, CASE WHEN model_profile_id IS NOT NULL AND f.id IS NULL THEN 'missing profile' WHEN NOT f.enabled THEN 'disabled profile' END AS error FROM project p LEFT JOIN f ON f.id = p.model_profile_id""")
def resolve_model(b):
    f = b.projects().where("id < 5").select("id", F.concat(F.lit("profile-"), F.col("id").cast("string")).alias("litellm_model_id"), (F.col("id") % 2 == 0).alias("enabled"), (F.col("id") + 2).cast("int").alias("max_concurrency"))
    return C.resolve_model(b.projects(), f)


def _leaders(b):
    missed = M.tm_lookup(L.select_candidates(b.languages()), b.memory()).where("not hit")
    return M.tm_batch_dedup(missed).where("leader")


def _prompt_sql(prompt: str, source: str) -> str:
    return f"trim(replace(replace(replace(CASE WHEN trim({prompt}) = '' THEN '{C.PROMPT}' ELSE {prompt} END, '{{source_lang}}', {NAMES.replace('source_lang', source)}), '{{target_lang}}', '简体中文'), '{{source_lang_code}}', {source})) || CASE WHEN guidance IS NULL THEN '' ELSE chr(10) || chr(10) || '{C.GUIDANCE}' || chr(10) || guidance END"


@query("lang tm glossary chapter", RESOLVED + f""", {WHOLE}, x AS (SELECT l.*, p.source_type, {_prompt_sql('r.prompt', 'l.source_lang')} AS system_prompt FROM lang l JOIN project p ON p.id = l.project_id JOIN r ON r.id = l.project_id
  WHERE l.status IN ('pending', 'error') AND NOT EXISTS (FROM tm t WHERE t.src_hash = l.src_hash AND t.source_lang = l.source_lang AND t.target_lang = l.target_lang) QUALIFY row_number() OVER (PARTITION BY l.source_lang, l.target_lang, l.src_hash ORDER BY l.project_id, l.ord, l.id) = 1)
  SELECT x.id, x.project_id, system_prompt, CASE WHEN {TOKENS} <= 1200 THEN text END AS context, CASE WHEN source_type = 'epub' THEN CASE ord % 11 WHEN 0 THEN regexp_replace(source_text, ' .name.$', ' ⟦VAR0000⟧') WHEN 1 THEN regexp_replace(source_text, ' %s$', ' ⟦VAR0000⟧') ELSE source_text END END AS plain_text, true AS is_message FROM x JOIN w ON w.id = x.id""")
def build_requests(b):
    """Every request with its prompt, its context where all of it fits, the masked text of plain ones, and the message made
    of both."""
    kinds = written(b.projects().select(F.col("id").alias("project_id"), "source_type"), "kinds")  # few rows, and known to be
    prompts = written(C.resolve_prompt(b.projects(), _templates(b)), "prompts")
    leaders = written(_leaders(b).join(kinds, "project_id"), "leaders")
    made = C.build_requests(leaders, b.languages(), b.chapters(), b.glossary(), prompts).join(kinds, "project_id")
    message = F.concat(F.lit(f"{C.CONTEXT}\n"), F.coalesce(F.nullif(T.strip(F.col("context")), F.lit("")), F.lit(C.NO_CONTEXT)), F.lit(f"\n\n{C.TASK}\n"), F.col("text"))
    return made.select("id", "project_id", "system_prompt", F.when(F.col("complete"), F.col("context")).alias("context"), F.when(F.col("source_type") == "epub", F.col("text")).alias("plain_text"), (F.col("message") == message).alias("is_message"))


# --- progress and cost ------------------------------------------------------------------------------------------------------


@query("segment project", f"""SELECT p.id AS project_id, count(*) FILTER (s.status = 'pending') AS pending, count(*) FILTER (s.status = 'done') AS done, count(s.id) AS total, count(*) FILTER (s.{DONE}) AS completed,
  CASE WHEN count(s.id) > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (s.{DONE}) / count(s.id), 2) ELSE 0 END AS percent, CAST(coalesce(sum(token_in), 0) AS BIGINT) AS token_in FROM project p LEFT JOIN segment s ON s.project_id = p.id GROUP BY 1""")
def project_progress(b):
    return P.project_progress(b.projects(), b.segments()).select("project_id", "pending", "done", "total", "completed", "percent", "token_in")


@query("segment chapter", f"SELECT c.id, c.ord, count(s.id) AS segment_count, count(*) FILTER (s.{DONE}) AS completed_count FROM chapter c LEFT JOIN segment s ON s.chapter_id = c.id GROUP BY 1, 2")
def chapter_progress(b):
    return P.chapter_progress(b.chapters(), b.segments()).select("id", "ord", "segment_count", "completed_count")


@query("segment project", f""", {DRAFTS}, m AS (SELECT coalesce(d.project_id, s.project_id) AS project_id, CASE WHEN s.src_hash = d.src_hash THEN s.status ELSE 'pending' END AS status, CASE WHEN s.src_hash = d.src_hash THEN s.token_in END AS token_in
    FROM draft d LEFT JOIN segment s ON s.project_id = d.project_id AND s.stable_key = d.stable_key)
  SELECT p.id AS project_id, count(*) FILTER (m.status = 'pending') AS pending, count(*) FILTER (m.status = 'done') AS done, count(m.project_id) AS total, count(*) FILTER (m.{DONE}) AS completed,
  CASE WHEN count(m.project_id) > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (m.{DONE}) / count(m.project_id), 2) ELSE 0 END AS percent, CAST(coalesce(sum(token_in), 0) AS BIGINT) AS token_in FROM project p LEFT JOIN m ON m.project_id = p.id GROUP BY 1""")
def kept_progress(b):
    """Counts kept from before a second import, and changed by what the merge did; SQL counts the merged ledger."""
    counts = P.status_counts(b.segments())
    now = P.apply_changes(counts, P.count_changes(L.ledger_merge(b.segments(), _drafts(b), NOW)))
    return P.progress_of_counts(b.projects(), now).select("project_id", "pending", "done", "total", "completed", "percent", "token_in")


@query("lang tm", RESULTS + """, h AS (SELECT l.project_id, count(*) AS n FROM lang l JOIN tm USING (src_hash, source_lang, target_lang) WHERE l.status = 'error' GROUP BY 1), a AS (SELECT project_id, count(*) AS n, count(*) FILTER (outcome = 'done') AS ok, count(*) FILTER (outcome = 'error') AS errors, sum(ord) FILTER (outcome = 'done') AS ti, sum(ord + 1) FILTER (outcome = 'done') AS tout FROM r WHERE outcome <> 'skipped' GROUP BY 1)
  SELECT coalesce(a.project_id, h.project_id) AS project_id, coalesce(a.n, 0) + coalesce(h.n, 0) AS total, coalesce(ok, 0) + coalesce(h.n, 0) AS done, coalesce(errors, 0) AS errors, coalesce(h.n, 0) AS tm_hits, CAST(coalesce(ti, 0) AS BIGINT) AS token_in, CAST(coalesce(tout, 0) AS BIGINT) AS token_out FROM a FULL JOIN h ON a.project_id = h.project_id""")
def run_stats(b):
    hits = M.tm_lookup(b.languages().where("status = 'error'"), b.memory()).where("hit")
    return P.run_stats(_results(b).where("outcome <> 'skipped'"), hits)


def _price(column: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(model), '{row[0]}') THEN CAST({row[column]} AS DOUBLE)" for row in P.PRICES) + " END"


@query("segment project chapter", f""", c AS (SELECT s.project_id, chapter_id, sum(CASE WHEN status IN ('pending', 'error') THEN length(source_text) ELSE 0 END) AS chars, count(*) FILTER (status IN ('pending', 'error')) AS n, least(sum(length(source_text) + 2), 8000) AS summary, any_value({blank('ch.summary')}) AS due FROM segment s JOIN chapter ch ON ch.id = s.chapter_id GROUP BY 1, 2),
  o AS (SELECT project_id, sum(chars) AS chars, sum(n) AS n, sum(CASE WHEN n > 0 AND due THEN summary ELSE 0 END) AS summary, count(*) FILTER (n > 0 AND due) AS k FROM c GROUP BY 1),
  t AS (SELECT p.id AS project_id, CAST(coalesce(n, 0) AS BIGINT) AS remaining, CAST(ceil(coalesce(chars, 0) / 4.0::DOUBLE * 1.2::DOUBLE) + CASE WHEN summaries THEN ceil(coalesce(summary, 0) / 4.0::DOUBLE) ELSE 0 END AS BIGINT) AS token_in, CAST(ceil(coalesce(chars, 0) / 3.0::DOUBLE) + CASE WHEN summaries THEN coalesce(k, 0) * 120 ELSE 0 END AS BIGINT) AS token_out,
  CASE WHEN input_price IS NOT NULL AND output_price IS NOT NULL THEN input_price ELSE {_price(1)} END AS a, CASE WHEN input_price IS NOT NULL AND output_price IS NOT NULL THEN output_price ELSE {_price(2)} END AS z FROM project p LEFT JOIN o ON o.project_id = p.id)
  SELECT project_id, remaining, token_in, token_out, round_even((token_in * a + token_out * z) / 1000000.0::DOUBLE, 6) AS cost FROM t""")
def cost_estimate(b):
    return P.cost_estimate(b.projects(), b.chapters(), b.segments())


@query("segment project", f"""SELECT count(*) AS total, count(*) FILTER (p.status IN ('translating', 'parsing')) AS active, count(*) FILTER (percent >= 100 OR p.status = 'done') AS completed
  FROM project p LEFT JOIN (SELECT project_id, 100.0 * count(*) FILTER ({DONE}) / count(*) AS percent FROM segment GROUP BY 1) s ON s.project_id = p.id""")
def library_metrics(b):
    return P.library_metrics(b.projects(), P.project_progress(b.projects(), b.segments()))


@query("log", "SELECT project_id, level, event_type, count(*) AS n FROM log GROUP BY ALL")
def log_summary(b):
    return P.log_summary(b.logs())


# --- QA ---------------------------------------------------------------------------------------------------------------------

MISSING = f"(NOT ({DONE}) OR {blank('target_text')})"


def compact(c: str) -> str:
    return f"length(regexp_replace({c}, '{WS}', '', 'g'))"




def _with_paths(b):
    return b.segments().withColumns({"source_type": F.when(F.col("ord") % 13 > 0, "md"), "file": F.lit(None).cast("string"), "xpath": F.lit(None).cast("string"), "token_index": F.when(F.col("ord") % 17 > 0, F.col("ord"))})


DETAILED = ("qa_missing", "qa_length_ratio", "qa_struct_path")


def _named(c: str):
    """A map as names and values in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")


def _rule(name: str):
    def run(b):
        return Q.row_issues(_with_paths(b), [name]).select(F.col("segment_id").alias("id"), "code", "severity", "detail", *([_named("details").alias("details")] if name in DETAILED else []))

    run.__name__ = name
    return run


NO_WORD = r"[^\pL\pM\pN\p{Pc}]"
RUN = f"(?:^|{NO_WORD})[A-Za-z][A-Za-z''’-]*(?:{WS}+[A-Za-z][A-Za-z''’-]*){{3}}{WS}+[A-Za-z](?:[A-Za-z''’-]*[A-Za-z])?(?:{NO_WORD}|$)"
ENGLISH = f"(NOT {MISSING} AND regexp_matches(target_text, '{RUN}') AND length(regexp_replace(target_text, '[^A-Za-z]', '', 'g')) / greatest({compact('target_text')}, 1) >= 0.35)"
BAD_PATH = "(ord % 13 = 0 OR ord % 17 = 0)"


query("segment", f"SELECT id, 'missing_translation' AS code, 'error' AS severity, status AS detail, 'status=' || status AS details FROM segment WHERE {MISSING}")(_rule("qa_missing"))
query("segment", f", q AS (SELECT *, {compact('source_text')} AS a, {compact('target_text')} AS z FROM segment WHERE NOT {MISSING}) SELECT id, 'length_ratio' AS code, 'warn' AS severity, printf('%.4f', round_even(z / a, 4)) AS detail, printf('maximum=3.0;minimum=0.3;ratio=%.4f;source_length=%d;target_length=%d', round_even(z / a, 4), a, z) AS details FROM q WHERE a >= 4 AND (z / a < 0.3 OR z / a > 3)")(_rule("qa_length_ratio"))
query("segment", f""", q AS (SELECT id, regexp_extract_all(source_text, '{PLACE}') AS a, regexp_extract_all(target_text, '{PLACE}') AS z FROM segment WHERE NOT {MISSING}),
  u AS (SELECT id, p, len(list_filter(a, lambda x: x = p)) - len(list_filter(z, lambda x: x = p)) AS n, list_position(a, p) AS place FROM (SELECT id, a, z, unnest(list_distinct(a)) AS p FROM q))
  SELECT id, 'placeholder_missing' AS code, 'warn' AS severity, string_agg(rtrim(repeat(p || '|', n), '|'), '|' ORDER BY place) AS detail FROM u WHERE n > 0 GROUP BY 1""")(_rule("qa_placeholders"))


#: Letters, marks, digits and joining signs beyond ASCII become "_", a word's character to RE2, so that its word bounds
#: are the Unicode ones; runs themselves hold none of them.
RUNS = f"regexp_extract_all(regexp_replace(target_text, '[^\\x{{00}}-\\x{{7F}}\\PL]|[^\\x{{00}}-\\x{{7F}}\\PM]|[^\\x{{00}}-\\x{{7F}}\\PN]', '_', 'g'), '\\b[A-Za-z][A-Za-z''’-]*(?:{WS}+[A-Za-z][A-Za-z''’-]*){{4,}}\\b')"


@query("segment", f"SELECT id, 'english_residual' AS code, 'warn' AS severity, array_to_string(list_slice({RUNS}, 1, 3), '|') AS detail FROM segment WHERE {ENGLISH}")
def qa_english_residual(b):
    return _rule("qa_english_residual")(b).select("id", "code", "severity", "detail")


query("segment", "SELECT id, 'invalid_structure_path' AS code, 'error' AS severity, CASE WHEN ord % 13 > 0 THEN 'md' ELSE '' END AS detail, 'source_type=' || CASE WHEN ord % 13 > 0 THEN 'md' ELSE '' END AS details FROM segment WHERE " + BAD_PATH)(_rule("qa_struct_path"))

MISMATCH = f"NOT CASE WHEN g.case_sensitive THEN contains(s.target_text, g.target_term) ELSE contains({FOLD('s.target_text')}, {FOLD('g.target_term')}) END"


@query("segment glossary", f"SELECT s.id, g.source_term AS detail FROM (FROM segment WHERE NOT {MISSING}) s JOIN glossary g ON {MATCH} AND {MISMATCH}")
def qa_glossary(b):
    return Q.glossary_issues(b.segments(), b.glossary()).select(F.col("segment_id").alias("id"), "detail")


@query("segment glossary project", f""", u AS (SELECT id, list_filter(list_distinct(a), lambda p: len(list_filter(a, lambda x: x = p)) > len(list_filter(z, lambda x: x = p))) AS lost FROM (SELECT id, regexp_extract_all(source_text, '{PLACE}') AS a, regexp_extract_all(target_text, '{PLACE}') AS z FROM segment WHERE NOT {MISSING})),
  i AS (SELECT project_id, 'error' AS severity FROM segment WHERE {MISSING} UNION ALL SELECT s.project_id, 'warn' FROM (FROM segment WHERE NOT {MISSING}) s JOIN glossary g ON {MATCH} AND {MISMATCH}
  UNION ALL SELECT project_id, 'warn' FROM (SELECT *, {compact('source_text')} AS a, {compact('target_text')} AS z FROM segment WHERE NOT {MISSING}) WHERE a >= 4 AND (z / a < 0.3 OR z / a > 3)
  UNION ALL SELECT project_id, 'warn' FROM segment WHERE {ENGLISH} UNION ALL SELECT project_id, 'error' FROM segment WHERE {BAD_PATH} UNION ALL SELECT s.project_id, 'warn' FROM segment s JOIN u ON u.id = s.id WHERE len(lost) > 0
  UNION ALL SELECT id, 'error' FROM project WHERE id % 3 = 0 UNION ALL SELECT id, 'error' FROM project WHERE id % 5 = 1 UNION ALL SELECT id, 'error' FROM project WHERE id % 7 = 0)
  SELECT project_id, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn, CAST(0 AS BIGINT) AS info, count(*) AS total FROM i GROUP BY 1""")
def qa_report(b):
    """All row rules, the glossary's, and the structure's: some projects' headings are lost, some have no documents, some no
    source."""
    p = b.projects().select(F.col("id").alias("project_id"), "title")
    files = p.select("project_id", F.concat(F.lit("# "), "title").alias("source"), F.when(F.col("project_id") % 3 == 0, F.col("title")).otherwise(F.concat(F.lit("# "), "title")).alias("target"))
    pages = p.where("project_id % 5 <> 1").select("project_id", F.concat(F.lit("<p>"), "title", F.lit("</p>")).alias("xhtml"))
    damage = Q.structure_issues(Q.markdown_structure(files), Q.xhtml_structure(b.projects(), pages), p.where("project_id % 7 = 0"))
    return Q.qa_report(Q.row_issues(_with_paths(b)), Q.glossary_issues(b.segments(), b.glossary()), damage)


@query("", """SELECT doc_id AS project_id, CASE WHEN doc_id % 3 = 0 THEN 'end' ELSE 'start' END AS place, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS more, CASE WHEN doc_id % 3 = 1 THEN 'h1' END AS source_token, CASE WHEN doc_id % 3 = 0 THEN 'h1' ELSE 'h2' END AS target_token
  FROM documents WHERE text IS NOT NULL AND doc_id % 3 < 2""")
def qa_markdown_structure(b):
    """Of three files one has gained a heading at its end, and one's first heading has sunk."""
    f = _markdown_files(b).withColumnRenamed("text", "source")
    k = F.col("project_id") % 3
    f = f.withColumn("target", F.when(k == 0, F.concat("source", F.lit("\n\n# extra"))).when(k == 1, F.concat(F.lit("#"), "source")).otherwise(F.col("source")))
    place = F.when(F.col("first_difference") == F.col("source_length"), "end").when(F.col("first_difference") == 0, "start")
    return Q.markdown_structure(f).select("project_id", place.alias("place"), (F.col("target_length") - F.col("source_length")).alias("more"), "source_token", "target_token")


@query("", """WITH d AS (SELECT CAST(substr(source, 4) AS BIGINT) AS project_id, doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 3 > 0), p AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id FROM documents UNION ALL SELECT 1000)
  SELECT p.id AS project_id, count(doc_id) AS documents, count(*) FILTER (doc_id % 5 = 0) AS damaged, count(doc_id) = 0 OR count(*) FILTER (doc_id % 5 = 0) > 0 AS error FROM p LEFT JOIN d ON d.project_id = p.id GROUP BY 1""")
def qa_xhtml_documents(b):
    """Pages made from two thirds of the documents, every fifth with a tag that isn't closed; one project has none."""
    plain = F.regexp_replace("html", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", " ")  # no characters of XML
    pages = _xhtml_files(b).where("page_id % 3 > 0").select("project_id", F.when(F.col("page_id") % 5 == 0, F.replace(plain, F.lit("</body>"), F.lit("<p></body>"))).otherwise(plain).alias("xhtml"))
    return Q.xhtml_structure(b.projects().select("id").union(b.spark.range(1000, 1001)), pages)


@query()
def qa_xhtml_structure(b):
    pages = b.table("pages").select((F.col("page_id") % 20).alias("project_id"), F.col("html").alias("xhtml"))
    return Q.xhtml_structure(b.projects(), pages)


# --- pages of rows ----------------------------------------------------------------------------------------------------------


@query("segment", ", f AS (SELECT * FROM segment WHERE project_id = 3 AND status IN ('done', 'reviewed') AND (contains(lower(source_text), 'th') OR coalesce(contains(lower(target_text), 'th'), false))) SELECT id, ord, (SELECT count(*) FROM f) AS total FROM f ORDER BY ord, id LIMIT 20 OFFSET 20")
def segment_page(b):
    return S.segment_page(b.segments(), 3, statuses=["done", "reviewed"], search="TH", page=2, size=20).select("id", "ord", F.col("total").cast("long").alias("total"))


@query("segment project", "SELECT p.id, p.title, count(s.id) AS segments FROM project p LEFT JOIN segment s ON s.project_id = p.id GROUP BY ALL ORDER BY any_value(p.updated_at) DESC, p.id DESC LIMIT 5 OFFSET 5")
def project_page(b):
    return S.project_page(b.projects(), P.project_progress(b.projects(), b.segments()), page=2, size=5).select("id", "title", "segments")


@query("segment", "SELECT id, project_id, ord, (SELECT count(*) FROM segment) AS total, (SELECT (count(*) + 99) // 100 FROM segment) AS pages FROM segment ORDER BY ord DESC, id LIMIT 100 OFFSET 1000")
def segment_range_page(b):
    """A page far down all segments, found by the counts of ranges."""
    return S.page_of(b.segments(), [F.desc("ord"), F.col("id")], 11, 100, shallow=0).select("id", "project_id", "ord", "total", "pages")


@query("segment", ", f AS (SELECT * FROM segment WHERE project_id = 3 AND (contains(lower(source_text), 'the ') OR coalesce(contains(lower(target_text), 'the '), false))) SELECT id, ord, (SELECT count(*) FROM f) AS total FROM f ORDER BY ord, id LIMIT 20")
def segment_page_indexed(b):
    """A page of what an index finds."""
    path = shared(b.spark, "grams")
    S.write_gram_index(b.segments(), path, ["source_text", "target_text"], block=1000)
    return S.segment_page(b.segments(), 3, search="THE ", size=20, index=path).select("id", "ord", F.col("total").cast("long").alias("total"))


@query("tm", """, f AS (SELECT * FROM tm WHERE source_lang = 'en' AND (contains(lower(source_text), 'ther') OR contains(lower(target_text), 'ther')))
  SELECT src_hash, hit_count, (SELECT count(*) FROM f) AS total FROM f ORDER BY hit_count DESC, updated_at DESC, src_hash DESC LIMIT 50""")
def tm_page_indexed(b):
    """A page of the memory's entries that an index finds."""
    path = shared(b.spark, "grams")
    S.write_gram_index(b.memory(), path, ["source_text", "target_text"], key="src_hash", block=1000)
    return M.tm_page(b.memory(), "en", "zh-CN", "Ther", index=path).select("src_hash", "hit_count", F.col("total").cast("long").alias("total"))


@query("glossary", "SELECT id, source_term FROM glossary WHERE enabled AND (contains(lower(source_term), 'ion') OR contains(lower(target_term), 'ion'))")
def glossary_search_indexed(b):
    path = shared(b.spark, "grams")
    S.write_gram_index(b.glossary(), path, ["source_term", "target_term"], block=200)
    return G.glossary_search(b.glossary(), search="Ion", enabled_only=True, index=path).select("id", "source_term")


@query("segment", "SELECT id, source_text FROM segment WHERE contains(lower(source_text), 'then') OR coalesce(contains(lower(target_text), 'then'), false)")
def indexed_search(b):
    """All segments through an index of three-letter grams that is written here."""
    path = shared(b.spark, "grams")
    S.write_gram_index(b.segments(), path, ["source_text", "target_text"], block=1000)
    return S.indexed_search(b.spark, path, "Then").select("id", "source_text")


@query("log", "SELECT id, event_type FROM log WHERE project_id = 4 AND level = 'error' ORDER BY id DESC LIMIT 50")
def log_page(b):
    return S.log_page(b.logs(), 4, "error").select("id", "event_type")


@query("log", ", a AS (SELECT id, 0 AS p FROM log WHERE id % 2 = 0 UNION ALL SELECT id, 1 FROM log WHERE id % 3 = 0) SELECT id, max(p) AS page FROM a GROUP BY 1")
def merge_log_pages(b):
    logs = b.logs().select("id")
    return S.merge_log_pages([logs.where("id % 2 = 0").withColumn("page", F.lit(0)), logs.where("id % 3 = 0").withColumn("page", F.lit(1))])


# --- rendering and export -----------------------------------------------------------------------------------------------------


BRACKETS = "translate(source_text, '[]()', '{}{}')"


@query("segment", f"SELECT id, 'T [x](' || CASE WHEN ord % 3 = 0 THEN 'broken' ELSE 'u' || ord END || ') ' || {BRACKETS} || ' [y](' || CASE WHEN ord % 3 = 0 THEN 'lost' ELSE 'v ' || id END || ')' AS fixed FROM segment")
def restore_links(b):
    """Segments between two links each; of every third one a link is missing in the source, so the target stays."""
    text = F.translate("source_text", "[]()", "{}{}")
    source = F.concat(F.lit("[a](u"), F.col("ord").cast("string"), F.lit(") "), text, F.when(F.col("ord") % 3 != 0, F.concat(F.lit(" [b](v "), F.col("id").cast("string"), F.lit(")"))).otherwise(""))
    return b.segments().select("id", R.restore_links(source, F.concat(F.lit("T [x](broken) "), text, F.lit(" [y](lost)"))).alias("fixed"))


def _translated_blocks(b):
    """Blocks with an even token_index have a target."""
    blocks = B.markdown_blocks(_markdown_files(b), ["project_id"]).where("translatable")
    return blocks.withColumns({"inline": F.col("text"), "translated": F.col("token_index") % 2 == 0, "target": F.when(F.col("token_index") % 2 == 0, F.concat(F.lit("T"), F.col("token_index").cast("string")))})


@query("", PIECES + " SELECT project_id, CAST(token_index AS INT) AS token_index, CAST(a AS INT) AS start, CAST(a + m AS INT) AS \"end\" FROM b WHERE kind <> 'code'")
def locate_inline(b):
    return R.locate_inline(_markdown_files(b), _translated_blocks(b), "project_id")


@query("segment", "SELECT id, CASE WHEN ord % 2 = 0 THEN '<br /><span class=\"translation\">' || replace(source_text, '|', '\\|') || '</span>' ELSE chr(10) || chr(10) || '> ' || source_text END AS suffix FROM segment")
def format_suffix(b):
    return b.segments().select("id", R.format_suffix(F.col("source_text"), F.col("ord") % 2 == 0).alias("suffix"))


def _cell_sql(token: str) -> str:
    return f"CASE WHEN ({token}) % 2 = 0 THEN '<br /><span class=\"translation\">T' || ({token}) || '</span>' ELSE '' END"


@query("", PIECES + f""", e AS (SELECT project_id, i, CASE WHEN n = 4 THEN '| a' || {_cell_sql('t')} || ' | b' || {_cell_sql('t + 1')} || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || cell || {_cell_sql('t + 2')} || ' | [l](http://x.y/' || link || {_cell_sql('t + 3')} || ' |'
    WHEN n = 1 AND kind <> 'code' AND t % 2 = 0 THEN piece || chr(10) || chr(10) || '> T' || t ELSE piece END AS piece FROM r)
  SELECT project_id, string_agg(piece, chr(10) || chr(10) ORDER BY i) AS rendered FROM e GROUP BY 1""")
def render_markdown(b):
    return R.render_markdown(_markdown_files(b), _translated_blocks(b), "project_id").select("project_id", "rendered")


def _bare_cell(token: str, own: str) -> str:
    return f"CASE WHEN ({token}) % 2 = 0 THEN 'T' || ({token}) ELSE {own} END"


@query("", PIECES + f""", e AS (SELECT project_id, i, CASE WHEN n = 4 THEN '| ' || {_bare_cell('t', "'a'")} || ' | ' || {_bare_cell('t + 1', "'b'")} || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_bare_cell('t + 2', 'cell')} || ' | ' || {_bare_cell('t + 3', "'[l](http://x.y/' || link")} || ' |'
    WHEN n = 1 AND kind <> 'code' AND t % 2 = 0 THEN CASE kind WHEN 'h1' THEN '# ' WHEN 'h2' THEN '## ' WHEN 'list_item' THEN '- ' WHEN 'blockquote' THEN '> ' ELSE '' END || 'T' || t ELSE piece END AS piece FROM r)
  SELECT project_id, string_agg(piece, chr(10) || chr(10) ORDER BY i) AS rendered FROM e GROUP BY 1""")
def render_markdown_target(b):
    """Books in the target language alone: what isn't translated keeps its source."""
    blocks = _translated_blocks(b).withColumn("target", F.coalesce("target", "inline"))
    return R.render_markdown(_markdown_files(b), blocks, "project_id", "target_only").select("project_id", "rendered")


def _xhtml_files(b, code: bool = True):
    """Each document as an XHTML page, a line an element: headings, items, quotes, code and paragraphs by turns."""
    wrap = lambda a, x, z: F.concat(F.lit(a), x, F.lit(z))

    def element(x, i):
        esc = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        kinds = [(i == 0, "<h1>", "</h1>"), (i % 7 == 1, "<ul><li>", "</li></ul>"), (i % 7 == 2, "<blockquote><p>", "</p></blockquote>"), (i % 7 == 3, "<pre><code>", "</code></pre>"), (i % 7 == 4, "<h2>", "</h2>"), (i % 7 == 5, "<p>a <code>x &lt; y</code> " if code else "<p>", "</p>")]
        out = wrap("<p>", esc, "</p>")
        for when, a, z in reversed(kinds):
            out = F.when(when, wrap(a, esc, z)).otherwise(out)
        return out

    body = F.array_join(F.transform(F.split("text", "\n"), element), "\n")
    return b.table("documents").where("text is not null").select(F.col("doc_id").alias("page_id"), F.substring("source", 4, 10).cast("long").alias("project_id"), wrap("<html><head><title>t</title></head><body>", body, "</body></html>").alias("html"))


#: The pages' elements: place, kind, trimmed text.
ELEMENTS = f"""WITH x AS (SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS project_id, i, regexp_replace(parts[i + 1], '^{WS}+|{WS}+$', '', 'g') AS t, parts[i + 1] AS raw, CASE WHEN i = 0 THEN 0 WHEN i % 7 BETWEEN 1 AND 5 THEN i % 7 ELSE 6 END AS k
  FROM (SELECT doc_id, source, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)))"""


@query("", ELEMENTS + """ SELECT doc_id AS page_id, CAST(i AS INT) AS token_index, ['heading', 'list_item', 'blockquote', 'code', 'heading', 'para', 'para'][k + 1] AS kind, CASE k WHEN 3 THEN '⟦EPUBCODE0000⟧' WHEN 5 THEN rtrim('a ⟦EPUBCODE0000⟧ ' || t) ELSE t END AS text, k = 5 OR k <> 3 AND t <> '' AS translatable FROM x""")
def xhtml_documents(b):
    """The blocks of pages made from documents."""
    return B.xhtml_blocks(_xhtml_files(b), ["page_id"]).select("page_id", "token_index", "kind", "text", "translatable")


@query("", ELEMENTS + """, h AS (SELECT project_id, doc_id, first(t ORDER BY i) FILTER (k IN (0, 4) AND t <> '') AS chapter_title FROM x GROUP BY 1, 2), p AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS project_id FROM documents UNION ALL SELECT 1000)
  SELECT p.project_id, CASE WHEN doc_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY p.project_id ORDER BY doc_id) - 1 END AS chapter_ord, chapter_title, doc_id || '.xhtml' AS chapter_href FROM p LEFT JOIN h ON h.project_id = p.project_id""")
def epub_chapters(b):
    """A chapter for each document of a book, and an empty one for a book without any."""
    pages = _xhtml_files(b).withColumn("file", F.concat(F.col("page_id").cast("string"), F.lit(".xhtml"))).withColumnRenamed("page_id", "spine_ord")
    blocks = SG.assign_epub_chapters(B.xhtml_blocks(pages, ["project_id", "spine_ord", "file"]))
    books = b.projects().select(F.col("id").alias("project_id")).union(b.spark.range(1000, 1001))
    return SG.chapter_table(books, blocks).withColumn("chapter_ord", F.col("chapter_ord").cast("long"))


def _clone_sql(a: str, z: str, attrs: str, again: str = "") -> str:
    return f"'<{a}>' || e || '</{z}>' || CASE WHEN t <> '' THEN '<{again or a}{attrs}>' || u || '</{z}>' ELSE '' END"


CLONED = ' class="translation" lang="zh-CN"'


@query("", ELEMENTS + f""", y AS (SELECT *, replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e, replace(replace(replace(replace(upper(t), chr(7838), 'SS'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS u FROM x)
  SELECT doc_id AS page_id, '<html><head><title>t</title><style type="text/css" data-foliant="true">{R.STYLE}</style></head><body>' || string_agg(CASE k WHEN 0 THEN {_clone_sql('h1', 'h1', CLONED)} WHEN 1 THEN '<ul>' || {_clone_sql('li', 'li', CLONED)} || '</ul>'
    WHEN 2 THEN '<blockquote><p>' || e || '</p></blockquote>' || CASE WHEN t <> '' THEN '<blockquote{CLONED}><p>' || u || '</p></blockquote>' ELSE '' END WHEN 3 THEN '<pre><code>' || e || '</code></pre>' WHEN 4 THEN {_clone_sql('h2', 'h2', CLONED)} ELSE {_clone_sql('p', 'p', CLONED)} END, chr(10) ORDER BY i) || '</body></html>' AS xhtml FROM y GROUP BY 1""")
def render_xhtml_documents(b):
    """Pages made from documents with each translatable element's clone in capitals after it."""
    pages = _xhtml_files(b, code=False)
    blocks = B.xhtml_blocks(pages, ["page_id"]).select("page_id", "token_index", "tag", F.when(F.col("translatable"), F.upper("text")).alias("target"), F.lit(None).cast("array<string>").alias("slots"))
    return R.render_xhtml(pages, blocks, "page_id").select("page_id", "xhtml")


@query()
def render_xhtml(b):
    """Upper-cased blocks beside their sources; what goes where is held against expected pages in the tests."""
    blocks = B.xhtml_blocks(b.table("pages"), ["page_id"]).select("page_id", "token_index", "tag", F.when(F.col("translatable"), F.upper("text")).alias("target"), F.lit(None).cast("array<string>").alias("slots"))
    return R.render_xhtml(b.table("pages").where("html is not null"), blocks, "page_id").select("page_id", "xhtml")


def _book_parts(b):
    """Markdown books in parts, a chapter each, and EPUBs with a document for each chapter."""
    kinds = b.projects().select(F.col("id").alias("project_id"), "source_type")
    rows = b.segments().groupBy("project_id", F.col("chapter_id").alias("part")).agg(F.array_sort(F.collect_list(F.struct("ord", "source_text"))).alias("r")).join(kinds, "project_id")
    text = rows.select("project_id", "part", "source_type", F.array_join(F.transform("r", lambda x: F.concat(x["source_text"], F.lit("\n"))), "").alias("text"))
    pages = text.where("source_type = 'epub'").select("project_id", F.col("part").alias("ord"), F.concat(F.col("part").cast("string"), F.lit(".xhtml")).alias("file"), F.col("text").alias("html"))
    plain = text.where("source_type = 'md'").select("project_id", "part", F.lit(None).cast("string").alias("member"), "text")
    return plain.unionByName(D.package_members(pages))


@query("segment project", """, t AS (SELECT project_id, string_agg(source_text || chr(10), '' ORDER BY chapter_id, ord) AS text, count(DISTINCT chapter_id) AS n FROM segment GROUP BY 1)
  SELECT project_id, printf('book-%02d-a-b-p', project_id) || project_id || '-20260601.' || source_type AS filename, CASE source_type WHEN 'epub' THEN 'application/epub+zip' ELSE 'text/markdown' END AS media_type, n + CASE source_type WHEN 'epub' THEN 2 ELSE 0 END AS parts,
  'ready' AS status, true AS as_said, sha256(text) AS text_sha256 FROM t JOIN project p ON p.id = t.project_id""")
def export_sink(b):
    """Every book as a file, read again: it has the size and digest that the manifest says, and its whole text."""
    path = shared(b.spark, "export")
    said = D.export_sink(b.projects(), _book_parts(b), path, "20260601")
    name = F.regexp_extract("path", "[^/]+$", 0).alias("filename")
    files = D.read_files(b.spark, f"{path}/books").select(name, F.octet_length("content").cast("long").alias("n"), F.sha2("content", 256).alias("digest"), F.when(~F.col("path").endswith(".epub"), F.col("content")).alias("plain"))
    inner = K.read_epubs(b.spark, f"{path}/books").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("spine_ord", "html"))).alias("d"))
    both = said.join(files, "filename").join(inner, "filename", "left")
    text = F.coalesce("plain", F.encode(F.array_join(F.transform("d", lambda x: x["html"]), ""), "UTF-8"))
    return both.select("project_id", "filename", "media_type", "parts", "status", ((F.col("size") == F.col("n")) & (F.col("sha256") == F.col("digest"))).alias("as_said"), F.sha2(text, 256).alias("text_sha256"))


# --- sources ------------------------------------------------------------------------------------------------------------------


def _files(b):
    ext = F.element_at(F.array(*map(F.lit, ["md", "MARKDOWN", "txt"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return b.table("documents").where("text is not null").select("doc_id", F.concat(F.lit("/b/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.encode(F.concat(F.when(F.col("doc_id") % 2 == 0, "﻿").otherwise(""), "text"), "UTF-8").alias("content"))


@query("", "SELECT '/b/' || doc_id || '.' || CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'MARKDOWN' ELSE 'txt' END AS path, CASE WHEN doc_id % 3 < 2 THEN text END AS text FROM documents WHERE text IS NOT NULL")
def read_markdown(b):
    return D.read_markdown(_files(b)).select("path", "text")


@query("", "SELECT '/b/' || doc_id AS path, sha256(text) AS sha256, strlen(text) AS size FROM documents WHERE text IS NOT NULL")
def source_fingerprint(b):
    f = b.table("documents").where("text is not null").select(F.concat(F.lit("/b/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return D.source_fingerprint(f)


@query("project", """, n AS (SELECT source_path, source_lang, target_lang, fingerprint AS old FROM project QUALIFY row_number() OVER (PARTITION BY source_path, source_lang, target_lang ORDER BY id DESC) = 1),
  w AS (SELECT DISTINCT source_path, source_lang, target_lang FROM project), c AS (SELECT w.*, 'fp' || CAST(substr(source_path, 8) AS BIGINT) AS fingerprint FROM w UNION ALL SELECT '/new', 'en', 'zh-CN', 'fp')
  SELECT c.source_path, c.source_lang, c.fingerprint FROM c LEFT JOIN n USING (source_path, source_lang, target_lang) WHERE c.fingerprint IS DISTINCT FROM n.old""")
def changed_sources(b):
    p = b.projects()
    now = p.select("source_path", "source_lang", "target_lang").distinct().withColumn("fingerprint", F.concat(F.lit("fp"), F.substring("source_path", 8, 5)))
    new = p.limit(1).select(F.lit("/new").alias("source_path"), F.lit("en").alias("source_lang"), F.lit("zh-CN").alias("target_lang"), F.lit("fp").alias("fingerprint"))
    return D.changed_sources(now.union(new), p).select("source_path", "source_lang", "fingerprint")


def _archives(b) -> str:
    """A folder with an EPUB for each ten pages, written by the book sink; every tenth isn't an archive."""
    path = shared(b.spark, "archives")
    place = Window.partitionBy("project_id").orderBy("page_id")
    pages = b.table("pages").select(F.floor(F.col("page_id") / 10).alias("project_id"), "page_id", "html").withColumn("ord", F.row_number().over(place) - 1)
    pages = pages.select("project_id", "ord", F.concat(F.col("ord").cast("string"), F.lit(".xhtml")).alias("file"), "html")
    good = D.package_members(pages.where("project_id % 10 <> 9")).withColumn("media_type", F.lit(K.EPUB))
    bad = pages.where("project_id % 10 = 9 AND ord = 0").select("project_id", F.lit(0).cast("long").alias("part"), F.lit(None).cast("string").alias("member"), F.lit("no zip").alias("text"), F.lit("text/plain").alias("media_type"))
    rows = good.unionByName(bad)
    K.write_books(rows.select("project_id", F.concat(F.col("project_id").cast("string"), F.lit(".epub")).alias("filename"), "media_type", "part", "member", F.encode("text", "UTF-8").alias("content")), path)
    return f"{path}/books"


@query("", "SELECT (page_id // 10) || '.epub' AS file, CASE WHEN any_value(page_id // 10) % 10 = 9 THEN 0 ELSE count(*) + 3 END AS members, CASE WHEN any_value(page_id // 10) % 10 = 9 THEN 'not an archive' ELSE 'ok' END AS verdict FROM pages GROUP BY 1")
def screen_archives(b):
    found = D.screen_archives(K.list_archives(b.spark, _archives(b)))
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "members", "verdict")


@query("", """SELECT (page_id // 10) || '.epub' AS book, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS INT) AS spine_ord, 'OEBPS/' || (row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1) || '.xhtml' AS file, coalesce(html, '') AS html, NULL AS reason FROM pages WHERE (page_id // 10) % 10 <> 9
  UNION ALL SELECT DISTINCT (page_id // 10) || '.epub', NULL, NULL, NULL, 'BadZipFile: File is not a zip file' FROM pages WHERE (page_id // 10) % 10 = 9""")
def read_epub(b):
    """Every document of every book, and a reason for what is none."""
    return K.read_epubs(b.spark, _archives(b)).select(F.regexp_extract("path", "[^/]+$", 0).alias("book"), "spine_ord", "file", "html", "reason")


@query("segment", "SELECT id, project_id, stable_key, ord, CASE WHEN project_id % 4 = 1 THEN source_text || '!' ELSE source_text END AS source_text, target_text, status FROM segment WHERE NOT (project_id % 4 = 1 AND ord % 2 = 1)")
def write_ledger(b):
    """The ledger written, some projects written again with fewer and other rows, and all of it read."""
    path = shared(b.spark, "ledger")
    LD.write_ledger(b.segments(), path, 8, 4)
    again = b.segments().where("project_id % 4 = 1 AND ord % 2 = 0").withColumn("source_text", F.concat("source_text", F.lit("!")))
    LD.write_ledger(again, path)
    return LD.read_ledger(b.spark, path).select("id", "project_id", "stable_key", "ord", "source_text", "target_text", "status")


@query("segment", f""", {DRAFTS}, e AS (SELECT * FROM draft WHERE project_id % 3 = 0)
  SELECT coalesce(d.project_id, s.project_id) AS project_id, coalesce(d.stable_key, s.stable_key) AS stable_key, coalesce(d.source_text, s.source_text) AS source_text, CASE WHEN d.stable_key IS NULL OR s.src_hash = d.src_hash THEN s.target_text END AS target_text, CASE WHEN d.stable_key IS NULL OR s.src_hash = d.src_hash THEN s.status ELSE 'pending' END AS status
  FROM segment s FULL JOIN e d ON s.project_id = d.project_id AND s.stable_key = d.stable_key WHERE d.stable_key IS NOT NULL OR s.project_id % 3 <> 0""")
def merge_ledger(b):
    """A second import of every third project merged into the stored ledger; the others stay as they are."""
    path = shared(b.spark, "ledger")
    LD.write_ledger(b.segments(), path, 8, 4)
    LD.merge_ledger(b.spark, path, _drafts(b).where("project_id % 3 = 0"), NOW)
    return LD.read_ledger(b.spark, path).select("project_id", "stable_key", "source_text", "target_text", "status")


# --- logs and streams -----------------------------------------------------------------------------------------------------------


@query("log", "SELECT id, CASE WHEN level IN ('debug', 'info', 'warning', 'error') THEN level ELSE 'info' END AS level, trim(event_type) AS event_type, CASE WHEN trim(message) = '' THEN 'Runtime event' ELSE substr(trim(message), 1, 1000) END AS message FROM log")
def ingest_logs(b):
    return LG.ingest_logs(b.logs()).select("id", "level", "event_type", "message")


CUT = "(SELECT strftime(max(ts) - INTERVAL 10 DAY, '%Y-%m-%dT%H:%M:%S') FROM events)"


def _cutoff(b) -> str:
    return b.table("events").agg(F.date_format(F.max("ts") - F.expr("interval 10 days"), "yyyy-MM-dd'T'HH:mm:ss").alias("c")).first()["c"]


@query("log", f"SELECT id, project_id FROM log WHERE created_at >= {CUT} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) <= 100")
def trim_logs(b):
    return LG.trim_logs(b.logs(), _cutoff(b), 100).select("id", "project_id")


@query("log", "SELECT id, project_id FROM log WHERE project_id % 2 = 1")
def clear_logs(b):
    return LG.clear_logs(b.logs(), b.projects().where("id % 2 = 0").select(F.col("id").alias("project_id"))).select("id", "project_id")


@query("log", f"SELECT count(*) FILTER (created_at >= {CUT}) AS kept, count(*) FILTER (created_at < {CUT}) AS removed FROM log")
def retain_audit(b):
    return LG.retain_audit(b.logs(), _cutoff(b))


@query("log", "SELECT id, project_id FROM (FROM log QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) <= 500) WHERE id > 5000")
def event_history(b):
    return LG.event_history(b.logs(), 5000).select("id", "project_id")


def _shared(b, name: str) -> str:
    return shared(b.spark, name)


def _streamed(b, transform, mode: str) -> DataFrame:
    """All events through a stream that ends with the data. Its rows and its state go to the shared folder."""
    source = Base(b.spark, b.dir)
    parts = _is_folder(b, "events")
    glob, path = ("*.parquet", f"{b.dir}/events.parquet") if parts else ("events.parquet", b.dir)
    schema = b.table("events").schema
    source.table = lambda _: b.spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    root = _shared(b, "stream")
    out, changed = f"{root}/out", transform(source.events())
    writer = changed.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").outputMode(mode).start(out)
    else:  # each batch has a folder of its own, so that one that is done again replaces itself

        def put(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

        run = writer.foreachBatch(put).outputMode(mode).start()
    run.awaitTermination()
    if mode == "append":
        return b.spark.read.schema(changed.schema).parquet(out)
    rows = b.spark.read.schema(changed.schema.add("batch", "long")).parquet(out)
    if mode == "complete":  # the last batch has all rows
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return rows.drop("batch")


def _is_folder(b, name: str) -> bool:
    path = b.spark._jvm.org.apache.hadoop.fs.Path(f"{b.dir}/{name}.parquet")
    return path.getFileSystem(b.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


@query("", "SELECT event_id AS id, user_id % 20 AS project_id FROM events WHERE event_id > 10")
def stream_dedup(b):
    return _streamed(b, lambda e: ST.stream_dedup(e.union(e), after=10), "append").select("id", "project_id")


@query("", "SELECT user_id % 20 AS project_id, count(*) FILTER (event_id % 6 = 2) AS done, count(*) FILTER (event_id % 6 = 3) AS errors, count(*) AS total FROM events GROUP BY 1")
def stream_progress(b):
    return _streamed(b, ST.stream_progress, "complete")


@query("", """WITH e AS (SELECT user_id AS segment_id, event_id AS id, event_id % 6 AS k FROM events), r AS (SELECT segment_id, max(id) FILTER (k IN (4, 5)) AS cut, max(id) AS last FROM e GROUP BY 1)
  SELECT e.segment_id, any_value(last) AS last_id, CASE WHEN any_value(cut) % 6 = 5 THEN 'T' || any_value(cut) ELSE '' END || coalesce(string_agg('d' || id, '' ORDER BY id) FILTER (k IN (0, 1) AND id > coalesce(cut, -1)), '') AS text FROM e JOIN r USING (segment_id) GROUP BY 1""")
def stream_segment_text(b):
    ST.state_store(b.spark)
    out = _streamed(b, ST.stream_segment_text, "update")
    return out.groupBy("segment_id").agg(F.max_by(F.struct("last_id", "text"), "last_id").alias("m")).select("segment_id", "m.last_id", "m.text")


# --- end to end -----------------------------------------------------------------------------------------------------------------


def translation_plan(b) -> DataFrame:
    """Documents to segments, memory hits and leaders, summed up by project: one lookup, whose equal texts of a project are
    one row from there on."""
    found = M.tm_lookup(L.select_candidates(b.languages()), b.memory())
    texts = written(found.groupBy("project_id", *M.KEYS, "hit").agg(F.count("*").alias("n"), F.min("ord").alias("ord")), "plan")
    leads = texts.where("NOT hit").groupBy(*M.KEYS).agg(F.min(F.struct("project_id", "ord"))["project_id"].alias("project_id"))
    leads = leads.groupBy("project_id").agg(F.count("*").alias("leaders"))
    counted = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    own = texts.groupBy("project_id").agg(F.sum("n").cast("long").alias("candidates"), counted(F.col("hit")).alias("hits"), counted(~F.col("hit")).alias("missed"))
    return own.join(leads, "project_id", "left").na.fill(0)


query("lang tm", """, c AS (SELECT l.*, t.src_hash IS NOT NULL AS hit FROM lang l LEFT JOIN tm t USING (src_hash, source_lang, target_lang) WHERE status IN ('pending', 'error')), m AS (SELECT *, row_number() OVER (PARTITION BY source_lang, target_lang, src_hash ORDER BY project_id, ord, id) = 1 AS leader FROM c WHERE NOT hit)
  SELECT project_id, count(*) AS candidates, count(*) FILTER (hit) AS hits, count(*) - count(*) FILTER (hit) AS missed, coalesce((SELECT count(*) FROM m WHERE m.project_id = c.project_id AND leader), 0) AS leaders FROM c GROUP BY 1""")(translation_plan)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation_plan(Base(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
