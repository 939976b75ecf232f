"""Context windows and translation requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.helpers import clip_context, mask_markdown, mask_plain, mask_slots
from . import glossary as G

# Display names of languages and the wording of prompts.
LANGUAGES = {"en": "英文", "zh": "中文", "zh-cn": "简体中文", "zh-tw": "繁体中文", "ja": "日文", "ko": "韩文", "fr": "法文", "de": "德文", "es": "西班牙文"}
PROMPT = "你是一名专业的书籍译者。请把{source_lang}原文翻译成{target_lang}。译文必须忠实、准确、自然、流畅，并保持原作语气、叙事视角和段落功能。严格遵守上下文中的术语表，同一人名、地名和概念前后一致。完整保留原文中的 Markdown 标记、HTML/XML 标记、URL、代码、占位符（例如 {name}、%s、{{value}}）和形如 ⟦...⟧ 的保护标记。只输出当前待译原文的译文，不要解释、不要复述上下文、不要添加标题或引号。"
GUIDANCE, GLOSSARY, HISTORY, SUMMARY = "【额外要求】", "【术语表（必须遵守）】", "【前文对照】", "【本章摘要】"
SOURCE, TARGET = "原文：", "译文："
NO_CONTEXT, CONTEXT, TASK = "（无额外上下文）", "【上下文，仅供理解，不要翻译或复述】", "【待译原文】"
DEFAULT_MODEL, MOST_CONCURRENT = "gpt-5-mini", 8
RUN = 10_000  # ordinals that one task sorts at once
LABELS = f"\n{SOURCE}\n{TARGET}"  # what a pair has beside its texts


def _ideographs(text: str) -> int:
    return sum("㐀" <= c <= "鿿" for c in text)


CJK_LABELS = _ideographs(LABELS)


def rolling_context(segments: DataFrame, n: int = 3) -> DataFrame:
    """(id, previous): the last ``n`` completed segments with a target before each segment of its project, oldest
    first; blank targets take their place and are dropped."""
    pairs = F.transform("previous", lambda p: F.struct(p["o"].alias("o"), p["s"].alias("s"), p["t"].alias("t")))
    return recent(segments, n).select("id", pairs.alias("previous"))


def recent(segments: DataFrame, n: int = 3, keep: tuple[str, ...] = (), asked: DataFrame | None = None) -> DataFrame:
    """(id, keep.., previous) as in ``rolling_context``, null without any, each pair with what it costs in a context: ``c``
    CJK characters of ``n``. Runs of ordinals are sorted each by itself, and the few pairs that a run's first rows take
    from the runs before it are joined by run: a text is shuffled once and costed once, and no list grows with the
    project. With ``asked`` (id, project_id, ord, keep..) only its rows get pairs: they stand among those that can be one,
    and neither other texts nor other rows' pairs move."""
    if not 0 <= n <= 12:
        raise ValueError("0 to 12 previous segments")
    ready = T.completed(F.col("status")) & F.col("target_text").isNotNull()
    s, t = F.col("source_text"), F.col("target_text")
    pair = F.struct(F.col("ord").alias("o"), s.alias("s"), t.alias("t"), (cjk(s) + cjk(t) + CJK_LABELS).cast("long").alias("c"), (F.length(s) + F.length(t) + len(LABELS)).cast("long").alias("n"))
    run = F.floor(F.col("ord") / RUN).alias("run")
    place = ["id", "project_id", "ord"]
    slim = segments.select(*place, run, ready.alias("ready"))
    rows = segments.select(*place, *keep, run, F.when(ready, pair).alias("_pair"), F.lit(True).alias("_asked")) if asked is None else None
    if rows is None:
        made = segments.where(ready).select(*place, run, pair.alias("_pair"))
        kind = made.schema["_pair"].dataType
        rows = made.select(*place, *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in keep], "run", "_pair", F.lit(False).alias("_asked"))
        rows = rows.unionByName(asked.select(*place, *keep, run, F.lit(None).cast(kind).alias("_pair"), F.lit(True).alias("_asked")))
        slim = slim.where("ready").unionByName(asked.select(*place, run, F.lit(False).alias("ready")))
    if n == 0:
        return rows.where("_asked").select("id", *keep, F.array().cast(f"array<{rows.schema['_pair'].dataType.simpleString()}>").alias("previous"))
    rows = rows.repartition("project_id", "run")
    lags = [F.expr(f"lag(_pair, {k}) IGNORE NULLS OVER (PARTITION BY project_id, run ORDER BY ord, id, _asked DESC)") for k in range(n, 0, -1)]
    wide = rows.withColumn("_own", F.array(*lags)).where("_asked").drop("_pair", "_asked")
    wide = wide.join(_carried(segments.where(ready), slim, n, pair), ["project_id", "run"], "left")
    every = F.concat(F.coalesce("_carried", F.array().cast(wide.schema["_own"].dataType)), F.filter("_own", lambda p: p.isNotNull()))
    last = F.filter(F.slice(every, F.greatest(F.size(every) - n + 1, F.lit(1)), n), lambda p: p["t"] != "")
    return wide.select("id", *keep, F.when(F.size(last) > 0, last).alias("previous"))


def _carried(ready: DataFrame, slim: DataFrame, n: int, pair: Column) -> DataFrame:
    """(project_id, run, _carried): the last ``n`` pairs before each run. They are among the last ``n`` of the runs before it,
    which are numbered through in each project; their texts alone are fetched, by broadcast: only those before
    another run are wanted, ``n`` for ``RUN`` ordinals, and none of a project within one run."""
    back = Window.partitionBy("project_id", "run").orderBy(F.desc("ord"), F.desc("id"))
    ends = slim.where("ready").withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).select("id", "project_id", "run", "ord")
    runs = slim.groupBy("project_id", "run").agg(F.least(F.count_if("ready"), F.lit(n)).alias("_n"))
    ended = Window.partitionBy("project_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_to", F.coalesce(F.sum("_n").over(ended), F.lit(0))).where("_to > 0")
    wanted = runs.select("project_id", "run", F.explode(F.sequence(F.greatest(F.col("_to") - n + 1, F.lit(1)), F.col("_to"))).alias("_k"))
    ends = ends.withColumn("_k", F.row_number().over(Window.partitionBy("project_id").orderBy("ord", "id"))).select("id", "project_id", "_k")
    ends = ends.join(wanted.select("project_id", "_k"), ["project_id", "_k"], "left_semi").select("id", "_k")
    texts = ready.join(F.broadcast(ends), "id").select("project_id", "_k", pair.alias("_pair"))
    return wanted.join(texts, ["project_id", "_k"]).groupBy("project_id", "run").agg(F.array_sort(F.collect_list("_pair")).alias("_carried"))


def history_section(previous: Column) -> Column:
    """Source and target lines of (s, t) pairs under a heading; empty without pairs."""
    lines = F.transform(previous, lambda p: F.concat(F.lit(SOURCE), p["s"], F.lit("\n" + TARGET), p["t"]))
    return F.when(F.size(previous) > 0, F.concat(F.lit(HISTORY + "\n"), F.array_join(lines, "\n"))).otherwise("")


def glossary_section(terms: Column) -> Column:
    """A line for each (source_term, target_term, note) under a heading; empty without terms."""
    note = lambda t: F.when(F.coalesce(t["note"], F.lit("")) != "", F.concat(F.lit("（"), t["note"], F.lit("）"))).otherwise("")
    lines = F.transform(terms, lambda t: F.concat(F.lit("- "), t["source_term"], F.lit(" → "), t["target_term"], note(t)))
    return F.when(F.size(terms) > 0, F.concat(F.lit(GLOSSARY + "\n"), F.array_join(lines, "\n"))).otherwise("")


def cjk(c: Column) -> Column:
    return F.length(c) - T.other_length(c)


def build_context(frame: DataFrame, most: int = 1200) -> DataFrame:
    """``context`` from ``terms``, ``summary`` and ``previous``, and ``complete``: whether nothing was left out. History is
    taken newest first, pairs that don't fit are passed over. A text's cost is additive in its CJK and its other characters,
    so the fold keeps two totals; pairs that come from ``recent`` bring theirs."""
    summary = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(SUMMARY + "\n"), T.strip(F.col("summary")))).otherwise("")
    terms = F.coalesce(glossary_section(F.col("terms")), F.lit(""))
    head = F.array_join(F.filter(F.array(terms, summary), lambda x: x != ""), "\n\n")
    kind = frame.schema["previous"].dataType
    frame = T.once(frame, "_head", head).withColumn("_prev", F.coalesce("previous", F.array().cast(kind)))
    frame = T.once(frame, "_cost", F.struct(cjk(F.col("_head")).alias("c"), F.length("_head").alias("n")))
    opening = F.when(F.col("_head") != "", 2).otherwise(0) + len(HISTORY)
    sized = F.reverse("_prev")
    if "c" not in kind.elementType.names:
        costs = lambda p: ((cjk(p["s"]) + cjk(p["t"]) + CJK_LABELS).cast("long").alias("c"), (F.length(p["s"]) + F.length(p["t"]) + len(LABELS)).cast("long").alias("n"))
        sized = F.transform(sized, lambda p: F.struct(*[p[f].alias(f) for f in kind.elementType.names], *costs(p)))
        kind = frame.select(sized.alias("x")).schema["x"].dataType
    start = F.struct(F.array().cast(kind).alias("got"), (F.col("_cost.c") + _ideographs(HISTORY)).cast("long").alias("c"), (F.col("_cost.n") + opening).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        c, n = acc["c"] + x["c"], acc["n"] + x["n"]
        fits = c + F.ceil((n - c) / F.lit(4.0)) <= most
        return F.when(fits, F.struct(F.concat(F.array(x), acc["got"]).alias("got"), c.alias("c"), n.alias("n"))).otherwise(acc)

    frame = T.once(frame, "_got", F.aggregate(sized, start, step, lambda acc: acc["got"]))
    whole = F.array_join(F.filter(F.array(F.col("_head"), history_section(F.col("_got"))), lambda x: x != ""), "\n\n")
    frame = T.once(frame, "_whole", whole)
    # history is taken only where it fits, so what is too long is a head that is
    long = F.col("_cost.c") + F.ceil((F.col("_cost.n") - F.col("_cost.c")) / F.lit(4.0)) > most
    context = F.when(long, clip_context(most)(F.when(long, F.col("_whole")))).otherwise(F.col("_whole"))
    frame = frame.withColumn("complete", ~long & (F.size("_got") == F.size("_prev")))
    return T.once(frame, "context", context).drop("_head", "_prev", "_cost", "_got", "_whole")


def chapter_summary_source(chapters: DataFrame, segments: DataFrame, candidates: DataFrame, most: int = 8000) -> DataFrame:
    """(chapter_id, text) of chapters without a summary that hold a candidate: sources in order, ``most`` characters."""
    due = chapters.where(T.is_blank(F.col("summary"))).select(F.col("id").alias("chapter_id"))
    due = due.join(candidates.select("chapter_id"), "chapter_id", "left_semi")
    # only what may reach the first characters, if by its separator alone, is gathered: lengths run on without the texts
    before = Window.partitionBy("chapter_id").orderBy("ord", "id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("id", "chapter_id", "ord", F.length("source_text").alias("n")).join(due, "chapter_id", "left_semi")
    first = sizes.withColumn("at", F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0))).where(F.col("at") - 2 < most).select("id")
    rows = segments.join(first, "id", "left_semi").groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "source_text"))).alias("r"))
    text = F.substring(F.array_join(F.transform("r", lambda x: x["source_text"]), "\n\n"), 1, most)
    return rows.select("chapter_id", text.alias("text")).where(~T.is_blank(F.col("text")))


def masked(frame: DataFrame, text: str = "source_text") -> DataFrame:
    """``masked`` by the segment's kind: markdown, EPUB with slots in one part, or plain."""
    md, c = F.coalesce(F.col("source_type") == "md", F.lit(False)), F.col(text)
    slots = F.coalesce((F.col("source_type") == "epub") & (F.col("part_count") == 1) & (F.size("inline_slots") > 0), F.lit(False))
    made = F.when(md, mask_markdown(F.when(md, c))).when(slots, mask_slots(F.when(slots, c), F.when(slots, F.col("inline_slots")))).otherwise(mask_plain(F.when(~md & ~slots, c)))
    return T.once(frame, "masked", made)


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(names[F.lower(code)], code)


def render_prompt(template: Column, guidance: Column, source_lang: Column, target_lang: Column) -> Column:
    """The four known names are filled in, others stay; a blank template is the built-in one. The template is cut into
    names and what stands between, and joined once, so a brace in a value is never taken for a name."""
    body = F.when(T.is_blank(template), F.lit(PROMPT)).otherwise(template)
    values = {"{source_lang}": language_name(source_lang), "{target_lang}": language_name(target_lang), "{source_lang_code}": source_lang, "{target_lang_code}": target_lang}
    names = "|".join(n.replace("{", r"\{").replace("}", r"\}") for n in values)
    parts = F.regexp_extract_all(body, F.lit(rf"{names}|[^{{]+|\{{"), F.lit(0))

    def filled(part: Column) -> Column:
        out = part
        for name, value in values.items():
            out = F.when(part == name, value).otherwise(out)
        return out

    out = F.array_join(F.transform(parts, filled), "")
    more = T.strip(F.coalesce(guidance, F.lit("")))
    return F.concat(T.strip(out), F.when(more != "", F.concat(F.lit(f"\n\n{GUIDANCE}\n"), more)).otherwise(""))


def resolve_prompt(projects: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, prompt, guidance, origin): the project's enabled template, else the enabled default, else the built-in."""
    live = templates.where("enabled")
    own = live.select(F.col("id").alias("prompt_template_id"), F.col("system_prompt").alias("p1"), F.col("user_prefix").alias("g1"), F.lit(True).alias("own"))
    base = live.where("is_default").groupBy().agg(F.min_by(F.struct("system_prompt", "user_prefix"), "id").alias("d"))
    out = projects.join(own, "prompt_template_id", "left").crossJoin(F.broadcast(base))  # one row
    pick = lambda a, b: F.when(F.col("own"), F.col(a)).otherwise(F.col(b))
    origin = F.when(F.col("own"), "own").when(F.col("d").isNotNull(), "default").otherwise("built-in")
    return out.select("id", pick("p1", "d.system_prompt").alias("prompt"), pick("g1", "d.user_prefix").alias("guidance"), origin.alias("origin"))


def resolve_model(projects: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, model, concurrency, error): a named profile must be there and enabled; without one the project's model."""
    p = profiles.select(F.col("id").alias("model_profile_id"), "litellm_model_id", F.col("enabled").alias("_on"), F.col("max_concurrency").alias("_most"))
    out = projects.join(p, "model_profile_id", "left")
    named = F.col("model_profile_id").isNotNull()
    error = F.when(named & F.col("_on").isNull(), "missing profile").when(named & ~F.col("_on"), "disabled profile")
    model = F.when(named, F.col("litellm_model_id")).otherwise(F.coalesce(F.nullif("model", F.lit("")), F.lit(DEFAULT_MODEL)))
    concurrency = F.least(F.lit(MOST_CONCURRENT), F.coalesce("max_concurrency", F.lit(MOST_CONCURRENT)), F.coalesce("_most", F.lit(MOST_CONCURRENT)))
    return out.select("id", F.when(error.isNull(), model).alias("model"), concurrency.alias("concurrency"), error.alias("error"))


def user_message(context: Column, text: Column) -> Column:
    body = T.strip(F.coalesce(context, F.lit("")))
    return F.concat(F.lit(CONTEXT + "\n"), F.when(body == "", NO_CONTEXT).otherwise(body), F.lit(f"\n\n{TASK}\n"), text)


def build_requests(leaders: DataFrame, segments: DataFrame, chapters: DataFrame, terms: DataFrame, prompts: DataFrame, n: int = 3, most: int = 1200) -> DataFrame:
    """A request for each leader: prompt, context, whether that is ``complete``, masked text, message and its tokens.
    ``prompts`` has (id, prompt, guidance) by project; leaders carry ord, source_lang, target_lang and, for masking by kind,
    source_type, part_count and inline_slots. Leaders get what is short before they meet the texts of others."""
    matches = G.term_lists(leaders.select("id", "project_id", "source_text"), terms)
    own = leaders.join(matches, "id", "left").join(chapters.select(F.col("id").alias("chapter_id"), "summary"), "chapter_id", "left")
    asked = own.select("id", "project_id", "ord", F.struct(*own.columns).alias("_own_row"))
    wide = recent(segments, n, ("_own_row",), asked).select("_own_row.*", "previous")
    wide = wide.join(prompts.select(F.col("id").alias("project_id"), "prompt", "guidance"), "project_id", "left")
    for name, kind in (("source_type", "string"), ("part_count", "int"), ("inline_slots", "array<struct<start:int,end:int>>")):
        if name not in wide.columns:
            wide = wide.withColumn(name, F.lit(None).cast(kind))
    wide = masked(build_context(wide, most)).withColumnRenamed("masked", "m")
    system = render_prompt(F.col("prompt"), F.col("guidance"), F.col("source_lang"), F.col("target_lang"))
    wide = T.once(wide, "system_prompt", system)
    out = wide.select("id", "project_id", "system_prompt", "context", "complete", F.col("m.text").alias("text"), F.col("m.replacements").alias("replacements"), user_message(F.col("context"), F.col("m.text")).alias("message"))
    return out.withColumn("tokens", T.estimate_tokens(F.col("system_prompt")) + T.estimate_tokens(F.col("message")))
