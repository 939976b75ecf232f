"""Facts about the operators on small rows."""

import io
import random
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.functions import helpers as H
from foliant.functions import text as T
from foliant.operators import context as C
from foliant.operators import glossary as G
from foliant.operators import ledger as L
from foliant.operators import qa as Q
from foliant.operators import render as R
from foliant.operators import segmenting as SG
from foliant.operators import tm as M
from foliant.sources import blocks as B
from foliant.sources import documents as D
from foliant.streaming import events as ST

SAMPLE = """# Chapter One

A *bold* [link](https://example.com/path?q=1) and `inline_code`.

| Name | Value |
| --- | --- |
| Alpha | 42 |

> A quoted paragraph.

```python
print("do not translate")
```

## Chapter Two

Hello, {name}! This is the second chapter.
"""


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_normalize_and_hash(spark):
    assert one(spark, "  “Hello”\n world  ", T.normalize_text) == '"Hello" world'
    assert one(spark, "é – a b", T.normalize_text) == "é - a b"
    assert one(spark, "A  B", T.source_hash) == one(spark, "A\nB", T.source_hash)
    assert one(spark, None, T.source_hash) is None


def test_placeholders(spark):
    assert one(spark, "Hi {name}, {{ role }}, {name}, %s, ${value}", T.placeholders) == ["{name}", "{{ role }}", "{name}", "%s", "${value}"]
    assert one(spark, "50% done", T.placeholders) == ["% d"]


def test_tokens(spark):
    for text, n in (("", 0), ("a", 1), ("abcde", 2), ("中文abcd", 3)):
        assert one(spark, text, T.estimate_tokens) == n == H.tokens_of(text)


@pytest.mark.parametrize("most", [1, 7, 80, 1500])
def test_split_is_lossless_and_bounded(most):
    text = ("First one here. Second! Third? " * 20) + "x" * 200 + "\n\nLast 中文。结束"
    parts = H.pieces_of(text, most, H.MARKER, False)
    assert "".join(parts) == text and all(0 < len(p) <= most for p in parts)
    marked = "a" * 10 + "⟦MDP0001⟧" + "b" * 30
    assert any("⟦MDP0001⟧" in p for p in H.pieces_of(marked, 12, H.MARKER, False))
    assert H.pieces_of("see `a b c d e f` end", 8, H.ATOM, True) == ["see ", "`a b c d e f`", " end"]


@pytest.mark.parametrize("text", ["A *bold* [l](http://x.y) `c` {n} %s", "![i](u) <b>x</b> https://e.org ⟦MDP0000⟧ [a][b]", ""])
def test_mask_and_restore(text):
    masked, kept = H.mask_markdown_text(text)
    rows = [{"marker": a, "original": b} for a, b in kept]
    assert H.restored_text(masked, rows)[0] == text
    if rows:
        assert H.restored_text(masked.replace(rows[0]["marker"], ""), rows)[2]


def test_restore_slots():
    slots = [{"start": 0, "end": 6}, {"start": 6, "end": 12}, {"start": 12, "end": 16}]
    masked, kept = H.mask_plain_text("Hello world now.", slots)
    rows = [{"marker": a, "original": b} for a, b in kept]
    text = masked.replace("Hello ", "你好，").replace("world ", "世界 ").replace("now.", "现在。")
    assert H.restored_text(text, rows, 3) == ("你好，世界 现在。", ["你好，", "世界 ", "现在。"], None)


def test_markdown_blocks():
    rows = B.markdown_rows(SAMPLE)
    kinds = [r[1] for r in rows]
    assert kinds == ["heading", "para", "table_cell", "table_cell", "table_cell", "table_cell", "blockquote", "code", "heading", "para"]
    assert not rows[7][4] and all(r[4] for r in rows if r[1] != "code")
    for r in rows:
        if r[4]:
            assert SAMPLE[r[7] + r[9] : r[7] + r[9] + len(r[3])] == r[3]
    assert [r[1] for r in B.markdown_rows("Title\n=====\n\n- a\n  b\n- c\n\n> - nested\n\n`only code`\n")] == ["heading", "list_item", "list_item", "list_item", "para"]
    assert not B.markdown_rows("`only code`")[0][4]


@pytest.mark.parametrize(
    "source, want",
    [
        ("- a\n  - b\n    - c\n\n      second\n", [("list_item", "a"), ("list_item", "b"), ("list_item", "c"), ("list_item", "second")]),
        ("[ref]: http://x\n[b]: <y> 'T'\ntext [ref]\n", [("para", "text [ref]")]),
        ("[only]: http://x\n", []),
        ("> # head\n> body\nlazy\n", [("heading", "head"), ("blockquote", "body\nlazy")]),
        ("> - q1\n>   more\n> - q2\n", [("list_item", "q1\nmore"), ("list_item", "q2")]),
        ("- item\n\n  ```py\n  code\n    x\n  ```\n- next\n", [("list_item", "item"), ("code", "code\n  x\n"), ("list_item", "next")]),
        ("<!-- a\n\nb -->\nafter\n", [("raw", "<!-- a\n\nb -->\n"), ("para", "after")]),
        ("1. one\n\n   two\n\ntext\n2. no list\n", [("list_item", "one"), ("list_item", "two"), ("para", "text\n2. no list")]),
        ("a\n---\n\n---\n- - -\nb\n===\n", [("heading", "a"), ("heading", "b")]),
        ("> ```\n> code\nout\n", [("code", "code\n"), ("para", "out")]),
        ("| a | b |\n|---|---|\n| x |\n\n- | c |\n  |---|\n", [("table_cell", "a"), ("table_cell", "b"), ("table_cell", "x"), ("table_cell", ""), ("table_cell", "c")]),
        ("<div>\n*x*\n\n*y*\n<b>z</b> w\n", [("raw", "<div>\n*x*\n"), ("para", "*y*\n<b>z</b> w")]),
        ("\tcode\n\n-\n\n  not inside\n", [("code", "code\n"), ("para", "not inside")]),
    ],
)
def test_nested_markdown(source, want):
    rows = B.markdown_rows(source)
    assert [(r[1], r[3]) for r in rows] == want
    for r in rows:
        if r[9] >= 0 and r[4]:
            assert source[r[7] + r[9] : r[7] + r[9] + len(r[3])] == r[3]


def test_deep_and_long_markdown():
    assert B.markdown_rows(">" * 3000 + " x")[-1][3].endswith("x")
    assert len(B.markdown_rows("- " * 3000 + "x")) == 1
    assert len(B.markdown_rows("> a\n" + "lazy\n" * 3000)) == 1
    assert Q.signature_of("> - a\n> - b") == ["open:quote", "open:item-", "p", "close:item-", "open:item-", "p", "close:item-", "close:quote"]


def test_epub_chapters(spark):
    rows = [(1, 0, "a", 0, "para", "x"), (1, 2, "c", 0, "heading", " "), (1, 2, "c", 1, "heading", "Two"), (1, 2, "c", 2, "heading", "No"), (2, 5, "z", 0, "heading", "Z")]
    blocks = SG.assign_epub_chapters(spark.createDataFrame(rows, "project_id long, spine_ord int, file string, token_index int, kind string, text string"))
    table = SG.chapter_table(spark.createDataFrame([(1,), (2,), (3,)], "project_id long"), blocks)
    assert sorted(map(tuple, table.collect())) == [(1, 0, None, "a"), (1, 1, "Two", "c"), (2, 0, "Z", "z"), (3, 0, None, None)]


def test_structure_issues_are_counted(spark):
    files = spark.createDataFrame([(1, "# a\n\nb", "# x\n\ny"), (2, "# a\n\nb", "a\n\nb")], "project_id long, source string, target string")
    projects, pages = spark.range(1, 5), spark.createDataFrame([(1, "<p>"), (2, "<p/>"), (3, "<p/>")], "project_id long, xhtml string")
    issues = Q.structure_issues(Q.markdown_structure(files), Q.xhtml_structure(projects, pages), spark.createDataFrame([(9,)], "project_id long"))
    got = {(r["project_id"], r["detail"]): r["details"] for r in issues.collect()}
    assert set(got) == {(2, "tokens differ"), (1, "not well-formed"), (4, "no documents"), (9, "source not found")}
    assert got[2, "tokens differ"] == {"source_token_count": "2", "rendered_token_count": "2", "first_mismatch": "0", "source_token": "h1", "rendered_token": "p"}
    assert {r["project_id"]: r["error"] for r in Q.qa_report(issues).collect()} == {1: 1, 2: 1, 4: 1, 9: 1}


def test_stable_paths(spark):
    df = spark.createDataFrame([({"source_type": "pdf", "page": 3, "raw_block": "x", "char_end": 5, "area": {"y": 1, "x": None}},)], "p struct<source_type:string,page:int,raw_block:string,char_end:int,area:struct<y:int,x:int>>")
    assert df.select(T.stable_path(F.col("p"), df.schema["p"].dataType).alias("j")).first()["j"] == '{"area":{"x":null,"y":1},"page":3,"source_type":"pdf"}'


def test_container_lines():
    assert R.container_text("- a\n- b\n", "x\ny\nz", "list_item") == "- x\n- y\n  z\n"
    assert R.container_text("> a\r\nb", "x\ny", "blockquote") == "> x\r\n> y"
    assert R.container_text("> 1. a", "x\ny", "list_item") == "> 1. x\n>    y"
    assert R.container_text("", "x\ny", "list_item") == "x\ny"
    assert R.container_text("> *em* x\n> y", "1\n2", "blockquote") == "> 1\n> 2"


def test_assign_chapters(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "no heading\n"), (3, "intro\n\n# \n\ntext")], "project_id long, text string")
    rows = SG.assign_chapters(B.markdown_blocks(df, ["project_id"])).select("project_id", "chapter_ord", "chapter_title").distinct().collect()
    assert {tuple(r) for r in rows} == {(1, 0, "Chapter One"), (1, 1, "Chapter Two"), (2, 0, None), (3, 0, None), (3, 1, "Untitled")}


def test_xhtml_blocks():
    rows = B.xhtml_rows("<body><h1>One</h1><p>Hello world.</p><p>Use <code>x()</code> now</p><pre>code</pre><p><code>only</code></p><ul><li>a <p>b</p></li></ul><p><script>x</script></p></body>")
    assert [r[1] for r in rows] == ["heading", "para", "para", "code", "para", "list_item", "para"]
    assert rows[2][3] == "Use ⟦EPUBCODE0000⟧ now" and rows[2][7] == [("⟦EPUBCODE0000⟧", "x()")]
    assert [r[4] for r in rows] == [True, True, True, False, False, True, False]
    assert rows[1][8] == [{"start": 0, "end": 12}]


def test_ledger_merge_keeps_and_deletes(spark):
    old = spark.createDataFrame([(1, "k1", 1, 0, "Keep", "h1", "T", None, 1, 2, "m", "done", "t"), (1, "k2", 1, 1, "Delete", "h2", None, None, None, None, None, "pending", "t")], "project_id long, stable_key string, chapter_id long, ord long, source_text string, src_hash string, target_text string, error_msg string, token_in long, token_out long, provider string, status string, updated_at string")
    drafts = old.where("stable_key = 'k1'").select("project_id", "stable_key", "chapter_id", "ord", "source_text", "src_hash")
    rows = {r["stable_key"]: r for r in L.ledger_merge(old, drafts, "now").collect()}
    assert rows["k1"]["action"] == "keep" and rows["k1"]["status"] == "done" and rows["k1"]["target_text"] == "T"
    assert rows["k2"]["action"] == "delete"
    again = L.ledger_merge(old.where("stable_key = 'k1'"), drafts, "now").collect()
    assert [r["action"] for r in again] == ["keep"]


def test_candidates_and_dedup(spark):
    s = spark.createDataFrame([(k, 1, 1, k, "en", "zh", h, st) for k, (h, st) in enumerate([("a", "pending"), ("a", "pending"), ("b", "error"), ("c", "done")])], "id long, project_id long, chapter_id long, ord long, source_lang string, target_lang string, src_hash string, status string")
    none = spark.createDataFrame([], "id long")
    assert L.select_candidates(s, none).count() == 0
    assert L.select_candidates(s).count() == 3 and L.select_candidates(s, force=True).count() == 4
    assert [r["leader"] for r in M.tm_batch_dedup(L.select_candidates(s)).orderBy("id").collect()] == [True, False, True]
    assert L.selectable_ids(s).count() == 4
    with pytest.raises(ValueError):
        L.selectable_ids(s, most=2)


def test_glossary(spark):
    s = spark.createDataFrame([(1, 1, "A party in New York", "纽约派对"), (2, 1, "Straße", "街")], "id long, project_id long, source_text string, target_text string")
    g = spark.createDataFrame([(1, 1, "art", "艺术", None, False, True), (2, 1, "new york", "纽约", None, False, True), (3, 1, "NEW", "新", None, True, True), (4, 1, " ", "x", None, False, True), (5, 1, "STRASSE", "路", None, False, True), (6, 1, "party", "派对", None, False, False)], "id long, project_id long, source_term string, target_term string, note string, case_sensitive boolean, enabled boolean")
    assert {(r["id"], r["term_id"]) for r in G.glossary_matches(s, g).collect()} == {(1, 1), (1, 2), (2, 5)}
    assert {(r["id"], r["source_term"]) for r in G.glossary_mismatches(s, g).collect()} == {(1, "art"), (1, " "), (2, "STRASSE")}


def test_context_skips_what_does_not_fit(spark):
    pairs = [(0, "old source", "old target"), (1, "y" * 4000, "z"), (2, "new source", "new target")]
    df = spark.createDataFrame([(1, [(1, "cat", "猫", "n")], " sum ", pairs), (2, None, None, None), (3, None, "w" * 9000, None)], "id long, terms array<struct<term_id:long,source_term:string,target_term:string,note:string>>, summary string, previous array<struct<o:long,s:string,t:string>>")
    rows = {r["id"]: r["context"] for r in C.build_context(df, 200).collect()}
    assert rows[1] == "【术语表（必须遵守）】\n- cat → 猫（n）\n\n【本章摘要】\nsum\n\n【前文对照】\n原文：old source\n译文：old target\n原文：new source\n译文：new target"
    assert rows[2] == ""
    assert rows[3].endswith(H.CLIPPED) and H.tokens_of(rows[3]) <= 200


def test_signature():
    assert Q.signature_of("plain *text* here") == Q.signature_of("other words")
    assert Q.signature_of("a [x](u)") != Q.signature_of("a [x](v)")
    assert Q.signature_of("a `c`") != Q.signature_of("a `d`")
    assert Q.signature_of("para") != Q.signature_of("# para")


def test_render_markdown():
    def row(r, target):
        return dict(zip(B.NAMES, r, strict=True)) | {"inline": r[3], "target": target, "translated": target is not None}

    rows = B.markdown_rows(SAMPLE)
    targets = [None if not r[4] else "甲 | 乙\n第二行" if r[1] == "table_cell" else "译 [链接](broken)" if "link" in r[3] else "译" for r in rows]
    out = R.rendered_text(SAMPLE, [row(r, t) for r, t in zip(rows, targets, strict=True)], "bilingual", True)
    assert "https://example.com/path?q=1)\n" in out and "> 译 [链接](https://example.com/path?q=1)" in out and "| --- | --- |" in out and 'print("do not translate")' in out
    only = R.rendered_text(SAMPLE, [row(r, t) for r, t in zip(rows, targets, strict=True)], "target_only", True)
    assert "甲 \\| 乙<br />第二行" in only and only.startswith("# 译\n") and "> 译" in only
    text = "Title\n=====\n\nBody\n"
    two = B.markdown_rows(text)
    assert R.rendered_text(text, [row(two[0], "标题"), row(two[1], None)], "bilingual", True) == "Title\n=====\n\n\n> 标题\nBody\n"
    quote = "> one\n> two\n"
    assert R.rendered_text(quote, [row(B.markdown_rows(quote)[0], "甲\n乙")], "target_only", True) == "> 甲\n> 乙\n"
    item = "- one\n  two\n"
    assert R.rendered_text(item, [row(B.markdown_rows(item)[0], "甲\n乙")], "target_only", True) == "- 甲\n  乙\n"


def test_cells_with_escaped_pipes():
    def row(r, target):
        return dict(zip(B.NAMES, r, strict=True)) | {"inline": r[3], "target": target, "translated": target is not None}

    text = "| h | k |\n| --- | --- |\n| x \\| y | keep |\n"
    rows = B.markdown_rows(text)
    made = [row(r, "T" if "x" in r[3] else None) for r in rows]
    assert R.rendered_text(text, made, "bilingual", True) == '| h | k |\n| --- | --- |\n| x \\| y<br /><span class="translation">T</span> | keep |\n'
    only = [row(r, "T" if "x" in r[3] else r[3]) for r in rows]
    assert R.rendered_text(text, only, "target_only", True) == "| h | k |\n| --- | --- |\n| T | keep |\n"


def test_slots_share_the_target():
    assert R.split_target("ab", ["long slot", "x"], ["a", "b"]) == ["a", "b"]
    assert R.split_target("abcdefgh", ["xxxxxx", "xx"]) == ["abcdef", "gh"]
    assert R.split_target("abc", ["x" * 90, "y", "z"]) == ["a", "b", "c"]
    assert R.split_target("", ["x", "y"]) == ["", ""] and R.split_target("abc", []) == []
    for n in range(30):
        parts = R.split_target("t" * n, ["one", "three", "of seven"])
        assert "".join(parts) == "t" * n and (n < 3 or all(parts))


def test_clip_is_the_longest_prefix_that_fits(spark):
    for text in ["word " * 40, "中文 and words 混合 " * 12, "x" * 200, " \n " * 50 + "end" * 40]:
        fits = [t.rstrip() + H.CLIPPED for t in (text[:n] for n in range(len(text) + 1)) if H.tokens_of(t.rstrip() + H.CLIPPED) <= 25]
        assert one(spark, text, H.clip_context(25)) == (fits[-1] if H.tokens_of(text) > 25 else text)


def test_prompt_is_filled_once(spark):
    df = spark.createDataFrame([("{source_lang} to {target_lang} {x} {", "{target_lang}", "zh-CN")], "t string, a string, b string")
    assert df.select(C.render_prompt(F.col("t"), F.lit(None).cast("string"), F.col("a"), F.col("b"))).first()[0] == "{target_lang} to 简体中文 {x} {"


def test_masking_by_kind(spark):
    rows = [(1, "md", 1, None, "a *b* {n}"), (2, "epub", 1, [(0, 1), (1, 9)], "a *b* {n}"), (3, "epub", 2, [(0, 1)], "a *b* {n}"), (4, None, None, None, "a *b* {n}")]
    df = spark.createDataFrame(rows, "id long, source_type string, part_count int, inline_slots array<struct<start:int,end:int>>, source_text string")
    got = {r["id"]: r["masked"]["text"] for r in C.masked(df).collect()}
    assert got == {1: "a ⟦MDP0001⟧b⟦MDP0002⟧ ⟦MDP0000⟧", 2: "⟦VAR0000⟧a⟦VAR0001⟧⟦VAR0002⟧ *b* ⟦VAR0004⟧⟦VAR0003⟧", 3: "a *b* ⟦VAR0000⟧", 4: "a *b* ⟦VAR0000⟧"}


def test_ascii_texts_stay_in_the_jvm(spark):
    """The Python step sees null for them."""
    df = spark.createDataFrame([("plain",), ("é",)], "x string")
    plan = df.select(T.normalize_text(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "NOT RLIKE" in plan


def test_english_runs_match_python(spark):
    pattern = re.compile(r"\b[A-Za-z][A-Za-z'’-]*(?:\s+[A-Za-z][A-Za-z'’-]*){4,}\b")
    texts = ["This is a plain English sentence, and here is yet another one.", "éThis is not a long run", "one two three four", "it's John's well-known old-fashioned way to'", "a b c d eé f", "中文 one two three four five 中文"]
    df = spark.createDataFrame([(k, 1, "k", "source", t, "done", "md", None, None, 1) for k, t in enumerate(texts)], "id long, project_id long, stable_key string, source_text string, target_text string, status string, source_type string, file string, xpath string, token_index int")
    got = {r["segment_id"]: r["detail"] for r in Q.row_issues(df, ["qa_english_residual"]).collect()}
    want = {k: "|".join(pattern.findall(t)[:3]) for k, t in enumerate(texts) if pattern.findall(t) and len(re.findall("[A-Za-z]", t)) / len(re.sub(r"\s", "", t)) >= 0.35}
    assert got == want and len(want) >= 3


def test_xhtml_checks(spark):
    projects = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    pages = spark.createDataFrame([(1, "<p>good</p>"), (1, "<p>bad"), (2, "<a><b/></a>")], "project_id long, xhtml string")
    assert {tuple(r) for r in Q.xhtml_structure(projects, pages).collect()} == {(1, 2, 1, True), (2, 1, 0, False), (3, 0, 0, True)}
    blocks = B.xhtml_blocks(spark.createDataFrame([(1, "<h2>Head</h2><p>a <b>c</b> d</p>"), (2, None)], "page_id long, html string"), ["page_id"])
    got = [(r["page_id"], r["token_index"], r["kind"], r["level"], r["text"], r["translatable"], r["xpath"], r["tag"], [tuple(x) for x in r["inline_slots"]]) for r in blocks.orderBy("token_index").collect()]
    assert got == [(1, 0, "heading", 2, "Head", True, "/h2[1]", "h2", [(0, 4)]), (1, 1, "para", 0, "a c d", True, "/p[1]", "p", [(0, 2), (2, 3), (3, 5)])]


def test_projects_go_with_all_their_rows(spark):
    tables = {"segment": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, project_id long"), "project": spark.createDataFrame([(1, "translating"), (2, "done")], "id long, status string")}
    left, removed = L.purge_projects(tables, spark.createDataFrame([(1,), (1,), (9,)], "project_id long"))
    assert {r["name"]: r["removed"] for r in removed.collect()} == {"segment": 2, "project": 1}
    assert left["segment"].count() == 1 and left["project"].count() == 1
    assert {r["id"]: r["status"] for r in L.recover_projects(tables["project"]).collect()} == {1: "ready", 2: "done"}


def test_render_xhtml():
    page = '<html><head></head><body><p id="a" class="c">Hello <b>world</b><img src="x"/></p><p>Two</p></body></html>'
    blocks = [{"tag": "p", "target": "你好世界", "slots": None}, {"tag": "p", "target": None, "slots": None}]
    both = R.xhtml_edited(page, blocks, "bilingual", "zh-CN")
    assert both.count("<img") == 1 and both.count('id="a"') == 1 and 'class="c translation" lang="zh-CN"' in both and "Hello <b>world</b>" in both
    only = R.xhtml_edited(page, blocks, "target_only", "zh-CN")
    assert "Hello" not in only and "<p>Two</p>" in only and "<b>" in only
    assert R.split_target("ab", ["long slot", "x"], ["a", "b"]) == ["a", "b"]


def test_archives(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../evil", "x")
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big", b"\0" * (3 << 20))
    bare = io.BytesIO()
    zipfile.ZipFile(bare, "w").close()
    df = spark.createDataFrame([("a", box.getvalue()), ("b", bomb.getvalue()), ("c", b"no zip"), ("d", bare.getvalue())], "path string, content binary")
    assert {r["path"]: r["reason"].split(":")[0] for r in D.read_epub(df).collect()} == {"a": "KeyError", "b": "KeyError", "c": "BadZipFile", "d": "KeyError"}
    assert {r["path"]: r["verdict"] for r in D.screen_archives(D.archive_members(df)).collect()} == {"a": "unsafe path", "b": "suspicious ratio", "c": "not an archive", "d": "ok"}


def test_glossary_csv(spark, tmp_path):
    file = tmp_path / "g.csv"
    file.write_text('﻿ Source_Term ,target_term,note,case_sensitive,enabled\nNew York,纽约,"two\nlines",yes,\n ,x,,,\nq,r,,perhaps,off\n', encoding="utf-8")
    rows = D.read_glossary_csv(spark, str(file)).collect()
    assert (rows[0]["note"], rows[0]["case_sensitive"], rows[0]["enabled"], rows[0]["reason"]) == ("two\nlines", True, True, None)
    assert [r["reason"] for r in rows[1:]] == ["source_term", "case_sensitive"]


def test_english_runs_of_any_length(spark):
    """A long line of words overflowed the stack of Java's pattern; short ones end where Python's do."""
    draw = random.Random(4)
    parts = ["a", "don't", "o'", "x-", "it'sé", "café", "foo'é", "ab", "é", "_", "7", "B’s", "-", "."]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(draw.randrange(4, 24))) for _ in range(6000)]
    texts += ["WORD " * 200_000 + "end", "word " * 100_000 + "café"]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r["runs"] for r in table.select("id", T.english_runs(F.col("t")).alias("runs")).collect()}
    python = re.compile(r"\b[A-Za-z][A-Za-z'’-]*(?:\s+[A-Za-z][A-Za-z'’-]*){4,}\b")
    assert sum(bool(v) for v in got.values()) > 300
    for k, t in enumerate(texts):
        assert got[k] == [m[0] for m in python.finditer(t)], t[:200]


def test_chapter_summary_source_cut_in_a_separator(spark):
    """The cut may fall between two texts: what stands between them counts, though none of the next one does."""
    chapters = spark.createDataFrame([(1, ""), (2, ""), (3, "")], "id long, summary string")
    rows = [(c, c, n, "x" * (10 - k) if n == 0 else "next") for k, c in enumerate((1, 2, 3)) for n in (0, 1)]
    s = spark.createDataFrame([(c * 10 + n, c, n, t) for c, _, n, t in rows], "id long, chapter_id long, ord long, source_text string")
    got = {r["chapter_id"]: r["text"] for r in C.chapter_summary_source(chapters, s, s, 10).collect()}
    assert got == {1: "x" * 10, 2: "x" * 9 + "\n", 3: "x" * 8 + "\n\n"}


def test_whole_documents_come_in_small_batches(spark, monkeypatch):
    """What Python holds of whole documents at once is bounded in bytes, and blocks leave it before all are made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(6).select(F.col("id").alias("page_id"), F.concat(F.repeat(F.lit("<p>x</p>"), 30), F.lit("<h1>"), F.col("id").cast("string"), F.lit("</h1>")).alias("html"))
    monkeypatch.setattr(B, "ROWS", 7)
    before = spark.conf.get(key)
    for use in (lambda: B.xhtml_blocks(docs, ["page_id"]), lambda: Q.markdown_structure(docs.select(F.col("html").alias("source"), F.col("html").alias("target"))), lambda: R.render_xhtml(docs, docs.select("page_id", F.lit(0).alias("token_index"), F.lit("p").alias("tag"), F.lit("t").alias("target"), F.lit(None).cast("array<string>").alias("slots")), "page_id"), lambda: Q.xhtml_structure(spark.range(1), docs.select(F.col("page_id").alias("project_id"), F.col("html").alias("xhtml")))):
        spark.conf.set(key, "64m")
        use()
        assert spark.conf.get(key) == "4m"
    rows = B.xhtml_blocks(docs.coalesce(1), ["page_id"]).collect()
    assert [(r["page_id"], r["token_index"]) for r in rows] == [(p, k) for p in range(6) for k in range(31)] and rows[-1]["text"] == "5"
    spark.conf.set(key, before)
