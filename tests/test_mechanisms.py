"""Indexes, automata, waves, stored tables, sinks and states against plain versions of themselves."""

import hashlib
import io
import os
import random
import time
import uuid
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import context as C
from foliant.operators import glossary as G
from foliant.operators import ledger as L
from foliant.operators import progress as P
from foliant.operators import search as S
from foliant.operators import tm as M
from foliant.sources import books as K
from foliant.sources import documents as D
from foliant.sources import ledger as LD
from foliant.sources import scratch
from foliant.streaming import events as ST

SEGMENT = "id long, project_id long, chapter_id long, ord long, stable_key string, source_text string, target_text string, src_hash string, status string, error_msg string, token_in long, token_out long, provider string, updated_at string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def opened(df, under):
    """How many files under a folder a query opens."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    spark.conf.set(key, "false")
    try:
        run = df.select("*")
        plan = run._jdf.queryExecution().executedPlan()
        run._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        scans = [leaves.apply(k) for k in range(leaves.size())]
        return sum(int(x.metrics().apply("numFiles").value()) for x in scans if "FileScan" in x.toString() and under in x.toString())
    finally:
        spark.conf.set(key, "true")


def folders(root, name):
    return {d for d in os.listdir(root) if d.startswith(name)}


# --- glossary ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(4)
    words = ["Strasse", "STRASSE", "straße", "aa", "aaa", "Aal", "İstanbul", "ﬁn", "the", "then", "ßß", " "]
    rows = [(k, k % 3, "".join(draw.choices(words, k=draw.randrange(0, 9)))) for k in range(300)] + [(900, 1, None), (901, 7, "the")]
    terms = [(k, k % 4, t, t.upper(), None, k % 2 == 0, k % 7 != 6) for k, t in enumerate(words * 5 + ["a", "ss", "s", "i̇s", "en", ""] * 4)]
    terms = list({(t[1], t[2], t[5]): t for t in terms}.values())
    return rows, terms, spark.createDataFrame(rows, "id long, project_id long, source_text string"), spark.createDataFrame(terms, "id long, project_id long, source_term string, target_term string, note string, case_sensitive boolean, enabled boolean")


@pytest.mark.parametrize("chars, most", [(2_000_000, 20_000), (300, 2)])
def test_automaton_finds_what_a_scan_finds(texts, monkeypatch, chars, most):
    monkeypatch.setattr(G, "CHARS", chars)
    monkeypatch.setattr(G, "TERMS", most)
    rows, terms, segments, glossary = texts
    want = set()
    for i, p, text in rows:
        for t, q, term, _, _, exact, on in terms:
            if on and p == q and term.strip() and text and (term in text if exact else term.casefold() in text.casefold()):
                want.add((i, t))
    found = G.glossary_matches(segments, glossary)
    got = [(r["id"], r["term_id"], r["starts"], r["source_text"], r["source_term"], r["case_sensitive"]) for r in found.collect()]
    assert {g[:2] for g in got} == want and len(got) == len(want) > 100
    for _, _, starts, text, term, exact in got:
        if exact:
            assert starts == [k for k in range(len(text)) if text.startswith(term, k)]
        else:
            low, prefix = text.casefold(), [len(text[:k].casefold()) for k in range(len(text) + 1)]
            at = [k for k in range(len(low)) if low.startswith(term.casefold(), k)]
            assert starts == sorted({max(j for j in range(len(text)) if prefix[j] <= k) for k in at})
    assert "Contains" not in plan_of(found) and "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)


# --- waves ----------------------------------------------------------------------------------------------------------


def slow_waves(rows, fails):
    """One row after the other, as a single run does it."""
    done, out = {}, {}
    for i, project, ord_, key in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if key in done:
            out[i] = ("hit", done[key])
        elif fails(i):
            out[i] = ("error", None)
        else:
            done[key] = f"T{i}"
            out[i] = ("done", f"T{i}")
    return out


@pytest.mark.parametrize("seed, hot", [(1, False), (2, True)])
def test_waves_are_a_sequential_run(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr("foliant.operators.spread.LEAST", 3)
        monkeypatch.setattr("foliant.operators.spread.HOT", 5)
    draw = random.Random(seed)
    rows = [(k, draw.randrange(3), draw.randrange(1000), f"h{0 if k % 3 == 0 else draw.randrange(12)}") for k in range(150)] + [(500, 0, 0, "alone"), (501, 0, 1, "lost"), (502, 0, 2, "lost")]
    fails = lambda i: i in (501, 502) or (i * 7) % 10 < 6
    frame = spark.createDataFrame([(i, p, 1, o, f"k{i}", f"text {key}", None, key, "pending", "old", None, None, None, "", "en", "de") for i, p, o, key in rows], SEGMENT + ", source_lang string, target_lang string")
    waves = []

    def translate(leads):
        waves.append(leads.count())
        bad = (F.col("id") * 7) % 10 < 6
        answers = leads.where("id <> 501").select(F.col("id").alias("segment_id"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("text"), F.lit(3).alias("in_tokens"), F.lit(4).alias("out_tokens"), F.lit("m").alias("model"), F.when(bad | (F.col("id") == 502), "no").alias("error"))
        return answers.withColumns({"replacements": F.array().cast("array<struct<marker:string,original:string>>"), "n_slots": F.lit(-1)})

    got = {r["id"]: r for r in M.translate_waves(frame, translate).collect()}
    want = slow_waves(rows, fails)
    assert {i: (r["outcome"], r["target_text"]) for i, r in got.items()} == want
    by_key = {}
    for i, _, _, key in rows:
        by_key[key] = by_key.get(key, 0) + (want[i][0] == "error")
    assert len(waves) <= max(by_key.values()) + 1
    assert all(r["token_in"] == 3 and r["provider"] == "m" for r in got.values() if r["outcome"] == "done")
    assert all(r["token_in"] is None and r["provider"] is None and r["status"] == "done" and r["error_msg"] is None for r in got.values() if r["outcome"] == "hit")


# --- a stored memory --------------------------------------------------------------------------------------------------


def test_stored_memory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("foliant.operators.spread.LEAST", 20)
    monkeypatch.setattr("foliant.operators.spread.HOT", 20)
    sha = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    tm = spark.createDataFrame([(sha(k), "en", "de", f"s{k}", f"t{k}", 0, "") for k in range(4000)], "src_hash string, source_lang string, target_lang string, source_text string, target_text string, hit_count long, updated_at string")
    path = str(tmp_path / "memory")
    M.write_memory(tm, path)
    rows = [(k, sha(7 if k % 3 == 0 else 3900 + k), "en" if k % 5 else "fr", "de", None, "pending", "e") for k in range(200)]
    batch = spark.createDataFrame(rows, "id long, src_hash string, source_lang string, target_lang string, target_text string, status string, error_msg string")
    columns = ["id", "hit", "target_text", "status", "error_msg"]
    got = sorted(M.tm_lookup_stored(batch, path).select(columns).collect())
    assert got == sorted(M.tm_lookup(batch, tm).select(columns).collect()) and 0 < sum(r["hit"] for r in got) < len(got)
    # a batch of three keys, one of them known, opens one folder of the 256
    few = spark.createDataFrame([(sha(5), "en", "de", 1), (sha(-1), "en", "de", 1), (sha(-2), "en", "de", 1)], "src_hash string, source_lang string, target_lang string, n long")
    found = M.memory_hits(spark, path, few)
    assert [r["target_text"] for r in found.collect()] == ["t5"]
    assert len(folders(f"{path}/entries", "prefix=")) > 250 and opened(found, "/entries") == 1
    none = spark.createDataFrame([], few.schema)
    assert M.memory_hits(spark, path, none).count() == 0
    M.write_memory(tm.limit(0), str(tmp_path / "none"))
    assert not any(r["hit"] for r in M.tm_lookup_stored(batch, str(tmp_path / "none")).collect())


# --- pages and search ---------------------------------------------------------------------------------------------------


def test_every_page_by_ranges(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), ((F.col("id") * 37) % 11).alias("k"))
    order, path = [F.desc("k"), F.col("id")], str(tmp_path)
    S.write_ranges(rows, order, path, 16)
    want = sorted(((r["k"], r["id"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    got = []
    for page in range(1, 16):
        found = S.range_page(spark, path, order, page, 70)
        assert opened(found, "/rows") <= 3
        got += [(r["k"], r["id"]) for r in found.collect()]
        assert all(r["total"] == 1000 and r["pages"] == 15 for r in found.collect())
    assert got == want
    assert S.range_page(spark, path, order, 99, 70).count() == 0
    assert [r["id"] for r in S.page_of(rows, order, 3, 20, shallow=0).collect()] == [i for _, i in want[40:60]]
    assert [r["id"] for r in S.page_of(rows, order, 3, 20).collect()] == [i for _, i in want[40:60]]


def test_gram_index_finds_what_a_scan_finds(spark, tmp_path):
    draw, path = random.Random(6), str(tmp_path)
    words = ["Über", "die", "Brücke", "THE", "then", "ocean", "x", "😀grin", "100%", "a_b", "\n", "naïve"]
    rows = [(k, " ".join(draw.choices(words, k=draw.randrange(0, 7))), draw.choice([None, "", "Target text", "die"])) for k in range(400)] + [(900, "one needle in it", None), (901, None, "İx needle")]
    table = spark.createDataFrame(rows, "id long, source_text string, target_text string")
    S.write_gram_index(table, path, ["source_text", "target_text"], block=40, buckets=8)
    for needle in ("the", "THEN", "needle", "x", "", "😀gr", "100%", "a_b", "brücke t", "absent", "\n", "ïve", "İx "):
        got = sorted(r["id"] for r in S.indexed_search(spark, path, needle).collect())
        low = lambda t: (t or "").lower()
        want = sorted(i for i, s, t in rows if (s is not None and low(needle) in low(s)) or (t is not None and low(needle) in low(t)))
        assert got == want, needle
    found = S.indexed_search(spark, path, "needle")
    assert opened(found, "/rows") <= 2 < 10 <= len(folders(f"{path}/rows", "_block="))


def test_gram_index_of_runs_cut_in_batches(spark, tmp_path, monkeypatch):
    """Runs that lie in several batches and parts of them give what a scan gives; there are few folders and few bytes,
    however small the blocks and long the keys are."""
    path, key = str(tmp_path), "spark.sql.execution.arrow.maxRecordsPerBatch"
    table = spark.range(20_000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("id"), F.concat(F.lit("Row the "), F.hex(F.xxhash64("id")), F.when(F.col("id") % 5000 == 7, " rare").otherwise("")).alias("t"))
    monkeypatch.setattr(S, "FOLDERS", 4)
    spark.conf.set(key, "333")
    try:
        S.write_gram_index(table, path, ["t"], block=500, buckets=8)
    finally:
        spark.conf.unset(key)
    for needle in ("rare", "the a", "e ab", "ROW", "absent"):
        assert S.indexed_search(spark, path, needle).count() == table.where(F.contains(F.lower("t"), F.lit(needle.lower()))).count()
    assert len(folders(f"{path}/rows", "_block=")) <= 16
    grams = spark.read.parquet(f"{path}/postings")
    assert grams.agg(F.sum(F.octet_length("held"))).first()[0] < 20_000 * 24 * 3
    assert opened(S.indexed_search(spark, path, "rare"), "/rows") <= 4


def test_grams_of_many_signs():
    """Grams of any letters, also more kinds of them than fit one number with the row."""
    for texts in ([["abcab", "", "ab"], ["xabc", "b", "😀grin"]], [["".join(map(chr, range(0x4E00, 0x9FFF)))], ["abc"]]):
        row = np.array([7, 300, 65_535][: len(texts[0])])
        for block in (65_536, 1 << 30):
            grams, held = S.grams_of(texts, row, block) if block == 65_536 else S.grams_of(texts, row % 100, 100)
            own = {}
            for column in texts:
                for r, t in zip(row if block == 65_536 else row % 100, column, strict=True):
                    for k in range(len(t) - 2):
                        own.setdefault(t[k : k + 3], set()).add(int(r))
            wide = 8192 if block == 65_536 else 13
            got = {g: set(np.frombuffer(h, "<u2").tolist()) if len(h) < wide else set(np.flatnonzero(np.unpackbits(np.frombuffer(h, np.uint8), bitorder="little")).tolist()) for g, h in zip(grams, held, strict=True)}
            assert got == own and len(grams) == len(own)


# --- the stored ledger ---------------------------------------------------------------------------------------------------


def ledger_rows(spark, n=400, projects=8):
    return spark.range(n).select(
        F.col("id"), (F.col("id") % projects).alias("project_id"), F.lit(1).cast("long").alias("chapter_id"), F.col("id").alias("ord"), F.format_string("%05d", "id").alias("stable_key"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("source_text"),
        F.when(F.col("id") % 2 == 0, "done").alias("target_text"), F.sha1(F.col("id").cast("string").cast("binary")).alias("src_hash"), F.when(F.col("id") % 2 == 0, "done").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("error_msg"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("token_in"), F.lit(None).cast("long").alias("token_out"), F.lit(None).cast("string").alias("provider"), F.lit("t").alias("updated_at"),
    )


def test_ledger_keeps_other_projects(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), ledger_rows(spark)
    LD.write_ledger(rows, path, groups=3, buckets=4)
    again = rows.where("project_id = 2 AND ord < 100").withColumn("source_text", F.lit("new"))
    LD.write_ledger(again, path)
    got = LD.read_ledger(spark, path)
    want = rows.where("project_id <> 2").unionByName(again)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # a write that fails in the middle leaves what was there
    broken = rows.where("project_id = 5").withColumn("source_text", F.when(F.col("ord") < 300, F.col("source_text")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        LD.write_ledger(broken, path)
    assert LD.read_ledger(spark, path).exceptAll(want).isEmpty() and LD.read_ledger(spark, path).count() == want.count()


def test_ledger_merges_in_place(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), ledger_rows(spark)
    LD.write_ledger(rows, path, groups=3, buckets=4)
    drafts = rows.where("project_id IN (1, 4) AND ord % 5 <> 0").select("project_id", "stable_key", "chapter_id", (F.col("ord") + 1).alias("ord"), "source_text", F.when(F.col("ord") % 3 == 0, "changed").otherwise(F.col("src_hash")).alias("src_hash"))
    merged = LD.merge_ledger(spark, path, drafts, "now")
    want = L.ledger_merge(rows.where("project_id IN (1, 4)"), drafts, "now")
    assert sorted(r["action"] for r in merged.collect()) == sorted(r["action"] for r in want.collect())
    got = {(r["project_id"], r["stable_key"]): (r["ord"], r["status"], r["src_hash"]) for r in LD.read_ledger(spark, path).collect()}
    expected = {(r["project_id"], r["stable_key"]): (r["ord"], r["status"], r["src_hash"]) for r in want.where("action <> 'delete'").unionByName(rows.where("project_id NOT IN (1, 4)"), allowMissingColumns=True).collect()}
    assert got == expected
    # only the drafts move: nothing is exchanged between the stored files and the join
    stored = LD.stored_side(spark, path, drafts.select("project_id").distinct(), [0, 1, 2])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = plan_of(L.ledger_merge(stored, drafts, "now"))
    assert before != "-1" and "Bucketed: true" in plan
    join = plan[plan.index("SortMergeJoin") if "SortMergeJoin" in plan else plan.index("ShuffledHashJoin") :]
    stored_side = join[: join.index("Bucketed: true")]
    assert "Exchange hashpartitioning" not in stored_side


def test_ledger_opens_in_another_session(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), ledger_rows(spark, 50)
    LD.write_ledger(rows, path, groups=3, buckets=4)
    spark.sql(f"DROP TABLE {LD.open_ledger(spark, path)[0]}")  # as a session that doesn't know it
    assert LD.read_ledger(spark, path).count() == 50
    with pytest.raises(FileNotFoundError):
        LD.read_ledger(spark, str(tmp_path / "none"))


# --- books and archives -----------------------------------------------------------------------------------------------------


def test_books_are_files(spark, tmp_path):
    projects = spark.createDataFrame([(1, "My Book: / x", "md"), (2, "..", "epub"), (3, None, "md")], "id long, title string, source_type string")
    made = spark.sparkContext.accumulator(0)

    def seen(t):
        made.add(1)
        return t

    parts = spark.createDataFrame([(1, 10, "second\n"), (1, 2, "first é\n"), (3, 1, "")], "project_id long, part long, text string").withColumn("text", F.udf(seen)("text"))
    pages = spark.createDataFrame([(2, k, f"{k}&.xhtml", f"<p>{k}</p>") for k in (1, 0)], "project_id long, ord long, file string, html string")
    rows = parts.withColumn("member", F.lit(None).cast("string")).unionByName(D.package_members(pages))
    manifest = {r["filename"]: r for r in D.export_sink(projects, rows, str(tmp_path), "T").collect()}
    assert sorted(manifest) == ["my-book-x-p1-T.md", "translation-p2-T.epub", "translation-p3-T.md"]
    assert made.value == 3 and sorted(os.listdir(tmp_path)) == ["books", "manifest"] and sorted(os.listdir(tmp_path / "books")) == sorted(manifest)
    for name, r in manifest.items():
        raw = (tmp_path / "books" / name).read_bytes()
        assert len(raw) == r["size"] and hashlib.sha256(raw).hexdigest() == r["sha256"]
    assert (tmp_path / "books" / "my-book-x-p1-T.md").read_text() == "first é\nsecond\n"
    with zipfile.ZipFile(tmp_path / "books" / "translation-p2-T.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.testzip() is None
    docs = K.read_epubs(spark, str(tmp_path / "books")).collect()
    assert [(r["spine_ord"], r["file"], r["html"]) for r in docs] == [(0, "OEBPS/0&.xhtml", "<p>0</p>"), (1, "OEBPS/1&.xhtml", "<p>1</p>")]


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    projects = spark.createDataFrame([(k, f"b{k}", "md") for k in range(6)], "id long, title string, source_type string")
    parts = spark.range(6).select(F.col("id").alias("project_id"), F.lit(0).alias("part"), F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken"):
        D.export_sink(projects, parts, str(tmp_path / "out"), "T")
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_archives_are_read_from_their_end(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", '<package><manifest><item id="a" href="a.xhtml"/><item id="n" href="n.xhtml" properties="nav"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="a"/></spine></package>')
        z.writestr("a.xhtml", "<p>a</p>" * 200_000)
        z.writestr("n.xhtml", "nav")
    with open(tmp_path / "large.epub", "wb") as f:  # what stands before an archive doesn't count; the gap takes no disk
        f.seek(2_300_000_000)
        f.write(box.getvalue())
    (tmp_path / "small.EPUB").write_bytes(box.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "cut.epub").write_bytes(box.getvalue()[:-30])
    (tmp_path / "none.epub").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(box.getvalue())
    members = K.list_archives(spark, str(tmp_path))
    verdicts = {os.path.basename(r["path"]): (r["members"], r["verdict"]) for r in D.screen_archives(members).collect()}
    assert verdicts == {"large.epub": (4, "ok"), "small.EPUB": (4, "ok"), "bad.epub": (0, "not an archive"), "cut.epub": (0, "not an archive"), "none.epub": (0, "not an archive")}
    assert sorted(r["path"] for r in K.list_archives(spark, f"file://{tmp_path}").select("path").distinct().collect()) == sorted(f"file://{tmp_path}/{n}" for n in verdicts)
    read = {os.path.basename(r["path"]): (r["bytes_read"], r["file_size"]) for r in members.collect()}
    assert read["large.epub"][1] > 2_300_000_000 and read["large.epub"][0] < 1000 and read["small.EPUB"][0] < 1000
    docs = K.read_epubs(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r["path"]), r["file"], len(r["html"] or "")) for r in docs if r["reason"] is None) == [("large.epub", "a.xhtml", 1_600_000), ("small.EPUB", "a.xhtml", 1_600_000)]
    assert sorted(os.path.basename(r["path"]) for r in docs if r["reason"]) == ["bad.epub", "cut.epub", "none.epub"]


# --- kept counts ---------------------------------------------------------------------------------------------------------------


def test_kept_counts_equal_a_recount(spark, tmp_path):
    draw = random.Random(9)
    rows = ledger_rows(spark, 60, 4).withColumn("chapter_id", F.col("id") % 5)
    counts, projects = P.status_counts(rows), spark.range(5)
    languages = projects.select("id", F.lit("en").alias("source_lang"), F.lit("de").alias("target_lang"))
    texts = M.text_counts(M.with_languages(rows, languages))
    for step in range(5):
        kind = draw.randrange(3)
        if kind == 0:
            drafts = rows.where(f"id % {draw.randrange(3, 7)} <> 0").select("project_id", "stable_key", "chapter_id", "ord", "source_text", F.when(F.col("ord") % draw.randrange(2, 5) == 0, F.lit(f"h{step}")).otherwise(F.col("src_hash")).alias("src_hash"))
            fresh = rows.where(f"id % 9 = {step}").select("project_id", F.concat("stable_key", F.lit(f"+{step}")).alias("stable_key"), "chapter_id", "ord", "source_text", "src_hash")
            changed = L.ledger_merge(rows, drafts.unionByName(fresh), "now")
            after = changed.where("action <> 'delete'").drop("action", "old").withColumn("id", F.xxhash64("project_id", "stable_key"))
        elif kind == 1:
            edits = rows.where(f"id % 3 = {step % 3}").select(F.col("id").alias("segment_id"), F.lit("edit").alias("new_text"), F.lit("reviewed").alias("new_status"), F.lit(True).alias("has_text"))
            changed = L.apply_edits(rows, edits)
            after = changed.drop("rejected", "to_tm", "old").unionByName(rows.join(edits, F.col("id") == F.col("segment_id"), "left_anti"))
        else:
            changed = L.bulk_action(rows.where(f"id % 2 = {step % 2}"), "set_pending")
            after = changed.drop("updated", "old").unionByName(rows.where(f"id % 2 <> {step % 2} OR id IS NULL"))
        columns = [c for c in rows.columns if c in after.columns]
        counts = P.apply_changes(counts, P.count_changes(changed))
        path = str(tmp_path / f"s{step}")
        after.select(columns).write.parquet(path)
        counts.write.parquet(path + "-counts")
        M.apply_text_changes(texts, M.text_changes(changed, languages)).write.parquet(path + "-texts")
        rows, counts, texts = spark.read.parquet(path), spark.read.parquet(path + "-counts"), spark.read.parquet(path + "-texts")
        assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, M.text_counts(M.with_languages(rows, languages)).select(texts.columns).collect()))
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, P.status_counts(rows).select(counts.columns).collect()))
    assert sorted(map(tuple, P.progress_of_counts(projects, counts).collect())) == sorted(map(tuple, P.project_progress(projects, rows).select(P.progress_of_counts(projects, counts).columns).collect()))


# --- texts from events out of order ------------------------------------------------------------------------------------------


def event(k, kind="segment_delta", text=None, minute=None, segment=1):
    return (k, datetime(2026, 1, 1) + timedelta(minutes=k if minute is None else minute), 1, segment, kind, f"d{k} " if kind == "segment_delta" else None, text, "done" if kind == "segment_done" else None)


EVENTS = "id long, ts timestamp, project_id long, segment_id long, type string, delta string, target_text string, status string"


def run_stream(spark, tmp_path, batches):
    """The last text of each segment after events in batches, and how many events the state holds at the most."""
    source = tmp_path / "in"
    for n, rows in enumerate(batches):
        path = tmp_path / f"b{n}"
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(path))
        (file,) = path.glob("*.parquet")
        source.mkdir(exist_ok=True)
        os.rename(file, source / f"{n:03d}.parquet")
        os.utime(source / f"{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    ST.state_store(spark)
    out = {}

    def put(rows, _):
        for r in rows.collect():
            out[r["segment_id"]] = r.asDict()

    stream = ST.stream_segment_text(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source)))
    run = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(put).outputMode("update").start()
    run.awaitTermination()
    states = [o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]]
    return out, max(states or [0])


def test_any_order_gives_one_text(spark, tmp_path):
    events = [event(k) for k in range(40)]
    events[7] = event(7, "segment_reset")
    events[20] = event(20, "segment_done", "whole ")
    events += [event(k, minute=k - 80, segment=2) for k in range(100, 110)]
    want = "whole " + "".join(f"d{k} " for k in range(21, 40))
    for seed in (1, 2):
        mixed = events[:]
        random.Random(seed).shuffle(mixed)
        out, _ = run_stream(spark, tmp_path / str(seed), [mixed[k::5] + mixed[:3] for k in range(5)])  # some come again
        assert out[1]["text"] == want and out[1]["status"] == "done" and out[1]["last_id"] == 39
        assert out[2]["text"] == "".join(f"d{k} " for k in range(100, 110))


def test_state_is_bounded_and_late_events_are_dropped(spark, tmp_path):
    """Hours of events in order: what the watermark has passed is settled; an event of long ago changes nothing."""
    batches = [[event(k) for k in range(60 * n, 60 * n + 60, 2)] for n in range(6)]
    batches[5] += [event(1, minute=1)]
    batches[1] += [event(5, minute=110)]  # a small id, but in time: what waits for it is not settled
    out, held = run_stream(spark, tmp_path, batches)
    assert out[1]["text"] == "".join(f"d{k} " for k in sorted([*range(0, 360, 2), 5]))
    assert held < 140


def test_fold():
    rows = pd.DataFrame([event(k) for k in range(4)], columns=[c.split()[0] for c in EVENTS.split(", ")])
    assert ST.fold("x ", "pending", rows) == ("x d0 d1 d2 d3 ", "pending")
    rows.loc[2, ["type", "target_text", "status"]] = ["segment_updated", "new ", "reviewed"]
    assert ST.fold("x ", "pending", rows.iloc[::-1]) == ("new d3 ", "reviewed")
    rows.loc[3, "type"] = "segment_reset"
    assert ST.fold("x ", "pending", rows) == ("", "reviewed")


def test_a_large_first_import_makes_more_buckets(spark, tmp_path, monkeypatch):
    """No task gets more than a bucket, so buckets are as many as their size asks for; later writes keep the shape."""
    path = str(tmp_path / "ledger")
    monkeypatch.setattr(LD, "LARGEST", 1000)
    rows = ledger_rows(spark, 4000)
    LD.write_ledger(rows, path, 2, 4)
    buckets = LD.open_ledger(spark, path)[2]
    assert buckets > 16
    files = [f for g in folders(f"{path}/rows", LD.GROUP) for f in os.listdir(f"{path}/rows/{g}") if f.endswith(".parquet")]
    assert len(files) > 16
    LD.write_ledger(rows.where("project_id < 2"), path, 2, 4)
    assert LD.open_ledger(spark, path)[2] == buckets and LD.read_ledger(spark, path).count() == 4000
    small = str(tmp_path / "small")
    monkeypatch.undo()
    LD.write_ledger(rows, small, 2, 4)
    assert LD.open_ledger(spark, small)[2] == 4


def test_previous_pairs_cross_runs(spark, monkeypatch):
    """Runs of two ordinals: the pairs before a segment lie in runs before it, some of which have none."""
    monkeypatch.setattr(C, "RUN", 2)
    rng = random.Random(7)
    rows = [(1000 * p + k, p, k, rng.choice(["done", "pending", "reviewed"]) if k % 9 < 4 else "error", f"中s{k}", rng.choice(["", f"t{k}", None])) for p in (1, 2) for k in range(40)]
    frame = spark.createDataFrame(rows, "id long, project_id long, ord long, status string, source_text string, target_text string")
    for n in (0, 1, 3, 5):
        got = {r["id"]: r["previous"] for r in C.recent(frame, n).collect()}
        plain = {r["id"]: r["previous"] for r in C.rolling_context(frame, n).collect()}
        assert len(got) == len(rows)
        for id_, p, k, *_ in rows:
            ready = [(r[2], r[4], r[5]) for r in rows if r[1] == p and r[2] < k and r[3] in ("done", "reviewed") and r[5] is not None]
            want = [x for x in ready[-n:] if x[2] != ""] if n else []
            assert [tuple(x) for x in plain[id_] or []] == want
            assert [tuple(x) for x in got[id_] or []] == [(*x, 5, len(x[1]) + len(x[2]) + 8) for x in want]


def test_terms_of_a_segment_are_one_row(spark, monkeypatch):
    """Also where a project's terms lie in several groups; texts and places don't come along."""
    monkeypatch.setattr(G, "TERMS", 2)
    s = spark.createDataFrame([(1, 1, "A party in New York"), (2, 1, "Straße"), (3, 1, "none"), (4, 2, "art")], "id long, project_id long, source_text string")
    g = spark.createDataFrame([(9, 1, "art", "艺术", None, False, True), (2, 1, "new york", "纽约", None, False, True), (3, 1, "NEW", "新", None, True, True), (4, 1, " ", "x", None, False, True), (5, 1, "STRASSE", "路", None, False, True), (6, 1, "New", "x", "n", True, True)], "id long, project_id long, source_term string, target_term string, note string, case_sensitive boolean, enabled boolean")
    lists = G.term_lists(s, g)
    assert lists.columns == ["id", "terms"]
    assert {r["id"]: [t["term_id"] for t in r["terms"]] for r in lists.collect()} == {1: [2, 6, 9], 2: [5]}


def test_contexts_cost_each_text_once(spark, tiny):
    """Segments are read from where they were written, not worked out at each use."""
    from foliant import plans

    plan = plans.queries()["build_context"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 12
    rows = spark.createDataFrame([("中文 ab",), ("",), (None,), ("x" * 9,)], "t string").select(T.estimate_tokens(F.col("t")).alias("n"), T.fits(F.col("t"), 2).alias("f")).collect()
    assert [(r["n"], r["f"]) for r in rows] == [(3, False), (0, True), (1, True), (3, False)]


def test_waiting_events_are_kept_only_as_far_as_needed(spark, tmp_path):
    """Within the watermark's span every event waits, but what stands before the last reset is not kept; an event that
    comes late before it changes the status alone."""
    minute = lambda k: k // 10
    events = [event(k, "segment_reset" if k % 20 == 10 else "segment_delta", minute=minute(k)) for k in range(0, 400, 2)]
    late = [event(31, "segment_done", "old ", minute=38), event(395, minute=38), event(5, "segment_reset", minute=38)]
    out, held = run_stream(spark, tmp_path, [events, late])
    assert out[1]["text"] == "".join(f"d{k} " for k in sorted([*range(392, 400, 2), 395]))
    assert out[1]["status"] == "done" and out[1]["last_id"] == 398
    assert held < 20


def test_needed_events_give_the_same_text():
    """Folding what is kept and what comes later equals folding everything, whatever the cut."""
    rng = random.Random(3)
    kinds = ["segment_delta", "segment_done", "segment_error", "segment_reset", "segment_updated"]
    for _ in range(300):
        events = [(k, k, rng.choice(kinds), rng.choice([None, f"d{k}"]), rng.choice([None, None, f"T{k}"]), rng.choice([None, f"s{k}"])) for k in range(12)]
        first = sorted(rng.sample(events, rng.randint(1, 12)))
        kept = ST.needed(first)
        later = [e for e in events if e not in first]
        assert set(kept) <= set(first) and kept[-1] == first[-1]
        assert ST.folded("x", "pending", sorted(kept + later)) == ST.folded("x", "pending", sorted(first + later))


def test_later_waves_read_what_is_open_alone(spark, tmp_path, monkeypatch):
    """The candidates' table is read for the first wave's rows and not for those of later ones."""
    path, real, reads = str(tmp_path / "candidates"), M.written, []
    rows = [(k, 1, 1, k, str(k), "text", None, f"h{k % 2}", "pending", None, None, None, None, None, "en", "zh") for k in range(8)]
    spark.createDataFrame(rows, SEGMENT + ", source_lang string, target_lang string").write.parquet(path)

    def spy(df, name):
        if name == "leads":
            reads.append(any(path in f for f in df.inputFiles()))
        return real(df, name)

    monkeypatch.setattr(M, "written", spy)
    answer = lambda leads: leads.select(F.col("id").alias("segment_id"), F.lit("T").alias("text"), F.lit(1).alias("in_tokens"), F.lit(1).alias("out_tokens"), F.lit("m").alias("model"), F.when(F.col("ord") < 4, "timeout").alias("error"), F.array().cast("array<struct<marker:string,original:string>>").alias("replacements"), F.lit(-1).alias("n_slots"))
    out = {r["id"]: (r["outcome"], r["wave"]) for r in M.translate_waves(spark.read.parquet(path), answer).collect()}
    assert out == {k: ("error", k // 2 + 1) if k < 4 else ("done", 3) if k < 6 else ("hit", None) for k in range(8)}
    assert reads == [True, False, False]


def test_asked_rows_get_their_own_pairs(spark, monkeypatch):
    """Rows that are asked for stand among the pairs alone; done ones among them don't get themselves."""
    monkeypatch.setattr(C, "RUN", 3)
    rng = random.Random(9)
    rows = [(1000 * p + k, p, k, rng.choice(["done", "pending", "error"]), f"s{k}", rng.choice(["", f"t{k}", None])) for p in (1, 2) for k in range(30)]
    frame = spark.createDataFrame(rows, "id long, project_id long, ord long, status string, source_text string, target_text string")
    asked = frame.where("id % 3 = 1").select("id", "project_id", "ord", F.struct("status", "id").alias("own"))
    for n in (0, 2, 3):
        want = {r["id"]: r["previous"] for r in C.recent(frame, n).where("id % 3 = 1").collect()}
        got = C.recent(frame, n, ("own",), asked).collect()
        assert {r["id"]: r["previous"] for r in got} == want and len(got) == len(want)
        assert all(r["own"]["id"] == r["id"] for r in got)


def test_written_tables_keep_no_shuffle(spark):
    """What a table was shuffled by goes when the table is there, and a table that nothing reads again goes as a whole."""
    roots = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for root in roots for _, _, names in os.walk(root) for f in names if f.startswith("shuffle_")}
    before = files()
    made = scratch.written(spark.range(5000).repartition(7, "id"), "made")
    for _ in range(40):
        if files() <= before:
            break
        time.sleep(0.25)
    assert files() <= before and made.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    folder = scratch.place(made).removeprefix("file:")
    assert os.path.isdir(folder)
    scratch.remove(made)
    assert not os.path.exists(folder)


def test_merges_leave_what_they_give_alone(spark, tmp_path, monkeypatch):
    """Of a merge's tables the merged rows stay; stored rows of other projects don't move, and folders don't fill with files,
    with projects by broadcast and beyond that."""
    for k, few in enumerate((LD.FEW, 0)):
        own = tmp_path / str(k)
        own.mkdir()
        monkeypatch.setattr(scratch, "shared", lambda _, name, own=own: f"{own}/tables/{name}-{uuid.uuid4().hex}")
        monkeypatch.setattr(LD, "FEW", few)
        path, rows = str(own / "ledger"), ledger_rows(spark)
        LD.write_ledger(rows, path, groups=1, buckets=2)
        assert list((own / "tables").iterdir()) == []
        for p in range(5):
            drafts = rows.where(f"project_id = {p}").select("project_id", "stable_key", "chapter_id", "ord", F.concat("source_text", F.lit("!")).alias("source_text"), F.lit("h").alias("src_hash"))
            merged = LD.merge_ledger(spark, path, drafts, "now")
            left = list((own / "tables").iterdir())
            assert [f.name.split("-")[0] for f in left] == ["merged"] and merged.count() == 50
            scratch.remove(merged)
        got = LD.read_ledger(spark, path)
        assert got.count() == 400 and got.where("source_text LIKE '%!'").count() == 250 == got.where("src_hash = 'h' AND status = 'pending' AND project_id < 5").count()
        files = [f for g in folders(f"{path}/rows", LD.GROUP) for f in os.listdir(f"{path}/rows/{g}") if f.endswith(".parquet")]
        assert len(files) <= 4


def test_a_write_copies_what_comes_alone(spark, tmp_path, monkeypatch):
    """Stored rows of other projects are never written elsewhere, and what came goes when it is in its place."""
    real, names = LD.written, []
    monkeypatch.setattr(scratch, "shared", lambda _, name: f"{tmp_path}/tables/{name}-{uuid.uuid4().hex}")
    monkeypatch.setattr(LD, "written", lambda df, name: names.append((name, df.count())) or real(df, name))
    path, rows = str(tmp_path / "ledger"), ledger_rows(spark)
    LD.write_ledger(rows, path, groups=1, buckets=2)
    LD.write_ledger(rows.where("project_id = 3 AND ord < 100"), path)
    assert names == [("incoming", 400), ("projects", 8), ("incoming", 13), ("projects", 1)]
    assert list((tmp_path / "tables").iterdir()) == []
    assert LD.read_ledger(spark, path).groupBy("project_id").count().where("count <> 50").collect() == [(3, 13)]


def test_segments_come_back_with_their_terms(spark, monkeypatch):
    """Every row once and whole, with or without text, terms or a project that has terms, whether a project's terms are one
    group or more; only more than one make another shuffle by id."""
    rows = [(k, k % 3, random.Random(k).choice(["A party in New York", "Straße", "none", "", None]), k * 2) for k in range(40)]
    s = spark.createDataFrame(rows, "id long, project_id long, source_text string, more long")
    g = spark.createDataFrame([(9, 1, "art", "艺术", None, False, True), (2, 1, "new york", "纽约", None, False, True), (3, 1, "NEW", "新", None, True, True), (4, 2, " ", "x", None, False, True), (5, 2, "STRASSE", "路", None, False, True), (6, 1, "New", "x", "n", True, True)], "id long, project_id long, source_term string, target_term string, note string, case_sensitive boolean, enabled boolean")
    for most in (G.TERMS, 2):
        monkeypatch.setattr(G, "TERMS", most)
        wide = G.with_terms(s, g)
        assert wide.columns == [*s.columns, "terms"]
        assert ("collect_list" in wide._jdf.queryExecution().optimizedPlan().toString()) == (most == 2)
        want = {r["id"]: r["terms"] for r in G.term_lists(s, g).collect()}
        got = wide.collect()
        assert sorted(tuple(r)[:4] for r in got) == sorted(rows) and {r["id"]: r["terms"] for r in got if r["terms"] is not None} == want
        assert len(want) > 5
    assert all(r["terms"] is None for r in G.with_terms(s, g.limit(0)).collect())


def test_contexts_move_whole_rows_once(spark, tiny):
    """What is left to run after rows have their terms and summaries: one shuffle of texts, by run."""
    from foliant import plans

    plan = plan_of(plans.queries()["build_context"](spark, tiny))
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("(project_id#" in line and "run#" in line and "REPARTITION" in line for line in moved) == 1
    assert "collect_list(terms" not in plan and "FlatMapCoGroupsInArrow" not in plan
