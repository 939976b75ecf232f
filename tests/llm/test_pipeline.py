"""The pipeline against its stages done by brute force on what the stage before kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import neardup, similar, store


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{tiny}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, tiny).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_kept_documents(spark, tiny, stages):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    sizes = [docs.count(), *(s.count() for s in stages[:3])]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    for s in stages[:3]:
        assert s.schema == docs.schema
        assert s.exceptAll(docs).isEmpty()
    labels = spark.read.parquet(f"{tiny}/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id", "left_semi").where("size(split(text, ' ')) >= 15").count()
    assert stages[1].join(labels, "doc_id", "left_semi").count() >= 0.93 * clean


def test_near_dedup_matches_brute_force(stages):
    want = slow_similar([(r["doc_id"], r["text"]) for r in stages[1].collect()])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(d for d, c in want.items() if d == c)


def test_packing_has_every_token_once(stages):
    pieces = [r.asDict() for r in stages[3].collect()]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert set(tokens) == {r["doc_id"] for r in stages[2].collect()}
    assert sum(r["length"] for r in pieces) == sum(tokens.values())
    assert max(r["sequence_id"] for r in pieces) + 1 == -(-sum(tokens.values()) // 4096)


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_similar(rows):
    """component_id of each (doc_id, text) by comparing all pairs of shingle sets."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 9 * both >= 4 * (len(a) + len(sets[j])) > 0:
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(d, least.get(find(k), d))
    return {d: least[find(k)] for k, (d, _) in enumerate(rows)}


def test_near_dedup_takes_similar_texts(spark, tiny):
    """Long texts with a few words changed lie more than four bits apart, yet are similar by 0.8 or more."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        rows.append((10 * k, " ".join(words)))
        for n in range(1, 4):
            for at in rng.choice(len(words), n, False):
                words[at] = f"x{rng.integers(1 << 30)}"
            rows.append((10 * k + n, " ".join(words)))
    rows += [(1000 + k, t) for k, t in enumerate(["", " ", "Two words", "two  words", "a b c d e f"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_similar(rows)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, tiny).collect()}
    assert kept == {d for d, c in want.items() if d == c}
    assert len(neardup.keep_first(docs).collect()) > len(kept)


def test_similar_texts_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert {r["doc_id"]: r["component_id"] for r in similar.similar(docs).collect()} == slow_similar([tuple(r) for r in docs.collect()])


def test_dealt_groups(spark, monkeypatch):
    monkeypatch.setattr(similar, "NODES", 3)
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*words[:90], *[f"y{k}"] * 6])) for k in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_similar(rows) and set(got.values()) == {0}


@pytest.mark.parametrize("nodes", [3, 25, 1000])
def test_rings_lose_no_link(spark, monkeypatch, nodes):
    """Two drifting chains, a dense group and texts far from all, put into one group by hand: every ring is filled."""
    monkeypatch.setattr(similar, "NODES", nodes)
    words = [f"w{k}" for k in range(600)]
    texts = [" ".join(words[2 * k : 2 * k + 60]) for k in range(60)] + [" ".join(words[300 + 5 * k : 360 + 5 * k]) for k in range(40)]
    texts += [" ".join([*words[100:190], f"y{k}"]) for k in range(50)] + [f"z{k} z z z z{k}" for k in range(20)]
    rows = list(enumerate(texts))
    table = store.written(similar.described(spark.createDataFrame(rows, "doc_id long, text string"), 5), "shingles")
    found = {r["a"]: set() for r in table.select(F.col("node").alias("a")).collect()}
    ids = {r["node"]: r["doc_id"] for r in table.collect()}
    for r in similar.links(table, table.select("node", F.lit(1).cast("long").alias("root")).distinct()).collect():
        a, b = shingle_set(texts[ids[r["a"]]]), shingle_set(texts[ids[r["b"]]])
        assert 9 * len(a & b) >= 4 * (len(a) + len(b))
        found[r["a"]].add(r["b"])
        found[r["b"]].add(r["a"])
    for d, c in slow_similar(rows).items():
        assert min(ids[n] for n in reached(found, next(n for n, x in ids.items() if x == d))) == c


def reached(edges, start):
    seen, queue = {start}, [start]
    while queue:
        for n in edges[queue.pop()] - seen:
            seen.add(n)
            queue.append(n)
    return seen


@pytest.mark.parametrize("keep", [neardup.keep_first, similar.keep_first])
def test_rows_without_an_id_stay_apart(spark, keep):
    words = [f"w{k}" for k in range(200)]
    a, b, c, d = (" ".join(words[k : k + 50]) for k in (0, 50, 100, 150))
    rows = [(None, a), (None, a), (None, b), (None, c), (5, c), (6, d), (6, d), (None, None), (7, a[:90])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in keep(docs).collect()))) == sorted(map(str, [(None, a), (None, b), (None, None), (5, c), (6, d), (7, a[:90])]))


def test_hot_keys_do_not_meet(spark, monkeypatch):
    """Many empty texts, a giant class of unlike copies and a hub: the same result when they go by broadcast."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, None if k % 3 == 0 else "") for k in range(90)]
    rows += [(1000 + k, " ".join([*base[:195], *[f"x{k % 150}"] * (k % 5)])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {f: sorted(tuple(r) for r in f(docs).collect()) for f in (neardup.near_duplicates, similar.similar)}
    monkeypatch.setattr(store, "LEAST", 3)
    monkeypatch.setattr(store, "HOT", 1 << 40)
    for f, want in plain.items():
        assert sorted(tuple(r) for r in f(docs).collect()) == want
    keyed = spark.createDataFrame([(1, 900, "hub"), (2, 2, "leaf")], "k long, n long, name string")
    edges = spark.range(900).select(F.lit(1).cast("long").alias("k")).union(spark.createDataFrame([(2,), (2,)], "k long"))
    joined = store.attach(edges, keyed, "k")
    assert joined.count() == 902
    assert "Broadcast" in joined._jdf.queryExecution().toString()
