"""Operators 11 to 13 against brute force, and near duplicates in tables with awkward columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import manifest, neardup, similar, whitening, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- 11 ---------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, low=False):
    text = r["text"]
    if low and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return sha(*[part(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        run = level[a : a + 16]
        out.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
        i //= 16
    return out


def slow_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[s] = grow([leaf_of(r) for r in by[s]])
    top = grow([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = siblings(trees[s], i) + siblings(top, k)
            x = leaf_of(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            for a, b in steps:
                x = sha(a, x, b)
            out.append((r["doc_id"], leaf_of(r), trees[s][-1][0], top[-1][0], sha(*[a + b for a, b in steps]), x, x == top[-1][0]))
    return out


def check_manifest(docs):
    found = manifest.manifest(docs)
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows_of(found)]
    assert sorted(map(repr, got)) == sorted(map(repr, slow_manifest(rows_of(docs.select("doc_id", "text", "lang", "source", "n_chars")))))
    return got


def test_manifest(spark, tiny):
    got = check_manifest(spark.read.parquet(f"{tiny}/documents.parquet"))
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (257, 1), (300, 290), (600, 3)])
def test_manifest_shapes(spark, n, sources):
    """Full and broken runs, many sources of one row, a source with most rows, as ids far apart."""
    rows = [(k * 7 - 50, f"Text {k}", "en", f"s{(k * k) % sources}" if k % 3 else "s0", k) for k in range(n)]
    check_manifest(spark.createDataFrame(rows, SCHEMA))


def test_manifest_awkward(spark):
    rows = [(None, None, None, None, None), (None, "Null id", "en", "é", 1), (5, "A", "en", "", 1), (5, "A", "en", "", 1), (5, "B", "en", "", 1), (10, "", None, "é", None), (11, "Ünï 😀 ABC" * 5000, "x:y", "Z", -3), (15, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check_manifest(docs)
    clash = docs.selectExpr("*", "1 AS key", "2 AS rank", "map('a', 1) AS steps", "'x' AS leaf", "0 AS tie", "0 AS first")
    assert sorted(map(repr, rows_of(manifest.manifest(clash)))) == sorted(map(repr, rows_of(manifest.manifest(docs))))
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


# --- 12 ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def slow_whitening(rows, want=8):
    kept = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    x = np.floor(1024 * np.array([np.float32(v) for _, v in kept]).astype(float)) + 100000
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    cov = c.T @ c / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:want], axes[:, ::-1][:, :want]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [i for i, _ in kept], c @ axes / np.sqrt(values), values / np.trace(cov), deviations


def check_whitening(spark, rows):
    got = rows_of(whitening.whitened(spark.createDataFrame(rows, VECTORS)))
    ids, want, shares, deviations = slow_whitening(rows)
    m = max(r["component"] for r in got)
    table = np.zeros((len(ids), m))
    place = {i: k for k, i in enumerate(ids)}
    assert len(got) == len(ids) * m
    for r in got:
        k = place[r["vec_id"]]
        table[k, r["component"] - 1] = r["whitened"]
        assert r["n"] == len(ids) and r["deviation"] == deviations[k] and r["identity_error"] < 1e-9
        assert abs(r["explained"] - shares[r["component"] - 1]) < 1e-9 * r["explained"] + 1e-12
    return table, want


@pytest.mark.parametrize("n, d", [(400, 20), (60, 3), (9, 12)])
def test_whitening(spark, n, d):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, d)) * np.linspace(3, 0.2, d) + 5
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000, None), (1001, [None] + [1.0] * (d - 1)), (1002, [float("nan")] * d), (1003, [float("-inf")] * d)]
    table, want = check_whitening(spark, rows)
    assert table.shape[1] == min(8, d, n - 1)
    sign = np.sign((table * want[:, : table.shape[1]]).sum(0))
    assert np.abs(table * sign - want[:, : table.shape[1]]).max() < 1e-7


def test_whitening_with_equal_values(spark):
    """A cross has the same variance along every axis: any axes do, and all eight are found."""
    d = 12
    rows = [(k, [float(s * (j == k % d)) for j in range(d)]) for k, s in enumerate([1, -1] * (2 * d))]
    got = rows_of(whitening.whitened(spark.createDataFrame(rows, VECTORS)))
    assert {r["component"] for r in got} == set(range(1, 9)) and got[0]["identity_error"] < 1e-9
    assert max(abs(r["explained"] - 1 / d) for r in got) < 1e-2


def test_whitening_awkward(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whitened(none).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)).count() == 0  # no variance
    assert whitening.whitened(spark.createDataFrame([(1, []), (2, [])], VECTORS)).count() == 0
    same = [(7, [1.0, 2.0])] * 4 + [(None, [3.0, 5.0]), (8, [0.0])]
    got = rows_of(whitening.whitened(spark.createDataFrame(same, VECTORS).selectExpr("*", "1 AS x", "map(1, 2) AS n")))
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1)] + [(7, 1)] * 4
    far = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])]
    got = rows_of(whitening.whitened(spark.createDataFrame(far, VECTORS)))
    assert len(got) == 6 and got[0]["identity_error"] < 1e-4


# --- 13 ---------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_contamination(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def check_contamination(docs, items):
    got = rows_of(winnowing.contamination(docs, items))
    want = slow_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(map(repr, (tuple(r.values())[:6] for r in got))) == sorted(map(repr, want))
    for r in got:
        assert r["n_items"] == len(r["items"])
    return got


def test_contamination(spark, tiny):
    got = check_contamination(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet"))
    assert any(r["contaminated"] for r in got)


def test_contamination_planted(spark):
    """Short items, items that share windows, passages cut to nine and ten words, overlapping hits, odd gaps."""
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 30, n)]
    items = [(k, " ".join(draw(int(n)))) for k, n in enumerate(rng.integers(10, 40, 30))]
    items += [(100 + n, " ".join(f"short{j}" for j in range(n))) for n in range(1, 10)]
    items += [(200, items[0][1]), (201, "shared " + items[1][1]), (202, None), (203, " ?! "), (None, "Null id"), (100, "same id twice here")]
    docs = []
    for k in range(80):
        text = draw(int(rng.integers(0, 60)))
        for _ in range(int(rng.integers(0, 4))):
            source = words_of(items[int(rng.integers(0, 40))][1])
            n = int(rng.integers(1, len(source) + 1)) if k % 2 else min(len(source), 9 + k % 3)
            at = int(rng.integers(0, len(source) - n + 1))
            text += [w.upper() for w in source[at : at + n]] + draw(2)
        docs.append((k, ["; ", "\n", " é "][k % 3].join(text) if k % 4 else " ".join(text)))
    docs += [(None, items[3][1]), (500, None), (501, ""), (502, "short0"), (503, items[4][1] + " " + items[4][1]), (503, items[4][1]), (504, "x " * 30000 + items[5][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = check_contamination(d, i)
    assert sum(r["contaminated"] for r in got) > 20
    clash = winnowing.contamination(d.selectExpr("*", "1 AS row", "map(1, 2) AS fps", "0 AS n_words"), i.selectExpr("*", "1 AS fp", "2 AS window"))
    assert sorted(map(repr, rows_of(clash))) == sorted(map(repr, got))


def test_contamination_awkward(spark, tiny):
    items = spark.read.parquet(f"{tiny}/benchmark.parquet")
    none, docs = items.limit(0), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert winnowing.contamination(docs.limit(0), items).count() == 0
    assert [r["contaminated"] for r in rows_of(winnowing.contamination(docs, none))] == [False, False]


def test_every_shared_window_shares_a_fingerprint():
    rng = np.random.default_rng(8)
    text = [f"t{x}" for x in rng.integers(0, 50, 400)]
    one = winnowing.Words([" ".join(text), "apart"])
    starts, fps = winnowing.fingerprints(one, 10)
    assert starts.tolist() == list(range(391))
    for k in (0, 17, 390):
        other = winnowing.Words(["before  this", "-".join(["x", *text[k : k + 10], "y"])])
        at, h = winnowing.fingerprints(other, 10)
        assert fps[k] in h[at == 3]
        assert one.window(k, 10) == other.window(3, 10)
    assert len(set(fps.tolist())) < 200  # far fewer than windows


# --- near duplicates in awkward tables ------------------------------------------------------------------------------


@pytest.mark.parametrize("keep_first", [similar.keep_first, neardup.keep_first])
def test_near_dedup_keeps_any_columns(spark, keep_first):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("b", long), ("a", long + " "), ("c", "something else that is not like it at all, is it"), ("c", "another text under the same id, read as one document"), (None, long), (None, "nameless and alone in its class of texts here"), (None, "nameless and alone in its class of texts here"), ("d", None), ("e", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "map('k', doc_id) AS tags", "1 AS _class", "2 AS _node", "3 AS _kept", "4 AS _first", "5 AS _fp", "6 AS fp", "7 AS node", "8 AS root", "9 AS component_id", "array(map(1, 2)) AS row", "0 AS _number", "0 AS n")
    out = keep_first(docs)
    assert out.schema.names == docs.schema.names
    got = [(r["doc_id"], r["text"], r["tags"], r["_class"], r["_fp"], r["root"]) for r in out.collect()]
    want = [("a", long + " "), ("c", "another text under the same id, read as one document"), (None, "nameless and alone in its class of texts here"), ("d", None)]
    assert sorted(map(repr, got)) == sorted(repr((d, t, {"k": d}, 1, 5, 8)) for d, t in want)
