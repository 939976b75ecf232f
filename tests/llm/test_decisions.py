"""What operators decide, against plain second versions of the decision."""

import base64
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import fingerprints, licenses, rules

# --- 1: likeness -----------------------------------------------------------------------------------------------


def filters_of(text):
    raw, size = base64.b64decode(text), fingerprints.BITS // 8
    return [int.from_bytes(raw[k : k + size], "big") for k in range(0, len(raw), size)]


def slow_likeness(x, y):
    """For each filter of the shorter digest its best overlap with one of the other's, over what chance alone gives."""
    if not x or not y:
        return float(len(x) == len(y))
    if x == y:
        return 1.0
    if len(x) > len(y):
        x, y = y, x
    total = 0.0
    for a in x:
        best = 0.0
        for b in y:
            na, nb, both = a.bit_count(), b.bit_count(), (a & b).bit_count()
            chance, most = na * nb / fingerprints.BITS, min(na, nb)
            cut = chance + 0.3 * (most - chance)
            best = max(best, min(1.0, (both - cut) / max(most - cut, 1e-9)))
        total += best
    return total / len(x)


def test_likeness(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = sorted((r.asDict() for r in fingerprints.fingerprints(docs).collect()), key=lambda r: r["doc_id"])
    for k, r in enumerate(got):
        own, edited, after = (filters_of(x) for x in (r["fingerprint"], r["edited_fingerprint"], got[(k + 1) % len(got)]["fingerprint"]))
        assert r["near_edited"] == pytest.approx(slow_likeness(own, edited), abs=1e-9)
        assert r["near_next"] == pytest.approx(slow_likeness(own, after), abs=1e-9)
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.1


# --- 2: kept ------------------------------------------------------------------------------------------------------


def slow_votes(text):
    """Each rule's vote on a text, by the rules as they are described."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, w = len(words), max(len(words), 1)
    count = lambda p: len(re.findall(p, text))
    letter, upper = str.isalpha, lambda c: __import__("unicodedata").category(c) == "Lu"
    space = lambda c: c in " \t\n\x0b\x0c\r"
    others = sum(not letter(c) and not space(c) for c in text)
    runs = re.findall("U{2,}", "".join("U" if upper(c) else "x" for c in text))
    shape = "".join("L" if letter(c) else "s" if space(c) else "o" for c in text)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    seen = {x for x in windows if windows.count(x) > 1} if len(set(windows)) < len(windows) else set()
    repeat = len({i + j for i, x in enumerate(windows) if x in seen for j in range(5)})
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    size, symbols, attached = sum(map(len, words)) / w, count(r"[#*$%&|<>]"), len(re.findall("Lo{2,}", shape))
    bad = lambda x: -1 if x and n else 0
    return (n < 10 or 100 * repeat > 20 * n), (
        bad(symbols / w > 0.1), bad(count(r"[#*$%&|<>]+") / w > 0.1), bad(n >= 10 and others / w > 1), bad(attached / w > 0.15), bad(len(runs) / w > 0.3), bad(count("!") / w > 0.2), bad(repeat / w > 0.15),
        bad(n >= 50 and len(set(words)) / w**0.8 < 0.6), bad((len(lines) - len(set(lines))) / max(len(lines), 1) > 0.3), bad(size < 2 or size > 13),
        1 if n >= 10 and symbols <= 0.02 * w and count("!") <= 0.02 * w and len(runs) <= 0.05 * w and attached <= 0.05 * w and repeat <= 0.05 * w else 0,
    )


def slow_posterior(votes, rounds=25, tolerance=1e-4):
    """Expectation-maximisation row by row."""
    v = np.array(votes)
    prior, right = 0.8, np.full(v.shape[1], 0.85)

    def good():
        up = prior * np.prod(np.where(v > 0, right, np.where(v < 0, 1 - right, 1.0)), 1)
        down = (1 - prior) * np.prod(np.where(v > 0, 1 - right, np.where(v < 0, right, 1.0)), 1)
        return up / (up + down)

    for _ in range(rounds):
        g = good()
        new_prior = min(0.99, max(0.01, (g.sum() + 1) / (len(g) + 2)))
        hit = np.where(v > 0, g[:, None], np.where(v < 0, 1 - g[:, None], 0)).sum(0)
        new = np.clip((hit + 4) / ((v != 0).sum(0) + 5), 0.55, 0.995)
        moved = max(abs(new_prior - prior), np.abs(new - right).max())
        prior, right = new_prior, new
        if moved < tolerance:
            break
    return good()


def test_kept(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    marked = [slow_votes(t) for _, t in rows]
    posterior = slow_posterior([v for _, v in marked])
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    for (doc, _), (failed, votes), p in zip(rows, marked, posterior, strict=True):
        assert tuple(got[doc][f"vote_{r}"] for r in rules.RULES) == votes
        assert got[doc]["posterior"] == pytest.approx(p, abs=1e-6)
        assert got[doc]["kept"] == (not failed and got[doc]["posterior"] >= 0.5)
    assert {r["doc_id"] for r in rules.keep_good(docs).select("doc_id").collect()} == {d for d, r in got.items() if r["kept"]}


# --- 6: labels and scores ---------------------------------------------------------------------------------------------


def pattern_of(parts):
    """A template's markup as a pattern over words that each end in a space."""
    out = ""
    for p in parts:
        out += "(?:" if p == "[[" else ")?" if p == "]]" else rf"(?:\S+ ){{0,{p[2:-2]}}}" if p.startswith("<<") else re.escape(p) + " "
    return out


def slow_scan(text):
    """Labels, whole labels and score by patterns: a template's score is its longest beginning that stands in the text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    line = "".join(w + " " for w in words)
    has = lambda pattern: re.search(r"(?:(?<= )|^)" + pattern, line) is not None
    labels, whole, score = set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        if has(re.escape(phrase + " ")):
            labels.add(label)
            score = 1.0
    for n, (label, markup) in enumerate([*licenses.TEMPLATES, *licenses.WHOLE]):
        parts = re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup)
        depth, ends = 0, []
        for k, p in enumerate(parts):
            depth += (p == "[[") - (p == "]]")
            if depth == 0 and p not in ("[[", "]]") and not p.startswith("<<"):
                ends.append(k)
        if has(pattern_of(parts)):
            labels.add(label)
            if n >= len(licenses.TEMPLATES):
                whole.add(label)
            score = 1.0
        lo, hi = 0, len(ends)  # beginnings that stand there are those up to some length
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if has(pattern_of(parts[: ends[mid - 1] + 1])) else (lo, mid - 1)
        score = max(score, lo / len(ends))
    return ",".join(sorted(labels)), ",".join(sorted(whole)), score


def filled(markup, draw):
    """A text that a template accepts."""
    out, skip = [], 0
    for p in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup):
        if p == "[[":
            skip += bool(skip) or draw.random() < 0.5
        elif p == "]]":
            skip = max(skip - 1, 0)
        elif not skip:
            out += [f"name{draw.randrange(9)}" for _ in range(draw.randrange(int(p[2:-2]) + 1))] if p.startswith("<<") else [p]
    return out


def test_labels_and_scores(spark, tiny):
    draw = random.Random(12)
    texts = []
    for label, markup in [*licenses.TEMPLATES, *licenses.WHOLE] * 2:
        words = filled(markup, draw)
        texts.append(("accepted", label, " ".join(w.upper() if draw.random() < 0.1 else w for w in ["intro", *words, "outro"])))
        cut = words[: draw.randrange(1, len(words) + 1)]
        texts.append(("cut", None, ", ".join(["x", *cut, "y"])))
        broken = words[:]
        broken[draw.randrange(len(words))] = "other"
        texts.append(("broken", None, "\n".join(broken)))
    texts += [("doc", None, r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").where(F.lower("text").rlike("licen|permission|gpl|creative")).collect()]
    docs = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    for k, (kind, label, text) in enumerate(texts):
        labels, whole, score = slow_scan(text)
        assert (got[k]["labels"], got[k]["whole"]) == (labels, whole), text[:200]
        assert got[k]["score"] == pytest.approx(score, abs=1e-12), text[:200]
        if kind == "accepted":
            assert label in labels.split(",") and got[k]["score"] == 1
    assert sum(bool(got[k]["whole"]) for k in got) >= 2 * len(licenses.WHOLE)
