"""Operator 2: weak supervision of quality rules, in DataFrame functions alone.

Eleven rules look at counts of a text and vote good (1), bad (-1) or abstain (0). A rule that looks for a defect
abstains where it finds none, since bad texts rarely have all defects. Votes have no labels to be held against:
expectation-maximisation over the table of distinct vote patterns estimates how often each rule is right when it
votes, and from these the posterior probability that a text is good.

Defined results: a null or empty text has counts 0, fails the base test and isn't kept. Words are runs of
characters other than space and U+0009 to U+000D. Repeated rows each get their row. Other columns are ignored by
``judge`` and kept by ``keep_good``. With no rows the model stays at its starting values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

SPACE = r"[ \t-\r]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "n_distinct", "n_others", "n_attached", "n_symbol_runs")
RULES = ("symbols", "symbol_runs", "others", "attached", "capitals", "marks", "repetition", "variety", "lines", "word_length", "plain")


def _let(value: Column, use) -> Column:
    """``use`` applied to a value that is worked out once, also where ``use`` looks at it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more. A window is known by its 64-bit hash; equal ones
    stand side by side once sorted, and only texts that have any are sorted."""
    n = F.size(words)

    def windows(h: Column) -> Column:
        both = F.zip_with(h, F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
        four = _let(both, lambda p: F.zip_with(p, F.slice(p, 3, n), lambda a, b: F.xxhash64(a, b)))
        return F.slice(F.zip_with(four, F.slice(h, 5, n), lambda a, b: F.xxhash64(a, b)), 1, n - 4)

    hashes = _let(F.transform(words, lambda x: F.xxhash64(x)), windows)

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(ordered, from_sorted)

    def from_sorted(s: Column) -> Column:
        m = F.size(s)
        own = F.transform(s, lambda x: x["h"])
        beside = _let(own, lambda h: F.arrays_zip(F.transform(s, lambda x: x["i"]).alias("i"), h.alias("h"), F.concat(F.array(F.lit(None).cast("long")), F.slice(h, 1, m - 1)).alias("p"), F.slice(h, 2, m).alias("q")))
        twice = F.filter(beside, lambda x: (x["h"] == x["p"]) | (x["h"] == x["q"]))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return _let(places, from_places)

    def from_places(p: Column) -> Column:
        gaps = F.arrays_zip(p.alias("a"), F.slice(p, 2, F.size(p)).alias("b"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + F.coalesce(F.least(F.lit(5), x["b"] - x["a"]), F.lit(5)))

    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(n >= 6, some).otherwise(F.lit(0).cast("long"))


def counted(docs: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """Adds a struct of COUNTS and base_failed. It is made by a generator of one row: filters on it stay above, so
    that nothing is counted twice."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    n = lambda c: c.cast("long")
    times = lambda pattern: n(F.regexp_count(body, F.lit(pattern)))

    def of_words(w: Column) -> Column:
        made = {"n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_distinct": F.size(F.array_distinct(w)), "n_repeat_words": _repeated(w)}
        return F.struct(*[n(v).alias(k) for k, v in made.items()])

    words = _let(F.array_remove(F.split(body, SPACE), ""), of_words)
    by_line = _let(lines, lambda x: F.struct(n(F.size(x)).alias("n_lines"), n(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    marks = {"n_symbols": "[#*$%&|<>]", "n_symbol_runs": "[#*$%&|<>]+", "n_marks": "!", "n_capitals": r"\p{Lu}{2,}", "n_others": r"[^\p{L}\s]", "n_attached": r"\p{L}[^\p{L}\s]{2,}"}
    both = F.struct(words.alias("w"), by_line.alias("l"), *[times(p).alias(k) for k, p in marks.items()])
    wide = docs.select("*", F.explode(F.array(both)).alias(name))
    made = [F.col(f"{name}.w.{k}").alias(k) for k in ("n_words", "word_chars", "n_distinct", "n_repeat_words")]
    made += [F.col(f"{name}.l.{k}").alias(k) for k in ("n_lines", "n_dup_lines")] + [F.col(f"{name}.{k}").alias(k) for k in marks]
    c = F.col(f"{name}.w")
    failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    return wide.withColumn(name, F.struct(*made, failed.alias("base_failed")))


def votes(counts: str = "counts") -> dict[str, Column]:
    """Each rule's vote from the counts."""
    c = {k: F.col(f"{counts}.{k}").cast("double") for k in COUNTS}
    words = F.greatest(c["n_words"], F.lit(1.0))
    size = c["word_chars"] / words
    bad = lambda x: F.when(x & (c["n_words"] > 0), -1).otherwise(0)
    return {
        "symbols": bad(c["n_symbols"] / words > 0.1),
        "symbol_runs": bad(c["n_symbol_runs"] / words > 0.1),
        "others": bad((c["n_words"] >= 10) & (c["n_others"] / words > 1.0)),
        "attached": bad(c["n_attached"] / words > 0.15),
        "capitals": bad(c["n_capitals"] / words > 0.3),
        "marks": bad(c["n_marks"] / words > 0.2),
        "repetition": bad(c["n_repeat_words"] / words > 0.15),
        "variety": bad((c["n_words"] >= 50) & (c["n_distinct"] / F.pow(words, 0.8) < 0.6)),
        "lines": bad(c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)) > 0.3),
        "word_length": bad((size < 2) | (size > 13)),
        "plain": F.when((c["n_words"] >= 10) & (c["n_symbols"] <= 0.02 * words) & (c["n_marks"] <= 0.02 * words) & (c["n_capitals"] <= 0.05 * words) & (c["n_attached"] <= 0.05 * words) & (c["n_repeat_words"] <= 0.05 * words), 1).otherwise(0),
    }


@dataclass
class Model:
    """Share of good texts, and how often each rule is right when it votes."""

    prior: float
    right: list[float]
    rounds: int = 0

    def posterior(self, vote: list[Column]) -> Column:
        """P(good | votes); an abstention says nothing."""
        up, down = F.lit(self.prior), F.lit(1 - self.prior)
        for v, a in zip(vote, self.right, strict=True):
            up = up * F.when(v > 0, a).when(v < 0, 1 - a).otherwise(1.0)
            down = down * F.when(v > 0, 1 - a).when(v < 0, a).otherwise(1.0)
        return up / (up + down)


def learn(patterns: DataFrame, rounds: int = 25, tolerance: float = 1e-4) -> Model:
    """Expectation-maximisation over (one column a rule, n): a row for each distinct pattern of votes, 3**11 at the
    most whatever the corpus. Each round is one aggregate; only its sums reach the driver. Rules start at 0.85, and
    are taken to be right more often than not: that names the two classes."""
    model = Model(0.8, [0.85] * len(RULES))
    vote = [F.col(r) for r in RULES]
    for turn in range(rounds):
        frame = patterns.withColumn("g", F.col("n") * model.posterior(vote)).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum("g"), F.sum("b")]
        for v in vote:
            sums += [F.sum(F.when(v > 0, F.col("g")).when(v < 0, F.col("b"))), F.sum(F.when(v != 0, F.col("n")))]
        found = [x or 0.0 for x in frame.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        good, bad = found[:2]
        if not good + bad:
            break
        new = Model(
            min(0.99, max(0.01, (good + 1) / (good + bad + 2))),  # one text of either kind keeps shares off 0 and 1
            [min(0.995, max(0.55, (hit + 4) / (n + 5))) for hit, n in zip(found[2::2], found[3::2], strict=True)],
            turn + 1,
        )
        moved = max(abs(x - y) for x, y in zip([new.prior, *new.right], [model.prior, *model.right], strict=True))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """A row a text: its counts, base_failed, each rule's vote, the posterior, and kept: the posterior reaches
    ``least`` and the base test isn't failed. Texts are read once; what follows uses the narrow table of counts."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ready = counted(plain)
    table = written(ready.select("doc_id", "counts.*", *[v.alias(f"vote_{r}") for r, v in votes().items()]), "rules")
    model = learn(_patterns(table.select(*[F.col(f"vote_{r}").alias(r) for r in RULES])))
    table = table.withColumn("posterior", model.posterior([F.col(f"vote_{r}") for r in RULES]))
    return table.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def _patterns(frame: DataFrame) -> DataFrame:
    return written(frame.groupBy(*RULES).agg(F.count("*").alias("n")).coalesce(1), "patterns")


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with the columns of ``docs``. Texts are counted once: rows are written
    with their votes, the model is learned from the votes' columns alone, and the rows that it keeps are read again, so
    rows need no key and texts are never shuffled."""
    columns, name = docs.columns, "_votes"
    while name in columns:
        name += "_"
    wide = counted(docs, text, name)
    made = F.struct(F.col(f"{name}.base_failed").alias("base_failed"), *[v.cast("byte").alias(r) for r, v in votes(name).items()])
    table = written(wide.withColumn(name, made), "voted")
    model = learn(_patterns(table.select(*[F.col(f"{name}.{r}").alias(r) for r in RULES])))
    good = model.posterior([F.col(f"{name}.{r}") for r in RULES]) >= least
    return table.where(~F.col(f"{name}.base_failed") & good).select(*[F.col(f"`{c}`") for c in columns])
