"""Operator 8: scores of a language model of word triples kept in Elias-Fano tries.

The corpus is encoded once, in chunks of documents: a chunk's dictionary of word hashes and its texts as numbers
in it. A chunk then asks for what it needs and nothing is ever gathered whole: the holders of a range of word
hashes add up every chunk's training counts and answer with the sums, and with numbers for the words, small for
frequent ones, which stand for them from then on; the holders of a range of contexts merge
every chunk's training pairs into a trie of quantised smoothed probabilities, memory-map it and answer the pairs
that chunks ask for by search among the context's successors; then other holders do the same with triples, whose
contexts are pairs. A gram is asked for once a chunk, however often it occurs. Contexts so frequent that they would
fill a holder are dealt out by their successors.

Answers say whether another chunk has asked for the same word or pair. Where only one chunk has a gram's context, or
its ending (the gram without its first word), no other has the gram: that chunk keeps it in a trie of its own and
asks nobody. This leaves out no gram and changes no count; it is what keeps the exchange of triples small.

The probability of a word after two others is Dirichlet-smoothed, (c(uvw) + mu p(w|v)) / (c(uv) + mu), p(w|v) being
(c(vw) + mu p(w)) / (c(v) + mu) and p(w) being (c(w) + 0.1) / (N + 0.1 (V + 1)); each sums to 1 with the unknown
word. A text's first word is scored after its start alone. Training counts of a context are those of the same words,
since every word is followed by one token. Quantisation keeps log10 p to 1/50 at each level.

Defined results: null and empty texts are the end token alone. A null doc_id is not held out. Repeated rows each
count and each get their row. Other columns are ignored. Without training rows N = V = 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import Trie, runs
from .ragged import blocks, row_sums, texts_of
from .store import partitions, small_batches, written

SPACE = re.compile(rb"[ \t-\r]+")
CHUNK = 10_000_000  # characters of a chunk at the most, or one text
#: Dictionary words, and tokens, of all chunks for each holder: what a holder gathers in one task stays the same however
#: large the corpus is.
WORDS, GRAMS = 2_000_000, 3_000_000
END = xxhash.xxh64_intdigest(b"\n")  # no word
START = (1 << 32) - 1  # the number of a text's start
MU, ADD, STEP, MISSING = 2.0, 0.1, 25.0, 255
U = np.uint64


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of integers, the first bytes of all, then the second ones, compressed."""
    import zstandard

    raw = values.view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes()) if len(values) else b""


def widen(raw: bytes, kind) -> np.ndarray:
    import zstandard

    if not raw:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def code_of(logs: np.ndarray) -> np.ndarray:
    """log10 p to 0..254, in steps of 1/25 down to -10.16."""
    return np.clip(np.round(-STEP * logs), 0, MISSING - 1).astype(np.uint8)


_KINDS = {"holder": pa.int32(), "chunk": pa.int64(), "tokens": pa.int64(), "types": pa.int64()}


def _rows(names: tuple[str, ...], rows: list[tuple]) -> dict[str, pa.Array]:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return {n: pa.array(list(c), _KINDS.get(n, pa.binary())) for n, c in zip(names, columns, strict=True)}


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: each carries a chunk."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def by_count(counts: np.ndarray) -> np.ndarray:
    """A chunk's words from the most frequent in training on: the order that tokens are numbered in, so that most are small."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def flagged(totals: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Counts, doubled, and one more where several chunks have the word or pair."""
    return totals.astype(U) * U(2) + (chunks > 1).astype(U)


def mixed(keys: np.ndarray) -> np.ndarray:
    """Evenly spread 32-bit values of keys, for dealing them out."""
    x = keys.astype(U) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> U(29))) >> U(32)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, none negative, in order, and the place of each key among them. Keys are sorted together with where
    they stand, as one number, wherever both fit in it."""
    bits = max(len(keys) - 1, 1).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 64:
        return np.unique(keys, return_inverse=True)
    both = keys.astype(U) << U(bits) | np.arange(len(keys), dtype=U)
    both.sort()
    at = (both & U((1 << bits) - 1)).astype(np.int64)
    values, run = runs((both >> U(bits)).astype(np.int64))
    where = np.empty(len(keys), np.int64)
    where[at] = run
    return values, where


def held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def encoded(docs: DataFrame) -> DataFrame:
    """(chunk, docs, sizes, words, counts, numbers, n_words, n_tokens) of (doc_id, text): sizes are tokens a document,
    words the sorted hashes of its dictionary, counts their training counts, numbers the tokens by their word's place in
    ``by_count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        sizes: list[int] = []
        numbers: list[np.ndarray] = []
        memo: dict[bytes, int] = {b"\n": 0}
        chars = 0

        def chunk() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in memo), U, len(memo))
            words, place = np.unique(hashes, return_inverse=True)
            flat = place.astype(np.uint32)[np.concatenate(numbers)] if numbers else np.zeros(0, np.uint32)
            train = np.repeat([not held(k) for k in ids], sizes)
            counts = np.bincount(flat[train], minlength=len(words)).astype(np.uint32)
            rank = np.empty(len(words), np.uint32)
            rank[by_count(counts)] = np.arange(len(words), dtype=np.uint32)
            flat = rank[flat]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([squeeze(np.array(sizes, np.uint32))]), pa.array([squeeze(words)]), pa.array([squeeze(counts)]), pa.array([squeeze(flat)]), pa.array([len(words)], pa.int64()), pa.array([len(flat)], pa.int64())],
                ["docs", "sizes", "words", "counts", "numbers", "n_words", "n_tokens"],
            )

        def reset() -> None:
            nonlocal chars
            ids.clear(), sizes.clear(), numbers.clear(), memo.clear()
            memo[b"\n"], chars = 0, 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if ids and chars + len(text) > CHUNK:
                    yield chunk()
                    reset()
                words = [w for w in SPACE.split(text.encode().lower()) if w]
                words.append(b"\n")
                numbers.append(np.fromiter([memo.setdefault(w, len(memo)) for w in words], np.uint32, len(words)))
                ids.append(doc)
                sizes.append(len(words))
                chars += len(text)
        if ids:
            yield chunk()

    found = docs.mapInArrow(run, "docs array<long>, sizes binary, words binary, counts binary, numbers binary, n_words long, n_tokens long")
    return found.select(F.monotonically_increasing_id().alias("chunk"), "*")


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds in sorted 64-bit ``keys`` of ``parts`` even ranges of their values."""
    limits = np.array([(k << 64) // parts for k in range(parts)], U)
    return np.append(np.searchsorted(keys, limits), len(keys))


def holders_of(chunks: DataFrame) -> tuple[int, int]:
    """How many holders of words and of grams there are: one a partition at the least, and as many as keep each one's
    share within WORDS and GRAMS."""
    words, tokens = (int(x or 0) for x in chunks.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    least = partitions(chunks.sparkSession)
    return max(least, -(-words // WORDS)), max(least, -(-tokens // GRAMS))


def word_counts(chunks: DataFrame, parts: int) -> DataFrame:
    """(chunk, holder, counts, ids, tokens, types): for each chunk and range of hashes, one of ``parts``, the corpus counts of
    its words, ``flagged``, and their numbers: the place by count among the holder's words, holders taking turns; tokens
    and types of the range's training words stand in one row a holder."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            words, counts = widen(row["words"], U), widen(row["counts"], np.uint32)
            cuts = _cuts(words, parts)
            rows = [(k, row["chunk"], squeeze(words[a:b]), squeeze(counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_pydict(_rows(("holder", "chunk", "words", "counts"), rows))

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [widen(r["words"], U) for r in rows]
        known, where = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(where, np.concatenate([widen(r["counts"], np.uint32) for r in rows]), len(known)).astype(np.uint64)
        ends = np.cumsum([len(w) for w in words])
        sums = [(int(total.sum()), int((total > 0).sum()))] + [(0, 0)] * (len(rows) - 1)
        marked = flagged(total, np.bincount(where, minlength=len(known)))
        ids = np.empty(len(known), np.int64)
        ids[by_count(total)] = np.arange(len(known)) * parts + rows[0]["holder"]
        if len(ids) and ids.max() >= START:
            raise ValueError("more distinct words than 32-bit numbers")
        ids = ids.astype(np.uint32)
        out = [(r["chunk"], r["holder"], squeeze(marked[where[e - len(w) : e]]), squeeze(ids[where[e - len(w) : e]]), *s) for r, w, e, s in zip(rows, words, ends, sums, strict=True)]
        return pa.table(_rows(("chunk", "holder", "counts", "ids", "tokens", "types"), out))

    asked = chunks.select("chunk", "words", "counts").mapInArrow(ask, "holder int, chunk long, words binary, counts binary")
    return asked.groupBy("holder").applyInArrow(answer, "chunk long, holder int, counts binary, ids binary, tokens long, types long")


def _answers(table: DataFrame, *names: str, level: str = "") -> DataFrame:
    """A chunk's answers in the order of holders, each of ``names`` as a list all_<name><level>."""
    rows = table.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("holder", *names))).alias("a"))  # one row a holder
    return rows.select("chunk", *[F.col(f"a.{n}").alias(f"all_{n}{level}") for n in names])


class Grams:
    """A chunk's distinct grams of one order: ``first`` is a gram's context and ``last`` its ending, by number. They stand in
    the order of the contexts' and the last words' corpus numbers, since a chunk's words do.

    ``keys``, ``totals`` and ``alone`` are the contexts' words as one number, training counts in the corpus, and whether no other
    chunk has them; ``ids``, ``end_alone`` and ``lower`` the endings' last words, whether no other chunk has the ending,
    and log10 p of the last word by the order below. ``counts`` are the grams' training counts in the chunk, ``where`` each token's gram.
    """

    def __init__(self, contexts: tuple, endings: tuple, first: np.ndarray, last: np.ndarray, counts: np.ndarray, where: np.ndarray):
        self.keys, self.totals, self.alone = contexts
        self.ids, self.end_alone, self.lower = endings
        self.first, self.last, self.counts, self.where = first, last, counts, where

    @cached_property
    def at_home(self) -> np.ndarray:
        """Grams whose context or ending no other chunk has: their counts here are the corpus'."""
        return self.alone[self.first] | self.end_alone[self.last]

    def away(self, tokens: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The other grams by holder, context and word, and where each holder's begin and end. A context's key gives
        the holder; frequent contexts are spread by the last word."""
        at = np.flatnonzero(~self.at_home)
        first, ids = self.first[at], self.ids[self.last[at]]
        share = np.ceil(self.totals * 4 * parts / max(tokens, 1)).astype(np.int64)
        spread = np.minimum(np.maximum(share, 1), parts)[first]
        home = (mixed(self.keys) * U(parts) >> U(32)).astype(np.int64)[first]
        holder = (home + mixed(ids).astype(np.int64) % spread) % parts
        order = np.argsort(holder.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
        return at[order], np.searchsorted(holder[order], np.arange(parts + 1))

    def messages(self, chunk: int, tokens: int, parts: int) -> list[tuple]:
        order, cuts = self.away(tokens, parts)
        rows = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                f, last = self.first[order[a:b]], self.last[order[a:b]]
                new = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                runs = np.diff(np.append(new, len(f))).astype(np.uint32)
                rows.append((k, chunk, squeeze(self.keys[f[new]]), squeeze(self.totals[f[new]].astype(U)), squeeze(runs), squeeze(self.ids[last]), squeeze(self.counts[order[a:b]].astype(np.uint32)), squeeze(code_of(self.lower[last]))))
        return rows

    def solved(self, tokens: int, parts: int, codes: list[bytes] | None, counts: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 p and, if they were answered, corpus counts of the grams, and whether no other chunk has them."""
        got, total, alone = np.full(len(self.first), MISSING, np.uint8), self.counts.astype(np.int64), np.ones(len(self.first), bool)
        home = np.flatnonzero(self.at_home)
        contexts, ids = self.keys[self.first[home]], self.ids[self.last[home]]
        order = np.flatnonzero(self.counts[home] > 0)
        known = home[order]
        p = smoothed(self.counts[known], self.lower[self.last[known]], self.totals[self.first[known]])
        got[home] = trie_of(contexts[order], ids[order], p).codes_of(contexts, ids, MISSING)
        away, _ = self.away(tokens, parts)
        got[away] = np.concatenate([np.zeros(0, np.uint8), *[widen(x, np.uint8) for x in codes or []]])
        if counts:
            marked = np.concatenate([widen(x, U) for x in counts])
            total[away], alone[away] = (marked >> U(1)).astype(np.int64), (marked & U(1)) == 0
        unseen = self.lower[self.last] + np.log10(MU / (self.totals[self.first] + MU))
        return np.where(got == MISSING, unseen, got / -STEP), total, alone


def smoothed(counts: np.ndarray, lower: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Probabilities of grams seen ``counts`` times after contexts seen ``totals`` times; ``lower`` are quantised before use,
    as in messages."""
    return (counts + MU * 10 ** (code_of(lower) / -STEP)) / (totals.astype(np.float64) + MU)


def trie_of(contexts: np.ndarray, ids: np.ndarray, p: np.ndarray) -> Trie:
    """The mapped trie of distinct grams in order."""
    return Trie.of(contexts, ids, code_of(np.log10(p))).mapped()


class Chunk:
    """A chunk with the corpus counts of its words, which are numbered by their corpus numbers' order."""

    def __init__(self, row: dict, tokens: int, types: int, parts: int):
        self.row, self.tokens, self.types, self.parts = row, tokens, types, parts
        self.sizes = widen(row["sizes"], np.uint32).astype(np.int64)
        words, ids = widen(row["words"], U), np.concatenate([widen(c, np.uint32) for c in row["all_ids"]])
        order = np.argsort(ids)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.words, self.ids, self.end = words[order], ids[order], int(place[np.searchsorted(words, U(END))])
        self.numbers = place[by_count(widen(row["counts"], np.uint32))][widen(row["numbers"], np.uint32)]
        marked = np.concatenate([widen(c, U) for c in row["all_counts"]])[order]
        self.counts, self.alone = (marked >> U(1)).astype(np.float64), (marked & U(1)) == 0
        self.logs = np.log10((self.counts + ADD) / (tokens + ADD * (types + 1)))
        self.docs = row["docs"]
        self.held = np.array([held(k) for k in self.docs], bool)
        self.train = np.repeat(~self.held, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @cached_property
    def pairs(self) -> Grams:
        """A text's start is a context as frequent as the end."""
        width, end = len(self.words), self.end
        before = np.empty_like(self.numbers)
        before[1:] = self.numbers[:-1]
        before[self.starts] = width
        keys, where = distinct(before * width + self.numbers)
        counts = np.bincount(where, self.train, len(keys))
        contexts = (np.append(self.ids, np.uint32(START)).astype(U), np.append(self.counts, self.counts[end]), np.append(self.alone, self.alone[end]))
        endings = (self.ids, self.alone, self.logs)
        return Grams(contexts, endings, keys // width, keys % width, counts, where)

    @cached_property
    def pair_logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.pairs.solved(self.tokens, self.parts, self.row["all_codes2"], self.row["all_totals2"])

    @cached_property
    def later(self) -> np.ndarray:
        """Tokens that aren't a text's first."""
        out = np.ones(len(self.numbers), bool)
        out[self.starts] = False
        return out

    @cached_property
    def triples(self) -> Grams:
        two, (logs, totals, alone) = self.pairs, self.pair_logs
        at, n = np.flatnonzero(self.later), len(two.first)
        keys, where = distinct(two.where[at - 1] * n + two.where[at])
        counts = np.bincount(where, self.train[at], len(keys))
        contexts = (two.keys[two.first] << U(32) | self.ids[two.last].astype(U), totals, alone)
        return Grams(contexts, (two.ids[two.last], alone, logs), keys // n, keys % n, counts, where)

    def token_logs(self) -> np.ndarray:
        """log10 p of each token, by the model."""
        logs = self.pair_logs[0][self.pairs.where]
        logs[self.later] = self.triples.solved(self.tokens, self.parts, self.row["all_codes3"])[0][self.triples.where]
        return logs


def gram_codes(joined: DataFrame, tokens: int, types: int, parts: int, grams: Callable[[Chunk], Grams]) -> DataFrame:
    """(chunk, holder, codes, totals): the quantised log10 p and the corpus counts, ``flagged``, of those of a chunk's ``grams`` that it asks
    for, in order; MISSING for a gram that training texts lack. ``joined`` has chunks with the answers so far; ``parts``
    holders answer."""
    names = ("holder", "chunk", "contexts", "totals", "runs", "words", "counts", "lower")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield pa.RecordBatch.from_pydict(_rows(names, grams(Chunk(row, tokens, types, parts)).messages(row["chunk"], tokens, parts)))

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes, pieces = [], []
        # contexts by their place among all: a gram is then one number, and grams are sorted once
        known, place = np.unique(np.concatenate([widen(r["contexts"], U) for r in rows]), return_inverse=True)
        taken = 0
        for r in rows:
            times = widen(r["runs"], np.uint32)
            pieces.append((np.repeat(place[taken : taken + len(times)], times), np.repeat(widen(r["totals"], U), times), *(widen(r[k], kind) for k, kind in (("words", np.uint32), ("counts", np.uint32), ("lower", np.uint8)))))
            sizes.append(len(pieces[-1][2]))
            taken += len(times)
        places, totals, words, counts, lower = (np.concatenate(x) for x in zip(*pieces, strict=True))
        del pieces, place
        contexts, packed = known[places], places.astype(U) << U(32) | words.astype(U)
        order = np.argsort(packed)
        packed = packed[order]
        new = np.ones(len(order), bool)
        new[1:] = packed[1:] != packed[:-1]
        at = order[new]
        del places, packed
        sums = np.add.reduceat(counts[order], np.flatnonzero(new), dtype=np.int64)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        marked = flagged(sums, np.diff(np.append(np.flatnonzero(new), len(order))))
        seen = sums > 0
        at_seen = at[seen]
        trie = trie_of(contexts[at_seen], words[at_seen], smoothed(sums[seen], lower[at_seen] / -STEP, totals[at_seen]))
        out, a = [], 0
        for r, n in zip(rows, sizes, strict=True):
            out.append((r["chunk"], r["holder"], squeeze(trie.codes_of(contexts[a : a + n], words[a : a + n], MISSING)), squeeze(marked[group[a : a + n]])))
            a += n
        return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()), "holder": pa.array([r[1] for r in out], pa.int32()), "codes": pa.array([r[2] for r in out], pa.binary()), "totals": pa.array([r[3] for r in out], pa.binary())})

    asked = joined.mapInArrow(ask, "holder int, chunk long, contexts binary, totals binary, runs binary, words binary, counts binary, lower binary")
    return asked.groupBy("holder").applyInArrow(answer, "chunk long, holder int, codes binary, totals binary")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every text under the counts, and under the model, of the texts that aren't held out."""
    small_batches(docs.sparkSession)
    chunks = written(encoded(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))), "chunks")
    word_holders, parts = holders_of(chunks)
    counts = written(word_counts(chunks, word_holders), "words")
    tokens, types = (int(x or 0) for x in counts.agg(F.sum("tokens"), F.sum("types")).first())
    joined = chunks.join(_answers(counts, "counts", "ids"), "chunk")
    # a chunk that keeps all its grams at home asks nobody
    pairs = gram_codes(joined, tokens, types, parts, lambda c: c.pairs)
    joined = joined.join(_answers(pairs, "codes", "totals", level="2"), "chunk", "left")
    triples = gram_codes(joined, tokens, types, parts, lambda c: c.triples).drop("totals")
    joined = joined.join(_answers(triples, "codes", level="3"), "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            c = Chunk(row, tokens, types, parts)
            known = (c.counts > 0)[c.numbers]
            columns = [c.docs, c.held, c.sizes, row_sums(known, c.sizes), np.full(len(c.sizes), tokens), row_sums(c.logs[c.numbers], c.sizes), row_sums(c.token_logs(), c.sizes)]
            for a, b in blocks([1] * len(c.docs), 10_000):
                arrays = [pa.array(x[a:b], kind) for x, kind in zip(columns, (pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in RESULT.split(", ")])

    return joined.mapInArrow(run, RESULT)
