"""Operator 7: mixture-controlled packing by deficit round-robin.

Each source is a queue of packets, its documents' token ids in pieces of at most a window, in the order of a hash
of the document. In every round a source gets credit: its target share of one window. It sends packets while its
credit lasts; what it lacks or has left is its deficit and is carried on. A packet that ends at token c of its
queue is therefore sent in round ceil(c / credit), so all rounds follow from running sums, taken in blocks and
then over the few sums of blocks: the deficit crosses windows and partitions without any task seeing a whole
queue. Packets in the order of rounds are laid end to end and cut at window bounds, so only the last window has
room left.

By default the target shares are the sources' shares of all tokens, so that all queues end together. With other
shares a queue may end early; the rounds after that belong to those which are left. Sources without a share come after
all others, in proportion to what they hold.

Defined results: a null or empty text is the closing id alone. A null source is a source. Repeated rows each get
their pieces. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ragged import Memo, blocks, give_back, row_sums, spans
from .store import partitions, small_batches, written

WINDOW, CLOSING = 4096, 2
#: Words that can be cut up here as the tokenizer does: no character of theirs is changed by NFC, and lower case is one
#: letter to one. All others go to the tokenizer whole.
PLAIN = re.compile(r"[\x21-\x7e\xc0-\u012f\u0131-\u017e]+")
_LETTERS = "a-z\xdf-\xf6\xf8-\xff\u0100-\u017f"
#: The tokenizer's own pattern of what is merged apart, for lower-cased plain words; spaces part the words.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9 ]+| ")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters for themselves, the
    rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Words:
    """Token ids of texts. The tokenizer drops white space and never merges across it, so a text's ids are its words'
    ids in a row; a word's ids are in turn those of its parts (letters, a digit, marks). Words and parts are both
    remembered: words repeat, and new words are mostly known parts in new case or with new marks. Both memos are
    bounded, and outlive a task: Spark uses a Python worker again for the next one."""

    def __init__(self, path: str, words: int = 300_000, parts: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens that stand in a text by their name, such as the closing one: a word with one is cut by the tokenizer.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.letters = byte_letters()
        self.words, self.parts = Memo(self._words, np.uint16, words), Memo(self._parts, np.uint16, parts)

    def _parts(self, parts: list[str]) -> list[list[int]]:
        merge, letters = self.tokenizer.model.tokenize, self.letters
        spelled = [p if p.isascii() else p.encode().decode("latin-1").translate(letters) for p in parts]
        return [[] if p == " " else [t.id for t in merge(p)] for p in spelled]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = {k: self.tokenizer.encode_batch_fast([w], add_special_tokens=False)[0].ids for k, w in enumerate(words) if not PLAIN.fullmatch(w) or self.added.search(w)}
        parts = PARTS.findall(" ".join(["" if k in whole else w for k, w in enumerate(words)]).lower())
        numbers = self.parts.numbers(parts)
        lengths = self.parts.lengths[numbers]
        ids = self.parts.flat[spans(self.parts.starts[numbers], lengths)]
        self.parts.trim()
        gaps = np.flatnonzero(np.fromiter((p == " " for p in parts), bool, len(parts)))
        ends = np.append(0, np.cumsum(lengths))
        rows = np.diff(np.concatenate([[0], ends[gaps], ends[-1:]]))
        if whole:
            at = np.repeat(np.cumsum(rows)[list(whole)], [len(x) for x in whole.values()])
            ids = np.insert(ids, at, [i for x in whole.values() for i in x])
            rows[list(whole)] = [len(x) for x in whole.values()]
        return ids, rows

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, each text's with the closing id, and how many each has."""
        # line ends and spaces are dropped by the tokenizer; other white space stays inside a "word" and is left to it
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        numbers = self.words.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        lengths = self.words.lengths[numbers]
        ids = self.words.flat[spans(self.words.starts[numbers], lengths)]
        sizes = row_sums(lengths, counts)
        out = np.full(len(ids) + len(counts), CLOSING, np.uint16)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), sizes)] = ids
        self.words.trim()
        return out, sizes + 1


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    return Words(path)


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, doc_id, source, n, ids): ids as bytes of little-endian 16-bit integers, the closing id included."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            for a, b in blocks(pc.binary_length(texts).to_pylist(), 1 << 20):
                part = batch.slice(a, b - a)
                ids, sizes = words.ids(texts[a:b])
                ends = np.cumsum(sizes)
                rows = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(rows, pa.binary())], ["doc_id", "source", "n", "ids"])
            give_back()

    found = frame.mapInArrow(run, "doc_id long, source string, n long, ids binary")
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


def credits(queues: DataFrame, window: int, shares: dict[str, float] | None) -> DataFrame:
    """(source, phase, credit) of (source, queue), queue being a source's tokens: what it gets in each round. Given
    shares are of one window together; sources without one take turns after all others (phase 1), by what they hold."""
    if shares is None:
        phase = F.lit(0)
        weight = F.col("queue").cast("double")
    else:
        bad = [k for k, v in shares.items() if v < 0]
        if bad:
            raise ValueError(f"negative shares: {bad}")
        given = F.coalesce(F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, float(v))])[F.col("source")], F.lit(0.0)) if shares else F.lit(0.0)
        phase = F.when(given > 0, 0).otherwise(1)
        weight = F.when(given > 0, given).otherwise(F.col("queue").cast("double"))
    made = queues.withColumn("phase", phase).withColumn("weight", weight)
    wholes = made.groupBy("phase").agg(F.sum("weight").alias("whole"))  # two rows at the most
    return made.join(F.broadcast(wholes), "phase").select("source", "phase", (window * F.col("weight") / F.col("whole")).alias("credit"))


def layout(sizes: DataFrame, window: int = WINDOW, shares: dict[str, float] | None = None) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset, round) of documents (row, source, n)."""
    parts = partitions(sizes.sparkSession)
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(window).cast("long"))
    packets = sizes.select("row", "source", "n", F.xxhash64("row").alias("h"), F.explode(starts).alias("start"))
    packets = packets.withColumn("len", F.least(F.col("n") - F.col("start"), F.lit(window))).withColumn("block", F.shiftrightunsigned("h", 32) * parts / F.lit(float(1 << 32)))
    packets = packets.withColumn("block", F.floor("block").cast("int"))
    # running tokens of each queue: inside a block of the hash, then over blocks
    sums = written(packets.groupBy("source", "block").agg(F.sum("len").alias("tokens")), "queues")
    over = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    queues = sums.withColumn("before", F.coalesce(F.sum("tokens").over(over), F.lit(0))).drop("tokens")
    credit = credits(sums.groupBy("source").agg(F.sum("tokens").alias("queue")), window, shares).withColumnRenamed("source", "s")
    queues = queues.join(credit, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    queues = queues.select(F.col("source").alias("s"), F.col("block").alias("b"), "before", "phase", "credit")
    met = packets.join(queues, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inner = Window.partitionBy("s", "block").orderBy("h", "row", "start").rowsBetween(Window.unboundedPreceding, 0)
    sent = met.withColumn("end", F.col("before") + F.sum("len").over(inner)).withColumn("round", F.ceil(F.col("end") / F.col("credit")))
    # the packets in the order they are sent, in even parts of it whatever the shares; written, so that parts stay as
    # they are, and read twice
    order = ("phase", "round", "source", "end")
    sent = sent.select("row", "start", "len", *order).repartitionByRange(parts, *order)
    sent = written(sent.withColumn("part", F.spark_partition_id()), "sent")
    blocks_ = sent.groupBy("part").agg(F.sum("len").alias("tokens"))  # one row a part
    first = blocks_.select(F.col("part").alias("p"), F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = sent.join(F.broadcast(first), F.col("part") == F.col("p")).withColumn("from", F.col("base") + F.sum("len").over(inside) - F.col("len"))
    w = F.lit(window).cast("long")
    seqs = F.sequence(F.floor(F.col("from") / w), F.floor((F.col("from") + F.col("len") - 1) / w))
    cut = placed.select("row", "start", "len", "from", "round", F.explode(seqs).alias("sequence_id"))
    a = F.greatest(F.col("from"), F.col("sequence_id") * w)
    b = F.least(F.col("from") + F.col("len"), (F.col("sequence_id") + 1) * w)
    return cut.select("row", (F.col("start") + a - F.col("from")).alias("start"), (b - a).alias("length"), "sequence_id", (a - F.col("sequence_id") * w).alias("offset"), "round")


RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", window: int = WINDOW, shares: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its place; ``with_ids`` adds the ids themselves. Tokens are worked out once and written;
    the layout reads their counts alone, and the ids are shuffled once, to meet their document's pieces."""
    small_batches(docs.sparkSession)
    table = written(tokenized(docs, tokenizer, doc_id, text, source), "tokens")
    pieces = layout(table.select("row", "source", "n"), window, shares)
    pieces = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    joined = table.select("row", "doc_id", "n", "ids").join(pieces, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            raw: list[bytes] = []
            for doc, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "pieces")), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                for p in at:
                    piece = wide[p["start"] : p["start"] + p["length"]].tobytes()
                    rows.append((doc, p["start"], p["length"], zlib.crc32(piece), n, p["sequence_id"], p["offset"]))
                    if with_ids:
                        raw.append(piece)
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)]
            names = [x.split()[0] for x in RESULT.split(", ")]
            if with_ids:
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, RESULT + (", ids binary" if with_ids else ""))
