"""Operators 3 and 5: greedy word-piece counts, and encoding that keeps byte offsets.

Both read a SentencePiece model's vocabulary. Words repeat, so each distinct word is worked out once a task.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import Memo, blocks, row_sums, spans, texts_of

SPACE = re.compile(r"[ \t-\r]+")
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


@lru_cache(maxsize=2)
def model_of(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model


# --- operator 3 -------------------------------------------------------------------------------------------------


class Automaton:
    """Longest-match word pieces in one pass: a trie with failure links. A node stands for what has been read and
    not yet given out. Where no child fits, the link leads to the node that stands for the same letters after
    the longest pieces at their front are popped; only the number of popped pieces is kept."""

    def __init__(self, first: list[str], later: list[str]):
        """``first``: pieces that begin a word; ``later``: pieces that go on."""
        self.children: list[dict[str, int]] = [{}, {}]  # 0: a word's start, 1: after a piece
        self.piece, self.depth, letter, up = [False, False], [0, 0], ["", ""], [-1, -1]
        for root, words in ((0, first), (1, later)):
            for word in words:
                at = root
                for c in word:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        for row, x in ((self.children, {}), (self.piece, False), (self.depth, self.depth[at] + 1), (letter, c), (up, at)):
                            row.append(x)
                    at = self.children[at][c]
                self.piece[at] |= at > 1
        n = len(self.children)
        self.fail, self.popped = [-1] * n, [0] * n
        for v in sorted(range(2, n), key=self.depth.__getitem__):
            if self.piece[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            z, count = self.fail[up[v]], self.popped[up[v]]
            while z >= 0 and letter[v] not in self.children[z]:
                count += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.children[z][letter[v]], count

    def count(self, word: str) -> int:
        """Pieces of ``word``, 1 (the unknown piece) where greedy matching comes to no end. Each letter goes one
        node down; each link goes up past popped pieces, so the work is linear in letters."""
        at, total = 0, 0
        for c in word:
            while c not in self.children[at]:
                total += self.popped[at]
                at = self.fail[at]
                if at < 0:
                    return 1
            at = self.children[at][c]
        while at > 1:
            total += self.popped[at]
            at = self.fail[at]
        return total if at == 1 else int(bool(word))


@lru_cache(maxsize=2)
def automaton_of(path: str) -> Automaton:
    pieces = [p.piece for p in model_of(path).pieces if p.type in (NORMAL, USER)]
    return Automaton([p[1:] for p in pieces if p.startswith(MARK) and p != MARK], [p for p in pieces if MARK not in p])


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_pieces, n_unknown): greedy word pieces of every text, counted and never built. Words are
    runs without space and U+0009 to U+000D; a word that pieces don't cover counts as one unknown piece. Null and
    empty texts count 0. Repeated rows each get their row; other columns are ignored."""
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton_of(vocabulary)

        def sizes(words: list[str]) -> list[tuple[int, int]]:
            return [(n, int(n == 1 and not fits(w))) for w, n in ((w, auto.count(w)) for w in words)]

        def fits(word: str) -> bool:
            at = 0
            for c in word:
                at = auto.children[at].get(c, -1)
                if at < 0:
                    return False
            return auto.piece[at]

        memo = Memo(sizes, np.int32)
        for batch in batches:
            texts = texts_of(batch)
            found = []
            for a, b in blocks([len(t) for t in texts], 1 << 21):
                words = [[w for w in SPACE.split(t) if w] for t in texts[a:b]]
                n = np.array([len(w) for w in words], np.int64)
                numbers = memo.numbers([x for w in words for x in w])
                at = memo.starts[numbers]
                found.append(np.stack([n, row_sums(memo.flat[at], n), row_sums(memo.flat[at + 1], n)]))
                memo.trim()
            n, pieces, unknown = np.concatenate([np.zeros((3, 0), np.int64), *found], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(pieces), pa.array(unknown)], ["doc_id", "n_words", "n_pieces", "n_unknown"])

    return frame.mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_unknown long")


# --- operator 5 -------------------------------------------------------------------------------------------------


class Charmap:
    """A compiled character map: a double array over UTF-8 bytes, and the texts that prefixes are replaced by."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """How many bytes the longest known prefix at ``at`` has, and what replaces it."""
        if not self.units:
            return None
        unit = self.units[0]
        node, found = self._offset(unit), None
        for k in range(at, len(raw)):
            node ^= raw[k]
            unit = self.units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if not found:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Encoder:
    """Encodes like the model's own library, with each piece's bytes in the source text."""

    def __init__(self, path: str):
        model = model_of(path)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        self.map, self.dummy = Charmap(spec.precompiled_charsmap), spec.add_dummy_prefix
        self.squeeze, self.escape = spec.remove_extra_whitespaces, spec.escape_whitespaces
        if trainer.model_type != 2 or trainer.treat_whitespace_as_suffix:
            raise ValueError("a byte-pair model with white space before words is needed")
        self.ids = {p.piece: k for k, p in enumerate(model.pieces)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER)}
        if any(p.type == USER for p in model.pieces):
            raise ValueError("user-defined pieces aren't supported")
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte = [self.ids.get(f"<0x{b:02X}>", self.unknown) for b in range(256)] if trainer.byte_fallback else None
        self.split = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.out = [self._bytes(p) for p in model.pieces]
        self.merger: Merger | None = None

    @staticmethod
    def _bytes(p) -> bytes:
        if p.type == BYTE:
            return bytes([int(p.piece[3:5], 16)])
        return b"" if p.type == CONTROL else b" \xe2\x81\x87 " if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode()

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the source byte that it comes from."""
        raw, mark = text.encode(), MARK.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:  # every prefix stands for itself, and a space for the mark
            lead = np.zeros(len(mark) if self.dummy and text else 0, np.int32)
            source = np.arange(len(raw), dtype=np.int32)
            if self.escape:
                source = np.repeat(source, np.where(np.frombuffer(raw, np.uint8) == 32, len(mark), 1))
            body = text.replace(" ", MARK) if self.escape else text
            return (mark.decode() if len(lead) else "") + body, np.concatenate([lead, source, np.array([len(raw)], np.int32)])
        pieces, align, at = [], [], 0
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit:
                n, new = hit
            else:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                new = raw[at : at + n]
            pieces.append((new, at))
            at += n
        begin = 0
        while self.squeeze and begin < len(pieces) and pieces[begin][0] == b" ":
            begin += 1
        pieces = pieces[begin:]
        if not pieces:
            return "", np.array([len(raw)], np.int32)
        out = bytearray()
        if self.dummy:
            out += mark
            align += [pieces[0][1]] * len(mark)
        after_space = bool(self.squeeze)
        for new, source in pieces:
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            if not new:
                continue
            for b in new:
                part = mark if b == 32 else bytes([b])
                out += part
                align += [source] * len(part)
            after_space = bool(self.squeeze) and new.endswith(b" ")
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], align[-len(mark) :]
        return out.decode(), np.array([*align, len(raw)], np.int32)

    def merge(self, chunk: str) -> list[str]:
        """Byte-pair merges, the best score first and the leftmost of equals."""
        parts, score = list(chunk), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge_long(self, chunk: str) -> list[str]:
        """The same merges for long chunks, with a heap."""
        import heapq

        n, score = len(chunk), self.score
        parts: list[str | None] = list(chunk)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-s, k, parts[k] + parts[k + 1]) for k in range(n - 1) if (s := score.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, joined = heapq.heappop(heap)
            j = right[k] if parts[k] is not None else -1
            if j < 0 or parts[k] + parts[j] != joined:
                continue
            parts[k], parts[j] = joined, None
            right[k] = right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b >= 0 and (s := score.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def chunk(self, chunk: str) -> list[tuple[str, list[int]]]:
        """A chunk's pieces, each with its ids: one, or one a byte where the vocabulary lacks it."""
        parts = self.merge(chunk) if len(chunk) <= 24 else self.merge_long(chunk)
        out: list[tuple[str, list[int]]] = []
        for p in parts:
            k = self.ids.get(p, self.unknown)
            if k != self.unknown:
                out.append((p, [k]))
            elif self.byte:
                out.append((p, [self.byte[b] for b in p.encode()]))
            elif out and out[-1][1] == [self.unknown]:
                out[-1] = (out[-1][0] + p, [self.unknown])
            else:
                out.append((p, [self.unknown]))
        return out

    def chunks(self, normal: str) -> list[str]:
        return self.cut.findall(normal) if self.split else [normal] if normal else []

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids; the space that normalising put first goes, and bytes that aren't UTF-8 become U+FFFD."""
        return self.finish(b"".join([self.out[k] for k in ids]))

    def finish(self, raw: bytes) -> bytes:
        text = replaced(raw)
        return text[1:] if self.dummy and text[:1] == b" " else text

    def many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, packed with how many normalised bytes each stands for (``PACK``), and how
        many each chunk has. A letter's byte ids stand for nothing but the last, which stands for the letter."""
        short = [c for c in chunks if len(c) <= 64] if self.byte else []
        rows: dict[int, list[int]] = {}
        for k, c in enumerate(chunks):
            if not self.byte or len(c) > 64:
                rows[k] = [i | (len(p.encode()) if j + 1 == len(ids) else 0) << PACK for p, ids in self.chunk(c) for j, i in enumerate(ids)]
        if not short:
            sizes = np.array([len(r) for r in rows.values()], np.int64)
            return np.array([i for r in rows.values() for i in r], np.int64), sizes
        if self.merger is None:
            self.merger = Merger(self.score, self.ids, self.byte)
        flat, lengths = self.merger.ids(short)
        sizes = np.zeros(len(chunks), np.int64)
        sizes[[k for k in range(len(chunks)) if k not in rows] if rows else slice(None)] = lengths
        if rows:
            at = np.repeat(np.cumsum(sizes)[list(rows)], [len(r) for r in rows.values()])
            flat = np.insert(flat, at, [i for r in rows.values() for i in r])
            sizes[list(rows)] = [len(r) for r in rows.values()]
        return flat, sizes

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of every id; the bytes are those of the source. Byte ids of one letter share the
        start of the letter's span and all but the last end there."""
        normal, align = self.normalize(text)
        packed, _ = self.many(self.chunks(normal))
        firsts, ends = spans_of(packed, align)
        return list(zip((packed & IDS).tolist(), firsts.tolist(), ends.tolist(), strict=True))


PACK, IDS = 32, (1 << 32) - 1


def spans_of(packed: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end source byte of each packed id of a text: its normalised bytes, projected by the alignment."""
    ends = np.cumsum(packed >> PACK)
    return align[ends - (packed >> PACK)], align[ends]


class Merger:
    """Byte-pair merges of many short chunks at once. Each round does every chunk's best merge, the leftmost of equals,
    so a chunk sees the same merges in the same order as alone. Symbols are numbers: those of letters and pieces of
    the vocabulary, and beyond them code points that it lacks."""

    def __init__(self, score: dict[str, float], ids: dict[str, int], byte: list[int]):
        symbols: dict[str, int] = {}
        for p in score:
            for x in (*p, p):
                symbols.setdefault(x, len(symbols))
        self.n, self.byte = len(symbols), byte
        self.width = self.n + 0x110000
        self.letter = np.arange(self.n, self.width, dtype=np.int64)
        self.out = np.full(self.n, -1, np.int64)  # id and bytes of each symbol that is a piece
        for x, k in symbols.items():
            if len(x) == 1:
                self.letter[ord(x)] = k
            if x in score:
                self.out[k] = ids[x] | len(x.encode()) << PACK
        self.text = {k: x for x, k in symbols.items() if x not in score}
        best = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        rows = sorted((symbols[p[:k]] * self.width + symbols[p[k:]], best[s], symbols[p]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.keys, self.rank, self.made = (np.array(c, np.int64) for c in zip(*(rows or [(-1, 0, 0)]), strict=True))
        self.none = len(best)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging neighbours; rank ``none`` where they don't merge."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], self.none), self.made[at]

    def merged(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All chunks' symbols in a row, and how many each has."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.letter[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        row = np.repeat(np.arange(len(chunks)), sizes)
        rank, made = self._look(symbols, np.append(symbols[1:], 0))
        rank[np.append(row[1:] != row[:-1], True)[: len(rank)]] = self.none
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            counts = np.diff(np.append(starts, len(row)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < self.none, counts)
            if not live.all():
                done.append((row[~live], symbols[~live]))
                symbols, row, rank, made = symbols[live], row[live], rank[live], made[live]
                some = best < self.none
                best, counts = best[some], counts[some]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, counts))
            at = at[np.append(True, row[at[1:]] != row[at[:-1]])]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, row, rank, made = symbols[keep], row[keep], rank[keep], made[keep]
            at = at - np.arange(len(at))
            at = np.concatenate([at[at > 0] - 1, at[at + 1 < len(row)]])  # the merged symbol's two neighbourhoods
            at = at[row[at] == row[at + 1]]
            rank[at], made[at] = self._look(symbols[at], symbols[at + 1])
            last = np.append(row[1:] != row[:-1], True)
            rank[last] = self.none
        if not done:
            return np.zeros(0, np.int64), sizes
        row, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(row, kind="stable")
        return symbols[order], np.bincount(row, minlength=len(chunks))

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Packed ids of all chunks, byte ids where a letter isn't in the vocabulary."""
        symbols, sizes = self.merged(chunks)
        flat = np.where(symbols < self.n, self.out[np.minimum(symbols, self.n - 1)], -1)
        strange = np.flatnonzero(flat < 0)
        if not len(strange):
            return flat, sizes
        raw = [(self.text[k] if k < self.n else chr(k - self.n)).encode() for k in symbols[strange].tolist()]
        more = np.array([len(r) for r in raw])
        row = np.repeat(np.arange(len(chunks)), sizes)
        wide = np.ones(len(flat), np.int64)
        wide[strange] = more
        flat = np.repeat(flat, wide)
        first = np.cumsum(wide)[strange] - more
        flat[np.repeat(first - np.cumsum(more) + more, more) + np.arange(more.sum())] = [self.byte[b] | (len(r) if j + 1 == len(r) else 0) << PACK for r in raw for j, b in enumerate(r)]
        return flat, np.bincount(np.repeat(row, wide), minlength=len(chunks))


def replaced(raw: bytes) -> bytes:
    """``raw`` with each byte that is no part of UTF-8 as U+FFFD."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = bytearray(), 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    raw[at : at + n].decode()
                except UnicodeDecodeError:
                    continue
                out += raw[at : at + n]
                at += n
                break
            else:
                out += "�".encode()
                at += 1
        return bytes(out)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def chunks_of(path: str) -> Chunks:
    """Of this worker, for all its tasks."""
    return Chunks(encoder_of(path))


class Chunks:
    """What each distinct chunk comes to: packed ids, its ids as text, and its decoded bytes. At most ``most`` chunks
    are remembered between blocks of texts."""

    def __init__(self, encoder: Encoder, most: int = 500_000):
        self.encoder, self.memo = encoder, Memo(self._make, np.int64, most)
        self.names = [str(k) for k in range(len(encoder.out))]
        self.widths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.names, encoder.out)]
        self.spelled: list[str] = []
        self.decoded: list[bytes] = []

    def _make(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = self.encoder.many(chunks)
        ids = flat & IDS
        names, out, each = self.names, self.encoder.out, ids.tolist()
        spelled, decoded = ",".join([names[k] for k in each]), b"".join([out[k] for k in each])
        last = np.cumsum(sizes)
        for text, width, gap, rows in ((spelled, self.widths[0], 1, self.spelled), (decoded, self.widths[1], 0, self.decoded)):
            ends = np.append(0, np.cumsum(width[ids] + gap))[np.append(0, last)].tolist()
            rows += [text[a : b - gap] for a, b in zip(ends, ends[1:], strict=False)]
        return flat, sizes

    def texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
        """(packed ids, first bytes, end bytes, numbers of the chunks) of each text."""
        normal = [self.encoder.normalize(t) for t in texts]
        parts = [self.encoder.chunks(n) for n, _ in normal]
        numbers = self.memo.numbers([c for p in parts for c in p])
        lengths, at = self.memo.lengths[numbers], 0
        for p, (_, align) in zip(parts, normal, strict=True):
            own = numbers[at : at + len(p)]
            packed = self.memo.flat[spans(self.memo.starts[own], lengths[at : at + len(p)])]
            at += len(p)
            yield packed, *spans_of(packed, align), own.tolist()

    def trim(self) -> None:
        if len(self.memo) > self.memo.most:
            self.memo.reset()
            self.spelled.clear(), self.decoded.clear()


def pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, pieces, firsts, ends): every id of every text, its piece, and its bytes in the source, firsts to
    ends. Null and empty texts have none. Repeated rows each get their row; other columns are ignored."""
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, names = chunks_of(model), [p.piece for p in model_of(model).pieces]
        for batch in batches:
            texts = texts_of(batch)
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                rows = [((p & IDS).tolist(), f, e) for p, f, e, _ in memo.texts(texts[a:b])]
                columns = [
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([[names[k] for k in r[0]] for r in rows], pa.list_(pa.string())),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                ]
                memo.trim()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns], ["doc_id", "ids", "pieces", "firsts", "ends"])

    return frame.mapInArrow(run, "doc_id long, ids array<int>, pieces array<string>, firsts array<long>, ends array<long>")


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256): digests of every text's ids, of the text that they
    decode to, and of the ids' first and end bytes in the source (little-endian 32-bit integers, all firsts, then all
    ends). What ``pieces`` gives, hashed in place."""
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = chunks_of(model)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            texts = texts_of(batch)
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                counts, ids, decoded, places = [], [], [], []
                for packed, firsts, ends, own in memo.texts(texts[a:b]):
                    counts.append(len(packed))
                    ids.append(sha(",".join(map(memo.spelled.__getitem__, own)).encode()))
                    decoded.append(sha(memo.encoder.finish(b"".join(map(memo.decoded.__getitem__, own)))))
                    places.append(sha(firsts.astype("<i4").tobytes() + ends.astype("<i4").tobytes()))
                memo.trim()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in (ids, decoded, places))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return frame.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
