"""Column functions over text: all built in, but for Unicode forms of texts that aren't plain ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .helpers import casefold as _casefold
from .helpers import nfc as _nfc

SPACE = r"(?U)[\s\x1c-\x1f]+"
ASCII = r"^[\x00-\x7F]*$"
# The pattern of placeholders and of runs of English words.
PLACEHOLDER = (
    r"(?U)\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|\{[A-Za-z_][\w.:-]*\}"
    r"|%\([A-Za-z_]\w*\)[#0 +\-]?(?:\d+|\*)?(?:\.\d+)?[diouxXeEfFgGcrs%]"
    r"|%(?:[#0 +\-]?(?:\d+|\*)?(?:\.\d+)?[diouxXeEfFgGcrs%])|\[\[[^\[\]\n]+\]\]|<[A-Za-z][^<>\n]*?>"
)
# Five words or more. Java steps into itself for each turn of a group that may give turns back, and a long run of words
# overflows its stack; a possessive group doesn't. It takes a word only if another one that ends at a bound comes after it.
WORD = r"[A-Za-z][A-Za-z'’-]*"
ENGLISH = rf"(?U)\b{WORD}+(?:\s+{WORD}+(?=\s+{WORD}\b)){{3,}}+\s+{WORD}\b"


def once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """``frame`` with a column that is worked out once a row, however often later columns use it: a generator of one
    row stands between them, and the optimizer doesn't copy expressions through it."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def is_blank(c: Column) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(~c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def normalize_text(c: Column) -> Column:
    """NFC, plain quotes, dashes and spaces, runs of white space as one space, trimmed."""
    ascii = c.rlike(ASCII)
    composed = F.when(ascii, c).otherwise(_nfc(F.when(~ascii, c)))
    plain = F.translate(composed, "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- ")
    return F.trim(F.regexp_replace(plain, SPACE, " "))


def source_hash(c: Column) -> Column:
    return F.sha1(normalize_text(c).cast("binary"))


def casefold(c: Column) -> Column:
    ascii = c.rlike(ASCII)
    return F.when(ascii, F.lower(c)).otherwise(_casefold(F.when(~ascii, c)))


# Fields of a path that change with a document's text and don't name a place.
VOLATILE = ("raw_block", "inline_source", "inline_offset", "block_text", "char_start", "char_end", "line_start", "line_end", "part_index", "part_count")


def stable_path(path: Column, kind: StructType) -> Column:
    """The canonical JSON of a path of type ``kind``: of Markdown its token, of an EPUB its file and place, of any other
    source all fields but the ``VOLATILE`` ones; fields in the order of their names at every depth."""
    names = set(kind.names)

    def sorted_struct(c: Column, t: StructType, keep) -> Column:
        fields = sorted((f for f in t.fields if keep(f.name)), key=lambda f: f.name)
        return F.struct(*[(sorted_struct(c[f.name], f.dataType, lambda _: True) if isinstance(f.dataType, StructType) else c[f.name]).alias(f.name) for f in fields])

    def text(keep) -> Column:
        return F.to_json(sorted_struct(path, kind, keep), {"ignoreNullFields": "false"})

    out = text(lambda n: n not in VOLATILE)
    if "source_type" not in names:
        return out
    for source, own in (("epub", {"file", "source_type", "xpath"}), ("md", {"source_type", "token_index"})):
        if own <= names:
            out = F.when(path["source_type"] == source, text(own.__contains__)).otherwise(out)
    return out


def stable_key(chapter_ord: Column, block_index: Column, path: Column, part_index: Column, part_count: Column, kind: StructType | None = None) -> Column:
    """Place and a hash of the canonical JSON of ``path``: a struct with its fields in the order of their names, or, with
    its ``kind``, any path, of which ``stable_path`` takes what is stable."""
    text = F.to_json(path, {"ignoreNullFields": "false"}) if kind is None else stable_path(path, kind)
    digest = F.substring(F.sha1(text.cast("binary")), 1, 8)
    key = F.format_string("%04d:%05d:%s", chapter_ord, block_index, digest)
    return F.when(part_count > 1, F.concat(key, F.lit("#"), part_index.cast("string"))).otherwise(key)


def other_length(c: Column) -> Column:
    """Characters that aren't CJK ones."""
    return F.length(F.regexp_replace(c, "[㐀-鿿]", ""))


def estimate_tokens(c: Column) -> Column:
    """A token for each CJK character and for each four others begun; 0 for an empty text, 1 for a null one. With m others
    of n characters this is n - m + ceil(m / 4) = n - floor(3 m / 4): the text is searched once."""
    return F.coalesce(F.length(c) - F.floor(3 * other_length(c).cast("long") / 4.0), F.lit(1)).cast("long")


def fits(c: Column, most: int) -> Column:
    """Whether ``c`` has ``most`` tokens at the most. No text has more tokens than characters, so short ones aren't searched."""
    return (F.length(c) <= most) | (estimate_tokens(c) <= most)


def placeholders(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PLACEHOLDER), F.lit(0))


def multiset_minus(a: Column, b: Column) -> Column:
    """Elements of ``a`` beyond their count in ``b``."""
    count = lambda xs, p: F.size(F.filter(xs, lambda x: x == p))
    return F.flatten(F.transform(F.array_distinct(a), lambda p: F.array_repeat(p, F.greatest(F.lit(0), count(a, p) - count(b, p)))))


def compact_length(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, ""))


def english_runs(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ENGLISH), F.lit(0))


def completed(status: Column) -> Column:
    return status.isin("done", "reviewed")


def contains_folded(c: Column, needle: str) -> Column:
    """Literal search without regard to case: % and _ stand for themselves."""
    return F.contains(F.lower(c), F.lower(F.lit(needle)))
