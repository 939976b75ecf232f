"""Blocks of Markdown and XHTML documents, a row each. Documents are independent, so nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})(.*)")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( +)(.*)|$)")
QUOTE = re.compile(r" {0,3}> ?")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r" {0,3}\[(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
# The names of elements that begin an HTML block.
NAMED = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
#: How an HTML block begins, and what its last line holds; None: a blank line comes after it.
HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(rf" {{0,3}}</?(?:{NAMED})(?:\s|/?>|$)", re.I), None),
]
ALONE = re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$")
INLINE_CODE, INLINE_IMAGE = re.compile(r"(`+).*?\1", re.S), re.compile(r"!\[[^\]\n]*\]\([^)\n]*\)")

BLOCK = "token_index int, kind string, level int, text string, translatable boolean, line_start int, line_end int, char_start int, char_end int, inline_offset int, block_char_start int, block_char_end int, tag string, markup string, table_cell_index int"
NAMES = [f.split()[0] for f in BLOCK.split(", ")]


def visible(text: str) -> bool:
    """Whether more than code and images is left."""
    return bool(INLINE_IMAGE.sub("", INLINE_CODE.sub("", text)).strip())


def cells(row: str) -> list[tuple[int, int]]:
    """Spans of a table row's cells, trimmed; a pipe after an odd number of backslashes is text."""
    body = row.rstrip("\r\n")
    bars = [m.end() - 1 for m in re.finditer(r"(?:^|[^\\])(?:\\\\)*\|", body)]
    bars = sorted({*bars, *(k for k in range(1, len(body)) if body[k] == "|" and body[k - 1] == "|")})
    spans = list(zip([0, *(b + 1 for b in bars)], [*bars, len(body)], strict=True))
    if bars and not body[: bars[0]].strip():
        spans.pop(0)
    if bars and spans and not body[bars[-1] + 1 :].strip():
        spans.pop()
    trim = lambda a, b: (a + len(body[a:b]) - len(body[a:b].lstrip()), b - len(body[a:b]) + len(body[a:b].rstrip())) if body[a:b].strip() else (a, a)
    return [trim(a, b) for a, b in spans]


DEEP = 50  # containers in each other; what lies deeper is a paragraph
Line = tuple[int, str]  # number, and what is left of the line inside its containers


def plain(text: str) -> str:
    """Leading tabs as spaces to the next of every fourth column."""
    lead = len(text) - len(text.lstrip(" \t"))
    return text[:lead].expandtabs(4) + text[lead:] if "\t" in text[:lead] else text


def indent_of(text: str) -> int:
    return len(text) - len(text.lstrip(" "))


def html_end(text: str, in_paragraph: bool = False) -> re.Pattern | str | None:
    """What ends the HTML block that a line begins: a pattern, or "blank"; None if it begins none."""
    for start, end in HTML:
        if start.match(text):
            return end or "blank"
    return "blank" if not in_paragraph and ALONE.match(text) else None


def interrupts(text: str) -> bool:
    """Whether a line ends the paragraph before it."""
    if indent_of(text) >= 4:
        return False
    m = ITEM.match(text)
    item = m is not None and bool((m[4] or "").strip()) and (not m[2][0].isdigit() or int(m[2][:-1]) == 1)
    return item or any(p.match(text) for p in (FENCE, HEADING, RULE, QUOTE)) or html_end(text, True) is not None


def begins_table(lines: list[Line], k: int) -> bool:
    if k + 1 >= len(lines) or indent_of(lines[k][1]) >= 4 or indent_of(lines[k + 1][1]) >= 4:
        return False
    head, below = lines[k][1], lines[k + 1][1]
    return "|" in head + below and DELIMITER.match(below) is not None and not (SETEXT.match(below) and "|" not in head) and len(cells(head)) == len(cells(below))


def open_paragraph(lines: list[Line]) -> bool:
    """Whether the last line stands in a paragraph, which then takes lines without their containers' marks."""
    fence = ""
    for _, text in lines:
        inner = text
        while m := QUOTE.match(inner) or (ITEM.match(inner) if not RULE.match(inner) else None):
            inner = inner[m.end() :] if m.re is QUOTE else m[4] or ""
        f = FENCE.match(inner)
        if fence:
            fence = "" if f and f[1].startswith(fence) and not f[2].strip() else fence
        elif f:
            fence = f[1]
    return not fence and bool(inner.strip()) and indent_of(inner) < 4 and not any(p.match(inner) for p in (FENCE, HEADING, RULE)) and html_end(inner, True) is None


def scan(lines: list[Line], emit, within: tuple[str, ...] = ()) -> None:
    """The blocks of ``lines``, in order, to ``emit(kind, first line, line after the last, text, within, **more)``. A
    container's lines without its marks are scanned again on their own; ``within`` names the containers."""
    k, n = 0, len(lines)
    while k < n:
        number, text = lines[k]
        end = k + 1
        if not text.strip():
            k += 1
        elif indent_of(text) >= 4:
            while end < n and (not lines[end][1].strip() or indent_of(lines[end][1]) >= 4):
                end += 1
            while not lines[end - 1][1].strip():
                end -= 1
            emit("code", number, lines[end - 1][0] + 1, "".join(t[4:] + "\n" for _, t in lines[k:end]), within, tag="code")
            k = end
        elif m := FENCE.match(text):
            close, off = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$"), indent_of(text)
            while end < n and not close.match(lines[end][1]):
                end += 1
            body = "".join(t[min(off, indent_of(t)) :] + "\n" for _, t in lines[k + 1 : end])
            end = min(end + 1, n)
            emit("code", number, lines[end - 1][0] + 1, body, within, tag="code", markup=m[1], info=m[2].strip())
            k = end
        elif stop := html_end(text):
            if stop == "blank":
                while end < n and lines[end][1].strip():
                    end += 1
            elif not stop.search(text):
                while end < n and not stop.search(lines[end][1]):
                    end += 1
                end = min(end + 1, n)
            emit("raw", number, lines[end - 1][0] + 1, "".join(t + "\n" for _, t in lines[k:end]), within)
            k = end
        elif m := HEADING.match(text):
            emit("heading", number, number + 1, (m[2] or "").strip(), within, tag=f"h{len(m[1])}", markup=m[1], level=len(m[1]))
            k = end
        elif RULE.match(text):
            emit("rule", number, number + 1, "", within)
            k = end
        elif len(within) < DEEP and QUOTE.match(text):
            inner: list[Line] = []
            while k < n:
                number, text = lines[k]
                if m := QUOTE.match(text):
                    inner.append((number, plain(text[m.end() :])))
                elif text.strip() and inner and not interrupts(text) and open_paragraph(inner):
                    inner.append((number, text.lstrip()))
                else:
                    break
                k += 1
            emit("open", inner[0][0], 0, "quote", within)
            scan(inner, emit, (*within, "quote"))
            emit("close", inner[-1][0], 0, "quote", within)
        elif len(within) < DEEP and (m := ITEM.match(text)):
            gap = len(m[3] or " ")
            width = len(m[1]) + len(m[2]) + (gap if gap <= 4 and m[4] else 1)
            inner = [(number, plain(text[width:]))]
            k += 1
            while k < n:
                number, text = lines[k]
                if not text.strip():
                    if not any(t.strip() for _, t in inner):  # an item that begins with two blank lines is empty
                        break
                    inner.append((number, ""))
                elif indent_of(text) >= width:
                    inner.append((number, text[width:]))
                elif inner[-1][1].strip() and not interrupts(text) and not ITEM.match(text) and open_paragraph(inner):
                    inner.append((number, text.lstrip()))
                else:
                    break
                k += 1
            while len(inner) > 1 and not inner[-1][1].strip():
                inner.pop()
            kind = "item" + m[2][-1]
            emit("open", inner[0][0], 0, kind, within)
            scan(inner, emit, (*within, "item"))
            emit("close", inner[-1][0], 0, kind, within)
        elif begins_table(lines, k):
            wide = len(cells(text))
            end = k + 2
            while end < n and lines[end][1].strip() and not interrupts(lines[end][1]) and indent_of(lines[end][1]) < 4:
                end += 1
            emit("open", number, 0, "table", within)
            for row in [k, *range(k + 2, end)]:
                emit("row", lines[row][0], lines[row][0] + 1, lines[row][1], within, wide=wide, tag="th" if row == k else "td")
            emit("close", number, 0, "table", within)
            k = end
        else:
            k = _paragraph(lines, k, emit, within)


def _paragraph(lines: list[Line], k: int, emit, within: tuple[str, ...]) -> int:
    """A paragraph or an underlined heading, without the link definitions before its words."""
    end, n = k + 1, len(lines)
    underline = None
    while end < n and lines[end][1].strip():
        if m := SETEXT.match(lines[end][1]):
            underline = m
            break
        if interrupts(lines[end][1]) or begins_table(lines, end):
            break
        end += 1
    text, first = "\n".join(t for _, t in lines[k:end]), k
    while m := DEFINITION.match(text):
        first, text = first + m[0].count("\n") + (not m[0].endswith("\n")), text[m.end() :]
    if not text.strip():  # definitions alone; what looked like an underline is a line of its own
        return end
    after = lines[end - 1][0] + 1
    if underline:
        level = 1 if underline[1][0] == "=" else 2
        emit("heading", lines[first][0], after, text.strip(), within, tag=f"h{level}", markup=underline[1][0], level=level, block=(lines[first][0], lines[end][0] + 1))
        return end + 1
    emit("para", lines[first][0], after, text.strip(), within)
    return end


def markdown_rows(source: str) -> list[tuple]:
    """Headings (ATX and underlined), paragraphs, list items, quotes, table cells; fenced and indented code and HTML
    blocks as not translatable. What stands in a list is an item's, also inside a quote; headings stay headings."""
    lines = source.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    out: list[tuple] = []
    looked: dict[tuple[int, int], int] = {}  # where the last text of the same lines ended

    def put(kind: str, a: int, b: int, text: str, offset: int, tag: str, markup: str = "", level: int = 0, cell: int | None = None, block: tuple[int, int] | None = None) -> None:
        lo, hi = starts[a], starts[b]
        c, d = (starts[block[0]], starts[block[1]]) if block else (lo, hi)
        good = kind not in ("code", "raw") and visible(text)
        out.append((len(out), kind, level, text, good, a, b, lo, hi, offset, c, d, tag, markup, cell))

    def emit(kind: str, a: int, b: int, text: str, within: tuple[str, ...], tag: str = "p", markup: str = "", level: int = 0, block=None, wide: int = 0, info: str = "") -> None:
        if kind in ("open", "close", "rule"):
            return
        if kind == "row":
            bare = lines[a].rstrip("\r\n")
            lead = len(bare) - len(text) if bare.endswith(text) else 0
            spans = cells(text)
            for j in range(wide):
                x, y = spans[j] if j < len(spans) else (0, 0)
                put("table_cell", a, b, text[x:y].replace("\\|", "|"), lead + x if j < len(spans) else -1, tag, cell=j)
            return
        raw = source[starts[a] : starts[b]]
        at = raw.find(text, looked.get((a, b), 0))
        at = raw.find(text) if at < 0 else at
        if at >= 0:
            looked[(a, b)] = at + len(text)
        if kind == "para":
            kind = "list_item" if "item" in within else "blockquote" if "quote" in within else "para"
        put(kind, a, b, text, at, "" if kind == "raw" else tag, markup, level, block=block)

    scan([(k, plain(x.rstrip("\r\n"))) for k, x in enumerate(lines)], emit)
    return out


#: Blocks that a task holds at once, but for those of one document.
ROWS = 10_000


def _rows_of(frame: DataFrame, text: str, keep: list[str], make, schema: str) -> DataFrame:
    """``make`` applied to each document's text; its rows keep the document's ``keep`` columns."""
    source = frame.select(*keep, F.col(text).alias("_source"))
    fields = T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL(schema).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def made_of(batch: pa.RecordBatch, index: list[int], flat: list[tuple]) -> pa.RecordBatch:
        at = pa.array(index, pa.int64())
        made = [pa.array([x[j] for x in flat], arrow.field(len(keep) + j).type) for j in range(len(arrow) - len(keep))]
        return pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(len(keep))), *made], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, flat = [], []
            for k, t in enumerate(batch.column(len(keep))):
                rows = make(t.as_py() or "")
                index += [k] * len(rows)
                flat += rows
                if len(flat) >= ROWS:  # a batch of documents may have very many blocks
                    yield made_of(batch, index, flat)
                    index, flat = [], []
            if flat:
                yield made_of(batch, index, flat)

    small_batches(frame.sparkSession)
    return source.mapInArrow(run, fields)


def markdown_blocks(files: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Blocks of each file with line and character offsets; token_index counts a file's blocks."""
    return _rows_of(files, text, keep, markdown_rows, BLOCK)


PICKED = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
XBLOCK = "token_index int, kind string, level int, text string, translatable boolean, xpath string, tag string, inline_code map<string,string>, inline_slots array<struct<start:int,end:int>>"


class Picker(HTMLParser):
    """Text of the picked elements in page order; inside a list item or quote only the outermost one is picked."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict[str, int], str]] = [("", {}, "")]
        self.rows: list[tuple] = []
        self.at: int | None = None  # depth of the picked element
        self.skip: int | None = None

    def handle_starttag(self, tag, attrs):
        if tag in PICKED or tag in ("div", "ul", "ol", "table"):
            while len(self.open) > 1 and self.open[-1][0] == "p":  # a paragraph ends where another block begins
                self.handle_endtag("p")
        if tag == "li" and self.open[-1][0] == "li":
            self.handle_endtag("li")
        counts = self.open[-1][1]
        counts[tag] = counts.get(tag, 0) + 1
        path = f"{self.open[-1][2]}/{tag}[{counts[tag]}]"
        if tag in VOID:
            return
        self.open.append((tag, {}, path))
        if self.at is None and tag in PICKED:
            self.at, self.parts, self.codes, self.path = len(self.open), [], {}, path
        if self.skip is None and (tag in ("script", "style") or (self.at is not None and tag in ("code", "pre") and len(self.open) > self.at)):
            self.skip, self.hidden = len(self.open), ""

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.skip is not None:
            self.hidden += data
        elif self.at is not None:
            self.parts.append((data, True))

    def handle_endtag(self, tag):
        if tag not in [t for t, _, _ in self.open[1:]]:
            return
        while True:
            name = self.open[-1][0]
            if self.skip == len(self.open):
                if name in ("code", "pre") and self.at is not None:
                    marker = f"⟦EPUBCODE{len(self.codes):04d}⟧"
                    self.codes[marker] = self.hidden
                    self.parts.append((marker, False))
                self.skip = None
            if self.at == len(self.open):
                self.pick(name)
            self.open.pop()
            if name == tag:
                return

    def pick(self, tag: str) -> None:
        whole = "".join(p for p, _ in self.parts)
        lead, at, slots = len(whole) - len(whole.lstrip()), 0, []
        text = whole.strip()
        for part, plain in self.parts:
            a, b = max(at - lead, 0), min(at + len(part) - lead, len(text))
            if plain and part.strip() and b > a:
                slots.append({"start": a, "end": b})
            at += len(part)
        kind = "heading" if tag[0] == "h" else {"li": "list_item", "blockquote": "blockquote", "pre": "code"}.get(tag, "para")
        good = tag != "pre" and bool(slots)
        self.rows.append((len(self.rows), kind, int(tag[1]) if tag[0] == "h" else 0, text, good, self.path, tag, list(self.codes.items()), slots))
        self.at = None

    def finish(self) -> list[tuple]:
        self.close()
        if len(self.open) > 1:
            self.handle_endtag(self.open[1][0])
        return self.rows


def xhtml_rows(page: str) -> list[tuple]:
    picker = Picker()
    picker.feed(page)
    return picker.finish()


def xhtml_blocks(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Blocks of each page with their place, code kept aside, and ranges of visible text; tolerant of broken pages."""
    return _rows_of(pages, html, keep, xhtml_rows, XBLOCK)
