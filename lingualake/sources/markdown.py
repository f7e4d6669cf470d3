"""Markdown: a walk over lines finds the blocks with their places; units, front matter and templates are plans over these.

Block rows are (doc_id, seq, kind, text, start, end) on normalised text (see normalised()): headings without their
marks, paragraphs, quotes with theirs, code with its fences or indent, html blocks, rules, the lines of list items,
table cells, and the names of link definitions. Fenced code inside of lists is none.

Cases: a null content is an empty file without blocks. Liquid tags alone, numbers and numbered references are no
units. A fence that is not closed is a paragraph. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import yaml_files

BLOCKS = "seq int, kind string, text string, start int, end int"
_FENCE = re.compile(r" *(`{3,}|~{3,})[^`\n]*$")
_HEADING = re.compile(r" {0,3}#{1,6}\s*\S")
_RULE = re.compile(r" {0,3}([-*_])(?: *\1){2,} *$")
_UNDERLINE = re.compile(r" *(=+|-+) *$")
_MARK = re.compile(r"( *)(?:[*+-]|\d+\.)( +)(?=\S)")
_DEFINITION = re.compile(r" *\[([^\^\]][^\]]*)\]: *\S.*$")
_HTML = re.compile(r" *</?(?:address|article|aside|blockquote|center|details|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|iframe|nav|ol|p|pre|script|section|style|summary|table|ul|video)\b|<!--", re.I)
_DIVIDER = re.compile(r" *\|? *:?-+:? *(?:\| *:?-+:? *)*\|? *$")
_NUMBER = re.compile(r"\s*[-+]?(?:\d[\d_]*\.?\d*|\.\d+)(?:e[-+]?\d+)?\s*$|\s*[-+]?(?:inf|infinity|nan)\s*$", re.I)


class _Lines:
    """The lines of a text with their places."""

    def __init__(self, text: str, offset: int):
        self.lines = text.split("\n")
        self.at = []
        for line in self.lines:
            self.at.append(offset)
            offset += len(line) + 1

    def span(self, first: int, last: int) -> tuple[str, int, int]:
        """The lines from `first` up to `last`, this one not counted, without empty ones at the end."""
        while last > first and not self.lines[last - 1].strip():
            last -= 1
        text = "\n".join(self.lines[first:last])
        return text, self.at[first], self.at[first] + len(text)

    def fence_end(self, k: int) -> int | None:
        """The line after the fenced code that starts at `k`, if any."""
        m = _FENCE.match(self.lines[k])
        if m:
            for end in range(k + 1, len(self.lines)):
                if self.lines[end].strip() == m.group(1):
                    return end + 1
        return None

    def interrupts(self, k: int) -> bool:
        """Whether line `k` ends a paragraph before it."""
        line = self.lines[k]
        return not line.strip() or bool(_HEADING.match(line) or _RULE.match(line) or line.lstrip().startswith(">") or _MARK.match(line) or _DEFINITION.match(line) or _HTML.match(line)) or self.fence_end(k) is not None


def _cells(line: str, at: int) -> Iterator[tuple[str, int, int]]:
    for m in re.finditer(r"(?:\\.|[^|\\])+", line):
        cell = m.group().strip()
        if cell:
            start = at + m.start() + m.group().index(cell)
            yield cell, start, start + len(cell)


def _list_of(own: _Lines, k: int) -> tuple[list[tuple], int]:
    """The units of the list that starts at line `k`, and the line after it."""
    out, deep, blank = [], 0, False
    while k < len(own.lines):
        line = own.lines[k]
        if not line.strip():
            k, blank = k + 1, True
            continue
        indent, mark = len(line) - len(line.lstrip()), _MARK.match(line)
        if blank and not mark and indent < 2 or _RULE.match(line) and indent < 2 or not mark and _HEADING.match(line) and not indent:
            break
        if blank and not mark and indent >= deep + 4:
            end = k
            while end < len(own.lines) and (not own.lines[end].strip() or len(own.lines[end]) - len(own.lines[end].lstrip()) >= deep + 4):
                end += 1
            out.append(("code", *own.span(k, end)))
            k, blank = end, True
            continue
        start, blank = 0, False
        while mark := _MARK.match(line, start):
            start = mark.end()
            deep = start
        if (m := _FENCE.match(line, start)) is not None:
            end = next((e for e in range(k + 1, len(own.lines)) if own.lines[e].strip() == m.group(1)), None)
            if end is not None:
                k = end + 1
                continue
        text = line[start:].strip()
        at = own.at[k] + start + len(line[start:]) - len(line[start:].lstrip())
        out.append(("list", text, at, at + len(text)))
        k += 1
    return out, k


def blocks_of(text: str, offset: int = 0) -> Iterator[tuple]:
    """(kind, text, start, end) of a text's blocks in order."""
    own, k = _Lines(text, offset), 0
    lines = own.lines
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif (end := own.fence_end(k)) is not None:
            yield "code", *own.span(k, end)
            k = end
        elif line.startswith("    "):
            end = k
            while end < len(lines) and (not lines[end].strip() or lines[end].startswith("    ")):
                end += 1
            yield "code", *own.span(k, end)
            k = end
        elif _HEADING.match(line):
            m = re.match(r"#+\s+", line)
            start = m.end() if m else 0
            yield "heading", line[start:], own.at[k] + start, own.at[k] + len(line)
            k += 1
        elif _RULE.match(line):
            yield "rule", *own.span(k, k + 1)
            k += 1
        elif "|" in line and k + 1 < len(lines) and "|" in lines[k + 1] and _DIVIDER.match(lines[k + 1]):
            for cell in _cells(line, own.at[k]):
                yield "table", *cell
            k += 2
            while k < len(lines) and "|" in lines[k]:
                for cell in _cells(lines[k], own.at[k]):
                    yield "table", *cell
                k += 1
        elif k + 1 < len(lines) and lines[k + 1].strip() and _UNDERLINE.match(lines[k + 1]):
            yield "heading", *own.span(k, k + 2)
            k += 2
        elif line.lstrip().startswith(">"):
            end = k
            while end < len(lines) and lines[end].strip():
                end += 1
            yield "quote", *own.span(k, end)
            k = end
        elif _MARK.match(line):
            found, k = _list_of(own, k)
            yield from found
        elif m := _DEFINITION.match(line):
            yield "reference", m.group(1), own.at[k] + m.start(1), own.at[k] + m.end(1)
            k += 1
        elif _HTML.match(line):
            end, closes = k + 1, line.lstrip().startswith("<!--")
            if closes:
                while end < len(lines) and "-->" not in "\n".join(lines[k:end]):
                    end += 1
            else:
                while end < len(lines) and lines[end].strip():
                    end += 1
            yield "html", *own.span(k, end)
            k = end
        else:
            end = k + 1
            while end < len(lines) and not own.interrupts(end):
                if end + 1 < len(lines) and lines[end + 1].strip() and _UNDERLINE.match(lines[end + 1]):
                    break
                end += 1
            yield "paragraph", *own.span(k, end)
            k = end


def _normal(text: str, compose: bool) -> str:
    text = re.sub(r"(?m)^ +$", "", text.replace("\r\n", "\n").expandtabs(4))
    return unicodedata.normalize("NFKC", text) if compose else text


def front_matter(text: str) -> tuple[str, str]:
    """The YAML at the beginning of a text, with the dashes before it, and the line of dashes behind it with the white space after; both empty if there is none.

    The text begins with three dashes and white space. The line behind is the first one of three dashes and white space
    that no list item follows at once, that one character more stands before, and that no backtick comes right before.
    """
    if text[:3] != "---" or not text[3:4].isspace():
        return "", ""
    at = text.find("\n---", 3)
    while at >= 0:
        end = at + 4
        while text[end : end + 1].isspace():
            end += 1
        end -= text[end : end + 1] == "-"
        if end > at + 4 and at > 4 and text[at - 1] != "`":
            return text[:at], text[at:end]
        at = text.find("\n---", at + 1)
    return "", ""


def _prepare(compose: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("content").to_pylist():
                own = _normal(text or "", compose)
                rows.append((own, *front_matter(own)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.string()) for c in columns), batch.column("newline")], ["doc_id", "content", "header", "separator", "newline"])

    return run


def normalised(files: DataFrame, compose: bool = True) -> DataFrame:
    """Rows (doc_id, content, header, separator, newline): tabs are four spaces, blank lines empty, lines end like in UNIX; if `compose` in normal form KC.

    `header` is the YAML at the beginning with the marks before it, `separator` the marks after it.
    """
    rows = files.select("doc_id", "content", T.newline_type(F.col("content")).alias("newline"))
    return rows.mapInArrow(_prepare(compose), f"doc_id {files.schema['doc_id'].dataType.simpleString()}, content string, header string, separator string, newline string")


def rows_of(text: str | None, start: int = 0) -> list[tuple]:
    """The block rows of one file from `start` on; blocks that are tags of a template language, numbers or blank are none."""
    own = [x for x in blocks_of((text or "")[start:], start) if not (x[1].startswith("{%") and x[1].endswith("%}")) and not _NUMBER.match(x[1]) and x[1].strip()]
    own = [x for x in own if not (x[0] == "reference" and x[1].strip().lstrip("+-").isdigit())]
    return [(i, *x) for i, x in enumerate(own)]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owners, rows = [], []
        for k, (text, start) in enumerate(zip(batch.column("content").to_pylist(), batch.column("start").to_pylist(), strict=True)):
            own = rows_of(text, start)
            owners += [k] * len(own)
            rows += own
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owners, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "seq", "kind", "text", "start", "end"])


def blocks(prepared: DataFrame) -> DataFrame:
    """The block rows of normalised files, header and separator left out."""
    rows = prepared.select("doc_id", "content", (F.length("header") + F.length("separator")).alias("start"))
    return rows.mapInArrow(_walk, f"doc_id {prepared.schema['doc_id'].dataType.simpleString()}, {BLOCKS}")


def _numbered(rows: DataFrame) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    rows = rows.withColumn("ord", order)
    key = F.col("ord").cast("string")
    return rows.select("doc_id", key.alias("key"), "text", "kind", "ord", T.string_hash(key).alias("string_hash"), T.placeholder(T.string_hash(key)).alias("placeholder"), "start", "end")


def units(files: DataFrame) -> DataFrame:
    """Rows (doc_id, key, text, kind, ord, string_hash, placeholder, start, end); of a YAML header the values of its lines, block values as a whole."""
    prepared = normalised(files, compose=False)
    lines = prepared.filter("header <> ''").select("doc_id", F.posexplode(F.split("header", "\n")).alias("n", "line"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    pair = ~F.col("line").startswith("#") & F.contains("line", F.lit(":"))
    opens = pair & T.strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).isin("|", ">", "[")
    indent = F.length(F.regexp_extract("line", "^( *)", 1))
    held = F.last(F.when(opens, indent + 2).when(pair, F.lit(10_000)), ignorenulls=True).over(before)
    owner = F.last(F.when(opens, F.col("n")), ignorenulls=True).over(before)
    lines = lines.withColumns({"inside": F.coalesce((indent >= held) & ~F.col("line").startswith("#"), F.lit(False)), "opens": opens, "pair": pair, "owner": owner})
    single = lines.filter("pair and not opens and not inside").withColumn("text", T.strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).filter("text <> ''")
    single = single.select("doc_id", F.col("n").alias("seq"), "text", (F.col("at") + F.length("line") - F.length(F.regexp_extract("line", r"^[^:]*:\s*(.*)$", 1))).cast("int").alias("start"))
    many = lines.filter("inside").groupBy("doc_id", F.col("owner").alias("seq")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"), F.min("at").cast("int").alias("start"))
    head = single.unionByName(many).withColumn("end", (F.col("start") + F.length("text")).cast("int"))
    head = head.filter(~F.col("text").rlike(r"^\{%[\s\S]*%\}$|^\s*[-+]?(\d+\.?\d*|\.\d+)\s*$")).withColumn("kind", F.lit("yaml"))
    body = blocks(prepared).withColumn("seq", F.col("seq") + 1_000_000)
    return _numbered(head.select("doc_id", "seq", "kind", "text", "start", "end").unionByName(body))


def front_matter_units(files: DataFrame) -> DataFrame:
    """Units of files whose header is YAML: its leaves by path with context and flags, then the blocks, whose order goes on. The same for MDX files."""
    prepared = normalised(files)
    head = yaml_files.units(prepared.filter("header <> ''").select("doc_id", F.col("header").alias("content")))
    head = head.select("doc_id", "key", "text", F.lit("yaml").alias("kind"), "context", "flags", "ord", "string_hash", "placeholder", "start", "end")
    counts = head.groupBy("doc_id").agg(F.count("*").alias("_n"))
    rows = blocks(prepared).join(counts, "doc_id", "left")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1 + F.coalesce("_n", F.lit(0))
    rows = rows.withColumn("ord", order.cast("int"))
    key = F.col("ord").cast("string")
    body = rows.select("doc_id", key.alias("key"), "text", "kind", F.lit("").alias("context"), F.lit("").alias("flags"), "ord", T.string_hash(key).alias("string_hash"), T.placeholder(T.string_hash(key)).alias("placeholder"), "start", "end")
    return head.unionByName(body)
