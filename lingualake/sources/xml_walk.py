"""XML files as node rows with offsets: a walk over the marks keeps places, comments, CDATA and entities as they stand.

Node rows are (doc_id, seq, parent, depth, kind, tag, attrs, start, open_end, close_start, end, tail_end, text,
inner, line, up, above) for elements and comments, `seq` in order of their starts. Places are code points: the opening tag
lies between `start` and `open_end`, the closing one between `close_start` and `end`, and what follows up to the
next mark ends at `tail_end`. `text` is what stands before the first mark inside. `inner` is all that stands
inside, given for elements without elements and for those named in `whole`. `up` and `above` list the `seq` and
the tags of the elements around, the innermost last. A file that is not well formed
gives one row of kind `error` instead, with the message as text and the line.

Cases: a null content is an empty file, which has no root: an error. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import walked

NODES = "seq int, parent int, depth int, kind string, tag string, attrs map<string,string>, start int, open_end int, close_start int, end int, tail_end int, text string, inner string, line int, up array<int>, above array<string>"
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), *[pa.int32()] * 5, pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()))
_MARK = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE(?:[^\[>]|\[.*?\])*>|<(/?)([^\s/>!?<]+)((?:\s+[^\s=/><]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)


class Malformed(Exception):
    """What is wrong with a file, and where."""

    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


def check(text: str) -> None:
    """Raises Malformed if a file is not well formed."""
    stack: list[tuple[str, int]] = []
    rooted, at = False, 0
    for m in _MARK.finditer(text):
        if (bare := text.find("<", at, m.start())) >= 0:
            raise Malformed("a < that starts no tag", bare)
        if not stack and text[at : m.start()].strip().strip("﻿"):
            raise Malformed("text outside of the root", at)
        at = m.end()
        if text.startswith("<![CDATA[", m.start()):
            if not stack:
                raise Malformed("text outside of the root", m.start())
            continue
        closing, tag, attributes, empty = m.groups()
        if tag is None:
            continue
        if closing:
            if not stack or stack[-1][0] != tag:
                raise Malformed(f"closing tag of {tag} where " + (f"{stack[-1][0]} is open" if stack else "nothing is open"), m.start())
            stack.pop()
            continue
        if not stack and rooted:
            raise Malformed("a second root", m.start())
        names = [x[1] for x in _ATTRIBUTE.finditer(attributes)] if attributes else []
        if len(set(names)) < len(names):
            raise Malformed(f"repeated attribute in {tag}", m.start())
        rooted = True
        if not empty:
            stack.append((tag, m.start()))
    if (bare := text.find("<", at)) >= 0:
        raise Malformed("a < that starts no tag", bare)
    if stack:
        raise Malformed(f"{stack[-1][0]} is not closed", stack[-1][1])
    if not rooted:
        raise Malformed("no root", 0)
    if text[at:].strip():
        raise Malformed("text outside of the root", at)


def nodes_of(text: str, whole: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """The node rows of one file, without doc_id, each as soon as what follows it begins; only elements that are open are held. The file must be well formed."""
    stack: list[list] = []  # [row, end of its text, whether it holds no element, `up` and `above` of what it holds]
    last: list | None = None  # what the text at hand follows
    seq, line, counted = 0, 1, 0
    for m in _MARK.finditer(text):
        start, end = m.span()
        if text.startswith("<![CDATA[", start):
            continue
        if last is not None:
            last[10] = start
            yield tuple(last)
            last = None
        top = stack[-1] if stack else None
        if top is not None and top[1] is None:
            top[1] = start
        closing, tag, attributes, empty = m.groups()
        comment = text.startswith("<!--", start)
        if tag is None and not comment:
            continue
        if closing:
            last, text_end, leaf, _, _ = stack.pop()
            last[8:10] = start, end
            last[11] = text[last[7] : text_end]
            last[12] = text[last[7] : start] if leaf or tag in whole else None
            continue
        line += text.count("\n", counted, start)
        counted = start
        up, above = (top[3], top[4]) if top is not None else ([], [])
        row = [seq, up[-1] if up else None, len(stack), "element", tag, [], start, end, end, end, None, "", "", line, up, above]
        seq += 1
        if comment:
            row[3:5], row[11:13] = ("comment", ""), (text[start + 4 : end - 3], None)
            last = row
            continue
        if attributes:
            row[5] = [(x[1], x[2] if x[2] is not None else x[3]) for x in _ATTRIBUTE.finditer(attributes)]
        if top is not None:
            top[2] = False
        if empty:
            last = row
        else:
            stack.append([row, None, True, [*up, row[0]], [*above, tag]])
    if last is not None:
        last[10] = len(text)
        yield tuple(last)


def _rows_of(text: str | None, whole: frozenset[str]) -> Iterator[tuple]:
    text = text or ""
    try:
        check(text)
    except Malformed as e:
        return iter([(0, None, 0, "error", "", [], e.at, None, None, None, None, str(e), None, text.count("\n", 0, e.at) + 1, [], [])])
    return nodes_of(text, whole)


def rows_of(text: str | None, whole: frozenset[str] = frozenset()) -> list[tuple]:
    """The node rows of one file in order, or its error row."""
    return sorted(_rows_of(text, whole), key=lambda row: row[0])


def _walk(whole: frozenset[str]):
    names = [x.split()[0] for x in NODES.split(", ")]
    return lambda batches: walked(batches, lambda text: _rows_of(text, whole), names, _TYPES)


def nodes(files: DataFrame, *whole: str) -> DataFrame:
    """The node rows of `files` (doc_id, content); elements named in `whole` give what is inside them even if it holds elements."""
    return files.select("doc_id", "content").mapInArrow(_walk(frozenset(whole)), f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {NODES}")


def errors(found: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, message, line) of the files that are not well formed."""
    return found.filter("kind = 'error'").select("doc_id", F.lit("not well formed").alias("rule"), F.col("text").alias("message"), "line")


def children(found: DataFrame, parents: DataFrame, *tags: str) -> DataFrame:
    """The elements with one of `tags`, or all without, whose parent is among `parents` (doc_id, seq)."""
    own = found.filter("kind = 'element'")
    own = own.filter(F.col("tag").isin(*tags)) if tags else own
    return own.join(parents.select("doc_id", F.col("seq").alias("parent")).distinct(), ["doc_id", "parent"], "left_semi")


def descendants(found: DataFrame, *tags: str) -> DataFrame:
    """The elements with one of `tags` at any depth."""
    return found.filter((F.col("kind") == "element") & F.col("tag").isin(*tags))
