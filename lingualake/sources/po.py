"""Gettext PO and POT files: a walk over lines yields entries; units, file kinds and rules are plans over these.

Entry rows are (doc_id, seq, kind, msgctxt, msgid, msgid_plural, msgstr, msgstrs, flags, occurrences, comment,
tcomment, previous, obsolete, line), texts unescaped; `kind` is `header` for the first entry if its msgid is empty and it has
no context, else `entry`. A file with a line that is none of PO gives one row of kind `error` with the message as msgid.

`previous` has the msgctxt, msgid and msgid_plural that an entry had before.

Cases: a null content is an empty file, which has no entries. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ENTRIES = "seq int, kind string, msgctxt string, msgid string, msgid_plural string, msgstr string, msgstrs map<int,string>, flags array<string>, occurrences array<string>, comment string, tcomment string, previous map<string,string>, obsolete boolean, line int"
_TYPES = (pa.int32(), *[pa.string()] * 5, pa.map_(pa.int32(), pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.int32())
_WORD = re.compile(r'(msgctxt|msgid_plural|msgid|msgstr)(?:\[(\d+)\])?\s*"(.*)"$')
_ESCAPE = re.compile(r"\\(.)", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class Malformed(Exception):
    """What is wrong with a line."""


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPED.get(m.group(1), m.group(1)), text)


def _entries_of(text: str) -> Iterator[dict]:
    """The entries of one file; raises Malformed."""
    own: dict = {}
    key = None
    for number, raw in enumerate([*text.replace("\r\n", "\n").split("\n"), ""], 1):
        line = raw.strip()
        obsolete = line.startswith("#~")
        if obsolete:
            line = f"#{line[2:]}" if line.startswith("#~|") else line[2:].strip()
        word = _WORD.match(line)
        starts = not line or line.startswith("#") or (word and (word.group(1) == "msgctxt" or (word.group(1) == "msgid" and "msgid" in own)))
        if starts and ("msgstr" in own or "msgstrs" in own):
            yield own
            own, key = {}, None
        if not line:
            if "msgid" in own:
                raise Malformed(f"line {number}: a msgid without a msgstr")
            continue
        own.setdefault("line", number)
        own["obsolete"] = own.get("obsolete", False) or obsolete
        if line.startswith("#"):
            kind, rest = line[1:2], line[2:].strip()
            if kind == ",":
                own["flags"] = own.get("flags", []) + [x.strip() for x in rest.split(",") if x.strip()]
            elif kind == ":":
                own["occurrences"] = own.get("occurrences", []) + rest.split()
            elif kind == ".":
                own["comment"] = own.get("comment", []) + [rest]
            elif kind == "|":
                earlier = _WORD.match(rest)
                if earlier and earlier.group(1) != "msgstr":
                    own.setdefault("previous", {})[earlier.group(1)] = _unescaped(earlier.group(3))
                    key = ("previous", earlier.group(1))
                elif isinstance(key, tuple) and len(rest) > 1 and rest[0] == rest[-1] == '"':
                    own["previous"][key[1]] += _unescaped(rest[1:-1])
            else:
                own["tcomment"] = own.get("tcomment", []) + [line[1:].strip()]
        elif word:
            name, index, value = word.groups()
            if index is not None:
                own.setdefault("msgstrs", {})[int(index)] = _unescaped(value)
                key = int(index)
            else:
                own[name] = _unescaped(value)
                key = name
        elif isinstance(key, (str, int)) and len(line) > 1 and line[0] == line[-1] == '"':
            held = own["msgstrs"] if isinstance(key, int) else own
            held[key] += _unescaped(line[1:-1])
        else:
            raise Malformed(f"line {number}: neither a keyword nor a quoted text")


def rows_of(text: str | None) -> list[tuple]:
    """The entry rows of one file, or its error row."""
    own = []
    try:
        for seq, e in enumerate(_entries_of(text or "")):
            kind = "header" if not seq and not e.get("msgid") and "msgctxt" not in e else "entry"
            lists = (e.get(k, []) for k in ("flags", "occurrences"))
            own.append((seq, kind, e.get("msgctxt"), e.get("msgid", ""), e.get("msgid_plural"), e.get("msgstr"), list(e.get("msgstrs", {}).items()), *lists, "\n".join(e.get("comment", [])), "\n".join(e.get("tcomment", [])), list(e.get("previous", {}).items()), e["obsolete"], e["line"]))
    except Malformed as e:
        own = [(0, "error", None, str(e), None, None, [], [], [], "", "", [], False, int(re.search(r"\d+", str(e)).group()))]
    return own


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", ENTRIES)]
    for batch in batches:
        owners, rows = [], []
        for k, text in enumerate(batch.column("content").to_pylist()):
            own = rows_of(text)
            owners += [k] * len(own)
            rows += own
        columns = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owners, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["doc_id", *names])


def entries(files: DataFrame) -> DataFrame:
    """The entry rows of `files` (doc_id, content), headers and obsolete entries included."""
    return files.select("doc_id", "content").mapInArrow(_walk, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {ENTRIES}")


def _texts() -> Column:
    """An entry's texts by plural index, or under 5."""
    return F.when(F.col("msgid_plural").isNotNull(), F.col("msgstrs")).otherwise(F.create_map(F.lit(5), F.coalesce("msgstr", F.lit(""))))


def _kind() -> Column:
    """EMPTY, SPACES or NOT_EMPTY, by an entry's texts."""
    some, every = F.exists(F.map_values("texts"), lambda x: T.strip(x) != ""), F.forall(F.map_values("texts"), lambda x: x == "")
    return F.when(some, "NOT_EMPTY").when(every, "EMPTY").otherwise("SPACES")


def typed_entries(found: DataFrame) -> DataFrame:
    """Entries that are not obsolete with key, context, texts, string_type, fuzzy, and file_type: PO if any text is filled, else POT."""
    key = F.concat(T.escape_po_key(F.col("msgid")), F.coalesce(F.concat(F.lit(":"), T.escape_po_key(F.col("msgid_plural"))), F.lit("")))
    rows = found.filter("kind = 'entry' and not obsolete").withColumns({"key": key, "context": F.coalesce("msgctxt", F.lit("")), "pluralized": F.col("msgid_plural").isNotNull(), "texts": _texts(), "fuzzy": F.array_contains("flags", "fuzzy")})
    rows = rows.withColumn("string_type", _kind())
    filled = F.bool_or(F.col("string_type") == "NOT_EMPTY").over(Window.partitionBy("doc_id"))
    hashed = T.string_hash(F.col("key"), F.col("context"))
    return rows.withColumns({"file_type": F.when(filled, "PO").otherwise("POT"), "string_hash": hashed, "placeholder": T.placeholder(hashed, F.col("pluralized"))})


def units(files: DataFrame, is_source: bool = True) -> DataFrame:
    """String units: of source files the msgids of those without any translation, else the msgstrs; fuzzy ones have no order.

    Of other files entries without a text are none.
    """
    rows = typed_entries(entries(files))
    ids = F.when(F.col("pluralized"), F.create_map(F.lit(0), F.col("msgid"), F.lit(1), F.col("msgid_plural"))).otherwise(F.create_map(F.lit(5), F.col("msgid")))
    if is_source:
        rows = rows.withColumn("strings", F.when(F.col("file_type") == "PO", F.col("texts")).otherwise(ids))
    else:
        rows = rows.filter("string_type <> 'EMPTY'").withColumn("strings", F.col("texts"))
    order = F.sum(F.when(F.col("fuzzy"), 0).otherwise(1)).over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return rows.select("doc_id", "seq", "key", "context", "pluralized", "strings", F.when(~F.col("fuzzy"), order).alias("ord"), F.array_join("flags", ", ").alias("flags"), "fuzzy", F.when(F.size("occurrences") > 0, F.array_join("occurrences", ", ")).alias("occurrences"), F.concat("comment", F.lit("\n"), "tcomment").alias("developer_comment"), "file_type", "string_hash", "placeholder")


def problems(files: DataFrame, is_source: bool = True) -> DataFrame:
    """Rows (doc_id, seq, rule, key) of what breaks the rules of PO files.

    Of source files that mix filled and empty entries the first one that differs from those before is named.
    """
    found = entries(files)
    rows = typed_entries(found)
    n = F.row_number().over(Window.partitionBy("doc_id", "key", "context").orderBy("seq"))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda kind: F.coalesce(F.bool_or(F.col("string_type") == kind).over(before), F.lit(False))
    rows = rows.withColumns({"_n": n, "_filled": seen("NOT_EMPTY"), "_empty": seen("EMPTY")})
    mixed = ((F.col("string_type") == "EMPTY") & F.col("_filled")) | ((F.col("string_type") == "NOT_EMPTY") & F.col("_empty"))
    first = F.min(F.when(mixed, F.col("seq"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("_first", first)
    rules = {
        "empty msgid": F.col("msgid") == "",
        "msgstr of a plural": F.col("pluralized") & (T.strip(F.coalesce("msgstr", F.lit(""))) != ""),
        "msgstr[*] without a plural": ~F.col("pluralized") & F.exists(F.map_values("msgstrs"), lambda x: x != ""),
        "incomplete plurals": F.col("pluralized") & (F.col("string_type") == "NOT_EMPTY") & F.exists(F.map_values("texts"), lambda x: x == ""),
        "duplicate msgid": F.col("_n") > 1,
    }
    if is_source:
        rules |= {"empty msgstr": (F.col("seq") == F.col("_first")) & (F.col("string_type") == "EMPTY"), "filled msgstr": (F.col("seq") == F.col("_first")) & (F.col("string_type") == "NOT_EMPTY")}
    listed = F.array_compact(F.array(*(F.when(test, F.lit(rule)) for rule, test in rules.items())))
    broken = rows.select("doc_id", "seq", F.explode(listed).alias("rule"), F.col("msgid").alias("key"))
    return broken.unionByName(found.filter("kind = 'error'").select("doc_id", "seq", F.lit("syntax").alias("rule"), F.col("msgid").alias("key")))
