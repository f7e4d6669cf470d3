"""Writing PO files from entry rows: templates, compiling and synchronising.

An entry's parts stand in the order comment, occurrences, flags, what it had before, context, msgid, plural, texts, one
blank line between entries; texts with line breaks are cut behind these, others and comments are wrapped at WIDTH columns.

Cases: files with a syntax error have no entries and come out empty. Obsolete entries keep their place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import po
from .json_compiling import matched


#: Columns of a line; longer texts, comments and occurrences are wrapped.
WIDTH = 78
_ESCAPES = str.maketrans({"\\": "\\\\", '"': '\\"', "\t": "\\t", "\r": "\\r", "\n": "\\n"})
_FILL = "\0"


def _wrapped(text: str, width: int, **rest) -> list[str]:
    """`text` in lines of at most `width` columns, cut between words; wide characters take two."""
    import textwrap

    filled = "".join(c + _FILL if unicodedata.east_asian_width(c) in "WF" else c for c in text)
    return [x.replace(_FILL, "") for x in textwrap.wrap(filled, width, break_long_words=False, **rest)]


def _columns(text: str) -> int:
    return sum(1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


def _field(mark: str, word: str, text: str, width: int) -> list[str]:
    """The lines of `word "text"`: texts with line breaks are cut behind these, long ones between words."""
    lines = text.split("\n")
    lines = [f"{x}\n".translate(_ESCAPES) for x in lines[:-1]] + [x.translate(_ESCAPES) for x in lines[-1:] if x]
    if len(lines) == 1 and width and _columns(text) > width - len(word) - 3:
        lines = ["", *_wrapped(lines[0], width - 2, drop_whitespace=False)]
    elif len(lines) > 1:
        lines = ["", *lines]
    first, *rest = lines or [""]
    return [f'{mark}{word} "{first}"', *(f'{mark}"{x}"' for x in rest)]


def _comment(mark: str, text: str, width: int) -> list[str]:
    out: list[str] = []
    for line in text.split("\n") if text else ():
        long = width and _columns(line) + len(mark) > width
        out += _wrapped(line, width, initial_indent=mark, subsequent_indent=mark) if long else [f"{mark}{line}".rstrip()]
    return out


def entry_lines(e: dict, width: int = WIDTH) -> list[str]:
    """The lines of one entry; a width of 0 wraps nothing."""
    out = _comment("# ", e["tcomment"], width) + _comment("#. ", e["comment"], width)
    if e["occurrences"]:
        places = " ".join(e["occurrences"])
        out += _wrapped(places, width, initial_indent="#: ", subsequent_indent="#: ", break_on_hyphens=False) if width and len(places) + 3 > width else [f"#: {places}"]
    if e["flags"]:
        out.append("#, " + ", ".join(e["flags"]))
    mark = "#~ " if e["obsolete"] else ""
    before = dict(e["previous"] or ())
    for word in ("msgctxt", "msgid", "msgid_plural"):
        out += _field("#~| " if mark else "#| ", word, before[word], width) if word in before else []
    for word in ("msgctxt", "msgid", "msgid_plural"):
        out += _field(mark, word, e[word], width) if e[word] is not None else []
    for index, text in sorted(e["msgstrs"] or ()):
        out += _field(mark, f"msgstr[{index}]", text or "", width)
    return out if e["msgstrs"] else out + _field(mark, "msgstr", e["msgstr"] or "", width)


def _write(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["".join(f"{x}\n" for x in entry_lines(e, width)) if e["kind"] != "error" else "" for e in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq"), pa.array(texts, pa.string())], ["doc_id", "seq", "text"])

    return run


def written(entries: DataFrame, files: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Files (doc_id, content) of entry rows in order of seq; those of `files` without entries come out empty."""
    lines = entries.mapInArrow(_write(width), f"doc_id {entries.schema['doc_id'].dataType.simpleString()}, seq int, text string")
    listed = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("xs"))
    done = listed.select("doc_id", F.array_join(F.transform("xs", lambda x: x["text"]), "\n").alias("content"))
    return done if files is None else files.select("doc_id").join(done, "doc_id", "left").select("doc_id", F.coalesce("content", F.lit("")).alias("content"))


def _with_texts(entries: DataFrame, msgstr: Column, msgstrs: Column) -> DataFrame:
    return entries.withColumns({"msgstr": msgstr, "msgstrs": msgstrs})


def template(files: DataFrame, is_source: bool = True) -> DataFrame:
    """Files with placeholders as texts, of plurals as the only form; fuzzy entries go, of files that are no sources empty ones too."""
    found = po.entries(files)
    marked = po.typed_entries(found).filter("not fuzzy")
    marked = marked if is_source else marked.filter("string_type <> 'EMPTY'")
    rows = found.join(marked.select("doc_id", "seq", "placeholder", "pluralized"), ["doc_id", "seq"], "left").filter("placeholder is not null or kind <> 'entry' or obsolete")
    single, plural = F.col("placeholder").isNotNull() & ~F.col("pluralized"), F.coalesce(F.col("pluralized"), F.lit(False))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    return written(_with_texts(rows, F.when(single, F.col("placeholder")).when(plural, F.lit(None)).otherwise(F.col("msgstr")), F.when(plural, F.create_map(F.lit(0), F.col("placeholder"))).when(single, none).otherwise(F.col("msgstrs"))), files)


def _slots(entries: DataFrame) -> DataFrame:
    """Entries with the placeholder that their text is, null for others."""
    own = F.when(F.col("msgid_plural").isNotNull(), F.try_element_at("msgstrs", F.lit(0))).otherwise(F.col("msgstr"))
    return entries.withColumn("placeholder", F.when((F.col("kind") == "entry") & ~F.col("obsolete"), own))


def compile_po(templates: DataFrame, translations: DataFrame) -> DataFrame:
    """Files with the translations (doc_id, placeholder, ord, strings) in place; entries without one keep the placeholder."""
    nth = Window.partitionBy("doc_id", "placeholder")
    texts = translations.select("doc_id", "placeholder", F.row_number().over(nth.orderBy("ord")).alias("_nth"), "strings")
    rows = _slots(po.entries(templates)).withColumn("_nth", F.row_number().over(nth.orderBy("seq"))).join(texts, ["doc_id", "placeholder", "_nth"], "left")
    told, plural = F.col("strings").isNotNull(), F.col("msgid_plural").isNotNull()
    return written(_with_texts(rows, F.when(told & ~plural, F.try_element_at("strings", F.lit(5))).otherwise(F.col("msgstr")), F.when(told & plural, F.col("strings")).otherwise(F.col("msgstrs"))), templates)


def split_key(key: Column) -> Column:
    """The struct (msgid, msgid_plural) of a unit's key, cut at the first colon without a backslash before; no plural is null."""
    pattern = r"(?s)^(.*?)(?<!\\):(.*)$"
    two = key.rlike(pattern)
    return F.struct(T.unescape_po_key(F.when(two, F.regexp_extract(key, pattern, 1)).otherwise(key)).alias("msgid"), F.when(two, T.unescape_po_key(F.regexp_extract(key, pattern, 2))).alias("msgid_plural"))


def sync_template(templates: DataFrame, strings: DataFrame, ordered: bool = True) -> DataFrame:
    """Templates without the entries that don't stay, and with an entry at the end for each string to add.

    `strings` are (doc_id, ord, key, context, pluralized, placeholder, flags, occurrences, developer_comment).
    """
    found = _slots(po.entries(templates))
    slots = found.filter("placeholder is not null").select("doc_id", "seq", "placeholder")
    kept, added = matched(slots, strings, ordered)
    stays = found.join(kept.select("doc_id", "seq", F.lit(True).alias("_kept")), ["doc_id", "seq"], "left").filter("_kept or placeholder is null")
    added = added.join(templates.select("doc_id"), "doc_id", "left_semi")
    split = split_key(F.col("key"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    listed = lambda c, by: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")
    new = added.withColumn("_s", split).select(
        "doc_id", (F.lit(1 << 30) + F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).cast("int").alias("seq"), F.lit("entry").alias("kind"), F.when(F.col("context") != "", F.col("context")).alias("msgctxt"), F.col("_s.msgid").alias("msgid"),
        F.when(F.col("pluralized"), F.coalesce("_s.msgid_plural", F.lit(""))).alias("msgid_plural"), F.when(~F.col("pluralized"), F.col("placeholder")).alias("msgstr"), F.when(F.col("pluralized"), F.create_map(F.lit(0), F.col("placeholder"))).otherwise(none).alias("msgstrs"),
        listed("flags", ",").alias("flags"), F.filter(listed("occurrences", ", "), lambda x: x.contains(":")).alias("occurrences"), F.coalesce("developer_comment", F.lit("")).alias("comment"), F.lit("").alias("tcomment"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("previous"), F.lit(False).alias("obsolete"), F.lit(0).alias("line"),
    )
    return written(stays.drop("_kept", "placeholder").unionByName(new), templates)
