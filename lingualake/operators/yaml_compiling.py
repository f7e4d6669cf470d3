"""Compiling YAML: styled scalars in a template, or whole files from keys and styles.

Scalars are one line unless a width is given. Then plain, single-quoted and `>` ones go on in a new line at the first
lone space beyond it, double-quoted ones at the first space, between backslashes; `|` keeps its lines.

Cases: of files that are no YAML nothing is changed. A translation without its placeholder in the template ends the
query, if asked to. Scalars that would read as something else in their style are written in double quotes, characters
that YAML can't hold as escapes. Words longer than the width are not cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..sources import yaml_files
from .compiling import apply_edits, complete, told

#: Plain scalars that are safe: no indicator first, no colon or hash that ends them, nothing that reads as another type.
_UNSAFE = r"(?s)^$|^[\s\-?:,\[\]{}#&*!|>'\"%@`]|\s$|:(\s|$)|\s#|[\n\t]|[,\[\]{}]"
_TYPED = r"(?i)^(~|null|true|false|yes|no|on|off|[-+]?[0-9][0-9_.,:]*(e[-+]?[0-9]+)?|[-+]?\.(inf|nan)|\d{4}-\d\d?-\d\d?.*|=|<<)$"


def indent_of(content: Column) -> Column:
    """How many spaces a file indents by: those of the first filled line below the first key that only blank or indented text follows, else 2; a tab is four."""
    lines = F.split(content, r"\r?\n")
    opens = F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda x, after: x.endswith(":") & ((after == "") | after.startswith(" ") | after.startswith("\t")))
    at = F.array_position(opens, True)
    below = F.get(F.filter(F.slice(lines, at.cast("int") + 1, F.size(lines)), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(""))) != ""), 0)
    wide = F.replace(below, F.lit("\t"), F.lit("    "))
    return F.when(at == 0, 2).otherwise(F.coalesce(F.length(wide) - F.length(F.ltrim(wide)), F.lit(0)))


#: Characters that stand in double quotes only: those that no file may hold, and line ends other than \n.
_SPECIAL = r"[^\n\t\x20-\x7E\xA0-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]|[\u2028\u2029\uFEFF]"


def _escaped(text: Column) -> Column:
    """`text` as it stands in double quotes; what is special and has no letter of its own is written as a number."""
    numbered = lambda x: F.concat(F.lit("\\u"), F.lpad(F.hex(F.encode(x, "UTF-16BE")), 4, "0"))
    parts = F.regexp_extract_all(T.escape_json(text), F.lit(rf"(?s){_SPECIAL}|(?:(?!{_SPECIAL}).)+"), F.lit(0))
    return F.when(T.escape_json(text).rlike(_SPECIAL), F.array_join(F.transform(parts, lambda x: F.when(x.rlike(_SPECIAL), numbered(x)).otherwise(x)), "")).otherwise(T.escape_json(text))


def _at_width(text: Column, space: str, first: Column, later: Column, instead: Column, line: str = "") -> Column:
    """`text` with `instead` for the first `space` beyond `first` characters of a line, then beyond `later` of what is left of it."""
    count = lambda n: F.greatest(n, F.lit(1)).cast("string")
    pattern = F.concat(F.lit(f"(?m)(^{line}.{{"), count(first), F.lit(r",}?|(?!^)\G.{"), count(later), F.lit(rf",}}?){space}"))
    return F.regexp_replace(text, pattern, F.concat(F.lit("$1"), instead))


def double_quoted(text: Column, indent: Column | None = None, width: int | None = None) -> Column:
    body = _escaped(text)
    if width is not None:
        pad = F.repeat(F.lit(" "), F.greatest(indent, F.lit(1)).cast("int"))
        body = _at_width(body, r"(?= .)", F.lit(width), width - indent, F.concat(F.lit("\\\\\n"), pad, F.lit("\\\\")))
    return F.concat(F.lit('"'), body, F.lit('"'))


def styled(text: Column, style: Column, indent: Column, width: int | None = None) -> Column:
    """A scalar in its style; its further lines are indented by `indent` spaces, folded at `width` if one is given. Texts that a style can't hold are double quoted."""
    pad = F.repeat(F.lit(" "), F.greatest(indent, F.lit(1)).cast("int"))
    lone = r"(?<=[^ \t\n]) (?=[^ \t\n])"
    wrapped = lambda x, first, line="": x if width is None else _at_width(x, lone, first, width - indent, F.lit("\n"), line)
    body = F.regexp_replace(text, "\n+$", "")
    ends = F.length(text) - F.length(body)
    chomp = F.when(ends == 0, "-").when(ends == 1, "").otherwise("+")
    lines = lambda x: F.regexp_replace(x, "(?m)^(?=.)", pad)
    extra = F.when(ends > 1, F.repeat(F.lit("\n"), ends - 1)).otherwise("")
    literal = F.concat(F.lit("|"), chomp, F.lit("\n"), lines(body), extra)
    # Lines that start with a space keep their ends, those between others are one line end longer.
    doubled = F.regexp_replace(body, r"(?m)^([^ \t\n].*)\n(?=\n*[^ \t\n])", "$1\n\n")
    folded = F.concat(F.lit(">"), chomp, F.lit("\n"), lines(wrapped(doubled, width - indent if width else None, r"(?![ \t])")), extra)
    sound = ~text.rlike(_SPECIAL)
    block = ~text.rlike(r"^[ \n]") & (body != "") & sound
    quoted = F.regexp_replace(F.replace(text, F.lit("'"), F.lit("''")), "(\n+)", "$1\n")
    single = F.concat(F.lit("'"), F.regexp_replace(wrapped(quoted, F.lit(width)), "(?<=\n)(?=[^\n]|$(?!\n))", pad), F.lit("'"))
    plain = ~text.rlike(_UNSAFE) & ~text.rlike(_TYPED) & sound
    one_line = F.regexp_replace(wrapped(text, F.lit(width)), "(?<=\n)", pad)
    kept = ~text.rlike(r"\t| \n|\n ") & sound
    return F.when((style == "'") & kept, single).when((style == "|") & block, literal).when((style == ">") & block, folded).when((style == "") & plain, one_line).otherwise(double_quoted(text, indent, width))


def template(files: DataFrame, units: DataFrame) -> DataFrame:
    """Files with placeholders in place of scalars, of plurals in place of all forms."""
    return apply_edits(files, units.select("doc_id", "start", "end", F.col("placeholder").alias("text")))


def compile_yaml(templates: DataFrame, translations: DataFrame, above: int = 0, strict: bool = True, width: int | None = None) -> DataFrame:
    """Files with the translations (doc_id, placeholder, key, flags, pluralized, strings) in place, each in the style that its flags end with.

    Forms of a plural take the style of their rule or that of `other`. `above` levels lie over the keys; a
    translation that the template lacks ends the query if `strict`. Scalars are folded at `width` if one is given.
    """
    templates = complete(templates, translations) if strict else templates
    rows = told(spans.marks(templates), translations, how="inner").join(templates.select("doc_id", indent_of(F.col("content")).alias("_step")), "doc_id")
    levels = F.size(F.split("key", r"\.")) + above
    rows = rows.withColumns({"_indent": (F.col("_step") * levels).cast("int"), "_styles": yaml_files.styles_of(F.col("flags"))})
    one = styled(F.element_at("strings", 5), F.element_at(F.split(F.coalesce("flags", F.lit("")), ":"), -1), F.col("_indent"), width)
    names = F.create_map(*(x for k, v in T.RULES.items() for x in (F.lit(v), F.lit(k))))
    style = lambda rule: F.coalesce(F.try_element_at("_styles", rule.cast("string")), F.try_element_at("_styles", F.lit("5")), F.lit(""))
    form = lambda e: F.concat(F.element_at(names, e["key"]), F.lit(": "), styled(e["value"], style(e["key"]), F.col("_indent") + F.col("_step"), width))
    flow = F.contains(F.coalesce("flags", F.lit("")), F.lit("flow"))
    many = F.array_join(F.transform(F.map_entries("strings"), form), "\x00")
    many = F.replace(many, F.lit("\x00"), F.when(flow, ", ").otherwise(F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.col("_indent")))))
    return apply_edits(templates, rows.select("doc_id", "start", "end", F.when(F.col("pluralized"), many).otherwise(one).alias("text")))


def _tree(entries: list[dict]):
    """Nested mappings and sequences of entries by their keys, with (text, style, tag) leaves."""
    root: dict = {}
    for e in entries:
        steps, node = e["key"].split("."), root
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node[steps[-1]] = (e["text"], e["flags"].split(":")[-1], e["context"])

    def built(node):
        if not isinstance(node, dict):
            return node
        if node and all(s.startswith("[") and s[1:-1].isdigit() for s in node):
            return [built(v) for _, v in sorted(node.items(), key=lambda x: int(x[0][1:-1]))]
        named = lambda s: int(s[1:-1]) if s.startswith("<") and s.endswith(">") and s[1:-1].lstrip("-").isdigit() else s.replace("<TX_DOT>", ".")
        return {named(k): built(v) for k, v in node.items()}

    return built(root)


def _dumper():
    import yaml

    class Dumper(yaml.SafeDumper):
        def increase_indent(self, flow=False, indentless=False):
            return super().increase_indent(flow, False)

        def ignore_aliases(self, data):
            return True

    def scalar(dumper, leaf):
        text, style, tag = leaf
        return dumper.represent_scalar(f"!{tag}" if tag else "tag:yaml.org,2002:str", text, style=style if style in tuple("'\"|>") else None)

    Dumper.add_representer(tuple, scalar)
    return Dumper


def _writer(width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        dumper = _dumper()
        for batch in batches:
            out = []
            for entries, language in zip(batch.column("entries").to_pylist(), batch.column("language").to_pylist(), strict=True):
                tree = _tree(entries)
                out.append(yaml.dump({language: tree} if language else tree, Dumper=dumper, width=width, allow_unicode=True, sort_keys=False, default_flow_style=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "content"])

    return run


def compile_without_template(units: DataFrame, language: str | None = None, width: int | None = None) -> DataFrame:
    """Files of units (doc_id, ord, key, context, flags, text): their keys make the tree, their last flag the scalar's style; `language` is put above. Scalars are folded at `width` if one is given."""
    entry = F.struct("ord", "key", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("flags", F.lit("")).alias("flags"), "text")
    grouped = units.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("entries")).withColumn("language", F.lit(language).cast("string"))
    return grouped.mapInArrow(_writer(float("inf") if width is None else width), f"doc_id {units.schema['doc_id'].dataType.simpleString()}, content string")
