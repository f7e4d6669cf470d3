"""YAML files: a walk over composed nodes yields leaf rows; units, plurals and language roots are plans over these.

Leaf rows are (doc_id, seq, kind, path, parent, name, tag, style, value, comment, key_start, start, end, line): the
string leaves by place, `style` the styles from the first level to the leaf joined by colons, `comment` the comment
lines right above, `start` and `end` around the scalar without anchor and tag. `kind` is `text`, `other` for leaves
that are no text, and `error` for a file that is no YAML or repeats a key, its message as value.

Cases: a null content is an empty file without leaves. Aliases and binary leaves are none. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .batches import walked

LEAVES = "seq int, kind string, path string, parent string, name string, tag string, style string, value string, comment string, key_start int, start int, end int, line int"
_TYPES = (pa.int32(), *[pa.string()] * 8, *[pa.int32()] * 4)
_PROPERTIES = re.compile(r"(?:[&!]\S*\s+)*")
_ALIAS = "alias"


def _style(node) -> str:
    return ("flow" if node.flow_style else "block") if hasattr(node, "flow_style") else node.style or ""


def _above(text: str) -> str:
    """The comment lines at the end of a text, not counting the line at hand."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if lines and not lines[-1].startswith("#"):
        lines.pop()
    first = len(lines)
    while first and lines[first - 1].startswith("#"):
        first -= 1
    return " ".join(x[1:].strip() for x in lines[first:])


#: What the C parser reads otherwise: tabs, byte order marks, and explicit keys.
_SLOW = re.compile("[\t\ufeff]|(?:^|[^\\w])\\?(?:\\s|$)")


@cache
def _loader(fast: bool):
    """The loader that composes aliases as nodes of their own; `fast` parses in C."""
    import yaml
    from yaml import composer, constructor, resolver

    bases = (composer.Composer, yaml.cyaml.CParser, constructor.SafeConstructor, resolver.Resolver) if fast else (yaml.SafeLoader,)

    class Parsing(*bases):
        def __init__(self, stream):
            if not fast:
                return super().__init__(stream)
            yaml.cyaml.CParser.__init__(self, stream)
            for part in (composer.Composer, constructor.SafeConstructor, resolver.Resolver):
                part.__init__(self)

        def compose_node(self, parent, index):
            if self.check_event(yaml.AliasEvent):
                event = self.get_event()
                return yaml.ScalarNode(_ALIAS, "", event.start_mark, event.end_mark)
            return super().compose_node(parent, index)

    return Parsing


def _leaves_of(text: str, fast: bool = False) -> list[tuple]:
    """The leaves of a document by start, or its error."""
    import yaml

    out: list[tuple] = []

    def walk(node, path: str, parent: str, name: str, style: str, key) -> None:
        if isinstance(node, yaml.ScalarNode):
            if node.tag == _ALIAS or node.tag.endswith(":binary"):
                return
            kind = "text" if node.tag.endswith(":str") or not node.tag.startswith("tag:") else "other"
            tag = "" if node.tag.startswith("tag:") else node.tag.lstrip("!")
            start, end = node.start_mark.index, node.end_mark.index
            start += _PROPERTIES.match(text, start, end).end() - start
            end = start + len(text[start:end].rstrip())
            out.append((kind, path, parent, name, tag, style, node.value, key.start_mark.index if key else start, start, end, node.start_mark.line + 1))
            return
        seen = set()
        for k, item in enumerate(node.value):
            if isinstance(node, yaml.MappingNode):
                at, value = item
                if not isinstance(at, yaml.ScalarNode):
                    continue
                if at.value in seen:
                    raise ValueError(f"duplicate key {at.value} on line {at.start_mark.line + 1}")
                seen.add(at.value)
                own = at.value
                quoted = own.replace(".", "<TX_DOT>")
                step = f"<{quoted}>" if at.tag.endswith(":int") else quoted
            else:
                at, value, own, step = None, item, f"[{k}]", f"[{k}]"
            walk(value, f"{path}.{step}" if path else step, path, own, f"{style}:{_style(value)}" if style is not None else _style(value), at)

    try:
        root = yaml.compose(text, Loader=_loader(fast))
        if root is not None:
            walk(root, "", "", "", None, None)
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        mark = getattr(e, "problem_mark", None)
        message = str(e) if mark is None else e.problem or "no YAML"
        line = mark.line + 1 if mark else int((re.search(r"line (\d+)", message) or re.search("(1)", "1")).group(1))
        return [(0, "error", None, None, None, None, None, message, "", 0, 0, 0, line)]
    rows, last = [], 0
    for k, x in enumerate(sorted(out, key=lambda x: x[8])):
        rows.append((k, *x[:7], _above(text[last : x[8]]), *x[7:]))
        last = x[9]
    return rows


def rows_of(text: str | None) -> list[tuple]:
    """The leaf rows of one file, or its error row; what the C parser finds no leaves or empty ones in is parsed again."""
    import yaml

    text = text or ""
    if yaml.__with_libyaml__ and not _SLOW.search(text):
        rows = _leaves_of(text, True)
        if all(r[1] == "text" or (r[1] == "other" and r[10] < r[11]) for r in rows):
            return rows
    return _leaves_of(text)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return walked(batches, rows_of, [x.split()[0] for x in LEAVES.split(", ")], _TYPES)


def leaves(files: DataFrame) -> DataFrame:
    return files.select("doc_id", "content").mapInArrow(_walk, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {LEAVES}")


def problems(files: DataFrame, one_root: bool = False) -> DataFrame:
    """Rows (doc_id, rule, message, line) of files that are no YAML or repeat a key; with `one_root` of those with several roots too."""
    found = leaves(files)
    rule = F.when(F.col("value").startswith("duplicate key"), "duplicate key").otherwise("no YAML")
    bad = found.filter("kind = 'error'").select("doc_id", rule.alias("rule"), F.col("value").alias("message"), "line")
    if not one_root:
        return bad
    roots = found.filter("kind <> 'error'").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.substring_index("path", ".", 1))).alias("roots")).filter("size(roots) > 1")
    return bad.unionByName(roots.select("doc_id", F.lit("several roots").alias("rule"), F.array_join("roots", ", ").alias("message"), F.lit(1).alias("line")))


def units(files: DataFrame) -> DataFrame:
    """Every filled string leaf, by its path; a custom tag is its context, its styles are flags."""
    rows = leaves(files).filter("kind = 'text' and value <> ''")
    hashed = T.string_hash(F.col("path"), F.col("tag"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return rows.select("doc_id", F.col("path").alias("key"), F.col("tag").alias("context"), F.col("value").alias("text"), order.alias("ord"), F.col("style").alias("flags"), F.col("comment").alias("developer_comment"), hashed.alias("string_hash"), T.placeholder(hashed).alias("placeholder"), "start", "end")


def plural_styles(entries: Column) -> Column:
    """(rule, style) structs as JSON with its colons written out, as a plural's last flag."""
    pairs = F.transform(entries, lambda e: F.concat(F.lit('"'), e["rule"].cast("string"), F.lit('": "'), F.replace(e["style"], F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.replace(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), F.lit(":"), F.lit("<COLON>"))


def styles_of(flags: Column) -> Column:
    """The map from rule number, as text, to style of a plural's flags, null if they hold none."""
    return F.from_json(F.replace(F.element_at(F.split(flags, ":"), -1), F.lit("<COLON>"), F.lit(":")), "map<string,string>")


def i18n_units(files: DataFrame, rules: tuple[str, ...] = ("one", "other")) -> DataFrame:
    """Units below the language root; a mapping that has all `rules` and only rule names is one plural, none if a form is blank."""
    rows = leaves(files).filter("kind = 'text'").withColumns({"path": F.regexp_replace("path", r"^[^.]*\.", ""), "language": F.substring_index("path", ".", 1)})
    rows = rows.withColumn("parent", F.when(F.col("parent").contains("."), F.regexp_replace("parent", r"^[^.]*\.", "")))
    nodes = rows.filter("parent is not null").groupBy("doc_id", "parent").agg(F.collect_set("name").alias("names"), F.min("seq").alias("first"))
    plural = F.size(F.array_except(F.array(*map(F.lit, rules)), "names")) == 0
    plural = plural & F.forall("names", lambda n: F.coalesce(T.rule_number(n).isNotNull(), F.lit(False)))
    nodes = nodes.filter(plural).select("doc_id", "parent", "first")
    both = rows.join(nodes, ["doc_id", "parent"], "left")
    entry = F.struct("seq", T.rule_number(F.col("name")).alias("rule"), F.col("value").alias("text"), F.element_at(F.split("style", ":"), -1).alias("style"))
    forms = both.filter(F.col("first").isNotNull() & F.col("name").isin(*rules)).groupBy("doc_id", "language", F.col("parent").alias("key"), F.col("first").alias("seq"))
    forms = forms.agg(F.sort_array(F.collect_list(entry)).alias("_forms"), F.min("key_start").alias("start"), F.max("end").alias("end"), F.first(F.regexp_replace("style", r":[^:]*$", "")).alias("_above"), F.min_by("comment", "seq").alias("developer_comment"))
    forms = forms.withColumns({"strings": T.plural_map(F.col("_forms")), "flags": F.concat("_above", F.lit(":"), plural_styles(F.col("_forms")))}).filter(F.forall(F.map_values("strings"), lambda x: x != "")).drop("_forms", "_above")
    single = both.filter("first is null and value <> ''").select("doc_id", "language", F.col("path").alias("key"), "seq", F.create_map(F.lit(5), F.col("value")).alias("strings"), F.col("style").alias("flags"), "start", "end", F.col("comment").alias("developer_comment"))
    every = single.withColumn("pluralized", F.lit(False)).unionByName(forms.withColumn("pluralized", F.lit(True)))
    hashed = T.string_hash(F.col("key"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return every.select("doc_id", "language", "key", "pluralized", "strings", order.alias("ord"), "flags", "developer_comment", hashed.alias("string_hash"), T.placeholder(hashed, F.col("pluralized")).alias("placeholder"), "start", "end")
